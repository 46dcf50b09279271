"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries when it is present.
"""
