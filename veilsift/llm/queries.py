"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import byte_bpe, common, exact, filter_audit, lexical, line_templates, merkle, minhash, mixing, packing, quality, token_files, toxicity, wordpiece


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tables.spread(tables.table(spark, sf_dir, table))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", out["__log_weight"].alias("log_weight"), out["__gumbel_key"].alias("gumbel_key"), out["__kept"].alias("kept"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", out["__dropped"].alias("n_dropped"), "text")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "token-files")
    manifest = token_files.write_token_files(_read(spark, sf_dir, "documents"), folder, common.default_tokenizer())
    return token_files.read_token_files(manifest)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(tables.table(spark, sf_dir, "documents")).drop("bucket", "chain")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", out["__topic"].alias("topic"), out["__tokens"].alias("tokens"), out["__probability"].alias("probability"), out["__kept"].alias("kept"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.decode(byte_bpe.encode(_read(spark, sf_dir, "documents")))
    digits = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_read(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_files": op6_token_files,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL = {"op7_exact_dedup": exact.EXACT_SQL, "op12_lexical_search": lexical.SEARCH_SQL, "op13_filter_audit": filter_audit.AUDIT_SQL}
