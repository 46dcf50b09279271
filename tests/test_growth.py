"""What keeps work in proportion to the input: conditions by literals, marks counted once."""

from pyspark.sql import functions as F

from veilsift.functions import patterns, prefilter


def test_literals_of_expressions():
    assert prefilter.literals(r"\bm[åa]nedsl[øo]n\b") == ("manedslon", "manedsløn", "månedslon", "månedsløn")
    assert prefilter.literals(r"\bprobation(ary)?\s*period\b") == ("probation", "probationary")
    assert prefilter.literals(r"(?<!\p{L})api_key(?!\p{L})") == ("api key",)
    assert prefilter.literals(r"\b\d{9}\b") is None and prefilter.literals(r"\b[a-z]+ing\b") == ("ing",)


def test_conditions_hold_wherever_expressions_match(spark):
    known = [(p, "i") for p in (r"\bsalary\s*slip\b", r"\bkill\b", r"\bmånedsl[øo]n\b", r"\bmatch_point\b", r"(?<!\p{L})ÅNGSTRÖM", r"\b(?:ceo|cfo)\s+x?-ray\b")]
    prefilter.register(p for p, _ in known)
    texts = ["ſalary  ſlip", "KıLL", "kİll", "MÅNEDSLØN", "månedsløn", "Match_Point", "match point", "Ångström", "the CFO x-Ray", "nothing", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumns(prefilter.facts(F.col("t")))
    for p, f in known:
        both = df.select(prefilter.holds(F.col("t"), p, f), patterns.found(F.col("t"), p, f)).collect()
        assert [r[0] for r in both] == [r[1] for r in both], p


def test_queries_run_expressions_only_where_a_literal_is(spark, sf_dir):
    from veilsift.plans import archetype_queries, class_queries, text_queries

    for query in (archetype_queries.archetype_documents, archetype_queries.archetype_contract, class_queries.class_markers, class_queries.class_documents, text_queries.clinical_ontology, text_queries.clinical_scan):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan()
        assert "held(" in plan.toString(), query.__name__


def test_words_of_unreadable_documents_are_tested_once(spark):
    from veilsift.operators import degraded

    names = ["Payſlip.pdf", "TYÖSOPIMUS_1.pdf", "assurance-vie.doc", "nothing.txt", "police İ.pdf", None]
    df = spark.createDataFrame([(n, "degraded") for n in names], "n string, q string")
    out = df.select(degraded.classify(F.col("n"), F.lit("busta paga"), F.col("q")).alias("c"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # before, the form of a name was spelled again for each word of each place that read it
    assert plan.count("[a-z]{2,4}") <= 4
    assert [tuple(r.c.tokens) for r in out.collect()] == [("payslip", "busta paga"), *[("busta paga",)] * 5]
    alone = df.select(degraded.classify(F.col("n"), F.lit(None).cast("string"), F.col("q")).alias("c")).collect()
    assert [(r.c.document_class, r.c.source) for r in alone] == [("doc.payroll", "filename"), ("doc.hr_record", "filename"), ("doc.insurance_policy", "filename"), (None, None), ("doc.insurance_policy", "filename"), (None, None)]


def test_texts_are_split_once_for_both_languages(spark):
    from veilsift.operators import scan

    english = "the (and) for, that. with this from are \"was\" not but have " * 4
    df = spark.createDataFrame([(english,), ("løn og er den det til med som har kan vil ikke " * 8,), ("x y z " * 60,), ("short",), (None,)], "t string").select(scan.locale_confidence(F.col("t")).alias("c"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r.c for r in df.collect()] == [1, 1, 0, 0, 0]


def test_a_number_is_cleaned_once_for_all_its_digits(spark):
    from veilsift.operators import scan

    df = spark.createDataFrame([(1, "RUT 12.345.678-5 end"), (2, "RUT 12.345.678-4 end"), (3, None)], "doc_id long, t string")
    out = scan.scan(df, [r for r in scan.RULES if r.id == "global-cl-rut"], text_col="t")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # before, it was cleaned 16 times
    assert plan.count("regexp_replace(upper(") == 1
    assert [(r.doc_id, r.matched) for r in out.collect()] == [(1, "12.345.678-5")]


def test_stages_before_python_are_spelled_once(spark):
    from veilsift.functions import normalize

    df = spark.createDataFrame([("a‐b né c a r t o n 1 2 3 4 5 6",), ("  x\r\n\r\n y ",), (None,)], "text string")
    out = normalize.normalized(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("u2066") == 1
    assert [r.text_norm for r in out.collect()] == ["a-b né carton 1 2 3 4 5 6", "x\ny", None]


def test_texts_without_file_syntax_are_not_split_for_it(spark):
    from veilsift.operators import quality

    texts = ["plain words " * 10, "endobj xref " * 20, "endobj" + " word" * 20, "an xrefs " * 20, "short", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(quality.extraction_quality(F.col("t")).alias("q"))
    # before, every text was searched and split
    assert "Contains(t#" in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.q for r in df.collect()] == ["clean", "degraded", "clean", "clean", "empty", "clean"]


def test_names_texts_and_fallbacks_are_found_in_one_pass(spark):
    from veilsift.operators import decisions

    rows = [(1, "password:x and nothing else in this text", "salary.pdf"), (2, "ssn 123-45-6789", "notes.txt"), (3, "nothing", "w2-2023.pdf"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string").withColumn("doc_length", F.length("text"))
    ready = decisions.document_context(docs, keep_facts=True)
    out = decisions.text_signals(ready, "name", guarded=True)
    # before, names, rules and fallbacks each read the texts anew, with normalization and locale
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    got = {(r.doc_id, r.source, r.description, r.seq < decisions.NAMED, r.seq >= decisions.FALLBACK_SEQ) for r in out.collect()}
    assert (1, "filename", "Financial document", True, False) in got and (3, "filename", "Tax document", True, False) in got
    assert {(d, by_name, weak) for d, _, _, by_name, weak in got if d in (2, 4)} == {(2, False, False)}


def test_policies_are_read_once(spark):
    from veilsift.operators import policies

    text = '{"signals": {"a": {"enabled": false, "baseSeverity": "low"}, "b": {"enabled": true, "baseSeverity": "critical"}}, "cooccurrenceRules": [{"requires": [7]}], "invariants": {"mandatorySignals": ["a", "b", null], "alwaysCritical": ["a", "b"]}}'
    made = spark.createDataFrame([(1, text), (None, text), (2, "[]"), (3, None)], "policy_id long, policy string")
    known = spark.createDataFrame([("b",), (None,)], "signal_id string")
    out = policies.violations(made, known_signals=known)
    # before, each part of a policy parsed the text anew
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    got = [(r.policy_id, r.path, r.rule) for r in out.collect()]
    for of in (1, None):  # a policy's own invariants hold for it, with an id or without
        assert {(of, "signals.a", "not disabled"), (of, "signals.a", "critical"), (of, "signals.a", "known"), (of, "cooccurrenceRules[0].requires[0]", "object")} <= set(got)
    assert [g for g in got if g[0] in (2, 3)] == [(2, "", "object"), (3, "", "object")] and not [g for g in got if g[1] == "signals.b"]


def test_batches_of_pieces_are_written_by_many_tasks(spark, sf_dir, tmp_path, monkeypatch):
    from veilsift.plans import stream_queries

    monkeypatch.setattr(stream_queries, "stream_root", lambda spark: f"file://{tmp_path}")
    stream_queries.stream_chunks(spark, sf_dir)
    # before, one task read all documents for a batch and wrote its one file
    assert len(list(tmp_path.glob("veilsift-stream/*/in/*.parquet"))) > stream_queries.BATCHES


def test_shadows_are_made_once_and_row_by_row(spark, sf_dir):
    from veilsift.functions import normalize
    from veilsift.plans import scan_queries

    out = scan_queries.norm_shadow(spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # before, Arrow held up to 10,000 texts a batch, and the filter had every shadow made a second time
    assert plan.count("BatchEvalPython") == 1 and "ArrowEvalPython" not in plan
    tails = (" amount 90 500,00 EUR", " 1.234,50 alone", " nothing")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {d: normalize.shadow_of(t + tails[d % 3]) for d, t in texts.items() if t is not None}
    assert {r.doc_id: r.shadow for r in out.collect()} == {d: s for d, s in want.items() if s is not None}


def test_white_space_is_collapsed_from_the_ends_of_lines(spark):
    import random
    import re

    from veilsift.functions import normalize

    space = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

    def plain(t):
        t = re.sub("\n+", "\n", re.sub("[ \t]+", " ", t.replace("\r\n", "\n").replace("\r", "\n")))
        return "\n".join(x.strip(space) for x in t.split("\n")).strip(space)

    rng = random.Random(5)
    parts = [*"  \t\n\n\rab-\x85\u200b\u2010\u2012\u2013\u2014", "\r\n", "\u00e9", "\U0001f600", *space]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "a \n \n b", "x \x85", "-\n\x85", None]], "t string")
    out = df.select("t", normalize.collapse_white_space(F.col("t")).alias("w"), normalize.unify_hyphens(F.col("t")).alias("h"))
    # before, an expression looked for a line's end at each character, and took a space before U+0085 for one at the end
    assert "^[" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        assert (r.w, r.h) == ((None, None) if r.t is None else (plain(r.t), re.sub("[\u2010-\u2013]", "-", r.t))), repr(r.t)


def test_texts_are_folded_without_a_look_at_each_character():
    import time

    text = "\u00e9t\u00e9 \u017f\u0131\u0130\u212a_ABC " * 20000
    began = time.perf_counter()
    want = text.translate(prefilter._FOLDED)
    plainly = time.perf_counter() - began
    began = time.perf_counter()
    assert prefilter.fold(text) == want.lower()
    # before, folding translated the text and more
    assert time.perf_counter() - began < plainly


def test_locales_are_scored_over_whole_texts(spark):
    from veilsift.operators import texts

    # before, what stands after the first 5000 characters did not count
    late = "xx " * 4000
    ends = ["und oder Rechnung €12", "DE89370400440532013000", "kr påx eller fra moms 12 kr", "på", "på eller.", "från_ för", "för, till och", "über für die Rechnung", "y_o con-de e", "R$5", "_og og1 Og moms", "", "colour £5"]
    rows = [(i, late + e) for i, e in enumerate(ends)] + [(100 + i, e) for i, e in enumerate(ends)] + [(-1, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    ready = docs.withColumns(prefilter.facts(F.col("text")))
    plain, guarded = ({r.doc_id: (r.locale, r.locale_confidence) for r in texts.with_locale(ready, "text", guarded=g).collect()} for g in (False, True))
    assert plain == guarded and plain[0] == ("EU-DACH", "high") and plain[1] == ("EU-DACH", "low") and plain[-1] == ("unknown", "none")
    assert all(plain[i] == plain[100 + i] for i in range(len(ends)))


def test_steps_of_decisions_are_made_once_and_where_asked(spark):
    from veilsift.operators import classes, scan, texts
    from veilsift.plans import class_words

    # before, signs of a character left their expressions unguarded
    assert prefilter.literals(texts.TRANSACTIONAL[0][0]) == ("$", "dkk", "eur", "gbp", "kr", "nok", "sek", "usd", "£", "€")
    assert prefilter.literals(r"(?:abc|)") is None and prefilter.literals(r"a|bcd") is None
    # before, clauses were looked for again for each number that they are compared with
    clauses = "1.1 a 1.2 b 1.3 c. Article 7, Clause 8, § 9. party a and party b, Date: ____ Dato: ____ " + "word " * 40
    docs = spark.createDataFrame([(1, clauses), (2, "word " * 60), (3, None)], "doc_id long, text string").withColumns(prefilter.facts(F.col("text")))
    for guarded in (False, True):
        out = docs.select("doc_id", classes.structure_points(F.col("text"), F.lit(None).cast("string"), guarded).alias("n"))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == len(class_words.CLAUSES)
        assert {r.doc_id: r.n for r in out.collect()} | {3: 0} == {1: 3 + 3 + 1, 2: 0, 3: 0}
    # before, the words of every text were counted, also where no rule of a language asks for them
    plan = scan.scan(spark.createDataFrame([(1, "a")], "doc_id long, text_norm string"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("ELSE 0 END AS __locale") == 1
