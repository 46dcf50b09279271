"""Layered policies, their validation, and framed explanations: cases that the registered queries do not hold."""

from pyspark.sql import functions as F

from veilsift.operators import decisions, diagnostics, frames, guardrails, policies


def test_layers_fold_in_order(spark):
    layers = [
        ("default", None, "email", 1, {"baseSeverity": "critical"}), ("default", None, "email", 0, {"baseSeverity": "low", "maxSeverity": "medium", "enabled": "true"}),
        ("locale", "US", "email", 0, {"baseSeverity": "medium", "x": "1"}), ("department", "legal", "email", 0, {"x": "2", "enabled": "false"}), ("tenant", "t", "email", 0, {"maxSeverity": None, "baseSeverity": "high"}),
        ("locale", None, "email", 0, {"baseSeverity": "critical"}), ("tenant", "t", "other", 0, {"baseSeverity": "high"}),
    ]
    contexts = [("email", "US", "legal", "t"), ("email", "US", None, None), ("email", None, None, None), ("email", "XX", "legal", "u"), ("other", "US", "legal", "t"), ("email", "US", "legal", "t")]
    df = spark.createDataFrame(contexts, "signal_id string, locale string, department string, tenant string")
    known = spark.createDataFrame(layers, policies.LAYERS)
    got = [(tuple(r)[:4], r.settings) for r in policies.effective(df, known).collect()]
    base = {"baseSeverity": "low", "maxSeverity": "medium", "enabled": "true"}
    want = {
        contexts[0]: base | {"baseSeverity": "high", "x": "2", "enabled": "false"}, contexts[1]: base | {"baseSeverity": "medium", "x": "1"}, contexts[2]: base, contexts[3]: base | {"x": "2", "enabled": "false"}, contexts[4]: None,
    }
    assert len(got) == 6 and all(want[c] == s for c, s in got)
    held = spark.createDataFrame([("email", "medium", False), ("other", "low", True)], policies.INVARIANTS)
    forced = {tuple(r)[:4]: r.settings for r in policies.effective(df, known, held).collect()}
    assert forced[contexts[0]]["enabled"] == "true" and forced[contexts[0]]["baseSeverity"] == "high"
    assert forced[contexts[2]]["baseSeverity"] == "medium" and forced[contexts[4]] is None


def test_the_first_policy_without_overlays(spark):
    rows = [
        (1, "API key pattern", "low", "US", 0, 0, 0, False, "critical"), (2, "25 phone numbers", "critical", "US", 25, 0, 0, False, "medium"), (3, "25 phone numbers", "low", "EU-NORDICS", 25, 0, 0, True, "low"), (4, "9 email addresses", "low", None, 0, 9, 0, False, "low"),
        (5, "SSN pattern", "critical", "EU-DACH", 0, 0, 1, False, "low"), (6, "SSN pattern", "low", "US", 30, 30, 1, True, "critical"), (7, "Something", "none", "US", 0, 0, 0, False, "none"), (8, "banking data", "low", "US", 0, 0, 0, True, "medium"), (9, "corporate document", "high", "US", 0, 0, 0, False, "low"),
        (10, "12 phone numbers", "low", "US", 12, 0, 0, True, "low"), (11, "Legal agreement", "critical", None, 0, 0, 0, False, "high"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, description string, severity string, locale string, phone_count int, email_count int, ssn_count int, transactional boolean, want string")
    df = df.selectExpr("*", "cast(null as string) department", "cast(null as string) tenant")
    got = {r.doc_id: (r.policy_severity, r.want) for r in policies.apply_v1(df, policies.default_layer(spark)).collect()}
    assert len(got) == len(rows) and all(a == b for a, b in got.values()), got


def test_what_is_no_policy_is_one_violation(spark):
    docs = [(1, "nope"), (2, None), (3, "[]"), (4, "null"), (None, "5")]
    df = spark.createDataFrame(docs, "policy_id long, policy string")
    got = policies.violations(df).collect()
    assert sorted((str(r.policy_id), r.path, r.rule) for r in got) == sorted((str(i), "", "object") for i, _ in docs)
    assert all(not r.ok and r.errors == 1 and r.use_default for r in policies.validated(df).collect())
    assert policies.violations(df.limit(0)).count() == 0


GOOD = """{"version": "1.0", "name": "n", "signals": {"a.b": {"enabled": true, "baseSeverity": "low", "minCount": 1.5}}, "localeOverrides": [{"locale": "XX"}], "departmentOverrides": [], "cooccurrenceRules": [],
 "invariants": {"mandatorySignals": ["a.b", "gone"], "mandatoryMinSeverity": "high", "alwaysCritical": []}, "more": 1}"""


def test_strict_mode_decides_what_is_an_error(spark):
    df = spark.createDataFrame([(1, GOOD)], "policy_id long, policy string")
    known = spark.createDataFrame([("other",)], "signal_id string")
    for strict, level in ((True, "error"), (False, "warning")):
        got = sorted((r.path, r.rule, r.level) for r in policies.violations(df, strict, known).collect())
        assert got == [("localeOverrides[0].locale", "locale", level), ("signals.a.b", "known", level)]
    row = policies.validated(df, strict=False, known_signals=known).first()
    assert row.ok and row.warnings == 2 and not row.use_default
    variant = df.selectExpr("policy_id", "parse_json(policy) AS policy")
    assert policies.violations(variant).count() == 1
    off = df.selectExpr("policy_id", "replace(policy, 'true', 'false') AS policy")
    assert ("signals.a.b", "not disabled", "error") in {(r.path, r.rule, r.level) for r in policies.violations(off, strict=False).collect()}


def test_frames_of_facts_that_are_missing(spark):
    row = frames.framed(spark.createDataFrame([(1,)], "doc_id long")).first()
    assert (row.frame, row.frame_confidence, row.frame_hint, row.suppress_details) == ("FRAME_REVIEW_ADVISED", "fallback", "unknown", False)
    df = spark.createDataFrame([(1, None, None, True, "x"), (2, ["doc.payroll"], "doc.payroll", False, None)], "doc_id long, driving_ids array<string>, document_class string, pdf_failed boolean, filename string")
    a, b = sorted(frames.framed(df).collect(), key=lambda r: r.doc_id)
    assert a.frame == "FRAME_PDF_UNREADABLE" and b.frame == "FRAME_PAYROLL" and b.suppress_rule == "AWF-011-suppress-doc-class" and b.frame_headline == "This file contains financial or payroll data"


def test_frames_of_decisions(spark):
    """A decision's own columns are facts: no renaming between the two."""
    docs = [(1, "api_key = 'abcdefghij1234567890xyz' and mail a@x.org b@y.net c@z.com d@w.io e@v.de f@u.se", "x.txt"), (2, "nothing to see", "Contract.txt")]
    decided = decisions.decide(spark.createDataFrame(docs, "doc_id long, text string, filename string"), filename_col="filename", keep=["filename"])
    rows = {r.doc_id: r for r in frames.framed(decided).collect()}
    assert rows[1].frame_confidence == "confirmed" and rows[1].frame_headline
    assert rows[2].frame == "FRAME_LEGAL" or rows[2].frame_hint == "contract_like"


def test_named_places_and_issues(spark):
    df = spark.createDataFrame([("a {x} b {y} {z}", {"x": "1", "y": None}), ("plain", {})], "t string, m map<string, string>")
    assert [r[0] for r in df.select(frames.fill(df["t"], df["m"])).collect()] == ["a 1 b  {z}", "plain"]
    df = spark.createDataFrame([("An ALERT", "s" * 141), ("h" * 81, "calm")], "h string, s string")
    assert [r[0] for r in df.select(frames.text_issues(df["h"], df["s"])).collect()] == [["Headline contains forbidden words: alert", "Summary exceeds 140 chars: 141"], ["Headline exceeds 80 chars: 81"]]
    assert len(frames.FRAMES) == 19 and len({f[0] for f in frames.FRAMES}) == 19


def test_counters_of_batches_and_streams(spark, tmp_path):
    rows = [("pii",), ("pii",), ("legal",), ("odd",), (None,)]
    df = spark.createDataFrame(rows, "type string")
    counters = diagnostics.Counters("r")
    first = counters.watch(df, "policy")
    last = counters.watch(first.where("type = 'pii'").distinct(), "dedup", visible=F.lit(True))
    assert last.count() == 1
    table = counters.table(spark)
    assert sorted(tuple(r) for r in table.collect()) == [("r", "dedup", "pii", 1), ("r", "dedup", "total", 1), ("r", "dedup", "visible", 1), ("r", "policy", "legal", 1), ("r", "policy", "other", 2), ("r", "policy", "pii", 2), ("r", "policy", "total", 5)]
    assert diagnostics.removed(table).first().removed == 4
    df.write.parquet(f"{tmp_path}/in")
    stream = diagnostics.watch_stream(spark.readStream.schema("type string").parquet(f"{tmp_path}/in"), "detection")
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(b, i): n for _, b, i, n in diagnostics.of_progress(query.recentProgress)}
    assert got == {("detection", "total"): 5, ("detection", "pii"): 2, ("detection", "legal"): 1, ("detection", "other"): 2}


def test_details_of_decisions_come_in_the_order_of_dominance(spark):
    """Details are the drivers in the order that dominance gives them; guard_dominance holds that order against its SQL."""
    docs = [(1, "card number 4111111111111111. CPR 010289-1234 employee salary and payroll salary band"), (2, "card 4111111111111111 api_key = 'abcdefghij1234567890xyz' password: hunter2x"), (3, "nothing")]
    out = decisions.decide(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = out.withColumn("again", guardrails.dominance(F.col("driving_ids"), F.col("document_class"), F.lit(None).cast("string"))).collect()
    assert all([d.signal_id for d in r.details] == r.again.ids[:3] and r.reordered == r.again.reordered and r.dominance_rule == r.again.rule_id for r in rows)
    assert all(r.details for r in rows if r.doc_id != 3)
