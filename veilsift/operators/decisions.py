"""From texts to decisions: one row a document with severity, action, drivers and what was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import normalize as nz
from ..functions import prefilter
from ..sources import tables
from . import archetypes, calibration, classes, clinical, fallback, guardrails, heuristics, scan, severity, texts

# Headlines by severity.
HEADLINES = {"critical": "Critical risk", "high": "High risk", "medium": "Moderate risk", "low": "Low risk", "none": "No risk found"}
MOST_DETAILS, LABEL = 3, 80
LEAST_CARD = 13
NAMED = 1000  # before the rules' findings: those in names
FALLBACK_SEQ = 100_000  # after the rules' findings
WORDS_SEQ = 1_000_000  # after all findings of a text


def document_context(docs: DataFrame, text_col: str = "text", url_col: str | None = None, language_col: str | None = None, keep_facts: bool = False) -> DataFrame:
    """Adds text_norm, locale, locale_confidence and transactional, and the facts of the raw text where they are to be kept; narrow."""
    text = F.col(text_col)
    facts = prefilter.facts(text)
    ready = nz.normalized(docs, text_col).withColumns(facts)
    placed = texts.with_locale(ready, text_col, url_col, language_col, guarded=True)
    return placed.withColumn("transactional", texts.is_transactional(text, guarded=True)).drop(*[] if keep_facts else facts)


def with_counts(signals: DataFrame) -> DataFrame:
    """Adds phones, e-mails and SSNs of each document, read off its signals' descriptions."""
    d = F.lower(F.col("description"))
    n = severity.described_count(F.col("description"))
    total = lambda word: F.coalesce(F.sum(F.when(F.contains(d, F.lit(word)), n)).over(Window.partitionBy("doc_id")), F.lit(0)).cast("long")
    return signals.withColumns({"phone_count": total("phone"), "email_count": total("email"), "ssn_count": total("ssn")})


def text_signals(docs: DataFrame, filename_col: str | None = None, department_col: str | None = None, raw_col: str = "text", guarded: bool = False) -> DataFrame:
    """Findings in the names (first), normalized texts and the department's words (last), one row each, in order of seq.

    Where the rules find nothing in a text, the fallbacks' findings in the raw one take their place.
    ``docs`` has doc_id, text_norm, the raw text, doc_length and, where named, the file's name and the department. A document's
    signals stay with its locale, length and transactional flag for the policy, so no later join with the texts is
    needed. They are dealt out by document here, once for every window and grouping that follows. Repeats are
    dropped; words of departments are one finding each already and join after that. Names, texts and fallbacks are read
    in one pass; ``guarded``: ``docs`` has the columns of ``prefilter.facts`` of the raw text.
    """
    keep = ["doc_id", "locale", "transactional", "doc_length"]
    kinds = dict(f.split() for f in scan.SIGNAL.split(", "))

    def signals(found: Column, base: int, source: str) -> Column:
        given = lambda h: {"seq": h["seq"] + base, "type": h["type"], "severity": h["severity"], "description": h["description"], "source": F.lit(source)}
        return F.transform(found, lambda h: F.struct(*[given(h).get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]))

    beside = signals(fallback.hits(F.col(raw_col), guarded), FALLBACK_SEQ, "content")
    if filename_col is not None:
        beside = F.concat(signals(texts.filename_hits(F.col(filename_col)), -NAMED, "filename"), beside)
    # names stand below 0 until all are moved up, so seq tells whose a finding is
    found = scan.scan(docs, keep=keep, beside=beside)
    primary = F.when(F.col("seq") >= 0, F.col("seq") < FALLBACK_SEQ)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("offset", "int"), ("match", "string"))]
    inside = found.select(*keep, F.when(F.col("seq") < FALLBACK_SEQ, F.col("seq") + NAMED).otherwise(F.col("seq")).alias("seq"), "type", "severity", "description", "source", "id", *nothing, "confidence", primary.alias("primary"))
    dealt = inside.repartition("doc_id")
    out = severity.deduplicate(fallback.unless_found(dealt, F.col("primary")).drop("primary"))
    if department_col is None:
        return out
    worded = texts.dictionary_hits(docs, "text_norm", department_col, keep)
    described = F.concat("label", F.lit(" ("), F.col("hits").cast("string"), F.lit(" matches)"))
    worded = worded.select(*keep, F.lit(WORDS_SEQ).alias("seq"), "id", "type", "severity", described.alias("description"), F.lit("content").alias("source"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("string").alias("match"), F.lit(None).cast("double").alias("confidence"))
    return out.unionByName(worded)


def document_facts(docs: DataFrame, keep: Sequence[str], text_col: str, filename_col: str | None) -> DataFrame:
    """doc_id, what was kept (a struct) and what the words and structures of a text and its name say; narrow.

    The facts are names of ``classes.MARKERS``, archetypes, the clinical ``confidence`` and ``structures``, and the
    ``inferred`` context for the order of drivers.
    """
    name = F.lit(None).cast("string") if filename_col is None else F.col(filename_col).cast("string")
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    base = docs.select("doc_id", kept.alias("kept"), F.col(text_col).alias("text"), name.alias("filename"))
    ready = base.withColumns(prefilter.facts(F.col("text")))
    marked = classes.markers(ready, "text", "filename", guarded=True).withColumn("archetypes", archetypes.detect(F.col("text"), guarded=True))
    # only cards are ever put behind others, and a card takes so many digits
    marked = marked.withColumn("inferred", F.when(F.col("__digits") >= LEAST_CARD, guardrails.inferred_context(F.col("text"), guarded=True)))
    out = clinical.ontology(marked, "text", ("doc_id", "kept", "archetypes", "inferred", *classes.MARKERS), guarded=True)
    return out.select("doc_id", "kept", "archetypes", "inferred", *classes.MARKERS, "structures", "confidence", "unit_cluster", "unit_near_range")


def details(ids: Column, sources: Column) -> Column:
    """At most three driving ids, 80 characters each, with their sources."""
    return F.transform(F.slice(ids, 1, MOST_DETAILS), lambda i: F.struct(F.substring(i, 1, LABEL).alias("signal_id"), F.array_join(sources, ",").alias("sources")))


def decide(docs: DataFrame, text_col: str = "text", filename_col: str | None = None, url_col: str | None = None, language_col: str | None = None, destination: Column | None = None, keep: Sequence[str] = (), department_col: str | None = None) -> DataFrame:
    """One row a document: severity, action, visibility, headline, class, drivers, counts, floor, guardrails.

    Findings are policed, calibrated, passed through the human heuristics and rid of the noise of the
    document's class; the worst of what drives, the class's baseline (gated by its identity), the escalation of
    patients' records, the floor of the regulated categories, the cap of summaries and the visibility of
    regulated findings then make the severity, in that order; details come in the order of signal dominance. ``department_col`` names the department whose words count.

    Texts are read in two narrow passes, for findings and for facts; only these are shuffled, by document. Every
    document has a row: without findings or a class its severity is none. Null texts count as empty. Rows that
    share a doc_id (null too) share their findings.
    """
    base = tables.spread(docs).withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    ready = document_context(base, text_col, url_col, language_col, keep_facts=True).withColumn("doc_length", F.length(text_col))
    policed = severity.apply_policy(with_counts(text_signals(ready, filename_col, department_col, text_col, guarded=True))).withColumn("severity", F.col("policy_severity"))
    roles = heuristics.apply_heuristics(calibration.calibrate(policed), F.col("role") == "driving")
    drives = (F.col("role") == "driving") & ~F.col("suppressed")
    name = severity.signal_identifier(F.col("id"), F.col("type"), F.col("description"))
    # no signal of its own may be shown above the decision; type and severity are for the guardrails
    entry = F.struct(F.col("seq").alias("k"), severity.rank(F.col("calibrated")).alias("r"), F.coalesce("confidence", F.lit(0.5)).alias("c"), name.alias("id"), F.col("id").alias("signal"), "source", "type", F.col("calibrated").alias("severity"))
    holder = F.contains(F.lower("description"), F.lit("cardholder"))
    found = F.struct(F.col("seq").alias("k"), F.col("id").alias("id"), "type", "severity")
    summed = roles.groupBy(F.col("doc_id").alias("of")).agg(
        F.array_sort(F.collect_list(F.when(drives, entry))).alias("entries"), F.array_sort(F.collect_list(found)).alias("findings"), F.count(F.lit(1)).alias("finding_count"), F.count_if(~drives).alias("suppressed_count"),
        F.coalesce(F.bool_or(drives & holder), F.lit(False)).alias("card_holder"), *severity.category_counts(policed),
    )  # fmt: skip  # a document has at most as many findings as there are rules
    facts = document_facts(base, keep, text_col, filename_col)
    out = facts.join(summed, facts["doc_id"].eqNullSafe(summed["of"]), "left").drop("of")
    out = out.withColumn("entries", F.coalesce("entries", F.array().cast(summed.schema["entries"].dataType))).withColumn("findings", F.coalesce("findings", F.array().cast(summed.schema["findings"].dataType)))
    out = out.withColumn("ids", F.array_distinct(F.array_compact(F.transform("entries", lambda e: e["signal"]))))
    coa = F.array_compact(F.array(F.when(F.col("confidence") == "high", clinical.RULES["icd"]), F.when(F.col("unit_cluster"), clinical.RULES["cluster"]), F.when(F.col("unit_near_range"), clinical.RULES["range"])))
    out = classes.classified(out, F.col("ids"), F.col("structures"), F.coalesce("card_holder", F.lit(False)), F.col("archetypes"), coa)
    out = out.withColumn("drivers", F.filter("entries", lambda e: F.coalesce(~F.array_contains("noise_ids", e["signal"]), F.lit(True))))
    out = out.withColumn("top", F.coalesce(F.array_max(F.transform("drivers", lambda e: e["r"])), F.lit(0)))
    best = F.array_sort(F.transform(F.filter("drivers", lambda e: e["r"] == F.col("top")), lambda e: F.struct((-e["c"]).alias("c"), e["id"].alias("id"), e["source"].alias("source"))))
    left = F.array_compact(F.transform("drivers", lambda e: e["signal"]))
    floor, categories = severity.floor_of(F.col("document_class"))
    strings = F.array().cast("array<string>")
    out = out.withColumns({"best": best, "left": left, "signal_count": F.size("drivers").cast("long"), "floor_rank": floor, "categories": F.coalesce(categories, strings)})
    decided = severity.authoritative(severity.level(F.col("top")), F.col("document_class"), F.col("identity_confidence"))
    reference = F.array_contains(archetypes.strong_ids(F.col("archetypes")), "clinical_reference") & ~archetypes.protected(F.col("left"))
    out = out.withColumn("medical", guardrails.medical_escalation(decided, F.lit("none"), F.col("document_class"), F.col("patient_context"), F.size("drivers"), reference))
    floored = severity.level(F.greatest(severity.rank(F.col("medical.severity")), F.col("floor_rank")))
    out = out.withColumn("capped", archetypes.capped(floored, F.col("left"), F.col("archetypes")))
    signal = lambda e: F.struct(e["id"].alias("id"), e["type"].alias("type"), e["severity"].alias("severity"))
    shown = F.transform("drivers", lambda e: F.struct(e["signal"].alias("id"), e["type"].alias("type"), e["severity"].alias("severity")))
    rescued = F.array_compact(F.array(F.when(F.col("medical.rescued").isNotNull(), F.struct(F.col("medical.rescued").alias("id"), F.lit("sensitive").alias("type"), F.lit("high").alias("severity")))))
    out = out.withColumn("guard", guardrails.regulated_visibility(F.transform("findings", signal), F.concat(shown, rescued), F.col("capped"), F.col("medical.escalation")))
    out = out.withColumns({"severity": F.col("guard.severity"), "escalation": F.col("guard.escalation"), "driving_ids": F.transform("best", lambda e: e["id"]), "driving_sources": F.array_sort(F.array_distinct(F.transform("best", lambda e: e["source"])))})
    # what is shown first: where cards drive in a document of persons, ids of its kind come before them
    out = out.withColumn("dominant", guardrails.dominance(F.col("driving_ids"), F.col("document_class"), F.col("inferred")))
    where = F.lit(None).cast("string") if destination is None else destination
    headline = F.element_at(F.create_map(*[F.lit(x) for kv in HEADLINES.items() for x in kv]), F.col("severity"))
    return out.select(
        "doc_id", *[F.col("kept")[c].alias(c) for c in keep], "severity", severity.action(F.col("severity"), where).alias("action"), severity.visibility(F.col("severity"), F.col("signal_count"), F.col("escalation"), F.lit(False)).alias("visibility"), "escalation", headline.alias("headline"),
        "document_class", "identity_confidence", "patient_context", archetypes.primary(F.col("archetypes")).alias("archetype"),
        "driving_ids", "driving_sources", "signal_count", F.coalesce("finding_count", F.lit(0)).cast("long").alias("finding_count"), F.coalesce("suppressed_count", F.lit(0)).cast("long").alias("suppressed_count"),
        severity.level(F.col("floor_rank")).alias("floor"), "categories", F.coalesce(F.col("guard.rescued"), F.col("medical.rescued")).alias("rescued"), F.col("dominant.reordered").alias("reordered"), F.col("dominant.rule_id").alias("dominance_rule"), details(F.col("dominant.ids"), F.col("driving_sources")).alias("details"),
    )
