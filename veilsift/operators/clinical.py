"""Clinical structure in texts: diagnosis codes, units of measure, reference ranges, vital signs, and their nearness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prefilter
from ..functions.patterns import around, found
from .texts import all_matches

# Clinical units (pattern, flags, unit).
UNITS = [
    (r"\bmmol\/L\b", "i", "mmol/L"), (r"(?:^|[^a-zA-Z])[µμu]mol\/L\b", "i", "µmol/L"), (r"\bng\/mL\b", "i", "ng/mL"), (r"\bng\/L\b", "i", "ng/L"), (r"\bmg\/dL\b", "i", "mg/dL"), (r"\bmg\/L\b", "i", "mg/L"), (r"\bg\/dL\b", "i", "g/dL"), (r"\bmEq\/L\b", "i", "mEq/L"),
    (r"\bmIU\/L\b", "i", "mIU/L"), (r"\bIU\/L\b", "i", "IU/L"), (r"\bU\/L\b", "i", "U/L"), (r"\bpg\/mL\b", "i", "pg/mL"), (r"\bfmol\/L\b", "i", "fmol/L"), (r"[×x]10[⁹9]\/?L\b", "i", "×10⁹/L"), (r"[×x]10[¹²12]{1,2}\/?L\b", "i", "×10¹²/L"), (r"\bcells?\/[µμu]L\b", "i", "cells/µL"),
    (r"\b\/HPF\b", "i", "/HPF"), (r"\bfL\b", "", "fL"), (r"\bpg\b", "", "pg"), (r"\bkU\/L\b", "i", "kU/L"), (r"\bnmol\/L\b", "i", "nmol/L"), (r"\bpmol\/L\b", "i", "pmol/L"), (r"\bkPa\b", "", "kPa"), (r"\bmmHg\b", "", "mmHg"),
]
# Reference ranges and vital signs (pattern, flags).
RANGES = [
    (r"\(\s*<?[\d.]+\s*[-–]\s*[\d.]+\s*\)", ""),
    (r"\(\s*[<>≤≥]\s*[\d.]+\s*\)", ""),
    (r"\[\s*<?[\d.]+\s*[-–]\s*[\d.]+\s*\]", ""),
    (r"\[\s*[<>≤≥]\s*[\d.]+\s*\]", ""),
    (r"\b(?:ref(?:erence)?|normal|range)\s*[:=]\s*<?[\d.]+\s*[-–]\s*[\d.]+", "i"),
    (r"[<>≤≥]\s*[\d.]+\s*(?:mmol|µmol|umol|ng|mg|mEq|IU|U|pg|nmol|pmol)\/[mLdl]+", "i"),
]
VITALS = [
    (r"\b\d{2,3}\/\d{2,3}\s*(?:mmHg)?\b", ""),
    (r"\bBMI\s*[:=]?\s*\d{1,2}(?:\.\d)?\b", "i"),
    (r"\b(?:pulse|HR|heart\s*rate)\s*[:=]?\s*\d{2,3}\b", "i"),
    (r"\b(?:temp(?:erature)?)\s*[:=]?\s*\d{2,3}(?:\.\d)?(?:\s*°?[CF])?\b", "i"),
    (r"\b(?:SpO2|O2\s*sat(?:uration)?)\s*[:=]?\s*\d{2,3}\s*%?\b", "i"),
    (r"\b(?:RR|resp(?:iratory)?\s*rate)\s*[:=]?\s*\d{1,2}\b", "i"),
]
prefilter.register(x[0] for x in [*UNITS, *RANGES, *VITALS])
# Diagnosis codes, what looks like one within 10 characters, chapters that are none, and the limits of coherence.
ICD = r"\b([A-TV-Z]\d{2})(?:\.(\d{1,2}))?\b"
ICD_ANY_CASE = r"\b([A-TV-Za-tv-z]\d{2})(?:\.(\d{1,2}))?\b"
NOT_ICD = [r"\bA4\b", r"\bB2B\b", r"\bC\+\+", r"\bV[0-9]\b", r"\bT\d{1,2}C\b"]
NO_CHAPTERS = ["U", "X"]
ICD_CONTEXT, MANY_CODES, SCATTERED, CLUSTER_LEAST = 10, 10, 8, 3
RULES = {"icd": "COA-001-icd-standalone", "cluster": "COA-002-unit-cluster", "range": "COA-003-unit-range-proximity", "low": "COA-005-icd-low-coherence", "none": "COA-000-no-anchors"}
CLUSTER, NEAR = 500, 100


def _places(text: Column, pattern: str, flags: str, name: str, guarded: bool) -> Column:
    hits = F.when(prefilter.holds(text, pattern, flags, guarded), all_matches(text, pattern, flags))
    return F.transform(hits, lambda m: F.struct(m["place"].alias("place"), F.lit(name).alias("name")))


def clinical_findings(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), guarded: bool = False) -> DataFrame:
    """One row a document: units, distinct_units, ranges, vitals, unit_cluster, unit_near_range, is_medical.

    Different units within 500 characters are a cluster (then two neighbours in place order are, too);
    a unit within 100 characters of a reference range is near it. Either makes a text medical.
    """
    text = F.col(text_col)
    all_of = lambda rows: F.array_sort(F.flatten(F.array_compact(F.array(*rows))))
    units = all_of([_places(text, p, f, u.lower(), guarded) for p, f, u in UNITS])
    ranges = all_of([_places(text, p, f, "range", guarded) for p, f in RANGES])
    vitals = all_of([_places(text, p, f, "vital", guarded) for p, f in VITALS])
    rows = df.select(*keep, units.alias("__u"), ranges.alias("__r"), F.size(vitals).alias("vitals"))
    u, r = F.col("__u"), F.col("__r")
    pairs = F.arrays_zip(F.slice(u, F.lit(1), F.greatest(F.size(u) - 1, F.lit(0))).alias("a"), F.slice(u, F.lit(2), F.greatest(F.size(u) - 1, F.lit(0))).alias("b"))
    cluster = F.exists(pairs, lambda p: (p["a"]["name"] != p["b"]["name"]) & (p["b"]["place"] - p["a"]["place"] <= CLUSTER))
    near = F.exists(u, lambda x: F.exists(r, lambda y: F.abs(x["place"] - y["place"]) <= NEAR))
    out = rows.select(*keep, F.size(u).alias("units"), F.size(F.array_distinct(F.transform(u, lambda x: x["name"]))).alias("distinct_units"), F.size(r).alias("ranges"), "vitals", cluster.alias("unit_cluster"), near.alias("unit_near_range"))
    return out.withColumn("is_medical", F.col("unit_cluster") | F.col("unit_near_range"))


def icd_codes(text: Column) -> Column:
    """The different diagnosis codes of a text in order of place; look-alikes by their surroundings are left out."""
    hits = F.when(found(text, ICD), all_matches(text, ICD))
    near = lambda m: around(text, m["place"], F.length(m["matched"]), ICD_CONTEXT)
    alike = lambda m: reduce(lambda a, b: a | b, [found(near(m), p, "i") for p in NOT_ICD])
    kept = F.filter(hits, lambda m: ~F.substring(m["matched"], 1, 1).isin(*NO_CHAPTERS) & ~alike(m))
    return F.coalesce(F.array_distinct(F.transform(kept, lambda m: m["matched"])), F.array().cast("array<string>"))


def icd_coherence(text: Column, codes: Column) -> Column:
    """Whether codes look like diagnoses: (chapters, base_codes, clustered, low_coherence).

    Three places of codes (any case; E11.9 is a place of E11 too) within 500 characters are a cluster.
    Ten codes of eight chapters without a cluster are of low coherence.
    """
    hits = F.when(F.size(codes) > 0, all_matches(text, ICD_ANY_CASE))
    names = lambda m: F.array_distinct(F.array(F.upper(F.substring(m["matched"], 1, 3)), F.upper(m["matched"])))
    places = F.flatten(F.transform(hits, lambda m: F.transform(F.filter(names(m), lambda n: F.array_contains(codes, n)), lambda n: m["place"])))
    width = F.greatest(F.size(places) - (CLUSTER_LEAST - 1), F.lit(0))
    ends = F.arrays_zip(F.slice(places, F.lit(1), width).alias("a"), F.slice(places, F.lit(CLUSTER_LEAST), width).alias("b"))
    clustered = F.coalesce(F.exists(ends, lambda e: e["b"] - e["a"] <= CLUSTER), F.lit(False))
    part = lambda n: F.size(F.array_distinct(F.transform(codes, lambda c: F.substring(c, 1, n))))
    low = (F.size(codes) >= MANY_CODES) & (part(1) >= SCATTERED) & ~clustered
    return F.struct(part(1).alias("chapters"), part(3).alias("base_codes"), clustered.alias("clustered"), low.alias("low_coherence"))


def ontology(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), guarded: bool = False) -> DataFrame:
    """``clinical_findings`` and the verdict on them: icd_codes, chapters, base_codes, clustered, low_coherence, confidence, rule, structures.

    Codes make a text medical (high) unless they are of low coherence, or a single one, without another
    clinical structure (low); then units do (medium). ``structures`` counts what supports a medical class.
    Null texts have none of it.
    """
    out = clinical_findings(df.withColumn(text_col, F.coalesce(text_col, F.lit(""))), text_col, (*keep, text_col), guarded)
    out = out.withColumn("icd_codes", icd_codes(F.col(text_col)))
    n, c = F.size("icd_codes"), icd_coherence(F.col(text_col), F.col("icd_codes"))
    out = out.withColumn("__c", c).select("*", "__c.*").drop("__c")
    other = F.col("unit_cluster") | F.col("unit_near_range") | (F.col("vitals") >= 2) | (F.col("ranges") >= 2)
    weak = ~other & (F.col("low_coherence") | (n == 1))
    cluster, near = F.col("unit_cluster"), F.col("unit_near_range")
    rule = F.when((n > 0) & ~weak, "icd").when(cluster, "cluster").when(near, "range").when(n > 0, "low").otherwise("none")
    out = out.withColumn("__rule", rule)
    return out.withColumns({
        "is_medical": F.col("__rule").isin("icd", "cluster", "range"),
        "confidence": F.when(F.col("__rule") == "icd", "high").when(F.col("__rule").isin("cluster", "range"), "medium").when(F.col("__rule") == "low", "low").otherwise("none"),
        "rule": F.element_at(F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv]), F.col("__rule")),
        "structures": (F.col("__rule") == "icd").cast("int") + cluster.cast("int") + near.cast("int"),
    }).drop("__rule", text_col)
