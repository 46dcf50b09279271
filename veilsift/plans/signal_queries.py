"""Queries over signals made from ``events``: dedupe, policy, calibration, aggregation, floors, decisions, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..operators import framing as fr
from ..operators import heuristics as he
from ..operators import proximity as prox
from ..operators import severity as sev
from ..sources import tables

Query = Callable[[SparkSession, str], DataFrame]

#: (id, type, severity, description) of the made signals; a null id stands for signals without one.
KINDS: list[tuple[str | None, str, str, str]] = [
    ("global-api-key-sk", "confidential", "critical", "API key pattern"),
    ("secrets.password", "secret", "high", "Password detected"),
    ("pii.phone", "pii", "low", "12 phone numbers"),
    ("pii.email", "pii", "low", "7 email addresses"),
    ("financial.iban", "financial", "medium", "IBAN found"),
    ("pii.ssn_us", "pii", "medium", "SSN pattern detected"),
    (None, "legal", "medium", "Legal agreement (contract)"),
    ("global-confidential-en", "confidential", "high", "Confidentiality marker in text"),
    ("registry-banking-terms", "financial", "high", "3 Banking Terminology"),
    ("hr-salary", "sensitive", "high", "Employee data (HR)"),
    (None, "metadata", "low", "Author name present"),
    ("misc.note", "other", "none", "Something else"),
]
LOCALES = ["US", "EU-NORDICS", "EU-DACH", "LATAM", "UK", "unknown"]
SOURCES = ["content", "metadata", "filename"]


def _pick(values: list, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def made_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of 300 documents, many for each."""
    return _made(spark, sf_dir, F.col("user_id") % 300)


def few_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same signals dealt out to documents of four."""
    return _made(spark, sf_dir, F.floor(F.col("event_id") / 4))


def _made(spark: SparkSession, sf_dir: str, u: Column) -> DataFrame:
    e = F.col("event_id")
    k = e * 7 % len(KINDS)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        u.alias("doc_id"), e.alias("seq"), *[_pick([x[i] for x in KINDS], k).alias(n) for i, n in enumerate(("id", "type", "severity", "description"))],
        F.when(e % 5 != 0, (e * 7919 % 6000).cast("int")).alias("offset"), _pick(SOURCES, e % 3).alias("source"), F.when(e % 4 != 0, F.concat(F.lit("m"), (e % 40).cast("string"))).alias("match"),
        F.when(e % 3 != 0, (e % 10) / 10.0).alias("confidence"), _pick(LOCALES, u % len(LOCALES)).alias("locale"), (u % 25).alias("phone_count"), (u % 9).alias("email_count"), (u % 4 == 0).alias("transactional"),
    )


def _lit(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _arr(values: list) -> str:
    return "([" + ", ".join(map(_lit, values)) + "])"


_K = f"(event_id * 7 % {len(KINDS)})::int + 1"
SIGNALS_SQL = f"""
SELECT user_id % 300 AS doc_id, event_id AS seq, {_arr([x[0] for x in KINDS])}[{_K}] AS id, {_arr([x[1] for x in KINDS])}[{_K}] AS type, {_arr([x[2] for x in KINDS])}[{_K}] AS severity, {_arr([x[3] for x in KINDS])}[{_K}] AS description,
  CASE WHEN event_id % 5 <> 0 THEN (event_id * 7919 % 6000)::int END AS "offset", {_arr(SOURCES)}[(event_id % 3)::int + 1] AS source, CASE WHEN event_id % 4 <> 0 THEN 'm' || (event_id % 40) END AS "match",
  CASE WHEN event_id % 3 <> 0 THEN (event_id % 10) / 10.0 END::double AS confidence, {_arr(LOCALES)}[(user_id % 300 % {len(LOCALES)})::int + 1] AS locale, user_id % 300 % 25 AS phone_count, user_id % 300 % 9 AS email_count, user_id % 300 % 4 = 0 AS transactional
FROM events"""


FEW_SQL = SIGNALS_SQL.replace("user_id % 300", "(event_id // 4)")


def _rank(col: str) -> str:
    return f"(list_position(['none', 'low', 'medium', 'high', 'critical'], {col}) - 1)"


def _level(expr: str) -> str:
    return f"(['none', 'low', 'medium', 'high', 'critical'])[({expr})::int + 1]"


def dedupe_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sev.deduplicate(made_signals(spark, sf_dir)).select("doc_id", "seq", "id", "type", "source")


DEDUPE_SQL = f"""
SELECT doc_id, seq, id, type, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, coalesce(id, type), coalesce("offset"::varchar, 'none'), source ORDER BY seq) AS n FROM ({SIGNALS_SQL})) WHERE n = 1"""


def policy_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sev.apply_policy(made_signals(spark, sf_dir)).select("doc_id", "seq", "policy_key", "policy_id", "policy_severity")


def _key_sql() -> str:
    whens = []
    for key, groups in sev.KEY_PARTS:
        whens.append("WHEN " + " AND ".join("(" + " OR ".join(f"contains(lower(description), {_lit(w)})" for w in g) + ")" for g in groups) + f" THEN {_lit(key)}")
    return "CASE " + " ".join(whens) + " END"


_P = " ".join(f"WHEN {_lit(k)} THEN {v.base}" for k, v in sev.POLICY.items())
_MAND = ", ".join(_lit(k) for k, v in sev.POLICY.items() if v.mandatory)
_EASED = ", ".join(_lit(k) for k, v in sev.POLICY.items() if v.transactional and not v.mandatory)
_CAPPED = ", ".join(_lit(k) for k, v in sev.POLICY.items() if v.most)
POLICY_SQL = f"""
WITH k AS (SELECT *, {_key_sql()} AS policy_key FROM ({SIGNALS_SQL})),
p AS (SELECT *, CASE policy_key {' '.join(f'WHEN {_lit(a)} THEN {_lit(b)}' for a, b in sev.POLICY_OF.items())} END AS policy_id FROM k),
b AS (SELECT *, CASE WHEN policy_id = 'pii.ssn_us' AND locale NOT IN ('US', 'unknown') THEN 1 WHEN policy_id IN ({_MAND}) THEN greatest({_rank('severity')}, CASE policy_id {_P} END) ELSE CASE policy_id {_P} END END AS r1 FROM p),
d AS (SELECT *, CASE WHEN (policy_id = 'pii.phone' AND phone_count >= CASE locale WHEN 'EU-NORDICS' THEN 20 WHEN 'EU-DACH' THEN 15 WHEN 'LATAM' THEN 15 ELSE 10 END) OR (policy_id = 'pii.email' AND email_count >= 5) THEN 2 ELSE r1 END AS r2 FROM b),
c AS (SELECT *, CASE WHEN policy_id IN ('pii.phone', 'pii.email') AND phone_count >= 5 AND email_count >= 5 THEN least(r2 + 1, 2) ELSE r2 END AS r3 FROM d),
t AS (SELECT *, CASE WHEN transactional AND policy_id IN ({_EASED}) THEN greatest(r3 - 1, 1) ELSE r3 END AS r4 FROM c),
m AS (SELECT *, CASE WHEN policy_id IN ({_CAPPED}) THEN least(r4, 2) ELSE r4 END AS r5 FROM t)
SELECT doc_id, seq, policy_key, policy_id, {_level(f"CASE WHEN policy_id IS NULL THEN {_rank('severity')} WHEN policy_id IN ({', '.join(map(_lit, sev.ALWAYS))}) THEN greatest(r5, 3) ELSE r5 END")} AS policy_severity FROM m"""


def agg_max_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every group of events, and 20 documents without signals
    docs = tables.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("doc_id")).distinct().unionByName(spark.range(20).select((-1 - F.col("id")).alias("doc_id")))
    out = sev.aggregate_severity(docs, few_signals(spark, sf_dir))
    return out.select("doc_id", "severity", F.array_join("driving_ids", ",").alias("driving_ids"), F.array_join("driving_sources", ",").alias("driving_sources"), "signal_count")


AGG_SQL = f"""
WITH s AS (SELECT *, {_rank('severity')} AS r, coalesce(id, type || ':' || substr(regexp_replace(regexp_replace(lower(description), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50)) AS sid FROM ({FEW_SQL})),
t AS (SELECT doc_id, max(r) AS r, count(*) AS n FROM s GROUP BY doc_id),
g AS (SELECT t.doc_id, t.r, t.n, string_agg(sid, ',' ORDER BY coalesce(confidence, 0.5) DESC, sid) AS ids, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM t JOIN s ON s.doc_id = t.doc_id AND s.r = t.r GROUP BY ALL)
SELECT d.doc_id, coalesce({_level('g.r')}, 'none') AS severity, coalesce(ids, '') AS driving_ids, coalesce(sources, '') AS driving_sources, coalesce(n, 0) AS signal_count
FROM (SELECT DISTINCT event_id // 4 AS doc_id FROM events UNION ALL SELECT -1 - range FROM range(20)) d LEFT JOIN g USING (doc_id)"""


def severity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sev.severity_floor(few_signals(spark, sf_dir))
    return out.select("doc_id", "floor", F.array_join("categories", ",").alias("categories"))


FLOOR_SQL = f"""
WITH s AS (SELECT doc_id, severity, coalesce(lower(id), '') AS i, lower(type) AS t FROM ({FEW_SQL})),
f AS (SELECT doc_id, severity, i,
  starts_with(i, 'secret.') OR starts_with(i, 'secret-') OR regexp_matches(i, 'api[_-]key|password|private[_-]key|bearer[_-]token') AS secret,
  starts_with(i, 'pii.') OR starts_with(i, 'pii-') OR starts_with(i, 'registry-') OR t = 'pii' AS pii,
  starts_with(i, 'hr-') OR starts_with(i, 'hr.') OR regexp_matches(i, 'employee|compensation|salary|payroll') AS hr,
  starts_with(i, 'legal.') OR starts_with(i, 'legal-') OR regexp_matches(i, 'contract|nda|privileged') AS legal,
  starts_with(i, 'financial.') OR starts_with(i, 'financial-') OR regexp_matches(i, 'credit[_-]card|iban|banking') OR t = 'financial' AS financial FROM s),
c AS (SELECT doc_id, count(*) FILTER (secret) AS a, count(*) FILTER (pii) AS b, count(*) FILTER (hr) AS h, count(*) FILTER (legal) AS l, count(*) FILTER (financial) AS m, count(*) FILTER (financial AND (regexp_matches(i, 'credit[_-]card') OR severity = 'critical')) AS x FROM f GROUP BY doc_id)
SELECT doc_id, {_level("greatest(CASE WHEN a > 0 THEN 3 ELSE 0 END, CASE WHEN b >= 3 THEN 3 WHEN b > 0 THEN 2 ELSE 0 END, CASE WHEN h > 0 OR l > 0 THEN 2 ELSE 0 END, CASE WHEN m > 0 THEN CASE WHEN x > 0 THEN 3 ELSE 2 END ELSE 0 END)")} AS floor,
  concat_ws(',', CASE WHEN a > 0 THEN 'secret' END, CASE WHEN b > 0 THEN 'pii' END, CASE WHEN h > 0 THEN 'hr' END, CASE WHEN l > 0 THEN 'legal' END, CASE WHEN m > 0 THEN 'financial' END) AS categories FROM c"""


def calibrate_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.calibrate(few_signals(spark, sf_dir)).select("doc_id", "seq", "tier", "role", "calibrated", "reason")


def _modifier_sql(k: int) -> str:
    parts = []
    for name, rows in cal.MODIFIERS.items():
        own = " ".join(f"WHEN locale = '{p}' THEN {_lit(r[k]) if isinstance(r[k], str) else r[k]}" for p, r in rows.items())
        rest = (_lit(rows["unknown"][k]) if isinstance(rows["unknown"][k], str) else rows["unknown"][k]) if "unknown" in rows else "NULL"
        parts.append(f"WHEN sid = '{name}' THEN CASE {own} ELSE {rest} END")
    return "CASE " + " ".join(parts) + " END"


def _threshold_sql() -> str:
    parts = [f"WHEN sid = '{n}' THEN CASE " + " ".join(f"WHEN locale = '{p}' THEN {v}" for p, v in rows.items()) + f" ELSE {rows.get('unknown', cal.DEFAULT_COUNT)} END" for n, rows in cal.COUNT_THRESHOLDS.items()]
    return "CASE " + " ".join(parts) + f" ELSE {cal.DEFAULT_COUNT} END"


_REGULATED = "(" + " OR ".join(f"starts_with(lower(coalesce(id, '')), '{p}')" for p in cal.REGULATED_PREFIXES) + f" OR type IN ({', '.join(map(_lit, cal.REGULATED_TYPES))}))"
CALIBRATE_SQL = f"""
WITH s AS (SELECT *, coalesce(id, 'unknown') AS sid, {_rank('severity')} AS r FROM ({FEW_SQL})),
t AS (SELECT *, CASE WHEN sid IN ({', '.join(map(_lit, cal.UNIVERSAL))}) THEN 'universal' WHEN sid IN ({', '.join(map(_lit, cal.REGION_SENSITIVE))}) THEN 'region_sensitive' ELSE 'contextual' END AS tier,
  count(*) OVER (PARTITION BY doc_id, sid) AS same_id, count(*) OVER (PARTITION BY doc_id, coalesce("match", sid)) AS same_match FROM s),
n AS (SELECT *, EXISTS (SELECT 1 FROM t u WHERE u.doc_id = t.doc_id AND u.tier = 'universal' AND abs(u."offset" - t."offset") <= 200) AS near FROM t),
o AS (SELECT *, CASE WHEN tier = 'universal' THEN 'driving' WHEN tier = 'region_sensitive' THEN coalesce({_modifier_sql(2)}, 'driving') WHEN same_match >= 5 THEN 'suppressed' WHEN same_id >= {_threshold_sql()} THEN 'driving' WHEN near THEN 'supporting' ELSE 'suppressed' END AS role0,
  CASE WHEN tier = 'region_sensitive' THEN greatest(least(r, coalesce({_modifier_sql(1)}, 4)), coalesce({_modifier_sql(0)}, 0)) ELSE r END AS c FROM n),
q AS (SELECT *, CASE WHEN tier = 'universal' THEN 'universal_immutable' WHEN tier = 'region_sensitive' AND role0 = 'driving' THEN 'region_sensitive_promoted' WHEN tier = 'region_sensitive' THEN 'region_sensitive_demoted' WHEN same_match >= 5 THEN 'boilerplate_repetition' WHEN role0 = 'driving' THEN 'contextual_count_threshold' WHEN role0 = 'supporting' THEN 'contextual_proximity_anchor' ELSE 'contextual_suppressed_default' END AS reason0,
  count(*) FILTER (role0 = 'driving') OVER (PARTITION BY doc_id) AS drivers, count(*) OVER (PARTITION BY doc_id) AS total, (role0 = 'suppressed' AND {_REGULATED}) AS can FROM o),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY can DESC, r DESC, seq) AS k, total = 1 AND coalesce(id IN ({', '.join(map(_lit, cal.STRONG))}), FALSE) AS strong FROM q),
x AS (SELECT *, drivers = 0 AND (strong OR (can AND k = 1)) AS saved FROM w)
SELECT doc_id, seq, tier, CASE WHEN saved THEN 'driving' ELSE role0 END AS role, {_level('c')} AS calibrated, CASE WHEN saved THEN CASE WHEN strong THEN 'single_strong_awareness' ELSE 'regulated_rescue' END ELSE reason0 END AS reason FROM x"""


def decision_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    s, d = _pick(sev.LEVELS, e % 5), _pick(["public_ai", "internal_ai", "unknown"], e % 3)
    classes = [*sev.CLASS_BASELINE, None]
    cls, identity = _pick(classes, e % len(classes)), _pick(["none", "weak", "strong"], F.floor(e / 7) % 3)
    esc = _pick(["none", "inline", "modal"], F.floor(e / 11) % 3)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", sev.action(s, d).alias("action"), sev.authoritative(s, cls, identity).alias("authoritative"), sev.visibility(s, e % 2, esc, e % 13 == 0).alias("visibility"), sev.level(sev.bump(sev.rank(s), 1)).alias("bumped"), sev.level(sev.reduce(sev.rank(s), 1)).alias("reduced"), sev.is_blocking(sev.rank(s)).alias("blocking"))


_CLASSES = [*sev.CLASS_BASELINE, None]
DECISION_SQL = f"""
WITH e AS (SELECT event_id, {_arr(sev.LEVELS)}[(event_id % 5)::int + 1] AS s, {_arr(['public_ai', 'internal_ai', 'unknown'])}[(event_id % 3)::int + 1] AS d, {_arr(_CLASSES)}[(event_id % {len(_CLASSES)})::int + 1] AS c,
  {_arr(['none', 'weak', 'strong'])}[(event_id // 7 % 3)::int + 1] AS i, {_arr(['none', 'inline', 'modal'])}[(event_id // 11 % 3)::int + 1] AS x FROM events),
r AS (SELECT *, {_rank('s')} AS r, coalesce(CASE c {' '.join(f'WHEN {_lit(k)} THEN {v}' for k, v in sev.CLASS_BASELINE.items())} END, 0) AS b FROM e)
SELECT event_id, CASE s WHEN 'critical' THEN 'block' WHEN 'high' THEN CASE WHEN d = 'internal_ai' THEN 'warn' ELSE 'block' END WHEN 'medium' THEN 'warn' ELSE 'allow' END AS action,
  {_level("greatest(r, CASE WHEN b = 4 AND i <> 'strong' THEN 3 ELSE b END)")} AS authoritative,
  CASE WHEN r >= 2 OR x = 'modal' OR event_id % 13 = 0 THEN 'interrupt' WHEN event_id % 2 = 0 AND r = 0 THEN 'notice' WHEN r = 1 AND x = 'inline' THEN 'notice' ELSE 'interrupt' END AS visibility,
  {_level('least(r + 1, 4)')} AS bumped, {_level('greatest(r - 1, 1)')} AS reduced, r >= 3 AS blocking FROM r"""


def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = made_signals(spark, sf_dir).where("offset is not null")
    anchors = s.where(F.col("id").isin("secrets.password", "global-api-key-sk"))
    return prox.nearest(s.where("id = 'pii.email'"), anchors, 200).select("doc_id", "seq", "anchor_seq", "distance")


NEAREST_SQL = f"""
WITH s AS (SELECT * FROM ({SIGNALS_SQL}) WHERE "offset" IS NOT NULL),
p AS (SELECT l.doc_id, l.seq, a.seq AS anchor_seq, abs(l."offset" - a."offset") AS distance, row_number() OVER (PARTITION BY l.doc_id, l.seq ORDER BY abs(l."offset" - a."offset"), a."offset", a.seq) AS n
  FROM s l JOIN s a ON l.doc_id = a.doc_id AND abs(l."offset" - a."offset") <= 200 WHERE l.id = 'pii.email' AND a.id IN ('secrets.password', 'global-api-key-sk'))
SELECT doc_id, seq, anchor_seq, distance FROM p WHERE n = 1"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prox.dense_clusters(made_signals(spark, sf_dir).where("offset is not null"), 3, 500)


CLUSTER_SQL = f"""
SELECT doc_id, coalesce(bool_or(gap <= 500), FALSE) AS clustered, min(gap) AS tightest FROM (SELECT doc_id, lead("offset", 2) OVER (PARTITION BY doc_id ORDER BY "offset", seq) - "offset" AS gap FROM ({SIGNALS_SQL}) WHERE "offset" IS NOT NULL) GROUP BY doc_id"""


def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prox.different_kinds_near(made_signals(spark, sf_dir).where("offset is not null and id is not null"), 500)


PAIRS_SQL = f"""
WITH s AS (SELECT doc_id, seq, id, "offset" FROM ({SIGNALS_SQL}) WHERE "offset" IS NOT NULL AND id IS NOT NULL)
SELECT doc_id, coalesce(bool_or(EXISTS (SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.id <> s.id AND abs(b."offset" - s."offset") <= 500)), FALSE) AS near FROM s GROUP BY doc_id"""


def list_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prox.lists(made_signals(spark, sf_dir).where("match is not null"), 5, 2000)


LIST_SQL = f"""
SELECT doc_id, id, count(DISTINCT "match") AS matches, max("offset") - min("offset") AS span, count(DISTINCT "match") >= 5 AND (count("offset") = 0 OR max("offset") - min("offset") <= 2000) AS is_list
FROM ({SIGNALS_SQL}) WHERE "match" IS NOT NULL GROUP BY doc_id, id"""


def human_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = few_signals(spark, sf_dir).withColumn("doc_length", F.lit(6000))
    return he.apply_heuristics(s).select("doc_id", "seq", "promoted", "suppressed", "rule")


def _in(values: list[str]) -> str:
    return "(" + ", ".join(map(_lit, values)) + ")"


HEURISTICS_SQL = f"""
WITH s AS (SELECT *, coalesce(id, 'unknown') AS i FROM ({FEW_SQL})),
a AS (SELECT *, i IN {_in(he.ANCHORS)} AS anchor, i IN {_in(he.PROMOTABLE)} AS can, coalesce("match", i) AS m, CASE WHEN i IN ('pii.email', 'pii.email.density') THEN 'e' WHEN i IN ('pii.phone', 'pii.phone.density') THEN 'p' END AS kind FROM s),
k AS (SELECT doc_id, kind, count(DISTINCT m) >= 5 AND coalesce(max("offset") - min("offset") <= 2000, TRUE) AS l FROM a WHERE kind IS NOT NULL GROUP BY ALL),
d AS (SELECT doc_id, bool_or(anchor) AS anchored, bool_or(anchor OR severity IN ('high', 'critical')) AS sensitive FROM a GROUP BY doc_id),
g AS (SELECT doc_id, m, count(*) >= 3 AND NOT bool_or(anchor) AS bp FROM a GROUP BY ALL),
f AS (SELECT a.*, a.can AND EXISTS (SELECT 1 FROM a b WHERE b.doc_id = a.doc_id AND b.anchor AND abs(b."offset" - a."offset") <= 200) AS near,
  coalesce((kind = 'e' AND (SELECT l FROM k WHERE k.doc_id = a.doc_id AND k.kind = 'e')) OR (kind = 'p' AND (SELECT l FROM k WHERE k.doc_id = a.doc_id AND k.kind = 'p') AND NOT coalesce((SELECT l FROM k WHERE k.doc_id = a.doc_id AND k.kind = 'e'), FALSE)), FALSE) AS listed,
  can AND NOT anchor AND ((source = 'metadata' AND NOT anchored) OR coalesce("offset" < 1500 OR "offset" > 4500, FALSE)) AS zone, bp, i IN {_in(he.LEGAL + he.MARKERS)} AND NOT sensitive AS fin
  FROM a JOIN d ON d.doc_id = a.doc_id JOIN g ON g.doc_id = a.doc_id AND g.m = a.m)
SELECT doc_id, seq, near OR listed AS promoted, NOT (near OR listed) AND (zone OR bp OR fin) AS suppressed, CASE WHEN listed THEN 'list' WHEN near THEN 'proximity' WHEN zone THEN 'zone' WHEN bp THEN 'boilerplate' WHEN fin THEN 'finality' END AS rule FROM f"""


def framing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = few_signals(spark, sf_dir).where("id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min("locale").alias("locale"), F.count(F.lit(1)).alias("n"))
    s, c = _pick(sev.LEVELS, F.col("doc_id") % 5), _pick(["doc.invoice", None, None], F.col("doc_id") % 3)
    df = per.select("doc_id", "ids", "n", s.alias("severity"), c.alias("cls"), "locale")
    sure = fr.surface_confidence(F.col("cls"), F.col("ids"), F.col("severity"), F.col("n"))
    df = df.withColumn("confidence", sure).withColumn("fam", fr.families(F.col("ids")))
    shown = fr.shown_severity(F.lit("high"), F.col("severity"), F.col("doc_id") % 2 == 0)
    return df.select("doc_id", "confidence", F.array_join("fam", ",").alias("families"), fr.family_list(F.col("fam")).alias("words"), fr.disclosure(F.col("severity")).alias("disclosure"), fr.display_severity(F.col("severity"), F.col("confidence")).alias("display"), fr.locale_group(F.col("locale")).alias("locale_group"), shown.alias("shown"))


def _parts_sql(parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(i), {_lit(p)})" for p in parts) + ")"


FRAMING_SQL = f"""
WITH s AS (SELECT DISTINCT doc_id, id AS i FROM ({FEW_SQL}) WHERE id IS NOT NULL),
f AS (SELECT doc_id, CASE {' '.join(f"WHEN {_parts_sql(parts)} THEN {_lit(label)}" for label, parts in fr.FAMILIES)} END AS fam, {_parts_sql(fr.STRONG_PARTS)} AS strong FROM s),
g AS (SELECT doc_id, list_sort(list_distinct(list(fam) FILTER (fam IS NOT NULL))) AS fam, bool_or(strong) AS strong FROM f GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, min(locale) AS locale FROM ({FEW_SQL}) WHERE id IS NOT NULL GROUP BY doc_id),
d AS (SELECT *, {_arr(sev.LEVELS)}[(doc_id % 5)::int + 1] AS severity, doc_id % 3 = 0 AS classed, coalesce(fam, []) AS fs FROM n JOIN g USING (doc_id)),
c AS (SELECT *, CASE WHEN classed THEN 'confirmed' WHEN severity IN ('high', 'critical') AND n >= 2 THEN 'confirmed' WHEN len(fs) >= 2 OR strong THEN 'confirmed' ELSE 'inferred' END AS confidence FROM d)
SELECT doc_id, confidence, array_to_string(fs, ',') AS families, CASE len(fs) WHEN 0 THEN 'sensitive' WHEN 1 THEN fs[1] WHEN 2 THEN fs[1] || ' and ' || fs[2] ELSE array_to_string(fs[1:len(fs)-1], ', ') || ', and ' || fs[len(fs)] END || ' information' AS words,
  CASE WHEN severity IN ('high', 'medium') THEN 'standard' ELSE 'minimal' END AS disclosure, CASE WHEN severity = 'critical' AND confidence = 'inferred' THEN 'high' ELSE severity END AS display,
  CASE WHEN locale IN ('US', 'UK', 'LATAM') THEN locale WHEN locale LIKE 'EU-%' THEN 'EU' WHEN locale LIKE 'EN-%' THEN 'EN' ELSE 'UNKNOWN' END AS locale_group,
  CASE WHEN doc_id % 2 = 0 OR 3 <= {_rank('severity')} THEN 'high' ELSE severity END AS shown FROM c"""


def signal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_signals(spark, sf_dir).groupBy("type", "severity").agg(F.count(F.lit(1)).alias("signals"), F.countDistinct("doc_id").alias("documents"), F.count("offset").alias("placed"))


REPORT_SQL = f'SELECT type, severity, count(*) AS signals, count(DISTINCT doc_id) AS documents, count("offset") AS placed FROM ({SIGNALS_SQL}) GROUP BY ALL'


def queries() -> dict[str, Query]:
    return {
        "dedupe_signals": dedupe_signals, "policy_contract": policy_contract, "agg_max_severity": agg_max_severity, "severity_floor": severity_floor, "calibrate_roles": calibrate_roles,
        "decision_tables": decision_tables, "nearest_anchor": nearest_anchor, "dense_clusters": clusters, "distinct_pairs": distinct_pairs, "list_detection": list_detection, "signal_report": signal_report, "framing_tables": framing_tables, "human_heuristics": human_heuristics,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "dedupe_signals": DEDUPE_SQL, "policy_contract": POLICY_SQL, "agg_max_severity": AGG_SQL, "severity_floor": FLOOR_SQL, "calibrate_roles": CALIBRATE_SQL,
        "decision_tables": DECISION_SQL, "nearest_anchor": NEAREST_SQL, "dense_clusters": CLUSTER_SQL, "distinct_pairs": PAIRS_SQL, "list_detection": LIST_SQL, "signal_report": REPORT_SQL, "framing_tables": FRAMING_SQL, "human_heuristics": HEURISTICS_SQL,
    }
