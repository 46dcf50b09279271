"""Queries of what is enforced on decisions, over decisions made from ``events``, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration
from ..operators import guardrails as gr
from ..operators import severity as sev
from ..sources import tables
from .scan_queries import _list, _quoted

Query = Callable[[SparkSession, str], DataFrame]

#: Signals of the made decisions: (id, type, severity); a null id stands for signals without one.
SIGNALS: list[tuple[str | None, str, str]] = [
    ("pii.credit_card", "pii", "critical"), ("hr-compensation", "sensitive", "high"), ("legal.nda", "legal", "medium"), ("global-national-id", "pii", "critical"), ("registry-credit-card-spaced", "pii", "critical"), ("other.note", "other", "low"),
    ("registry-medical-content", "sensitive", "high"), (None, "financial", "medium"), ("pii.name", "pii", "low"), ("global-dob", "other", "high"), ("global-insurance-terms", "other", "low"), ("global-aws-access-key", "secret", "critical"),
    ("global-swift", "other", "medium"), ("legal.contract", "legal", "low"), ("doc.payroll", "sensitive", "none"), (None, "other", "high"), ("COA-002-unit-cluster", "sensitive", "medium"), ("financial.iban", "financial", "high"), ("dictionary.hr", "other", "low"),
]
CLASSES = ["doc.payroll", None, "doc.medical_record", None, "doc.legal_contract", "doc.insurance_policy", None, "doc.invoice", "doc.hr_record"]
PHRASES = ["nothing to see", "salary and bonus", "whereas the governing law", "salary 010203-1234", "hereby 010203-1234", "id 0102031234", "the bonus hereby", "employment contract, probation period", "whereas"]
ARCHETYPES = ["resume_cv", "medical_record", "insurance", "employment_hr"]
ESCALATIONS, CONFIDENCES = ["none", "inline", "modal"], ["fallback", "inferred", "confirmed"]
CARDS = ["4111 1111 1111 1111", None, "4111 1111 1111 1112", "5500 0000 0000 0004", "9999 9999 9999 9995"]
AROUND = ["pay with the card ", "the number is ", "Kreditkarte: ", "ref "]
EXPLANATIONS = ["secret.private_key", "pii.credit_card", "pii.phone", "code_block", "financial.iban", "dictionary.legal", "unknown.type", "", "secret.api_key", "legal.nda", "pii.email.density"]
CONTEXT = {
    "department": ["legal", "engineering", "marketing", None], "destination": ["internal_ai", "public_ai", None], "intent": ["refactor", None], "locale_group": ["US", "EU", "UNKNOWN", None, "EU"], "locale_profile": ["EU-NORDICS", "US", None],
}
STEPS = (3, 5, 11)


def _pick(values: list, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision an event: its signals (up to three), the visible ones, ids, class, severity, escalation, text."""
    e, u = F.col("event_id"), F.col("user_id")
    every = F.array(*[F.struct(*[_pick([s[k] for s in SIGNALS], (e * n + n) % len(SIGNALS)).alias(name) for k, name in enumerate(("id", "type", "severity"))]) for n in STEPS])
    signals = F.slice(every, F.lit(1), (e % 4).cast("int"))
    df = tables.table(spark, sf_dir, "events").select("event_id", "user_id", signals.alias("signals"))
    ids = F.transform(F.filter("signals", lambda s: s["id"].isNotNull()), lambda s: s["id"])
    return df.select(
        "event_id", "signals", ids.alias("ids"), F.slice("signals", F.lit(1), (u % 3).cast("int")).alias("visible"), _pick(CLASSES, u % len(CLASSES)).alias("class"), _pick(sev.LEVELS, u % 5).alias("severity"),
        _pick(ESCALATIONS, F.floor(e / 3) % 3).alias("escalation"), _pick(PHRASES, (e + u) % len(PHRASES)).alias("text"), F.array(_pick(ARCHETYPES, u % 4)).alias("archetypes"), (u % 2 == 0).alias("patient"), (e % 7 == 0).alias("reference"),
    )


def _arr(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else _quoted(v) for v in values) + "]"


def _at(values: list, index: str) -> str:
    return f"({_arr(values)})[({index})::int + 1]"


_EVERY = ", ".join("{" + ", ".join(f"'{name}': {_at([s[k] for s in SIGNALS], f'(event_id * {n} + {n}) % {len(SIGNALS)}')}" for k, name in enumerate(("id", "type", "severity"))) + "}" for n in STEPS)
MADE = f"""(SELECT *, list_transform(list_filter(signals, lambda s: s.id IS NOT NULL), lambda s: s.id) AS ids, list_slice(signals, 1, (user_id % 3)::int) AS visible FROM (
  SELECT event_id, user_id, list_slice([{_EVERY}], 1, (event_id % 4)::int) AS signals, {_at(CLASSES, f"user_id % {len(CLASSES)}")} AS cls, {_at(sev.LEVELS, "user_id % 5")} AS severity, {_at(ESCALATIONS, "event_id // 3 % 3")} AS escalation,
    {_at(PHRASES, f"(event_id + user_id) % {len(PHRASES)}")} AS text, [{_at(ARCHETYPES, "user_id % 4")}] AS archetypes, user_id % 2 = 0 AS patient, event_id % 7 = 0 AS reference FROM events))"""


def _rank(x: str) -> str:
    return f"(list_position({_list(sev.LEVELS)}, {x}) - 1)"


def _level(x: str) -> str:
    return f"({_list(sev.LEVELS)})[({x})::int + 1]"


def _in(x: str, known: list[str]) -> str:
    return f"{x} IN ({', '.join(map(_quoted, known))})"


def _some(known: list[str], ids: str = "ids") -> str:
    return f"len(list_filter({ids}, lambda i: {_in('i', known)})) > 0"


def _of(x: str, values: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in values.items()) + " END"


def guard_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = made(spark, sf_dir).withColumn("context", gr.inferred_context(F.col("text")))
    found = gr.dominance(F.col("ids"), F.col("class"), F.col("context"))
    return out.withColumn("d", found).select("event_id", "context", F.array_join("d.ids", ",").alias("ids"), "d.reordered", "d.promoted", "d.demoted", "d.rule_id")


def _dominance_sql() -> str:
    count = lambda ps: " + ".join(f"regexp_matches(text, {_quoted('(?i)' + p)})::int" for p in ps)
    kinds = {"hr": gr.HR_IDS + gr.PII_IDS, "legal": gr.LEGAL_IDS + gr.PII_IDS, "medical": gr.MEDICAL_IDS + gr.PII_IDS, "pii": gr.PII_IDS}
    first = "CASE kind " + " ".join(f"WHEN '{k}' THEN list_filter(ids, lambda i: {_in('i', v)})" for k, v in kinds.items()) + " END"
    return f"""
WITH c AS (SELECT *, {count(gr.HR_CONTEXT)} AS h, {count(gr.LEGAL_CONTEXT)} AS l, regexp_matches(text, {_quoted(gr.CPR_FORM)}) AS p FROM {MADE}),
x AS (SELECT *, CASE WHEN h >= 2 OR (h >= 1 AND l >= 1) THEN 'hr' WHEN l >= 2 THEN 'legal' WHEN h >= 1 AND p THEN 'hr' WHEN l >= 1 AND p THEN 'legal' WHEN p THEN 'pii' END AS context FROM c),
k AS (SELECT *, CASE WHEN cls IN ('doc.payroll', 'doc.hr_record') THEN 'hr' WHEN cls = 'doc.medical_record' THEN 'medical' WHEN cls = 'doc.legal_contract' THEN 'legal' WHEN cls = 'doc.insurance_policy' THEN 'pii'
  WHEN {_some(gr.HR_IDS)} OR ({_some(gr.PII_IDS)} AND cls IS NULL) THEN 'hr' WHEN {_some(gr.LEGAL_IDS)} THEN 'legal' END AS sure FROM x),
f AS (SELECT *, coalesce(sure, context) AS kind FROM k), g AS (SELECT *, {first} AS pref FROM f),
o AS (SELECT *, len(ids) > 1 AND {_some(gr.CARD_IDS)} AND kind IS NOT NULL AND (len(pref) > 0 OR sure IS NULL) AS acts, list_filter(ids, lambda i: NOT list_contains(pref, i) AND NOT ({_in("i", gr.CARD_IDS)})) AS rest,
  list_filter(ids, lambda i: NOT list_contains(pref, i) AND {_in("i", gr.CARD_IDS)}) AS cards FROM g),
r AS (SELECT *, CASE WHEN acts THEN list_concat(list_concat(pref, rest), cards) ELSE ids END AS ordered FROM o), m AS (SELECT *, coalesce(ordered[1] <> ids[1], FALSE) AS moved FROM r)
SELECT event_id, context, array_to_string(ordered, ',') AS ids, moved AS reordered, CASE WHEN moved THEN coalesce(pref[1], rest[1]) END AS promoted, CASE WHEN moved THEN cards[1] END AS demoted,
  CASE WHEN len(ids) <= 1 THEN '{gr.NO_DOMINANCE}' WHEN NOT ({_some(gr.CARD_IDS)}) THEN '{gr.NO_CARDS}' WHEN acts THEN CASE WHEN sure IS NULL THEN {_of("context", gr.INFERRED_RULES)} WHEN kind = 'medical' THEN '{gr.MEDICAL_RULE}'
    WHEN kind = 'legal' THEN '{gr.LEGAL_RULE}' ELSE '{gr.HR_RULE}' END ELSE '{gr.NO_DOMINANCE}' END AS rule_id FROM m"""


def guard_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("ids", F.lit(0))
    out = made(spark, sf_dir).withColumn("i", gr.identity(F.col("ids"), F.col("class")))
    return out.select("event_id", gr.domain_of(first).alias("family"), "i.confidence", "i.domain", "i.rule_id", gr.identity_label(first, F.col("i.confidence"), F.col("class")).alias("label"))


def _family(x: str) -> str:
    out = []
    for name, (primary, _, parts) in gr.DOMAINS.items():
        out.append(f"WHEN {_in(x, primary)} OR " + " OR ".join(f"contains(lower({x}), '{p}')" for p in parts) + f" THEN '{name}'")
    return "CASE " + " ".join(out) + " ELSE 'other' END"


def _identity_sql() -> str:
    held = {k: f"list_contains(fam, '{k}')" for k in gr.DOMAINS}
    own = {k: f"len(list_filter(ids, lambda i: {_in('i', v[0])}))" for k, v in gr.DOMAINS.items()}
    proven = " ".join(f"WHEN {held[k]} AND ({own[k]} >= 2 OR ({own[k]} >= 1 AND {_some(gr.DOMAINS[k][1])})) THEN '{k}'" for k in ("medical", "legal", "hr"))
    single = " ".join(f"WHEN {held[k]} THEN '{k}'" for k in ("medical", "legal", "hr"))
    strong, terms = ({k: v[i] for k, v in gr.IDENTITY_LABELS.items()} for i in (0, 1))
    return f"""
WITH f AS (SELECT *, list_transform(ids, lambda i: {_family("i")}) AS fam FROM {MADE}),
p AS (SELECT *, CASE {proven} END AS proven, CASE {single} END AS single, {" + ".join(f"{h}::int" for h in held.values())} AS n FROM f),
c AS (SELECT *, CASE WHEN cls IS NOT NULL OR proven IS NOT NULL OR n >= 2 THEN 'strong' WHEN single IS NOT NULL THEN 'weak' ELSE 'none' END AS confidence FROM p)
SELECT event_id, {_family("ids[1]")} AS family, confidence, CASE WHEN cls IS NOT NULL THEN coalesce({_of("cls", gr.CLASS_DOMAINS)}, 'other') WHEN proven IS NOT NULL THEN proven WHEN n >= 2 THEN NULL ELSE single END AS domain,
  CASE WHEN cls IS NOT NULL THEN 'IC-001-doc-class-confirmed' WHEN proven IS NOT NULL THEN 'IC-002-corroborated' WHEN n >= 2 THEN 'IC-005-multi-family-strong' WHEN single IS NOT NULL THEN 'IC-003-single-signal-weak' ELSE 'IC-004-no-domain-signals' END AS rule_id,
  CASE WHEN confidence = 'strong' OR cls IS NOT NULL THEN {_of("ids[1]", strong)} ELSE {_of("ids[1]", terms)} END AS label FROM c"""


def guard_context_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir).select("event_id", gr.contextual_cap(F.col("signals"), F.col("archetypes")).alias("c")).select("event_id", "c.*")


def _context_cap_sql() -> str:
    only = lambda r, known: f"len(list_filter(signals, lambda s: s.severity = '{sev.LEVELS[r]}' AND NOT coalesce({_in('s.id', known)}, FALSE))) = 0"
    ids = "list_transform(signals, lambda s: s.id)"
    context = " OR ".join(_some(k, ids) for k in (gr.MEDICAL_CONTEXT, gr.EMPLOYMENT_CONTEXT, gr.INSURANCE_CONTEXT)) + f" OR {_some(['medical_record', 'medical_health'], 'archetypes')}"
    return f"""
WITH t AS (SELECT *, greatest(coalesce(list_max(list_transform(signals, lambda s: {_rank("s.severity")})), 1), 1) AS top FROM {MADE}),
c AS (SELECT *, len(signals) > 0 AND ((top = 4 AND {only(4, gr.CAPPED_IDS)} AND ({context})) OR (top = 3 AND {only(3, gr.BIRTH_IDS)} AND {_some(gr.INSURANCE_CONTEXT, ids)}) OR (top = 2 AND list_contains(archetypes, 'resume_cv') AND {only(2, gr.INCIDENTAL_IDS)})) AS capped FROM t)
SELECT event_id, {_level("top - capped::int")} AS severity, capped, {_level("top")} AS raw FROM c"""


def guard_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    card, lead = _pick(CARDS, e % len(CARDS)), _pick(AROUND, u % len(AROUND))
    text = F.concat(lead, F.coalesce(card, F.lit("")))
    near = gr.near_card_words(text, F.length(lead), F.length(F.coalesce(card, F.lit(""))))
    id_ = _pick([s[0] for s in SIGNALS], (e * 3 + u) % len(SIGNALS))
    capped = gr.ladder(_pick(sev.LEVELS, F.floor(e / 2) % 5), id_, _pick(CONFIDENCES, u % 3), card, near)
    return tables.table(spark, sf_dir, "events").select("event_id", near.alias("near"), capped.alias("severity"))


def _ladder_sql() -> str:
    text = f"({_at(AROUND, f'user_id % {len(AROUND)}')} || coalesce({_at(CARDS, f'event_id % {len(CARDS)}')}, ''))"
    near = f"len(list_filter({_list(gr.CARD_WORDS)}, lambda w: contains(lower({text}), w))) > 0"
    most = "CASE WHEN conf = 'fallback' THEN 2 WHEN card IS NULL THEN CASE conf WHEN 'inferred' THEN 3 ELSE 4 END WHEN NOT good THEN 2 WHEN near AND conf = 'confirmed' THEN 4 ELSE 3 END"
    return f"""
WITH e AS (SELECT event_id, {near} AS near, {_at([s[0] for s in SIGNALS], f"(event_id * 3 + user_id) % {len(SIGNALS)}")} AS id, {_at(CONFIDENCES, "user_id % 3")} AS conf, {_at(CARDS, f"event_id % {len(CARDS)}")} AS card, event_id // 2 % 5 AS r FROM events),
g AS (SELECT *, card IN ('4111 1111 1111 1111', '5500 0000 0000 0004') AS good FROM e)
SELECT event_id, near, {_level(f"least(r, CASE WHEN coalesce({_in('id', gr.PAYMENT_IDS)}, FALSE) THEN {most} ELSE CASE conf WHEN 'fallback' THEN 2 WHEN 'inferred' THEN 3 ELSE 4 END END)")} AS severity FROM g"""


def guard_medical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    out = made(spark, sf_dir).withColumn("m", gr.medical_escalation(c("severity"), c("escalation"), c("class"), c("patient"), F.size("visible"), c("reference")))
    return out.select("event_id", "m.*")


MEDICAL_SQL = f"""
WITH a AS (SELECT *, coalesce(cls = 'doc.medical_record', FALSE) AS med, len(visible) = 0 AS unseen FROM {MADE}), b AS (SELECT *, med AND NOT reference AND patient AS acts FROM a)
SELECT event_id, CASE WHEN acts AND {_rank("severity")} < 3 THEN 'high' ELSE severity END AS severity, CASE WHEN acts THEN 'modal' ELSE escalation END AS escalation, CASE WHEN acts AND unseen THEN 'doc.medical_record' END AS rescued,
  acts AND ({_rank("severity")} < 3 OR escalation <> 'modal' OR unseen) AS escalated,
  CASE WHEN NOT med THEN 'MRE-011-not-medical' WHEN reference THEN 'MRE-012-clinical-reference-bypass' WHEN NOT patient THEN 'MRE-010-no-patient-context' ELSE 'MRE-001-severity-floor' END AS rule_id FROM b"""


def guard_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    out = made(spark, sf_dir).withColumn("v", gr.regulated_visibility(c("signals"), c("visible"), c("severity"), c("escalation")))
    return out.select("event_id", "v.*")


def _visibility_sql() -> str:
    prefixes = calibration.REGULATED_PREFIXES
    reg = lambda s: f"({_in(s + '.type', calibration.REGULATED_TYPES)} OR coalesce({' OR '.join(f'starts_with(lower({s}.id), {_quoted(p)})' for p in prefixes)}, FALSE))"
    spot = lambda s: "CASE " + " ".join(f"WHEN starts_with(lower({s}.id), {_quoted(p)}) THEN {k}" for k, p in enumerate(prefixes)) + f" ELSE {len(prefixes)} END"
    keys = ", ".join(f"CASE WHEN len(signals) >= {k} AND {reg(f'signals[{k}]')} THEN (4 - {_rank(f'signals[{k}].severity')}) * 10000 + ({spot(f'signals[{k}]')}) * 100 + {k} END" for k in (1, 2, 3))
    return f"""
WITH a AS (SELECT *, list_min([{keys}]) AS k, len(list_filter(visible, lambda s: {reg("s")})) > 0 AS seen FROM {MADE}),
b AS (SELECT *, k IS NOT NULL AS has_any, seen AND {_rank("severity")} >= 1 AS fine, CASE WHEN k IS NOT NULL AND NOT seen THEN signals[(k % 100)::int] END AS resc FROM a),
c AS (SELECT *, CASE WHEN has_any AND NOT fine THEN greatest(coalesce({_rank("resc.severity")}, 1), 1) ELSE 0 END AS least_ FROM b)
SELECT event_id, CASE WHEN {_rank("severity")} < least_ THEN {_level("least_")} ELSE severity END AS severity, CASE WHEN has_any AND escalation = 'none' THEN 'inline' ELSE escalation END AS escalation,
  CASE WHEN resc IS NOT NULL THEN coalesce(resc.id, 'legacy.' || resc.type) END AS rescued, has_any AND (escalation = 'none' OR resc IS NOT NULL OR {_rank("severity")} < least_) AS enforced,
  CASE WHEN NOT has_any THEN 'VGR-010-no-regulated' WHEN fine AND escalation = 'none' THEN 'VGR-003-escalation-floor' WHEN fine THEN 'VGR-011-already-visible' ELSE 'VGR-001-signal-rescued' END AS rule_id FROM c"""


def guard_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that still break a rule after enforcement: none."""
    c = F.col
    df = made(spark, sf_dir).withColumn("m", gr.medical_escalation(c("severity"), c("escalation"), c("class"), c("patient"), F.size("visible"), F.lit(False)))
    seen = F.size("visible") + F.when(c("m.rescued").isNotNull(), 1).otherwise(0)
    df = df.withColumn("medical", gr.medical_violations(c("m.severity"), c("m.escalation"), c("class"), c("patient"), seen))
    df = df.withColumn("v", gr.regulated_visibility(c("signals"), c("visible"), c("severity"), c("escalation")))
    shown = F.when(c("v.rescued").isNotNull(), F.concat("visible", F.array(F.struct(c("v.rescued").alias("id"), F.lit("pii").alias("type"), c("v.severity").alias("severity"))))).otherwise(c("visible"))
    df = df.withColumn("hidden", gr.visibility_violations(c("signals"), shown, c("v.severity"), c("v.escalation")))
    return df.where((F.size("medical") > 0) | (F.size("hidden") > 0)).select("event_id", F.size("medical").alias("medical"), F.size("hidden").alias("hidden"))


def guard_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    details = F.transform(F.filter("signals", lambda s: s["id"].isNotNull()), lambda s: F.struct(s["id"].alias("id"), s["severity"].alias("severity")))
    out = made(spark, sf_dir).withColumn("k", gr.consistent(details, F.slice("ids", 1, 1), c("severity")))
    first = F.get(details, F.lit(0))
    loud = F.coalesce(gr.alarming(first["severity"], c("severity"), c("patient")), F.lit(False))
    return out.select("event_id", F.array_join(F.transform("k.details", lambda d: F.concat_ws("=", d["id"], d["severity"])), ",").alias("details"), "k.downgraded", "k.violations", loud.alias("alarming"))


CONSISTENCY_SQL = f"""
WITH a AS (SELECT *, list_filter(signals, lambda s: s.id IS NOT NULL) AS ds, ids[1] AS drv, {_rank("severity")} AS r FROM {MADE})
SELECT event_id, array_to_string(list_transform(ds, lambda d: d.id || '=' || CASE WHEN {_rank("d.severity")} > r AND d.id <> drv THEN severity ELSE d.severity END), ',') AS details,
  len(list_filter(ds, lambda d: {_rank("d.severity")} > r AND d.id <> drv))::int AS downgraded, len(list_filter(ds, lambda d: {_rank("d.severity")} > r))::int AS violations,
  coalesce(patient AND ds[1].severity IN ('high', 'critical') AND severity IN ('high', 'critical'), FALSE) AS alarming FROM a"""


def policy_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanation and escalation by type and context: the first override that fits, else the default."""
    e, u = F.col("event_id"), F.col("user_id")
    picked = {name: _pick(values, (e + u * (k + 1)) % len(values)) for k, (name, values) in enumerate(CONTEXT.items())}
    df = tables.table(spark, sf_dir, "events").select("event_id", gr.signal_type(_pick(EXPLANATIONS, e % len(EXPLANATIONS))).alias("signal_type"), *[v.alias(k) for k, v in picked.items()])
    return gr.mapped(df).select("event_id", "signal_type", "explanation_id", "escalation")


def _mapping_sql() -> str:
    typed, default, raised = [], [], []
    for name, (explanation, escalation, overrides) in gr.MAPPINGS.items():
        for conditions, own, quiet in overrides:
            fits = " AND ".join(f"{k} = {_quoted(v)}" for k, v in conditions.items())
            default.append(f"WHEN t = '{name}' AND {fits} THEN {_quoted(own or explanation)}")
            raised.append(f"WHEN t = '{name}' AND {fits} THEN {_quoted(quiet or escalation)}")
        default.append(f"WHEN t = '{name}' THEN {_quoted(explanation)}")
        raised.append(f"WHEN t = '{name}' THEN {_quoted(escalation)}")
    typed = _of("x", gr.SIGNAL_TYPES)
    picked = ", ".join(f"{_at(values, f'(event_id + user_id * {k + 1}) % {len(values)}')} AS {name}" for k, (name, values) in enumerate(CONTEXT.items()))
    return f"""
WITH x AS (SELECT event_id, {_at(EXPLANATIONS, f"event_id % {len(EXPLANATIONS)}")} AS x, {picked} FROM events), y AS (SELECT *, coalesce({typed}, x) AS t FROM x)
SELECT event_id, t AS signal_type, CASE {" ".join(default)} WHEN t = '' THEN 'gen.generic' ELSE t END AS explanation_id, CASE {" ".join(raised)} ELSE 'inline' END AS escalation FROM y"""


def queries() -> dict[str, Query]:
    return {
        "guard_dominance": guard_dominance, "guard_identity": guard_identity, "guard_context_cap": guard_context_cap, "guard_ladder": guard_ladder, "guard_medical": guard_medical, "guard_visibility": guard_visibility,
        "guard_invariants": guard_invariants, "guard_consistency": guard_consistency, "policy_mapping": policy_mapping,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "guard_dominance": _dominance_sql(), "guard_identity": _identity_sql(), "guard_context_cap": _context_cap_sql(), "guard_ladder": _ladder_sql(), "guard_medical": MEDICAL_SQL, "guard_visibility": _visibility_sql(),
        "guard_invariants": "SELECT event_id, 1 AS medical, 1 AS hidden FROM events WHERE FALSE", "guard_consistency": CONSISTENCY_SQL, "policy_mapping": _mapping_sql(),
    }
