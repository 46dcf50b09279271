"""Policies as layers of data: a default, then overlays by locale, department and tenant, each a table of settings.

A layer's row gives settings of one signal for one scope. What holds for a signal is the fold of its
layers in order, later settings over earlier ones, and what no layer may undo (the invariants) over all.
Layers meet each distinct context once, so the joins are as small as the policies, not as the findings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import severity as sev

#: A row of a layer; a scope is a value of the column of the layer's name, null in the default layer.
LAYERS = "layer string, scope string, signal_id string, ord int, settings map<string, string>"
#: What holds in the end: such signals are enabled, at least so severe, and exactly critical where ``always``.
INVARIANTS = "signal_id string, least string, always boolean"
ORDER = ("locale", "department", "tenant")

# The first policy (signal, base severity, cap, hard floor, eased in transactional documents, thresholds).
SIGNALS_V1 = [
    ("api-key", "critical", None, True, False, None),
    ("aws-key", "critical", None, True, False, None),
    ("password", "critical", None, True, False, None),
    ("ssn", "critical", None, True, False, None),
    ("credit-card", "critical", None, True, False, None),
    ("confidential-marker", "high", None, True, False, None),
    ("ma-terms", "critical", None, True, False, None),
    ("legal-agreement", "high", None, False, False, None),
    ("phone", "low", "medium", False, True, '{"20": "medium"}'),
    ("email", "low", "medium", False, True, '{"10": "medium"}'),
    ("iban", "high", None, False, False, None),
    ("banking", "high", None, False, True, None),
    ("financial-data", "high", None, False, False, None),
    ("author-name", "low", "medium", False, False, None),
    ("company-name", "low", "low", False, False, None),
    ("employee-data", "high", None, False, False, None),
    ("ip-content", "critical", None, True, False, None),
    ("sensitive-dept", "high", None, False, False, None),
]
# From so many on, a level more, medium at most: e-mails and phones together; those and SSNs.
TOGETHER, TOGETHER_KEYS = 10, ["phone", "email"]
DENSE, DENSE_KEYS = 50, ["phone", "email", "ssn"]
# Phones from which on a locale lets them escalate; others as unknown.
PHONES = {"US": 20, "UK": 20, "EU-NORDICS": 50, "EU-DACH": 30, "EU-SOUTHERN": 25, "EU-WESTERN": 25, "EU-EASTERN": 25, "EN-COMMONWEALTH": 20, "LATAM": 25, "unknown": 20}


def default_layer(spark: SparkSession) -> DataFrame:
    """SIGNALS_V1 as a layer."""
    rows = []
    for name, base, most, floor, eased, thresholds in SIGNALS_V1:
        settings = {"enabled": "true", "baseSeverity": base, "hardFloor": str(floor).lower(), "transactionalDowngrade": str(eased).lower()}
        rows.append(("default", None, name, 0, settings | ({"maxSeverity": most} if most else {}) | ({"thresholds": thresholds} if thresholds else {})))
    return spark.createDataFrame(rows, LAYERS)


def merged(*maps: Column) -> Column:
    """Maps from left to right, later values over earlier ones; a null map changes nothing."""
    out = F.coalesce(maps[0], F.create_map().cast("map<string, string>"))
    for m in maps[1:]:
        out = F.map_zip_with(out, F.coalesce(m, F.create_map().cast("map<string, string>")), lambda _, a, b: F.coalesce(b, a))
    return out


def effective(contexts: DataFrame, layers: DataFrame, invariants: DataFrame | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """``contexts`` (signal_id and a column for each layer of ``order``) with their settings; null without a default.

    Of several rows for one layer, scope and signal the one with the smallest ord counts. A null scope
    of a context takes no overlay. The invariants come last.
    """
    one = layers.groupBy("layer", "scope", "signal_id").agg(F.min_by("settings", "ord").alias("settings"))
    rows = lambda name: one.where(F.col("layer") == name)
    out = contexts.join(rows("default").select("signal_id", F.col("settings").alias("__0")), "signal_id", "left")
    for i, name in enumerate(order, 1):
        overlay = rows(name).where(F.col("scope").isNotNull()).select(F.col("scope").alias(name), "signal_id", F.col("settings").alias(f"__{i}"))
        out = out.join(overlay, [name, "signal_id"], "left")
    out = out.withColumn("settings", F.when(F.col("__0").isNotNull(), merged(*[F.col(f"__{i}") for i in range(len(order) + 1)]))).select(*contexts.columns, "settings")
    if invariants is None:
        return out
    out = out.join(invariants.select("signal_id", F.col("least").alias("__least"), F.col("always").alias("__always")), "signal_id", "left")
    severity = F.when(F.col("__always"), "critical").otherwise(sev.level(F.greatest(sev.rank(F.col("settings")["baseSeverity"]), sev.rank(F.col("__least")))))
    forced = F.create_map(F.lit("enabled"), F.lit("true"), F.lit("baseSeverity"), severity)
    held = F.when(F.col("settings").isNotNull() & (F.col("__least").isNotNull() | F.col("__always")), merged(F.col("settings"), forced)).otherwise(F.col("settings"))
    return out.select(*contexts.columns, held.alias("settings"))


def with_settings(signals: DataFrame, layers: DataFrame, invariants: DataFrame | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """Signals (with policy_key and the columns of ``order``) and the settings that hold for each.

    Each distinct context is worked out once and joined back; null values of a context equal each other.
    """
    contexts = signals.where("policy_key is not null").select(F.col("policy_key").alias("signal_id"), *order).distinct()
    known = effective(contexts, layers, invariants, order)
    right = known.select(F.col("signal_id").alias("__s"), *[F.col(c).alias(f"__c_{c}") for c in order], "settings")
    same = F.col("policy_key") == F.col("__s")
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"__c_{c}"))
    return signals.join(right, same, "left").select(*signals.columns, "settings")


def apply_v1(signals: DataFrame, layers: DataFrame, invariants: DataFrame | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """The first policy over layered settings: signals with policy_severity; those of disabled kinds go.

    Reads severity, description, phone_count, email_count, ssn_count, transactional and the columns of
    ``order`` (of which locale). In order: base severity (or at least that, with a hard floor), thresholds of counts (phones where their
    locale lets them), together, density, transactional, cap, floor. SSNs outside the US are low.
    Signals without settings keep their severity.
    """
    keyed = with_settings(signals.withColumn("policy_key", sev.pattern_key(F.col("description"))), layers, invariants, order)
    s, key = F.col("settings"), F.col("policy_key")
    flag = lambda name: F.coalesce(s[name] == "true", F.lit(False))
    own, base, floor = sev.rank(F.col("severity")), sev.rank(s["baseSeverity"]), flag("hardFloor")
    r = F.when(floor, F.greatest(own, base)).otherwise(base)
    count = F.when(key == "phone", F.col("phone_count")).when(key == "email", F.col("email_count")).otherwise(1)
    steps = F.filter(F.map_entries(F.from_json(s["thresholds"], "map<string, string>")), lambda e: count >= e["key"].cast("int"))
    reached = F.array_max(F.transform(steps, lambda e: F.struct(e["key"].cast("int").alias("at"), sev.rank(e["value"]).alias("r"))))["r"]
    phones = F.coalesce(sev._by_policy(F.col("locale"), PHONES), F.lit(PHONES["unknown"]))
    r = F.when((key != "phone") | (F.col("phone_count") >= phones), F.greatest(r, F.coalesce(reached, F.lit(0)))).otherwise(r)
    both = F.col("email_count") + F.col("phone_count")
    r = F.when((both >= TOGETHER) & key.isin(*TOGETHER_KEYS), sev.cap(sev.bump(r, 1), 2)).otherwise(r)
    r = F.when((both + F.col("ssn_count") >= DENSE) & key.isin(*DENSE_KEYS), sev.cap(sev.bump(r, 1), 2)).otherwise(r)
    r = F.when(F.col("transactional") & flag("transactionalDowngrade") & ~floor, sev.reduce(r, 1)).otherwise(r)
    r = F.when(s["maxSeverity"].isNotNull(), F.least(r, sev.rank(s["maxSeverity"]))).otherwise(r)
    r = F.when(floor, F.greatest(r, base)).otherwise(r)
    abroad = (key == "ssn") & F.coalesce(~F.col("locale").isin("US", "unknown"), F.lit(False))
    result = F.when(abroad, "low").when(s.isNull(), F.col("severity")).otherwise(sev.level(r))
    return keyed.where(s.isNull() | flag("enabled")).withColumn("policy_severity", result).drop("settings")


# --- validation -----------------------------------------------------------------------------------------

# What a policy may name.
SEVERITIES = ["low", "medium", "high", "critical"]
LOCALES = ["US", "UK", "EU-NORDICS", "EU-DACH", "EU-SOUTHERN", "EU-WESTERN", "EU-EASTERN", "EN-COMMONWEALTH", "LATAM", "unknown"]
DEPARTMENTS = ["engineering", "legal", "finance", "hr", "marketing", "sales", "operations", "executive", "security", "compliance", "default"]

# Fields of each part of a policy (field, kind, required, always an error). Others are errors in strict mode only.
FIELDS: dict[str, list[tuple[str, str, bool, bool]]] = {
    "root": [
        ("version", "version", True, True), ("name", "string", True, True), ("description", "string", False, False), ("signals", "object", True, True), ("localeOverrides", "array", True, True),
        ("departmentOverrides", "array", True, True), ("cooccurrenceRules", "array", True, True), ("invariants", "object", True, True),
    ],
    "signal": [
        ("enabled", "boolean", True, True), ("baseSeverity", "severity", True, True), ("maxSeverity", "severity", False, False), ("escalatedSeverity", "severity", False, False),
        ("minCount", "number", False, False), ("escalationThreshold", "number", False, False), ("mandatory", "boolean", False, False),
    ],
    "locale": [("locale", "string", True, True), ("locale", "locale", False, False), ("signals", "object", False, True), ("phone", "object", False, False), ("nationalId", "object", False, False)],
    "department": [("department", "string", True, True), ("department", "department", False, False), ("signals", "object", False, True), ("dictionaries", "object", False, False)],
    "rule": [
        ("id", "string", True, True), ("description", "string", True, True), ("requires", "array", True, True), ("escalates", "array", True, True), ("severityBump", "number", True, True),
        ("maxSeverity", "severity", True, True), ("enabled", "boolean", True, True),
    ],
    "require": [("signalId", "string", True, True), ("minCount", "number", True, True)],
    "invariants": [("mandatorySignals", "array", True, True), ("mandatoryMinSeverity", "severity", True, True), ("alwaysCritical", "array", True, True)],
}
WARNING_ONLY = {("root", "description")}


def _kind(v: Column) -> Column:
    """object, array, string, boolean, number or null of a variant; SQL null where the value is missing."""
    # asked once: the type's first word, looked up
    names = F.create_map(*[F.lit(x) for pair in (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null")) for x in pair])
    return F.coalesce(F.try_element_at(names, F.substring_index(F.schema_of_variant(v), "<", 1)), F.when(v.isNotNull(), "number"))


def _allowed(kind: str, v: Column) -> Column:
    """Whether a value that is there is of a kind; lists of names hold for strings."""
    named = {"version": ["1.0"], "severity": SEVERITIES, "locale": LOCALES, "department": DEPARTMENTS}
    if kind not in named:
        return _kind(v) == kind
    text = F.when(_kind(v) == "string", F.try_variant_get(v, "$", "string"))
    known = F.coalesce(text.isin(*named[kind]), F.lit(False))
    # a locale or department that is no string is told of by the field's other check
    return known | (_kind(v) != "string") if kind in ("locale", "department") else known


def _checked(part: Column, kind: str, strict: bool) -> Column:
    """Violations of the fields of a part (path, v): array of (path, rule, level, key); a part that is no object is one."""
    path, checks = part["path"], []
    for field, allowed, required, hard in FIELDS[kind]:
        v = F.try_variant_get(part["v"], f"$.{field}", "variant")
        wrong = F.when(v.isNull(), F.lit(required)).otherwise(~_allowed(allowed, v))
        level = "warning" if (kind, field) in WARNING_ONLY else "error" if hard or strict else "warning"
        checks.append(F.when(wrong, _fault(F.when(path == "", field).otherwise(F.concat(path, F.lit(f".{field}"))), allowed, level)))
    return F.when(_kind(part["v"]) == "object", F.array_compact(F.array(*checks))).otherwise(F.array(_fault(path, "object", "error")))


def _fault(path: Column, rule: str, level: str, key: Column | None = None) -> Column:
    return F.struct(path.alias("path"), F.lit(rule).alias("rule"), F.lit(level).alias("level"), (F.lit(None).cast("string") if key is None else key).alias("key"))


def _member(path: Column, v: Column, key: Column | None = None) -> Column:
    return F.struct(path.alias("path"), v.alias("v"), (F.lit(None).cast("string") if key is None else key).alias("key"))


def _inside(part: Column, field: str, kind: str) -> Column:
    """The members of an object or elements of an array in ``field`` of a part: array of parts with paths of their own."""
    v = F.try_variant_get(part["v"], f"$.{field}", "variant")
    prefix = F.when(part["path"] == "", field).otherwise(F.concat(part["path"], F.lit(f".{field}")))
    if kind == "object":
        members = F.map_entries(F.try_variant_get(v, "$", "map<string, variant>"))
        inside = F.transform(members, lambda e: _member(F.concat(prefix, F.lit("."), e["key"]), e["value"], e["key"]))
    else:
        inside = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e, i: _member(F.concat(prefix, F.lit("["), i.cast("string"), F.lit("]")), e))
    return F.when(_kind(v) == kind, inside).otherwise(F.array().cast(PARTS))


def _placed(kind: str, parts: Column) -> Column:
    return F.transform(parts, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("part")))


PARTS = "array<struct<path: string, v: variant, key: string>>"
PLACED = "array<struct<kind: string, part: struct<path: string, v: variant, key: string>>>"


def violations(policies: DataFrame, strict: bool = True, known_signals: DataFrame | None = None) -> DataFrame:
    """What is wrong with policies (policy_id, policy: JSON text or variant): policy_id, path, rule, level, a row each.

    Rules are the kinds a field must be of (a name of a list for version, severity, locale, department),
    ``not disabled`` and ``critical`` for signals that the policy's own invariants protect, and ``known``
    for signals that are not in ``known_signals`` (signal_id), an anti join. Outside strict mode what is
    optional or unknown is a warning. Text that is not JSON, and anything but an object, is one violation
    of the whole. A null policy is no object.

    One narrow pass parses each policy once and deals its parts out as rows, which are checked by their kind.
    """
    v = F.col("policy") if policies.schema["policy"].dataType.typeName() == "variant" else F.try_parse_json("policy")
    one = lambda c: F.explode_outer(F.array(c))  # noqa: E731  # what is read often is spelled once
    out = policies.select("policy_id", one(_member(F.lit(""), F.coalesce(v, F.parse_json(F.lit("null"))))).alias("root"))
    root = F.col("root")
    out = out.withColumn("parts", one(F.struct(
        _inside(root, "signals", "object").alias("signal"), _inside(root, "localeOverrides", "array").alias("locale"), _inside(root, "departmentOverrides", "array").alias("department"),
        _inside(root, "cooccurrenceRules", "array").alias("rule"), _member(F.lit("invariants"), F.try_variant_get(root["v"], "$.invariants", "variant")).alias("invariants"),
    )))
    parts = F.col("parts")
    has = _kind(parts["invariants"]["v"]) == "object"
    # names that the invariants protect; null, which holds nobody, where there are none
    named = lambda field: F.when(has, F.array_compact(F.transform(_inside(parts["invariants"], field, "array"), lambda p: F.try_variant_get(p["v"], "$", "string"))))
    placed = [_placed("root", F.array(root)), *[_placed(k, parts[k]) for k in ("signal", "locale", "department", "rule")], _placed("require", F.flatten(F.transform(parts["rule"], lambda p: _inside(p, "requires", "array")))), F.when(has, _placed("invariants", F.array(parts["invariants"]))).otherwise(F.array().cast(PLACED))]
    out = out.select("policy_id", named("mandatorySignals").alias("mandatory"), named("alwaysCritical").alias("critical"), F.explode_outer(F.concat(*placed)).alias("part"))
    part, kind = F.col("part.part"), F.col("part.kind")
    own = [_checked(part, "signal", strict)]
    enabled, base = F.try_variant_get(part["v"], "$.enabled", "boolean"), F.try_variant_get(part["v"], "$.baseSeverity", "string")
    for names, rule, broken in (("mandatory", "not disabled", ~enabled), ("critical", "critical", base != "critical")):
        own.append(F.array_compact(F.array(F.when(F.array_contains(names, part["key"]) & broken, _fault(part["path"], rule, "error")))))
    if known_signals is not None:
        own.append(F.array(_fault(part["path"], "known", "error" if strict else "warning", part["key"])))
    found = F.when(kind == "signal", F.concat(*own))
    for k in FIELDS:
        if k != "signal":
            found = found.when(kind == k, _checked(part, k, strict))
    rows = out.select("policy_id", F.explode_outer(found).alias("x")).where("x is not null").select("policy_id", "x.*")
    if known_signals is not None:
        # only signals have a key; other rows take part by a number that no known signal has, so that they stay dealt out
        aside = F.when(F.col("key").isNull(), F.pmod(F.xxhash64("policy_id", "path"), F.lit(1 << 20)) + 1).otherwise(0)
        known = known_signals.select(F.col("signal_id").alias("__signal"), F.lit(0).cast("long").alias("__none"))
        rows = rows.withColumn("__aside", aside)
        rows = rows.join(known, (F.coalesce("key", F.lit("")) == known["__signal"]) & (rows["__aside"] == known["__none"]), "left_anti")
    return rows.select("policy_id", "path", "rule", "level")


def validated(policies: DataFrame, strict: bool = True, known_signals: DataFrame | None = None) -> DataFrame:
    """policy_id, ok, errors, warnings and use_default: whether the default policy takes the place of a broken one."""
    found = violations(policies, strict, known_signals).groupBy(F.col("policy_id").alias("of")).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    out = policies.select("policy_id").join(found, F.col("policy_id").eqNullSafe(F.col("of")), "left").na.fill(0, ["errors", "warnings"])
    ok = F.col("errors") == 0
    return out.select("policy_id", ok.alias("ok"), "errors", "warnings", (~ok & F.lit(strict)).alias("use_default"))
