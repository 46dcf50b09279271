"""Queries of layered policies over signals found in documents, and of the validation of policies made from events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics, policies
from ..sources import tables

Query = Callable[[SparkSession, str], DataFrame]

EMAIL, PHONE, SSN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\+[0-9][0-9 ()-]{6,}[0-9]", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

#: Overlays by locale, department and tenant that disagree with the default and with each other.
OVERLAYS = [
    ("locale", "EU-DACH", "email", 0, {"baseSeverity": "medium", "maxSeverity": "high"}),
    ("locale", "EU-DACH", "email", 1, {"baseSeverity": "critical"}),
    ("locale", "LATAM", "legal-agreement", 0, {"baseSeverity": "low"}),
    ("locale", "EU-WESTERN", "banking", 0, {"enabled": "false"}),
    ("locale", "US", "financial-data", 0, {"baseSeverity": "critical", "maxSeverity": "high"}),
    ("department", "legal", "legal-agreement", 0, {"baseSeverity": "critical", "hardFloor": "true"}),
    ("department", "legal", "email", 0, {"baseSeverity": "low", "thresholds": '{"2": "high", "1": "medium"}'}),
    ("department", "finance", "banking", 0, {"enabled": "true", "baseSeverity": "critical"}),
    ("department", "finance", "phone", 0, {"transactionalDowngrade": "false", "baseSeverity": "medium"}),
    ("department", "hr", "financial-data", 0, {"enabled": "false"}),
]
INVARIANTS = [("api-key", "high", True), ("credit-card", "high", False), ("banking", "high", False)]


def document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of whole texts, with what the policy asks about their documents."""
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    n = lambda regex: F.regexp_count("text", F.lit(regex))
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    facts = docs.select(
        "doc_id", "text", F.col("source").alias("tenant"), F.element_at(F.create_map(*[F.lit(x) for x in ("en", "US", "de", "EU-DACH", "fr", "EU-WESTERN", "es", "LATAM")]), F.col("lang")).alias("locale"),
        F.when(number < 5, "legal").when(number < 10, "finance").when(number < 15, "hr").alias("department"), n(EMAIL).alias("email_count"), n(PHONE).alias("phone_count"), n(SSN).alias("ssn_count"), F.col("text").rlike("[0-9][.,][0-9]{2}").alias("transactional"),
    )
    hit = lambda regex, description, severity: F.when(F.col("text").rlike(regex), F.struct(F.lit(description).alias("description"), F.lit(severity).alias("severity")))
    counted = lambda column, what: F.when(F.col(column) > 0, F.struct(F.concat(F.col(column).cast("string"), F.lit(what)).alias("description"), F.lit("low").alias("severity")))
    hits = F.array_compact(F.array(
        counted("email_count", " email addresses"), counted("phone_count", " phone numbers"), hit(SSN, "SSN pattern detected", "critical"), hit(r"(?i)(?:token|api[_-]?key)\s*[:=]", "API key pattern", "high"),
        hit(r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "Payment card pattern", "medium"), hit(r"(?i)licen[cs]e|copyright", "Legal agreement", "medium"), hit(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "Routing addresses", "low"),
        hit(r"[0-9]{5,}", "Revenue figures", "low"), hit(r"[#$%&*|]{2,}", "Unnamed marks", "low"),
    ))
    return facts.select(*[c for c in facts.columns if c != "text"], F.explode(hits).alias("s")).select("*", "s.*").drop("s")


def policy_layers(spark: SparkSession, sf_dir: str, signals: DataFrame | None = None) -> DataFrame:
    """The first policy over four layers that disagree; each source is a tenant with an overlay of its own number."""
    tenants = tables.table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int").alias("n")).where("n is not null").distinct()
    level = F.when(F.col("n") % 3 == 0, "high").when(F.col("n") % 3 == 1, "medium").otherwise("low")
    own = tenants.select(F.lit("tenant").alias("layer"), "scope", F.lit("api-key").alias("signal_id"), F.lit(0).alias("ord"), F.create_map(F.lit("enabled"), F.lit("false")).alias("settings")).union(
        tenants.select(F.lit("tenant"), "scope", F.lit("email"), F.lit(0), F.create_map(F.lit("maxSeverity"), level)))
    layers = policies.default_layer(spark).union(spark.createDataFrame(OVERLAYS, policies.LAYERS)).union(own)
    found = document_signals(spark, sf_dir) if signals is None else signals
    out = policies.apply_v1(found, layers, spark.createDataFrame(INVARIANTS, policies.INVARIANTS))
    return out.select("doc_id", "description", "severity", "locale", "department", "tenant", "policy_key", "policy_severity")


def boundary_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals at the four boundaries of one run, counted as they pass: severities found, then decided, one of each a document, shown from medium on."""
    counters = diagnostics.Counters("documents", ("low", "medium", "high", "critical"))
    found = counters.watch(document_signals(spark, sf_dir), "detection", "severity")
    decided = counters.watch(policy_layers(spark, sf_dir, found), "policy", "policy_severity")
    once = counters.watch(decided.dropDuplicates(["doc_id", "policy_severity"]), "dedup", "policy_severity")
    shown = counters.watch(once, "shown", "policy_severity", F.col("policy_severity") != "low")
    shown.write.format("noop").mode("overwrite").save()
    return counters.table(spark)


#: Settings one by one, the layers of one scope in order: the last that says something holds.
LAYERS_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source AS tenant, try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n,
    CASE lang WHEN 'en' THEN 'US' WHEN 'de' THEN 'EU-DACH' WHEN 'fr' THEN 'EU-WESTERN' WHEN 'es' THEN 'LATAM' END AS locale,
    len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails,
    len(regexp_extract_all(text, '\+[0-9][0-9 ()-]{6,}[0-9]')) AS phones,
    len(regexp_extract_all(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}')) AS ssns,
    regexp_matches(text, '[0-9][.,][0-9]{2}') AS eased
  FROM documents
), f AS (SELECT *, CASE WHEN n < 5 THEN 'legal' WHEN n < 10 THEN 'finance' WHEN n < 15 THEN 'hr' END AS department FROM d
), s AS (
  SELECT *, emails || ' email addresses' AS description, 1 AS own, 'email' AS key FROM f WHERE emails > 0
  UNION ALL SELECT *, phones || ' phone numbers', 1, 'phone' FROM f WHERE phones > 0
  UNION ALL SELECT *, 'SSN pattern detected', 4, 'ssn' FROM f WHERE ssns > 0
  UNION ALL SELECT *, 'API key pattern', 3, 'api-key' FROM f WHERE regexp_matches(text, '(?i)(?:token|api[_-]?key)\s*[:=]')
  UNION ALL SELECT *, 'Payment card pattern', 2, 'credit-card' FROM f WHERE regexp_matches(text, '[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}')
  UNION ALL SELECT *, 'Legal agreement', 2, 'legal-agreement' FROM f WHERE regexp_matches(text, '(?i)licen[cs]e|copyright')
  UNION ALL SELECT *, 'Routing addresses', 1, 'banking' FROM f WHERE regexp_matches(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}')
  UNION ALL SELECT *, 'Revenue figures', 1, 'financial-data' FROM f WHERE regexp_matches(text, '[0-9]{5,}')
  UNION ALL SELECT *, 'Unnamed marks', 1, NULL FROM f WHERE regexp_matches(text, '[#$%&*|]{2,}')
), base AS (
  SELECT *,
    CASE key WHEN 'email' THEN CASE WHEN department = 'legal' THEN 1 WHEN locale = 'EU-DACH' THEN 2 ELSE 1 END
      WHEN 'phone' THEN CASE WHEN department = 'finance' THEN 2 ELSE 1 END WHEN 'ssn' THEN 4 WHEN 'api-key' THEN 4 WHEN 'credit-card' THEN 4
      WHEN 'legal-agreement' THEN CASE WHEN department = 'legal' THEN 4 WHEN locale = 'LATAM' THEN 1 ELSE 3 END
      WHEN 'banking' THEN CASE WHEN department = 'finance' THEN 4 ELSE 3 END
      WHEN 'financial-data' THEN CASE WHEN locale = 'US' THEN 4 ELSE 3 END END AS b,
    CASE key WHEN 'email' THEN CASE WHEN n % 3 = 0 THEN 3 WHEN n % 3 = 1 THEN 2 WHEN n % 3 = 2 THEN 1 WHEN locale = 'EU-DACH' THEN 3 ELSE 2 END
      WHEN 'phone' THEN 2 WHEN 'financial-data' THEN CASE WHEN locale = 'US' THEN 3 ELSE 4 END ELSE 4 END AS most,
    key IN ('ssn', 'api-key', 'credit-card') OR (key = 'legal-agreement' AND coalesce(department = 'legal', FALSE)) AS hard,
    CASE key WHEN 'email' THEN eased WHEN 'phone' THEN eased AND coalesce(department <> 'finance', TRUE) WHEN 'banking' THEN eased ELSE FALSE END AS ease,
    CASE WHEN key = 'financial-data' THEN coalesce(department <> 'hr', TRUE) ELSE TRUE END AS enabled
  FROM s
), started AS (SELECT *, CASE WHEN hard THEN greatest(own, b) ELSE b END AS r0 FROM base
), stepped AS (
  SELECT *, CASE
    WHEN key = 'email' AND coalesce(department = 'legal', FALSE) THEN greatest(r0, CASE WHEN emails >= 2 THEN 3 WHEN emails >= 1 THEN 2 ELSE 0 END)
    WHEN key = 'email' AND emails >= 10 THEN greatest(r0, 2)
    WHEN key = 'phone' AND phones >= 20 AND phones >= CASE locale WHEN 'EU-DACH' THEN 30 WHEN 'EU-WESTERN' THEN 25 WHEN 'LATAM' THEN 25 ELSE 20 END THEN greatest(r0, 2)
    ELSE r0 END AS r1 FROM started
), bumped AS (SELECT *, CASE WHEN emails + phones >= 10 AND key IN ('phone', 'email') THEN least(least(r1 + 1, 4), 2) ELSE r1 END AS r2 FROM stepped
), dense AS (SELECT *, CASE WHEN emails + phones + ssns >= 50 AND key IN ('phone', 'email', 'ssn') THEN least(least(r2 + 1, 4), 2) ELSE r2 END AS r3 FROM bumped
), last AS (SELECT *, least(CASE WHEN ease AND NOT hard THEN greatest(r3 - 1, 1) ELSE r3 END, most) AS r4 FROM dense
), done AS (SELECT *, CASE WHEN key IS NULL THEN own WHEN key = 'ssn' AND coalesce(locale NOT IN ('US', 'unknown'), FALSE) THEN 1 WHEN hard THEN greatest(r4, b) ELSE r4 END AS r FROM last)
SELECT doc_id, description, (['low', 'medium', 'high', 'critical'])[own] AS severity, locale, department, tenant, key AS policy_key, (['low', 'medium', 'high', 'critical'])[r] AS policy_severity
FROM done WHERE enabled OR key IS NULL
"""


def _counters_sql() -> str:
    found, decided = LAYERS_SQL.split(", base AS (")[0] + " SELECT (['low', 'medium', 'high', 'critical'])[own] AS x FROM s", f"SELECT policy_severity AS x FROM ({LAYERS_SQL})"
    once = f"SELECT DISTINCT doc_id, policy_severity AS x FROM ({LAYERS_SQL})"
    parts = []
    for boundary, rows in (("detection", found), ("policy", decided), ("dedup", once), ("shown", once)):
        parts += [f"SELECT '{boundary}' AS boundary, x AS id, count(*) AS n FROM ({rows}) GROUP BY x", f"SELECT '{boundary}', 'total', count(*) FROM ({rows})"]
    return f"SELECT 'documents' AS run, boundary, id, n FROM ({' UNION ALL '.join(parts)} UNION ALL SELECT 'shown', 'visible', count(*) FROM ({once}) WHERE x <> 'low')"


def made_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy for each event, right or wrong by the event's value, type and properties."""
    return tables.spread(tables.table(spark, sf_dir, "events")).select(F.col("event_id").alias("policy_id"), F.expr(POLICY_EXPR).alias("policy"))


#: JSON text of a policy, in SQL that both engines read alike.
POLICY_EXPR = """concat(
  '{"version": ', CASE WHEN value < 4 THEN '2' WHEN value < 8 THEN '"2.0"' ELSE '"1.0"' END,
  ', "name": ', CASE WHEN event_type = 'error' THEN 'null' ELSE concat('"', event_type, '"') END,
  CASE WHEN value < 12 THEN ', "description": 7' ELSE '' END,
  ', "signals": ', CASE WHEN value > 250 THEN '[]' ELSE concat('{"', event_type, '.a": {"enabled": ', CASE WHEN value < 30 THEN 'true' WHEN value < 60 THEN 'false' ELSE '"yes"' END,
    ', "baseSeverity": ', CASE WHEN value < 15 THEN '"critical"' WHEN value < 45 THEN '"low"' WHEN value < 80 THEN '"grave"' ELSE '3' END,
    CASE WHEN value < 25 THEN ', "maxSeverity": "high"' WHEN value < 50 THEN ', "maxSeverity": null' ELSE '' END,
    ', "minCount": ', CASE WHEN value < 70 THEN '2.5' ELSE '"2"' END, '}, "click.b": ', CASE WHEN value < 100 THEN '{"enabled": true, "baseSeverity": "high", "mandatory": 1}' ELSE '"none"' END, '}') END,
  ', "localeOverrides": [', CASE WHEN value < 20 THEN '{"locale": "US", "phone": {}}' WHEN value < 40 THEN '{"locale": "XX", "signals": []}, {"locale": 1}, 5' ELSE '' END, ']',
  ', "departmentOverrides": ', CASE WHEN value < 35 THEN '[{"department": "hr"}, {"department": "moon", "dictionaries": "d"}]' ELSE props END,
  ', "cooccurrenceRules": [{"id": "r", "description": "d", "requires": [{"signalId": "s", "minCount": 1}', CASE WHEN value < 10 THEN ', {"signalId": 5}, "x"' ELSE '' END, '], "escalates": [], "severityBump": 1, "maxSeverity": "medium", "enabled": true}',
    CASE WHEN value > 90 THEN ', {"requires": {}, "maxSeverity": "none"}' ELSE '' END, ']',
  ', "invariants": ', CASE WHEN event_type = 'view' THEN props ELSE '{"mandatorySignals": ["click.a", "click.b"], "mandatoryMinSeverity": "high", "alwaysCritical": ["click.a", "click.b"]}' END,
  CASE WHEN value > 300 THEN '' ELSE '}' END)"""


def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("click.a",), ("view.a",), ("click.b",)], "signal_id string")
    return policies.violations(made_policies(spark, sf_dir), known_signals=known)


def _violations_sql() -> str:
    kinds = {
        "string": "json_type({v}) = 'VARCHAR'", "object": "json_type({v}) = 'OBJECT'", "array": "json_type({v}) = 'ARRAY'", "boolean": "json_type({v}) = 'BOOLEAN'", "number": "json_type({v}) IN ('UBIGINT', 'BIGINT', 'DOUBLE')",
        "version": "coalesce({v} = '\"1.0\"', FALSE)", "severity": "{v}::VARCHAR IN ('\"low\"', '\"medium\"', '\"high\"', '\"critical\"')", "locale": "json_type({v}) <> 'VARCHAR' OR {v}::VARCHAR IN ('\"US\"', '\"UK\"')",
        "department": "json_type({v}) <> 'VARCHAR' OR {v}::VARCHAR IN ('\"hr\"', '\"legal\"')",
    }
    # part: fields that must be there, and fields that may
    fields = {
        "root": ("version:version name:string signals:object localeOverrides:array departmentOverrides:array cooccurrenceRules:array invariants:object", "description:string"),
        "signals": ("enabled:boolean baseSeverity:severity", "maxSeverity:severity escalatedSeverity:severity minCount:number escalationThreshold:number mandatory:boolean"),
        "locales": ("locale:string", "locale:locale signals:object phone:object nationalId:object"),
        "departments": ("department:string", "department:department signals:object dictionaries:object"),
        "rules": ("id:string description:string requires:array escalates:array severityBump:number maxSeverity:severity enabled:boolean", ""),
        "requires": ("signalId:string minCount:number", ""),
        "inv": ("mandatorySignals:array mandatoryMinSeverity:severity alwaysCritical:array", ""),
    }
    parts = []
    for part, (must, may) in fields.items():
        parts.append(f"SELECT policy_id, path, 'object' AS rule, 'error' AS level FROM {part} WHERE coalesce(json_type(v), 'NULL') <> 'OBJECT'")
        for needed, listed in ((True, must), (False, may)):
            for field, kind in (x.split(":") for x in listed.split()):
                v = f"json_extract(v, '$.{field}')"
                wrong = f"CASE WHEN {v} IS NULL THEN {needed} ELSE NOT coalesce({kinds[kind].format(v=v)}, FALSE) END"
                level = "warning" if (part, field) == ("root", "description") else "error"
                path = f"CASE WHEN path = '' THEN '{field}' ELSE path || '.{field}' END"
                parts.append(f"SELECT policy_id, {path}, '{kind}', '{level}' FROM {part} WHERE json_type(v) = 'OBJECT' AND {wrong}")
    elements = lambda of, field, name: f"SELECT policy_id, CASE WHEN path = '' THEN '' ELSE path || '.' END || '{field}[' || i || ']' AS path, json_extract(v, '$.{field}[' || i || ']') AS v FROM (SELECT policy_id, path, v, unnest(range(json_array_length(v, '$.{field}')::BIGINT)) AS i FROM {of} WHERE json_type(v, '$.{field}') = 'ARRAY')"
    named = lambda field: f"(SELECT policy_id, json_extract_string(v, '$') AS key FROM ({elements('inv', field, 'n')}))"
    return f"""
WITH made AS (SELECT event_id AS policy_id, {POLICY_EXPR} AS policy FROM events
), root AS (SELECT policy_id, '' AS path, CASE WHEN json_valid(policy) THEN policy::JSON END AS v FROM made
), members AS (SELECT policy_id, key, value AS v FROM root, json_each(CASE WHEN json_type(v, '$.signals') = 'OBJECT' THEN json_extract(v, '$.signals') ELSE '{{}}'::JSON END)
), signals AS (SELECT policy_id, 'signals.' || key AS path, key, v FROM members
), locales AS ({elements("root", "localeOverrides", "l")}
), departments AS ({elements("root", "departmentOverrides", "d")}
), rules AS ({elements("root", "cooccurrenceRules", "r")}
), requires AS ({elements("rules", "requires", "q")}
), inv AS (SELECT policy_id, 'invariants' AS path, json_extract(v, '$.invariants') AS v FROM root WHERE json_type(v, '$.invariants') = 'OBJECT')
{" UNION ALL ".join(parts)}
UNION ALL SELECT policy_id, path, 'not disabled', 'error' FROM signals WHERE json_extract(v, '$.enabled')::VARCHAR = 'false' AND (policy_id, key) IN {named("mandatorySignals")}
UNION ALL SELECT policy_id, path, 'critical', 'error' FROM signals WHERE json_extract_string(v, '$.baseSeverity') <> 'critical' AND (policy_id, key) IN {named("alwaysCritical")}
UNION ALL SELECT policy_id, path, 'known', 'error' FROM signals WHERE key NOT IN ('click.a', 'view.a', 'click.b')
"""


def queries() -> dict[str, Query]:
    return {"policy_layers": policy_layers, "policy_violations": policy_violations, "boundary_counters": boundary_counters}


def oracle_sql() -> dict[str, str]:
    return {"policy_layers": LAYERS_SQL, "policy_violations": _violations_sql(), "boundary_counters": _counters_sql()}
