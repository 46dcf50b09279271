"""What a reader would do with findings: promote near anchors and lists, suppress headers, footers and boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Anchors, identifiers that context can promote, legal boilerplate and markers, and the zones' sizes.
ANCHORS = ["secret.api_key", "secret.aws_key", "secret.password", "secret.private_key", "secret.bearer_token", "secret.connection_string", "secrets.api_key", "secrets.aws_key", "pii.credit_card", "financial.credit_card", "confidential.ma_terms"]
PROMOTABLE = ["pii.email", "pii.phone", "pii.name", "pii.employee", "financial.swift", "financial.bic", "financial.iban", "metadata.author", "metadata.creator"]
LEGAL = ['legal.contract', 'legal.agreement', 'legal.nda', 'legal.privileged', 'dictionary.legal']
MARKERS = ['confidential.marker', 'confidential.ma', 'confidential.ma_terms']
REACH, HEADER, FOOTER, BOILERPLATE, LIST_LEAST, LIST_SPAN = 200, 1500, 1500, 3, 5, 2000


def apply_heuristics(signals: DataFrame, acts: Column | None = None) -> DataFrame:
    """Adds promoted, suppressed and rule to signals with doc_id, id, severity, source, match, offset, doc_length.

    In order: nearness to an anchor promotes; header, footer and metadata zones suppress; lists of many
    different addresses promote (e-mails, else phones); repeated matches without an anchor are boilerplate;
    legal text and markers alone, without anything sensitive in the document, are suppressed. What is
    promoted is never suppressed. Windows over documents only. Only rows that ``acts`` (default: all) are
    promoted, suppressed and counted in lists and repeats; the others still count as anchors and as sensitive.
    """
    doc, i = Window.partitionBy("doc_id"), F.coalesce("id", F.lit("unknown"))
    df = signals.repartition("doc_id").withColumns({"__anchor": i.isin(*ANCHORS), "__can": i.isin(*PROMOTABLE), "__acts": F.lit(True) if acts is None else F.coalesce(acts, F.lit(False))})
    place = F.when(F.col("__anchor"), F.col("offset"))
    ordered = doc.orderBy(F.col("offset").asc_nulls_first())
    before = F.max(place).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(place).over(ordered.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    by_match = Window.partitionBy("doc_id", F.coalesce("match", i))
    kind = F.when(F.col("__acts"), F.when(i.isin("pii.email", "pii.email.density"), "e").when(i.isin("pii.phone", "pii.phone.density"), "p"))
    by_kind = Window.partitionBy("doc_id", kind)
    df = df.withColumns({
        "__near": F.coalesce(F.least(F.col("offset") - before, after - F.col("offset")) <= REACH, F.lit(False)),
        "__anchored": F.max("__anchor").over(doc), "__group": F.count_if("__acts").over(by_match), "__group_anchor": F.coalesce(F.max(F.when(F.col("__acts"), F.col("__anchor"))).over(by_match), F.lit(False)),
        "__sensitive": F.max(F.col("__anchor") | F.col("severity").isin("high", "critical")).over(doc),
        "__different": F.size(F.collect_set(F.coalesce("match", i)).over(by_kind)), "__span": F.max("offset").over(by_kind) - F.min("offset").over(by_kind), "__kind": kind,
    })
    # a span is null where no match has a place
    is_list = (F.col("__different") >= LIST_LEAST) & F.coalesce(F.col("__span") <= LIST_SPAN, F.lit(True))
    df = df.withColumn("__emails", F.coalesce(F.max((F.col("__kind") == "e") & is_list).over(doc), F.lit(False)))
    listed = F.coalesce(((F.col("__kind") == "e") | (~F.col("__emails") & (F.col("__kind") == "p"))) & is_list, F.lit(False))
    near = F.col("__near") & F.col("__can")
    zone = F.col("__can") & ~F.col("__anchor") & (((F.col("source") == "metadata") & ~F.col("__anchored")) | F.coalesce((F.col("offset") < HEADER) | (F.col("offset") > F.col("doc_length") - FOOTER), F.lit(False)))
    boilerplate = (F.col("__group") >= BOILERPLATE) & ~F.col("__group_anchor")
    final = i.isin(*LEGAL, *MARKERS) & ~F.col("__sensitive")
    df = df.withColumns({"promoted": F.col("__acts") & (near | listed), "__zone": zone, "__boilerplate": boilerplate, "__final": final, "__listed": listed})
    rule = F.when(~F.col("__acts"), None).when(F.col("__listed"), "list").when(F.col("promoted"), "proximity").when(F.col("__zone"), "zone").when(F.col("__boilerplate"), "boilerplate").when(F.col("__final"), "finality")
    df = df.withColumns({"suppressed": F.col("__acts") & ~F.col("promoted") & (F.col("__zone") | F.col("__boilerplate") | F.col("__final")), "rule": rule})
    return df.drop(*[c for c in df.columns if c.startswith("__")])
