"""Resolving document types from evidence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions import normalise as N


def resolve_type(evidence: DataFrame, key: str = "record_id") -> DataFrame:
    """``(key, work_type, type_status, fingerprint)`` from provider labels.

    ``evidence`` needs ``provider, raw_type, method``.  Reviewed evidence decides
    alone; an unmapped label makes the type unknown; supported beside unsupported
    labels conflict; ``other`` gives way to a supported label.  No result depends on
    how often a row is repeated, so rows are combined on the map side without a ``distinct``.
    """
    return resolve_mapped(mapped_evidence(evidence), key)


def mapped_evidence(evidence: DataFrame) -> DataFrame:
    return N.with_canonical_type(evidence).withColumn("safe_type", F.coalesce("safe_type", F.lit("unrecognized")))


def resolve_mapped(mapped: DataFrame, key: str = "record_id") -> DataFrame:
    kind = F.col("canonical_type")
    reviewed = F.col("method") == "document-inspection"
    preference = {name: position for position, name in enumerate(vocab.TYPE_PREFERENCE)}
    place = F.lit(100)
    for name, position in preference.items():
        place = F.when(kind == name, position).otherwise(place)
    supported = kind.isin(vocab.SUPPORTED_TYPES)
    text = F.concat_ws("|", "provider", "safe_type", F.coalesce("canonical_type", F.lit("")), "method")
    order = F.struct(place, kind)
    sums = mapped.groupBy(key).agg(
        F.count_if(reviewed).alias("n_reviewed"),
        F.count_if(reviewed & kind.isNull()).alias("n_reviewed_null"),
        F.min(F.when(reviewed, kind)).alias("reviewed_low"), F.max(F.when(reviewed, kind)).alias("reviewed_high"),
        F.count_if(kind.isNull()).alias("n_unmapped"),
        F.count_if(supported).alias("n_supported"),
        F.count_if(~supported & (kind != "other")).alias("n_unsupported"),
        F.count_if(kind == "other").alias("n_other"),
        (F.min(kind) == F.max(kind)).alias("single"),
        F.min_by(kind, order).alias("preferred"),
        F.min_by(F.when(kind != "other", kind), F.when(kind != "other", order)).alias("preferred_specific"),
        F.count_if(F.col("method") == "explicit-bibliographic-label").alias("n_explicit"),
        F.array_sort(F.collect_set(text)).alias("labels"),
    )
    conflict = (F.col("n_reviewed") > 0) & (
        (F.col("n_reviewed_null") > 0) | (F.col("reviewed_low") != F.col("reviewed_high"))
    )
    mixed = (F.col("n_supported") > 0) & (F.col("n_unsupported") > 0)
    chosen = F.when(F.col("n_supported") > 0, F.col("preferred_specific")).otherwise(F.col("preferred"))
    work_type = (
        F.when(conflict, "conflict").when(F.col("n_reviewed") > 0, F.col("reviewed_low"))
        .when(F.col("n_unmapped") > 0, "unknown").when(mixed, "conflict").otherwise(chosen)
    )
    status = (
        F.when(conflict, "conflict").when(F.col("n_reviewed") > 0, "reviewed")
        .when(F.col("n_unmapped") > 0, "unknown").when(mixed, "conflict")
        .when(F.col("n_explicit") > 0, "explicit_label").when(F.col("single"), "confirmed").otherwise("compatible")
    )
    return sums.select(
        key, work_type.alias("work_type"), status.alias("type_status"),
        N.evidence_fingerprint(F.col("labels")).alias("fingerprint"),
    )


def with_default_type(records: DataFrame, resolved: DataFrame, default: str = "article", key: str = "record_id") -> DataFrame:
    """Records without any evidence take the default type."""
    return records.join(resolved, key, "left").withColumn("type_status", F.coalesce("type_status", F.lit("defaulted"))).withColumn(
        "work_type", F.coalesce("work_type", F.lit(default))
    )


def applicable_reviews(resolved: DataFrame, titles: DataFrame, reviews: DataFrame) -> DataFrame:
    """``record_id, work_type`` of document inspections whose fingerprint still equals
    the evidence; records whose applicable reviews disagree are left out.

    ``titles`` holds ``(record_id, title_norm)``; ``reviews`` holds ``record_id,
    title_norm, work_type, fingerprints``.
    """
    current = resolved.join(titles, "record_id").filter("type_status <> 'reviewed'")
    r = reviews.select("record_id", "title_norm", F.col("work_type").alias("reviewed_type"), F.explode("fingerprints").alias("fingerprint"))
    return current.join(r, ["record_id", "title_norm", "fingerprint"]).groupBy("record_id").agg(
        F.min("reviewed_type").alias("work_type"), F.max("reviewed_type").alias("_high")
    ).filter("work_type = _high").drop("_high")


def apply_type_reviews(resolved: DataFrame, titles: DataFrame, reviews: DataFrame) -> DataFrame:
    """Resolutions after the applicable inspections."""
    settled = applicable_reviews(resolved, titles, reviews).withColumn("type_status", F.lit("reviewed"))
    untouched = resolved.join(settled.select("record_id"), "record_id", "left_anti").select("record_id", "work_type", "type_status")
    return untouched.unionByName(settled)


def earliest_version(works: DataFrame, group: str = "group_id") -> DataFrame:
    """Earliest dated work of each group; an undated one only where it is the only one."""
    dated = F.when(F.col("published").isNotNull(), F.col("record_id"))
    picked = works.groupBy(group).agg(
        F.min_by(dated, F.when(F.col("published").isNotNull(), F.struct("published", "record_id"))).alias("first_dated"),
        F.min("record_id").alias("low"), F.max("record_id").alias("high"), F.min("published").alias("published"),
    )
    only = F.when(F.col("low") == F.col("high"), F.col("low"))
    return picked.select(group, F.coalesce("first_dated", only).alias("record_id"), "published")
