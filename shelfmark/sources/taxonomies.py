"""Category payloads -> taxonomy nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(entry: Column, names: list[str], position: int) -> Column:
    positional = F.get_json_object(entry, f"$[{position}]")
    named = F.coalesce(*[F.get_json_object(entry, f"$.{n}") for n in names])
    return F.when(entry.startswith("["), positional).otherwise(named)


def taxonomy_entries(payloads: DataFrame) -> DataFrame:
    """Entries of category payloads, written as objects or as four positional fields."""
    listed = F.when(F.ltrim("payload").startswith("["), F.col("payload")).otherwise(F.get_json_object("payload", "$.categories"))
    one = payloads.select("snapshot_id", F.posexplode(F.from_json(listed, "array<string>")).alias("source_index", "e"))
    e = F.col("e")
    parents = _pick(e, ["parents", "parent_ids", "parentIds"], 2)
    many = F.from_json(parents, "array<string>")
    split = F.split(F.coalesce(parents, F.lit("")), ",")
    return one.select(
        "snapshot_id", "source_index",
        F.trim(_pick(e, ["name", "category_name"], 0)).alias("name"), F.trim(_pick(e, ["id", "category_id", "catId"], 1)).alias("category_id"),
        F.filter(F.transform(F.when(parents.startswith("["), many).otherwise(split), lambda v: F.trim(v)), lambda p: p != "").alias("parent_ids"),
        F.nullif(F.trim(_pick(e, ["primaryParent", "primary_parent", "primary_parent_id", "primaryParentId"], 3)), F.lit("")).alias("primary_parent_id"),
        F.when(e.startswith("["), F.json_array_length(e) == 4).otherwise(e.startswith("{")).alias("_shaped"),
    )


def taxonomy_nodes(payloads: DataFrame, omitted_root: str = "1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, set-aside and faulty entries with a reason, and duplicate-name groups.

    References to the root that the source leaves out are dropped.  Unnamed
    leaves nobody refers to are set aside; other faults are violations.
    """
    entries = taxonomy_entries(payloads)
    cleaned = entries.withColumn(
        "parent_ids", F.array_distinct(F.filter("parent_ids", lambda p: p != omitted_root))
    ).withColumn("primary_parent_id", F.when(F.col("primary_parent_id") != omitted_root, F.col("primary_parent_id")))
    referred = cleaned.select("snapshot_id", F.explode("parent_ids").alias("category_id")).distinct().withColumn("_referred", F.lit(True))
    repeated = cleaned.groupBy("snapshot_id", "category_id").agg(F.count("*").alias("_copies")).filter("_copies > 1")
    unnamed = F.coalesce("name", F.lit("")) == ""
    reason = (
        F.when(~F.coalesce("_shaped", F.lit(False)), "unsupported_shape")
        .when(~F.coalesce(F.col("category_id").rlike("^[0-9]*[1-9][0-9]*$"), F.lit(False)), "invalid_id")
        .when(F.col("category_id") == omitted_root, "omitted_root_present")
        .when(F.col("_copies").isNotNull(), "duplicate_id")
        .when(F.exists("parent_ids", lambda p: ~p.rlike("^[0-9]*[1-9][0-9]*$")), "invalid_parent")
        .when(F.col("primary_parent_id").isNotNull() & ~F.array_contains("parent_ids", F.coalesce("primary_parent_id", F.lit(""))), "primary_parent_not_parent")
        .when(unnamed & F.col("_referred").isNotNull(), "unnamed_parent")
        .when(unnamed, "empty_category_name_unreferenced_leaf")
        .when(F.col("name").rlike(r"[<>\x00-\x1f\x7f]"), "unsafe_name")
    )
    judged = cleaned.join(referred, ["snapshot_id", "category_id"], "left").join(repeated, ["snapshot_id", "category_id"], "left").withColumn("reason", reason)
    nodes = judged.filter("reason IS NULL").select(
        "snapshot_id", "category_id", "name", F.array_sort("parent_ids").alias("parent_ids"), "primary_parent_id", F.lit(True).alias("active")
    )
    # the ids of a shared name are given as rows: a name may be very common
    shared = nodes.groupBy("snapshot_id", F.lower(F.trim("name")).alias("name_key")).agg(F.count("*").alias("n_ids"), F.min("category_id").alias("first_id")).filter("n_ids > 1")
    return nodes, judged.filter("reason IS NOT NULL").select("snapshot_id", "source_index", "category_id", "reason"), shared
