"""Groups of records that share identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``links(u, v)``; the root is the least node.

    Alternating large-star and small-star steps; the number of rounds grows with
    the logarithm of the longest chain.  Every round is written to the shared
    folder, so neither lineage nor lost executors undo earlier rounds.
    """
    current = cut(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        current = cut(small)
        mark = _fingerprint(current)
        if mark == seen:
            break
        seen = mark
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def connected_records(items: DataFrame, identifiers: list[str]) -> DataFrame:
    """``(record_id, group_id)``: records that share any identifier, directly or through others.

    Each identifier value links its records to the least of them, so a value
    carried by many records adds one link per record.
    """
    links = None
    for column in identifiers:
        held = items.filter(F.col(column).isNotNull()).select("record_id", F.col(column).alias("value"))
        hubs = held.groupBy("value").agg(F.min("record_id").alias("v"))
        part = held.join(hubs, "value").select(F.col("record_id").alias("u"), "v")
        links = part if links is None else links.unionByName(part)
    groups = components(links).select(F.col("node").alias("record_id"), F.col("root").alias("group_id"))
    return items.select("record_id").join(groups, "record_id", "left").select(
        "record_id", F.coalesce("group_id", "record_id").alias("group_id")
    )


def merge_items(items: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group; a citation count or year stands only if all known values agree."""
    def agreed(column):
        return F.when(F.min(column) == F.max(column), F.min(column))

    return items.join(groups, "record_id").groupBy("group_id").agg(
        F.count("*").alias("n_records"),
        F.min("title").alias("title"),
        F.min("doi").alias("doi"),
        F.min("record_url").alias("record_url"),
        agreed("year").alias("year"),
        agreed("citations").alias("citations"),
        F.array_sort(F.collect_set("category_id")).alias("category_ids"),
    )
