"""Interval algebra and as-of look-ups that do not put a whole key in one task.

Ordered work per key is a prefix scan in two levels.  Inside a bucket a window sees
the distinct instants of that bucket only; across buckets a second window sees one
row per bucket and hands each the state it starts from.  A bucket is a day of a key,
or, where a day holds more than ``BLOCK`` instants, one of about ``PARTS`` ranges of
instants of that day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.gates import instant
from shelfmark.session import cut

BLOCK, PARTS = 20_000, 512


def _before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _blocked(rows: DataFrame, key: str, at: str, bucket: str, block: int | None = None) -> DataFrame:
    """``rows``, written out, with ``_bucket``: a day of a key, and a range of instants of that day where it is crowded.

    The bucket holds its key in a struct, so a join on it finds the rows without a key, as a grouping does.

    The ranges of a crowded day begin at instants of its own, chosen by hash, about
    ``PARTS`` of them however many there are.  ``rows`` has few rows of one instant.
    """
    day = F.struct(key, F.date_trunc(bucket, at).cast("timestamp_ntz").alias("_day")).alias("_day")
    rows = rows.select("*", day)
    placed = rows.select("_day", F.col(at).alias("_at"))
    crowded = placed.groupBy("_day").agg(F.count("*").alias("_n")).filter(F.col("_n") > (block or BLOCK))
    chosen = F.pmod(F.xxhash64("_at"), F.ceil(F.col("_n") / PARTS)) == 0
    starts = (
        placed.join(crowded, "_day").filter(chosen).groupBy("_day").agg(F.sort_array(F.collect_set("_at")).alias("_starts"))
    )
    # how many starts lie at or before the instant, by halving steps
    passed = F.aggregate(
        F.array(*[F.lit(2**k) for k in range(10, -1, -1)]), F.lit(0),
        lambda found, step: F.when(F.get("_starts", found + step - 1) <= F.col(at), found + step).otherwise(found),
    )
    part = F.when(F.col("_starts").isNull(), 0).otherwise(passed)
    return cut(
        rows.join(starts, "_day", "left").withColumn("_bucket", F.struct("_day", part.alias("_part")))
        .drop("_day", "_starts")
    )


def coalesce_intervals(cov: DataFrame, key: str = "source_key", bucket: str = "day") -> DataFrame:
    """Clamp ends to ``checked_at``, drop empty intervals, merge touching ones per key."""
    clamped = (
        cov.withColumn("window_end", F.least("window_end", "checked_at")).filter("window_start < window_end")
        .groupBy(key, "window_start").agg(F.max("window_end").alias("window_end"), F.max("checked_at").alias("checked_at"))
    )
    clamped = _blocked(clamped, key, "window_start", bucket)
    carried = (
        clamped.groupBy(key, "_bucket").agg(F.max("window_end").alias("_end"))
        .withColumn("_carried", F.max("_end").over(_before([key], "_bucket"))).drop("_end")
    )
    inside = Window.partitionBy(key, "_bucket").orderBy("window_start")
    reach = F.greatest(
        F.col("_carried"), F.max("window_end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )
    marked = clamped.join(carried.drop(key), "_bucket").withColumn("_reach", reach).withColumn(
        "_new", F.when(F.col("_reach").isNull() | (F.col("window_start") > F.col("_reach")), 1).otherwise(0)
    )
    earlier = (
        marked.groupBy(key, "_bucket").agg(F.sum("_new").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(_before([key], "_bucket")), F.lit(0))).drop("_n")
    )
    running = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        marked.join(earlier.drop(key), "_bucket").withColumn("_island", F.col("_base") + running)
        .groupBy(key, "_island").agg(
            F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"),
            F.max("checked_at").alias("checked_at"),
        ).drop("_island")
    )


def _with_next(islands: DataFrame, key: str, bucket: str) -> DataFrame:
    placed = _blocked(islands, key, "window_start", bucket)
    firsts = placed.groupBy(key, "_bucket").agg(F.min("window_start").alias("_first")).withColumn(
        "_later", F.lead("_first").over(Window.partitionBy(key).orderBy("_bucket"))
    ).drop("_first")
    following = F.lead("window_start").over(Window.partitionBy(key, "_bucket").orderBy("window_start"))
    return placed.join(firsts.drop(key), "_bucket").withColumn("_next", F.coalesce(following, F.col("_later")))


def coverage_gaps(cov: DataFrame, start, end, key: str = "source_key", bucket: str = "day") -> DataFrame:
    """Uncovered sub-intervals of ``[start, end)`` per key."""
    lo, hi = instant(start), instant(end)
    islands = coalesce_intervals(cov, key, bucket).filter((F.col("window_end") > lo) & (F.col("window_start") < hi)).select(
        key, F.greatest("window_start", lo).alias("window_start"), F.least("window_end", hi).alias("window_end")
    )
    opening = cov.select(key).distinct().select(key, lo.alias("window_start"), lo.alias("window_end"))
    merged = islands.unionByName(opening).groupBy(key, "window_start").agg(F.max("window_end").alias("window_end"))
    return _with_next(merged, key, bucket).select(
        key, F.col("window_end").alias("gap_start"), F.coalesce("_next", hi).alias("gap_end")
    ).filter("gap_start < gap_end")


def as_of(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tie: str | None = None,
    bucket: str = "day",
) -> DataFrame:
    """Each ``left`` row with the latest ``right`` row of its key at or before its instant.

    Only distinct instants of the left side are looked up, and the answers are
    joined back.  ``tie`` orders right rows of one instant; the greatest wins.
    """
    values = [c for c in right.columns if c != key]
    order = F.col(tie) if tie else F.lit(0)
    facts = right.groupBy(key, F.col(right_time).alias("_at")).agg(
        F.max_by(F.struct(*values), order).alias("_value")
    )
    asks = left.select(key, F.col(left_time).alias("_at")).distinct()
    # a fact at an instant sorts before the question at that instant
    rows = facts.select(key, "_at", F.lit(0).alias("_side"), "_value").unionByName(
        asks.select(key, "_at", F.lit(1).alias("_side")), allowMissingColumns=True
    )
    rows = _blocked(rows, key, "_at", bucket)
    latest = rows.groupBy(key, "_bucket").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_last")
    ).withColumn("_carried", F.last("_last", ignorenulls=True).over(_before([key], "_bucket"))).drop("_last")
    inside = Window.partitionBy(key, "_bucket").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = (
        rows.join(latest, [key, "_bucket"])
        .withColumn("_found", F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carried")))
        .filter("_side = 1").select(key, F.col("_at").alias(left_time), "_found")
    )
    answered = answered.withColumnsRenamed({key: "_key", left_time: "_time"})
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(left_time).eqNullSafe(F.col("_time"))
    return left.join(answered, same, "left").select(*left.columns, "_found.*")


def covering_interval(cov: DataFrame, windows: DataFrame, key: str = "source_key", bucket: str = "day") -> DataFrame:
    """The coalesced interval that holds each window whole, or NULL bounds.

    Coalesced intervals are disjoint, so only the last one starting at or before
    the window can hold it: an as-of look-up, not a range join.
    """
    islands = coalesce_intervals(cov, key, bucket).select(
        key, F.col("window_start").alias("covered_start"), F.col("window_end").alias("covered_end")
    )
    held = as_of(windows, islands, key, "window_start", "covered_start", bucket=bucket)
    whole = F.col("covered_end") >= F.col("window_end")
    return held.withColumn("covered_start", F.when(whole, F.col("covered_start"))).withColumn(
        "covered_end", F.when(whole, F.col("covered_end"))
    )


def prune_history(events: DataFrame, cov: DataFrame, cutoff) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept events, clipped coverage, and one row of counts before and after."""
    at = instant(cutoff)
    kept = events.filter(F.col("changed_at") >= at)
    clipped = cov.filter(F.col("window_end") > at).withColumn("window_start", F.greatest("window_start", at))
    counts = events.agg(
        F.count("*").alias("events_before"), F.count_if(F.col("changed_at") >= at).alias("events_after"),
    ).withColumn("_one", F.lit(1)).join(
        cov.agg(
            F.count("*").alias("coverage_before"), F.count_if(F.col("window_end") > at).alias("coverage_after"),
        ).withColumn("_one", F.lit(1)), "_one",
    ).drop("_one")
    return kept, clipped, counts


def profile_as_of(events: DataFrame, profiles: DataFrame, at: str = "at") -> DataFrame:
    """Profile version in force at each event; ties go to the higher version."""
    return as_of(events, profiles.select("profile_id", "version", "effective_from"), "profile_id", at, "effective_from", "version")


def month_edges(year: Column, month: Column, zone: Column) -> tuple[Column, Column]:
    """UTC instants of the local month's start and end."""
    first = F.make_date(year, month, F.lit(1))
    def utc(day):
        return F.convert_timezone(zone, F.lit("UTC"), day.cast("timestamp_ntz"))
    return utc(first), utc(F.add_months(first, 1))


def date_overlap(records: DataFrame, start, end, zone: str = "UTC") -> DataFrame:
    """Add ``overlap`` to month- or day-labelled records for one window:
    ``inside``, ``outside``, ``conflict`` or ``unknown``.

    Needs ``year, label_month, day, date_conflict``; an exact day beats the month.
    """
    lo_m, hi_m = month_edges(F.col("year"), F.col("label_month"), F.lit(zone))
    def utc(day):
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))
    lo = F.coalesce(utc(F.col("day")), lo_m)
    hi = F.coalesce(utc(F.date_add("day", 1)), hi_m)
    inside = (lo < instant(end)) & (hi > instant(start))
    return records.withColumn(
        "overlap", F.when(F.col("date_conflict"), "conflict").when(lo.isNull(), "unknown")
        .when(inside, "inside").otherwise("outside")
    )


def date_overlap_many(records: DataFrame, windows: DataFrame) -> DataFrame:
    """Record and window ids whose label month overlaps the window.

    Each window is spread over the local months it touches, so the join is on
    equal months; its output is the answer, not a superset.
    """
    first = F.convert_timezone(F.lit("UTC"), F.col("zone"), F.col("window_start"))
    last = F.convert_timezone(F.lit("UTC"), F.col("zone"), F.col("window_end")) - F.expr("INTERVAL 1 MICROSECOND")
    months = F.sequence(F.trunc(F.to_date(first), "month"), F.trunc(F.to_date(last), "month"), F.expr("INTERVAL 1 MONTH"))
    spread = windows.select("window_id", F.explode(months).alias("m")).select(
        "window_id", F.year("m").alias("year"), F.month("m").alias("label_month")
    )
    return records.filter("label_month IS NOT NULL AND NOT date_conflict").join(spread, ["year", "label_month"]).select(
        "record_id", "window_id"
    )


