"""Predicates and gates.  Rows that a gate holds back are returned, never lost."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions import normalise as N


def instant(value: datetime | str | Column) -> Column:
    """A UTC instant as TIMESTAMP_NTZ; a datetime must carry its zone, a text is in UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is None:
            raise ValueError("a datetime without a zone is no instant")
        value = value.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    text = value
    return F.lit(text).cast("timestamp_ntz")


def within(column: Column, start, end) -> Column:
    return (column >= instant(start)) & (column < instant(end))


class WindowNotOver(ValueError):
    """The window ends after the time of asking."""


def refuse_open_window(spark: SparkSession, end, now) -> None:
    """An error, before any table is read, for a window that is not over at ``now``."""
    if spark.range(1).select(instant(end) > instant(now)).first()[0]:
        raise WindowNotOver(f"the window ends at {end}, after {now}")


def in_window(events: DataFrame, start, end, at: str = "changed_at", now: datetime | str | None = None) -> DataFrame:
    """Rows inside ``[start, end)``; a plain range filter, so it reaches the scan.

    With ``now``, a window that ends later is refused: its rows are not all there yet.
    """
    if now is not None:
        refuse_open_window(events.sparkSession, end, now)
    return events.filter(within(F.col(at), start, end))


def window_counts(events: DataFrame, start, end, now, at: str = "changed_at", key: str = "record_key") -> DataFrame:
    """One row: kept, excluded and unkeyed counts, and whether the window is over."""
    inside = within(F.col(at), start, end)
    return events.agg(
        F.count_if(inside).alias("kept"),
        F.count_if(~inside).alias("excluded"),
        F.count_if(inside & F.col(key).isNull()).alias("unkeyed"),
    ).withColumn("window_over", instant(end) <= instant(now))


def assess_freshness(works: DataFrame, start, end) -> DataFrame:
    """Add ``freshness`` and ``freshness_reason`` from dated evidence.

    Needs ``value``, ``precision``, ``source``, ``event`` and ``inferred``.
    """
    bounds = N.date_bounds(F.col("value"), F.col("precision"))
    lo, hi = bounds["lo"], bounds["hi"]
    exact = F.col("precision").isin("day", "second")
    rules = [
        (F.col("value").isNull(), "uncertain", "no_date"),
        (~F.coalesce(F.col("event").isin(vocab.PUBLICATION_EVENTS), F.lit(False)), "source_record_updated", "other_event"),
        (F.col("inferred"), "uncertain", "inferred_date"),
        (F.lower("source").isin(vocab.OBSERVATION_SOURCES), "source_record_updated", "observation_source"),
        (~exact & (hi <= instant(start)), "newly_indexed_old_work", "coarse_date_before_window"),
        (~exact, "uncertain", "coarse_date"),
        (within(lo, start, end), "confirmed_new", "inside_window"),
        (lo < instant(start), "newly_indexed_old_work", "before_window"),
    ]
    status, reason = F.lit("uncertain"), F.lit("after_window")
    for test, outcome, why in reversed(rules):
        status = F.when(test, F.lit(outcome)).otherwise(status)
        reason = F.when(test, F.lit(why)).otherwise(reason)
    return works.withColumn("freshness", status).withColumn("freshness_reason", reason)


def _known_years(candidates: DataFrame) -> Column:
    empty = F.array().cast("array<int>")
    parts = [F.coalesce(F.col(c), empty) for c in ("year_hints", "change_year_hints") if c in candidates.columns]
    return F.concat(*parts)


def window_years(start, end, zone: str = "UTC") -> Column:
    """Every local calendar year that ``[start, end]`` touches, as an array."""
    local = lambda v: F.year(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant(v)))
    return F.sequence(local(start), local(end))


def window_candidates(candidates: DataFrame, start, end, change_feed_ok: bool, zone: str = "UTC") -> DataFrame:
    """Keep merged records that may belong to a window.

    A year outside the window drops a record; otherwise an in-window feed date,
    or the lack of any feed date, keeps it.  When the change log loaded, records
    without date, year and change are dropped too; when it failed the wider set
    stays.
    """
    years = _known_years(candidates)
    stale = (F.size(years) > 0) & ~F.arrays_overlap(years, window_years(start, end, zone))
    dated = F.col("last_feed_date").isNotNull()
    keep = ~stale & (~dated | F.col("date_in_window"))
    if change_feed_ok:
        no_evidence = ~dated & (F.size("year_hints") == 0) & F.col("changed_at").isNull()
        keep = keep & ~no_evidence
    return candidates.filter(keep)


def arrival_eligible(candidates: DataFrame, start, end) -> Column:
    """Whether feed and change evidence alone can admit a record."""
    years = _known_years(candidates)
    recent = F.arrays_overlap(years, window_years(start, end))
    stale = (F.size(years) > 0) & ~recent
    hinted = (F.size("type_hints") > 0) | F.col("change_type").isNotNull()
    changed = F.coalesce(within(F.col("changed_at"), start, end), F.lit(False))
    return ~stale & (hinted | (F.size(years) > 0) & recent | F.col("date_in_window") | changed)


def undated_stock(candidates: DataFrame) -> Column:
    """Only a change stamp speaks for the record: no date, year, DOI or early-work hint."""
    kinds = F.transform(
        F.concat(F.col("type_hints"), F.array_compact(F.array("change_type"))),
        lambda v: F.regexp_replace(F.lower(v), "_", "-"),
    )
    early = F.exists(kinds, lambda v: v.rlike("|".join(vocab.EARLY_WORK_MARKERS)))
    return (
        F.col("changed_at").isNotNull()
        & F.col("last_feed_date").isNull()
        & (F.size(_known_years(candidates)) == 0)
        & (F.col("n_dois") == 0)
        & ~early
    )


def year_hint_gate(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Add ``gate``: ``pass``, or ``year_review_pending`` where neither a hint nor a
    reviewed year exists.  ``reviews`` holds one row per record URL."""
    reviewed = reviews.select("record_url", F.col("publication_year").alias("reviewed_year"))
    passes = (F.size("year_hints") > 0) | F.col("reviewed_year").isNotNull()
    return candidates.join(reviewed, "record_url", "left").withColumn(
        "gate", F.when(passes, "pass").otherwise("year_review_pending")
    )


def supported_type(column: Column) -> Column:
    value = F.regexp_replace(F.lower(F.trim(column)), "_", "-")
    safe = F.when(value.rlike(vocab.SAFE_TYPE), value)
    return F.coalesce(safe.isin(vocab.SUPPORTED_TYPES + vocab.SUPPORTED_LEGACY_TYPES), F.lit(False))


def search_filters(
    items: DataFrame, work_types: list[str] | None = None, year_from: int | None = None,
    year_to: int | None = None,
) -> DataFrame:
    """Add ``drop_reason`` (NULL for kept rows); the first failing filter names it.

    Needs ``is_excluded``, ``in_scope``, ``work_type`` and ``year``.
    """
    unverified = F.col("work_type").isin("unknown", "conflict")
    rules = [
        (F.col("is_excluded"), "excluded_category"),
        (~F.col("in_scope"), "filtered_out"),
        (~supported_type(F.col("work_type")) & unverified, "type_unverified"),
        (~supported_type(F.col("work_type")), "unsupported_type"),
    ]
    if work_types:
        rules.append((~F.col("work_type").isin(work_types), "filtered_out"))
    if year_from is not None or year_to is not None:
        rules.append((F.col("year").isNull(), "year_unknown"))
        outside = F.lit(False)
        if year_from is not None:
            outside = outside | (F.col("year") < year_from)
        if year_to is not None:
            outside = outside | (F.col("year") > year_to)
        rules.append((outside, "filtered_out"))
    return items.withColumn("drop_reason", F.coalesce(*[F.when(test, F.lit(name)) for test, name in rules]))


class BudgetExceeded(ValueError):
    """A candidate set is larger than the caller allows."""


def budget_guard(df: DataFrame, most: int) -> DataFrame:
    """Refuse, never truncate, a set of more than ``most`` rows.

    Counting stops after ``most + 1`` rows.
    """
    found = df.limit(most + 1).count()
    if found > most:
        raise BudgetExceeded(f"more than {most} candidates; narrow the window or raise the limit")
    return df
