"""Merging feed entries, change events and journal records by key.

Sets kept as arrays have a fixed domain (categories, years, type labels).
Feed dates and DOIs have none, so a merged record carries their extremes and
counts, and ``feed_values`` carries every distinct value as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import normalise as N
from shelfmark.operators.gates import within


def _set(column: str):
    return F.array_sort(F.collect_set(column))


def feed_values(entries: DataFrame) -> DataFrame:
    """Distinct ``(record_url, kind, value)`` rows of dates, years, DOIs and types."""
    pairs = F.array(
        F.struct(F.lit("date").alias("kind"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("value")),
        F.struct(F.lit("year").alias("kind"), F.col("year_hint").cast("string").alias("value")),
        F.struct(F.lit("doi").alias("kind"), F.col("doi_hint").alias("value")),
        F.struct(F.lit("type").alias("kind"), F.col("type_hint").alias("value")),
    )
    return (
        entries.select("record_url", F.explode(pairs).alias("p"))
        .select("record_url", "p.kind", "p.value").filter("value IS NOT NULL").distinct()
    )


def merge_feeds(entries: DataFrame, window: tuple | None = None) -> DataFrame:
    """One row per record URL from entries of many category feeds.

    Every aggregate combines on the map side, so a URL that holds a large share
    of all entries costs one partial row per task.  With ``window`` the row also
    tells whether any feed date lies inside it.
    """
    start, end = window if window else (None, None)
    inside = within(F.col("published_at"), start, end) if window else F.lit(None).cast("boolean")
    title_key = N.title_norm(F.col("title"))
    merged = (
        entries.filter("record_url IS NOT NULL").withColumn("_title", title_key)
        .groupBy("record_url").agg(
            F.min("title").alias("title"),
            (F.min("_title") != F.max("_title")).alias("title_conflict"),
            _set("category_id").alias("category_ids"),
            F.max("checked_at").alias("observed_at"),
            F.min("published_at").alias("first_feed_date"),
            F.max("published_at").alias("last_feed_date"),
            F.coalesce(F.bool_or(inside), F.lit(False)).alias("date_in_window"),
            _set("year_hint").alias("year_hints"),
            _set("type_hint").alias("type_hints"),
            F.min("doi_hint").alias("_low"), F.max("doi_hint").alias("_high"),
        )
    )
    return (
        merged.withColumn("n_dois", F.when(F.col("_low").isNull(), 0).when(F.col("_low") == F.col("_high"), 1).otherwise(2))
        .withColumn("doi", F.when(F.col("n_dois") == 1, F.col("_low")))
        .drop("_low", "_high")
        .withColumn("row_hash", N.row_hash(F.col("record_url"), F.col("title"), F.array_join("category_ids", "\x1f")))
    )


def title_conflicts(entries: DataFrame) -> DataFrame:
    """Every normalised title of the record URLs whose titles disagree."""
    titles = entries.select("record_url", N.title_norm(F.col("title")).alias("title_norm")).distinct()
    several = titles.groupBy("record_url").agg(F.count("*").alias("n_titles")).filter("n_titles > 1")
    return titles.join(several, "record_url")


def latest_active(events: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """Latest event per record key; deleted keys are dropped unless asked for.

    Ties take the greater ``(changed_at, identifier, event_id)``.
    """
    order = F.struct("changed_at", "identifier", "event_id")
    body = F.struct(*[c for c in events.columns if c != "record_key"])
    latest = (
        events.filter("record_key IS NOT NULL").groupBy("record_key")
        .agg(F.max_by(body, order).alias("e")).select("record_key", "e.*")
    )
    return latest if keep_deleted else latest.filter("NOT deleted")


def change_audit(events: DataFrame) -> DataFrame:
    """One row of counts beside ``latest_active``."""
    per_key = events.groupBy("record_key").agg(
        F.count("*").alias("n"), F.max_by("deleted", F.struct("changed_at", "identifier", "event_id")).alias("deleted")
    )
    keyed = F.col("record_key").isNotNull()
    return per_key.agg(
        F.sum("n").alias("events"),
        F.coalesce(F.sum(F.when(~keyed, F.col("n"))), F.lit(0)).alias("unkeyed"),
        F.coalesce(F.sum(F.when(keyed, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.count_if(keyed & F.col("deleted")).alias("deleted_keys"),
        F.count_if(keyed & ~F.col("deleted")).alias("active_keys"),
    )


def enrich_with_changes(candidates: DataFrame, latest: DataFrame) -> DataFrame:
    """Attach the latest change of the shared record key.  Both sides hold one row per key."""
    changes = latest.select(
        "record_key", "changed_at", F.col("identifier").alias("change_record_id"),
        F.col("dc_type").alias("change_type"),
        F.array_compact(F.array(N.year_hint(F.col("dc_date")))).alias("change_year_hints"),
    )
    keyed = candidates.withColumn("record_key", N.record_key(F.col("record_url")))
    return keyed.join(changes, "record_key", "left")


def group_issues(records: DataFrame) -> DataFrame:
    """Journal records -> issues; the label month stands only if all labels agree."""
    issue = ["_venue", "year", "issue"]
    keyed = records.filter("issue <> '' AND venue <> '' AND year IS NOT NULL").withColumn("_venue", N.venue_key(F.col("venue")))
    # records first, so that counts keep to fixed-width hash aggregation
    low, high = F.min("low"), F.max("high")
    counts = keyed.groupBy(*issue, "url").agg(F.min("label_month").alias("low"), F.max("label_month").alias("high")).groupBy(*issue).agg(
        F.when(low == high, low).alias("label_month"), F.coalesce(low != high, F.lit(False)).alias("label_conflict"),
        F.count("*").alias("n_records"),
    )
    queries = keyed.select(*issue, "venue", "query").distinct().groupBy(*issue).agg(F.min("venue").alias("venue"), _set("query").alias("queries"))
    return counts.join(queries, issue).withColumn(
        "issue_key", F.sha2(F.concat_ws("|", "_venue", F.col("year").cast("string"), "issue"), 256)
    ).drop("_venue")


def merge_work(works: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One row per work id.  Disagreeing freshness or date becomes uncertain without
    a date; rows of one id with different DOIs are marked, not merged away."""
    def same(column):
        filled = F.coalesce(F.col(column).cast("string"), F.lit("\0"))
        return F.min(filled) == F.max(filled)

    agreed = same("freshness") & same("freshness_event") & same("publication_date")
    merged = works.groupBy("work_id").agg(
        F.min("title").alias("title"),
        F.min("doi").alias("doi"),
        (~same("doi")).alias("doi_conflict"),
        F.min("observed_at").alias("observed_at"),
        agreed.alias("agreed"),
        F.min("freshness").alias("_freshness"), F.min("freshness_event").alias("_event"),
        F.min("publication_date").alias("_date"),
        F.min("record_url").alias("record_url"),
        F.count("*").alias("n_rows"),
    )
    return merged.select(
        "work_id", "title", "doi", "doi_conflict", "observed_at", "record_url", "n_rows",
        F.when(F.col("agreed"), F.col("_freshness")).otherwise("uncertain").alias("freshness"),
        F.when(F.col("agreed"), F.col("_event")).otherwise("conflicting_resolution_evidence").alias("freshness_event"),
        F.when(F.col("agreed"), F.col("_date")).alias("publication_date"),
    )


def work_members(works: DataFrame) -> DataFrame:
    """Distinct ``(work_id, record_url, category_id)`` rows: the unioned assignments."""
    return works.select("work_id", "record_url", F.explode("category_ids").alias("category_id")).distinct()


def new_records(current: DataFrame, known: DataFrame, key: str = "record_url") -> DataFrame:
    return current.join(known.select(key).distinct(), key, "left_anti")


def already_reported(leads: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Leads with ``reported``: TRUE where the log holds the same keys."""
    seen = log.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return leads.join(seen, keys, "left").withColumn("reported", F.coalesce("_seen", F.lit(False))).drop("_seen")


