"""Structured Streaming forms of the incremental jobs.

Each job starts a query over a streaming DataFrame and writes below one folder:
``log/`` holds rows by micro-batch, ``_checkpoint`` the stream's progress.  A
micro-batch writes its own ``batch_id=`` folder with overwrite, so a batch that
is run again after a failure leaves the same result.  ``read_*`` gives the table
that the batch form of the job would give on the same input.

Totals per key are logs of parts with snapshots (``totals``).  "Ever seen" is a
streaming aggregation in the RocksDB state store: a micro-batch looks up and
changes its own keys only, however many are known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark import vocab
from shelfmark.operators import gates, intervals
from shelfmark.operators.ranking import to_local
from shelfmark.sources.tables import exists
from shelfmark.streaming import totals
from shelfmark.streaming.totals import Totals

# the state store keeps keys on disk and checkpoints what a micro-batch changed
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _start(
    stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str, mode: str = "update", trigger: dict | None = None,
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/_checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start()


def _write(df: DataFrame, folder: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")


def _read(spark: SparkSession, folder: str, name: str, like: DataFrame | None = None) -> DataFrame:
    """Rows of all batches with their ``batch_id``; none before the first batch."""
    if like is not None and not exists(spark, f"{folder}/{name}"):
        return like.limit(0).withColumn("batch_id", F.lit(-1).cast("bigint"))
    found = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return found.withColumn("batch_id", F.col("batch_id").cast("bigint"))


def _totals(stream: DataFrame, spec: Totals, folder: str, trigger: dict | None, every: int) -> StreamingQuery:
    return _start(stream, lambda df, batch_id: totals.write_batch(spec, df, batch_id, folder, every), folder, "append", trigger)


def _first_batch_only(rows: DataFrame, keys: list[str], *columns, unless: str = "false") -> DataFrame:
    """Update-mode aggregation of ``keys`` with ``_new``: TRUE in the batch that first brings a key.

    All rows of a micro-batch arrive at its one instant, kept in the checkpoint; a key
    is new as long as its least and greatest arrival are equal.
    """
    arrived = rows.withColumn("_arrived", F.current_timestamp())
    new = (F.min("_arrived") == F.max("_arrived")) & ~F.bool_or(F.expr(unless))
    return arrived.groupBy(*keys).agg(new.alias("_new"), *columns)


def _news(stream: DataFrame, folder: str, trigger: dict | None) -> StreamingQuery:
    """Log the new keys of each batch."""
    spark = stream.sparkSession
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:  # a query takes the settings of its start
        return _start(stream, lambda df, batch_id: _write(df.filter("_new").drop("_new"), folder, "log", batch_id), folder, "update", trigger)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stream_first_seen(entries: DataFrame, folder: str, baseline: DataFrame | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Records never seen before, with their least title in the batch that brought them.

    ``baseline`` is written once and read by the first micro-batch, so its records are known
    from then on and no later batch reads it.
    """
    spark = entries.sparkSession
    rows = entries.filter("record_url IS NOT NULL").select("record_url", "title", F.lit(False).alias("_known"))
    if baseline is not None:
        path = f"{folder}/baseline"
        if not exists(spark, f"{path}/_SUCCESS"):
            baseline.filter("record_url IS NOT NULL").select("record_url").write.mode("overwrite").parquet(path)
        known = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        rows = rows.unionByName(known.select("record_url", F.lit(None).cast("string").alias("title"), F.lit(True).alias("_known")))
    return _news(_first_batch_only(rows, ["record_url"], F.min("title").alias("title"), unless="_known"), folder, trigger)


def read_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "log").select("record_url", "title")


LATEST = Totals(("record_key",), {"e": ("max(struct(changed_at, identifier, event_id, deleted, dc_type, dc_date))", "max")})


def stream_latest(events: DataFrame, folder: str, trigger: dict | None = None, snapshot_every: int = totals.SNAPSHOT_EVERY) -> StreamingQuery:
    """Latest event per record key; a deleted key stays as a tombstone."""
    return _totals(events.filter("record_key IS NOT NULL"), LATEST, folder, trigger, snapshot_every)


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    return totals.read(LATEST, spark, folder).select(
        "record_key", "e.identifier", "e.event_id", "e.changed_at", "e.deleted", "e.dc_type", "e.dc_date"
    ).filter("NOT deleted")


WEEKS = Totals(("week_start",), {"n_changes": ("count(*)", "sum"), "n_deleted": ("count_if(deleted)", "sum")})


def stream_week_counts(
    events: DataFrame, folder: str, zone: str, trigger: dict | None = None, snapshot_every: int = totals.SNAPSHOT_EVERY
) -> StreamingQuery:
    """Changes per local week; weeks start on local Mondays, whatever daylight saving does."""
    week = F.date_trunc("week", to_local(F.col("changed_at"), zone)).cast("timestamp_ntz")
    return _totals(events.withColumn("week_start", week), WEEKS, folder, trigger, snapshot_every)


def read_week_counts(spark: SparkSession, folder: str) -> DataFrame:
    return totals.read(WEEKS, spark, folder)


def _mark(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """One row ``closed_until``: the instant up to which windows were over before this batch."""
    earlier = [n for n in totals.finished(spark, f"{folder}/marks", "batch_id") if n < batch_id]
    return spark.read.parquet(f"{folder}/marks/batch_id={earlier[-1]}") if earlier else None


def stream_window_close(events: DataFrame, folder: str, days: int, delay_hours: int, trigger: dict | None = None) -> StreamingQuery:
    """Report a window only after it is over; rows later than that wait in ``late/``.

    A window is over when the newest instant seen is ``delay_hours`` past its end.
    Rows of open windows are kept by window, so closing one reads only its rows.
    """
    spark = events.sparkSession
    span = F.make_dt_interval(F.lit(days))
    epoch = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    number = F.floor(F.datediff(F.to_date("changed_at"), F.to_date(epoch)) / days)
    start = (F.date_add(F.to_date(epoch), (number * days).cast("int"))).cast("timestamp_ntz")

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("window_start", start).withColumn("window_end", F.col("window_start") + span)
        mark = _mark(spark, folder, batch_id)
        before = mark.first()[0] if mark is not None else None
        newest = rows.agg(F.max("changed_at")).first()[0]
        closed = F.lit(None).cast("timestamp_ntz") if before is None else gates.instant(str(before))
        late = F.coalesce(F.col("window_end") <= closed, F.lit(False))
        rows.filter(late).write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")
        rows.filter(~late).write.mode("overwrite").partitionBy("window_start").parquet(f"{folder}/open/batch_id={batch_id}")
        if newest is None:
            return
        until = F.greatest(closed, gates.instant(str(newest)) - F.expr(f"INTERVAL {delay_hours} HOUR"))
        held = _read(spark, folder, "open", rows).filter(F.col("batch_id") <= batch_id).withColumn(
            "window_start", F.col("window_start").cast("timestamp_ntz")
        )
        over = held.filter((F.col("window_end") <= until) & F.coalesce(F.col("window_end") > closed, F.lit(True)))
        report = over.groupBy("window_start", "window_end").agg(F.count("*").alias("n_changes"), F.count_if("deleted").alias("n_deleted"))
        _write(report, folder, "log", batch_id)
        _write(rows.sparkSession.range(1).select(until.alias("closed_until")), folder, "marks", batch_id)

    return _start(events, each, folder, "append", trigger)


def read_window_close(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "log").drop("batch_id")


RETRY = Totals(("record_url",), {"attempts": ("count(*)", "sum"), "last": ("max(struct(attempted_at, seq, reason_code))", "max")})


def stream_retry(attempts: DataFrame, folder: str, trigger: dict | None = None, snapshot_every: int = totals.SNAPSHOT_EVERY) -> StreamingQuery:
    """Attempts per unresolved record and the last of them."""
    return _totals(attempts, RETRY, folder, trigger, snapshot_every)


def read_retry(spark: SparkSession, folder: str, after_days: int, max_attempts: int) -> DataFrame:
    """Attempts, when the next is due, and whether none is left."""
    spent = F.col("attempts") >= max_attempts
    return totals.read(RETRY, spark, folder).select(
        "record_url", "attempts", F.col("last.attempted_at").alias("last_attempt"), "last.reason_code", spent.alias("exhausted"),
        F.when(~spent, F.col("last.attempted_at") + F.make_dt_interval(F.lit(after_days))).alias("next_retry_at"),
    )


def _younger(column: str, age: str) -> Callable[[DataFrame], DataFrame]:
    """Rows no older than ``age`` before the newest row."""

    def keep(table: DataFrame) -> DataFrame:
        newest = table.agg(F.max(column)).first()[0]
        return table if newest is None else table.filter(F.col(column) >= gates.instant(str(newest)) - F.expr(f"INTERVAL {age}"))

    return keep


# no look-up lives longer than a hit, so an entry that old cannot hide or reveal another
CACHE = Totals(
    ("source", "query"), {"c": ("max(struct(cached_at, seq, status, expires_at))", "max")}, _younger("c.cached_at", f"{vocab.HIT_HOURS} HOUR")
)


def stream_ttl_cache(lookups: DataFrame, folder: str, trigger: dict | None = None, snapshot_every: int = totals.SNAPSHOT_EVERY) -> StreamingQuery:
    """Newest look-up per source and query; snapshots leave out what is past the longest life.

    A look-up that arrives late counts by its own instant.
    """
    return _totals(lookups, CACHE, folder, trigger, snapshot_every)


def read_ttl_cache(spark: SparkSession, folder: str, now) -> DataFrame:
    """Entries alive at ``now``, which is not before the newest entry."""
    newest = totals.read(CACHE, spark, folder).select("source", "query", "c.status", "c.cached_at", "c.expires_at")
    return newest.filter(F.col("expires_at") > gates.instant(now))


UNDATED = Totals(
    ("record_url",),
    {"first_quarantined": ("min(CASE WHEN undated THEN seen_at END)", "min"), "newest": ("max(struct(seen_at, undated))", "max")},
    _younger("newest.seen_at", f"{vocab.QUARANTINE_DAYS} DAY"),
)


def stream_quarantine(candidates: DataFrame, folder: str, trigger: dict | None = None, snapshot_every: int = totals.SNAPSHOT_EVERY) -> StreamingQuery:
    """First and last time each undated record was seen; evidence seen later releases it.

    Snapshots forget records that were not seen for the retention time.
    """
    return _totals(candidates, UNDATED, folder, trigger, snapshot_every)


def read_quarantine(spark: SparkSession, folder: str, now) -> DataFrame:
    keep = gates.instant(now) - F.expr(f"INTERVAL {vocab.QUARANTINE_DAYS} DAY")
    seen = totals.read(UNDATED, spark, folder).filter(F.col("newest.undated") & (F.col("newest.seen_at") >= keep))
    return seen.select("record_url", "first_quarantined", F.col("newest.seen_at").alias("last_seen"))


def stream_notify_once(matches: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """At most one notification per work and kind over the whole stream: the earliest match of
    the batch that first brings them."""
    keys = ["work_id", "kind"]
    rest = [c for c in matches.columns if c not in keys]
    earliest = F.min(F.struct("matched_at", *[c for c in rest if c != "matched_at"])).alias("_first")
    first = _first_batch_only(matches, keys, earliest)
    return _news(first.select(*keys, "_new", *[F.col("_first")[c].alias(c) for c in rest]), folder, trigger)


def read_notifications(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "log").drop("batch_id")


def stream_coverage(pages: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Coverage intervals of requests whose every page has arrived.

    ``pages``: ``request_id, page_no, n_pages, source_key, window_start,
    window_end, checked_at``.  Only pages of unfinished requests are carried on.
    """
    spark = pages.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        carried = _read(spark, folder, "open", batch).filter(F.col("batch_id") == batch_id - 1).drop("batch_id")
        # of a page that arrives twice the greater facts count, in whatever order they came
        kept = [c for c in batch.columns if c not in ("request_id", "page_no")]
        every = carried.unionByName(batch).groupBy("request_id", "page_no").agg(F.max(F.struct(*kept)).alias("p")).select("request_id", "page_no", "p.*")
        sums = every.groupBy("request_id").agg(
            F.count("*").alias("_n"), F.min("n_pages").alias("_low"), F.max("n_pages").alias("_high"),
            F.min("source_key").alias("source_key"), F.min("window_start").alias("window_start"),
            F.max("window_end").alias("window_end"), F.max("checked_at").alias("checked_at"),
        )
        whole = (F.col("_n") == F.col("_low")) & (F.col("_low") == F.col("_high"))
        _write(sums.filter(whole).select("request_id", "source_key", "window_start", "window_end", "checked_at"), folder, "log", batch_id)
        rest = every.join(sums.filter(~whole).select("request_id"), "request_id", "left_semi")
        _write(rest, folder, "open", batch_id)

    return _start(pages, each, folder, "append", trigger)


def read_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.coalesce_intervals(_read(spark, folder, "log").drop("batch_id", "request_id"))


REQUESTS = Totals(("window_start", "source", "late"), {
    "logical_requests": ("count(*)", "sum"),
    "first_attempt_successes": ("count_if(outcome = 'success' AND attempts = 1)", "sum"),
    "failed_requests": ("count_if(NOT outcome = 'success')", "sum"),
    "attempts": ("sum(attempts)", "sum"), "wait_centis": ("sum(wait_centis)", "sum"),
})


def stream_telemetry(
    requests: DataFrame, folder: str, width: str = "1 day", delay: str = "1 day", trigger: dict | None = None,
    snapshot_every: int = totals.SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Request counters per source and event-time window.

    A window is over when a request ``delay`` past its end was seen in an earlier batch.
    Requests of windows that are over are added up apart, so what was reported of a
    window stays as it was and what came later is known.
    """
    spark = requests.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        mark = _mark(spark, folder, batch_id)
        before = mark.first()[0] if mark is not None else None
        closed = F.lit(None).cast("timestamp_ntz") if before is None else gates.instant(str(before))
        timed = batch.withColumn("_w", F.window("ts", width))
        late = F.coalesce(F.col("_w.end") <= closed, F.lit(False))
        totals.write_batch(
            REQUESTS, timed.withColumn("window_start", F.col("_w.start")).withColumn("late", late), batch_id, folder, snapshot_every
        )
        until = F.greatest(closed, F.max("ts") - F.expr(f"INTERVAL {delay}"))
        _write(batch.agg(until.alias("closed_until")), folder, "marks", batch_id)

    return _start(requests, each, folder, "append", trigger)


def read_telemetry(spark: SparkSession, folder: str, late: bool | None = None) -> DataFrame:
    """Counters of all requests, or of those in time (``late=False``) or late (``late=True``)."""
    rows = totals.read(REQUESTS, spark, folder)
    if late is not None:
        rows = rows.filter(F.col("late") == late)
    return rows.groupBy("window_start", "source").agg(*[F.sum(c).alias(c) for c in REQUESTS.columns])
