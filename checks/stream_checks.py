"""Checks of the streaming jobs: each stream runs to the end of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.journal_checks import stamp
from checks.records import LATEST
from checks.registry import check
from checks.views import Tables, cat
from shelfmark.session import shared_path
from shelfmark.streaming import jobs


class Streamed(Tables):
    """The same views over a streaming read of one table."""

    def read(self, name):
        table = f"{name}.parquet"
        schema = self.spark.read.parquet(f"{self.folder}/{table}").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", table).parquet(self.folder)


def finished(job, stream, t: Tables, name: str, *args, **kwargs) -> str:
    folder = shared_path(t.spark, name)
    query = job(stream, folder, *args, **kwargs)
    query.awaitTermination()
    return folder


def streamed(t: Tables) -> Streamed:
    return Streamed(t.spark, t.folder)


@check("j01_stream_first_seen", """
    SELECT record_url, min(title) AS title FROM v_feed_entries WHERE record_url NOT IN (SELECT record_url FROM v_unresolved WHERE attempts = 1) GROUP BY record_url""")
def _(t):
    baseline = t.v_unresolved.filter("attempts = 1")
    return jobs.read_first_seen(t.spark, finished(jobs.stream_first_seen, streamed(t).v_feed_entries, t, "first", baseline=baseline))


@check("j02_stream_latest", f"""
    SELECT record_key, identifier, event_id, {stamp("date_trunc('second', changed_at)").replace("AS date_trunc('second', changed_at)", "AS changed_at")}, deleted, dc_type, dc_date FROM ({LATEST})""")
def _(t):
    return jobs.read_latest(t.spark, finished(jobs.stream_latest, streamed(t).v_change_events, t, "latest"))


@check("j03_stream_week_counts", """
    SELECT strftime(date_trunc('week', changed_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York'), '%Y-%m-%d %H:%M:%S') AS week_start,
      count(*) AS n_changes, count(*) FILTER (WHERE deleted) AS n_deleted FROM v_change_events GROUP BY 1""")
def _(t):
    return jobs.read_week_counts(t.spark, finished(jobs.stream_week_counts, streamed(t).v_change_events, t, "weeks", zone="America/New_York"))


@check("j04_stream_window_close", """
    WITH w AS (SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(floor((CAST(changed_at AS DATE) - DATE '2024-01-01') / 7) * 7 AS INTEGER)) AS s FROM v_change_events)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n_changes, count(*) FILTER (WHERE deleted) AS n_deleted
    FROM w WHERE s + INTERVAL 7 DAY <= (SELECT max(changed_at) - INTERVAL 6 HOUR FROM v_change_events) GROUP BY s""")
def _(t):
    return jobs.read_window_close(t.spark, finished(jobs.stream_window_close, streamed(t).v_change_events, t, "close", days=7, delay_hours=6))


@check("j05_stream_retry", """
    SELECT record_url, count(*) AS attempts, strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS last_attempt, arg_max(reason_code, (ts, event_id)) AS reason_code,
      count(*) >= 70 AS exhausted, CASE WHEN count(*) < 70 THEN strftime(date_trunc('second', max(ts) + INTERVAL 7 DAY), '%Y-%m-%d %H:%M:%S') END AS next_retry_at
    FROM (SELECT 'r' || user_id AS record_url, ts, event_id, event_type AS reason_code FROM events) GROUP BY record_url""")
def _(t):
    attempts = streamed(t).events.select(
        cat("r", F.col("user_id").cast("string")).alias("record_url"), F.col("ts").alias("attempted_at"), F.col("event_id").alias("seq"), F.col("event_type").alias("reason_code")
    )
    return jobs.read_retry(t.spark, finished(jobs.stream_retry, attempts, t, "retry"), after_days=7, max_attempts=70)


@check("j06_stream_ttl_cache", """
    SELECT source, query, status, strftime(date_trunc('second', cached_at), '%Y-%m-%d %H:%M:%S') AS cached_at, strftime(date_trunc('second', expires_at), '%Y-%m-%d %H:%M:%S') AS expires_at
    FROM (SELECT *, row_number() OVER (PARTITION BY source, query ORDER BY cached_at DESC, seq DESC) AS rn FROM v_lookup_cache) WHERE rn = 1 AND expires_at > TIMESTAMP '2024-01-30 06:00:00'""")
def _(t):
    return jobs.read_ttl_cache(t.spark, finished(jobs.stream_ttl_cache, streamed(t).v_lookup_cache, t, "cache"), "2024-01-30 06:00:00")


@check("j06_stream_quarantine", """
    SELECT * EXCLUDE (last_undated) FROM (SELECT 'r' || user_id AS record_url, strftime(date_trunc('second', min(ts) FILTER (WHERE k % 2 = 0)), '%Y-%m-%d %H:%M:%S') AS first_quarantined,
        strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS last_seen, arg_max(k % 2 = 0, ts) AS last_undated FROM v_k GROUP BY user_id) WHERE last_undated""")
def _(t):
    rows = streamed(t).v_k.select(cat("r", F.col("user_id").cast("string")).alias("record_url"), (F.col("k") % 2 == 0).alias("undated"), F.col("ts").alias("seen_at"))
    return jobs.read_quarantine(t.spark, finished(jobs.stream_quarantine, rows, t, "quarantine"), "2024-02-01 00:00:00")


@check("j07_stream_notify_once", """
    SELECT 'w' || user_id AS work_id, event_type AS kind, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS matched_at FROM events GROUP BY user_id, event_type""")
def _(t):
    rows = streamed(t).events.select(cat("w", F.col("user_id").cast("string")).alias("work_id"), F.col("event_type").alias("kind"), F.col("ts").alias("matched_at"))
    return jobs.read_notifications(t.spark, finished(jobs.stream_notify_once, rows, t, "notify"))


@check("j08_stream_coverage", f"""
    WITH pages AS (SELECT o_custkey AS request_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no, o_orderkey, o_orderdate, o_custkey % 40 AS source_key FROM orders),
    w AS (SELECT request_id, source_key, min(o_orderdate) AS s, max(o_orderdate) + INTERVAL 1 DAY AS e, max(o_orderdate) + INTERVAL 30 DAY AS c FROM pages WHERE request_id % 5 <> 0 GROUP BY ALL),
    p AS (SELECT *, max(e) OVER (PARTITION BY source_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM w),
    i AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM p)
    SELECT source_key, strftime(min(s), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(max(e), '%Y-%m-%d %H:%M:%S') AS window_end, strftime(max(c), '%Y-%m-%d %H:%M:%S') AS checked_at FROM i GROUP BY source_key, island""")
def _(t):
    from pyspark.sql import Window

    request = Window.partitionBy("o_custkey")
    place = F.row_number().over(request.orderBy("o_orderkey"))
    # every fifth customer's last page never arrives
    told = F.count("*").over(request) + F.when(F.col("o_custkey") % 5 == 0, 1).otherwise(0)
    day = F.col("o_orderdate")
    held = t.orders.withColumn("page_no", place).withColumn("n_pages", told.cast("int")).select(
        F.col("o_custkey").alias("request_id"), "page_no", "n_pages", (F.col("o_custkey") % 40).alias("source_key"),
        day.alias("window_start"), (day + F.expr("INTERVAL 1 DAY")).alias("window_end"), (day + F.expr("INTERVAL 30 DAY")).alias("checked_at"),
    )
    landed = shared_path(t.spark, "pages")
    held.write.parquet(landed)
    stream = t.spark.readStream.schema(held.schema).parquet(landed)
    return jobs.read_coverage(t.spark, finished(jobs.stream_coverage, stream, t, "coverage"))


@check("j09_stream_telemetry", """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, source, count(*) AS logical_requests, count(*) FILTER (WHERE outcome = 'success' AND attempts = 1) AS first_attempt_successes,
      count(*) FILTER (WHERE outcome <> 'success') AS failed_requests, sum(attempts) AS attempts, sum(wait_centis) AS wait_centis FROM v_requests GROUP BY date_trunc('day', ts), source""", ints="attempts wait_centis")
def _(t):
    return jobs.read_telemetry(t.spark, finished(jobs.stream_telemetry, streamed(t).v_requests, t, "telemetry"))


