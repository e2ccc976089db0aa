"""Decision tables, skew, order, empty input, commits and streams of several batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import gates, graph, intervals, journals, merge, ranking, state, taxonomy, types
from shelfmark.session import shared_path
from shelfmark.sources import feeds, tables
from shelfmark.streaming import jobs, totals

NTZ = "timestamp_ntz"


def ts(text):
    return datetime.fromisoformat(text)


@pytest.mark.parametrize("value,precision,source,event,inferred,status", [
    ("2026-09-03", "day", "crossref", "recently_published_online", False, "confirmed_new"),
    ("2026-08-31", "day", "crossref", "recently_published_online", False, "confirmed_new"),
    ("2026-09-07", "day", "crossref", "recently_published_online", False, "uncertain"),
    ("2026-08-01", "day", "crossref", "recently_published_online", False, "newly_indexed_old_work"),
    ("2026-09", "month", "crossref", "recently_published", False, "uncertain"),
    ("2026-07", "month", "crossref", "recently_published", False, "newly_indexed_old_work"),
    ("2025", "year", "crossref", "recently_published", False, "newly_indexed_old_work"),
    ("2026", "year", "crossref", "recently_published", False, "uncertain"),
    ("2026-09-03", "day", "crossref", "recently_published", True, "uncertain"),
    ("2026-09-03", "day", "OAI-Datestamp", "recently_published", False, "source_record_updated"),
    ("2026-09-03", "day", "crossref", "metadata_updated", False, "source_record_updated"),
    (None, None, None, "recently_published", False, "uncertain"),
    ("2026-09-06T23:59:59", "second", "crossref", "recently_published", False, "confirmed_new"),
])
def test_freshness(spark, value, precision, source, event, inferred, status):
    df = spark.createDataFrame([(value, precision, source, event, inferred)], "value string, precision string, source string, event string, inferred boolean")
    assert gates.assess_freshness(df, "2026-08-31 00:00:00", "2026-09-07 00:00:00").first().freshness == status


@pytest.mark.parametrize("rows,work_type,status", [
    ([("crossref", "journal-article", "s")], "article", "confirmed"),
    ([("crossref", "journal-article", "s"), ("openalex", "article", "s")], "article", "confirmed"),
    ([("crossref", "posted-content", "s"), ("openalex", "article", "s")], "article", "compatible"),
    ([("crossref", "book", "s"), ("openalex", "article", "s")], "conflict", "conflict"),
    ([("crossref", "component", "s"), ("openalex", "article", "s")], "article", "compatible"),
    ([("crossref", "component", "s")], "other", "confirmed"),
    ([("crossref", "nonsense", "s"), ("openalex", "article", "s")], "unknown", "unknown"),
    ([("title-label", "book-review", "explicit-bibliographic-label")], "book-review", "explicit_label"),
    ([("crossref", "book", "s"), ("openalex", "article", "document-inspection")], "article", "reviewed"),
    ([("openalex", "book", "document-inspection"), ("openalex", "article", "document-inspection")], "conflict", "conflict"),
    ([("change-log", "info:eu-repo/semantics/bachelorThesis", "s")], "dissertation", "confirmed"),
    ([("elsewhere", "article", "s")], "unknown", "unknown"),
])
def test_types(spark, rows, work_type, status):
    df = spark.createDataFrame([(1, *r) for r in rows], "record_id int, provider string, raw_type string, method string")
    got = types.resolve_type(df).first()
    assert (got.work_type, got.type_status) == (work_type, status)


def test_expansion_stops_at_inactive_and_survives_depth(spark):
    rows = [("r", [], True), ("a", ["r"], True), ("b", ["r"], False), ("c", ["b"], True), ("d", ["a", "b"], True)]
    rows += [(f"n{i}", ["d" if i == 0 else f"n{i - 1}"], True) for i in range(6)]
    nodes = spark.createDataFrame([(i, i, p, None, a) for i, p, a in rows], "category_id string, name string, parent_ids array<string>, primary_parent_id string, active boolean")
    picked = spark.createDataFrame([("r", True)], "category_id string, include_descendants boolean")
    got = {r.category_id for r in taxonomy.expand_categories(nodes, picked).collect()}
    assert got == {"r", "a", "d", *(f"n{i}" for i in range(6))}


def test_cycles_are_reported_and_end(spark):
    rows = [("a", ["c"]), ("b", ["a"]), ("c", ["b"]), ("d", ["c"]), ("e", [])]
    nodes = spark.createDataFrame([(i, i, p, None, True) for i, p in rows], "category_id string, name string, parent_ids array<string>, primary_parent_id string, active boolean")
    got = {(r.category_id, r.detail) for r in taxonomy.taxonomy_violations(nodes).filter("violation = 'cycle'").collect()}
    assert got == {("a", "c"), ("b", "a"), ("c", "b")}


def test_components_of_a_long_chain(spark):
    n = 200
    chain = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert graph.components(chain).groupBy("root").count().collect()[0].asDict() == {"root": 0, "count": n + 1}


def test_components_with_one_hub(spark):
    items = spark.range(2000).select(
        F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, "hub").alias("doi"), F.concat(F.lit("u"), F.col("id") % 1500).alias("url")
    )
    groups = graph.connected_records(items, ["doi", "url"])
    by_python = {}
    parent = list(range(2000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(2000):
        for key in (["hub"] if i % 3 == 0 else []) + [f"u{i % 1500}"]:
            if key in by_python:
                a, b = sorted((find(i), find(by_python[key])))
                parent[b] = a
            else:
                by_python[key] = i
    assert {r.record_id: r.group_id for r in groups.collect()} == {i: find(i) for i in range(2000)}


def merge_spans(rows):
    out = []
    for start, end, checked in sorted(rows):
        end = min(end, checked)
        if start >= end:
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), max(out[-1][2], checked))
        else:
            out.append((start, end, checked))
    return out


def test_rows_without_a_key_are_a_key_of_their_own(spark, monkeypatch):
    """As a grouping does; a window without a key is still held by nothing.  Also where their day is crowded."""
    shape = "source_key string, window_start timestamp_ntz, window_end timestamp_ntz, checked_at timestamp_ntz"
    start = datetime(2024, 1, 5)
    rows = [(key, start + timedelta(hours=2 * k), start + timedelta(hours=2 * k + 1 + k % 2), datetime(2024, 2, 1)) for key in (None, "a") for k in range(8)]
    df = spark.createDataFrame(rows, shape)
    for block in (intervals.BLOCK, 2):
        monkeypatch.setattr(intervals, "BLOCK", block)
        found = {}
        for r in intervals.coalesce_intervals(df).collect():
            found.setdefault(r.source_key, []).append((r.window_start, r.window_end))
        assert len(found["a"]) == 5 and sorted(found[None]) == sorted(found["a"])
        gaps = {}
        for r in intervals.coverage_gaps(df, "2024-01-05 00:00:00", "2024-01-06 00:00:00").collect():
            gaps.setdefault(r.source_key, []).append((r.gap_start, r.gap_end))
        assert len(gaps["a"]) == 5 and sorted(gaps[None]) == sorted(gaps["a"])
        held = intervals.covering_interval(df, df.select("source_key", "window_start", "window_end"))
        assert {(r.source_key, r.covered_start is not None) for r in held.collect()} == {(None, False), ("a", True)}


def test_intervals_of_one_hot_key(spark):
    base = ts("2024-01-01")
    rows = []
    for i in range(400):
        start = base + timedelta(hours=(i * 37) % 2000)
        rows.append((1, start, start + timedelta(hours=1 + i % 9), start + timedelta(hours=5)))
    df = spark.createDataFrame(rows, f"source_key int, window_start {NTZ}, window_end {NTZ}, checked_at {NTZ}").repartition(7)
    got = sorted((r.window_start, r.window_end, r.checked_at) for r in intervals.coalesce_intervals(df).collect())
    want = merge_spans([r[1:] for r in rows])
    assert got == want
    gaps = sorted((r.gap_start, r.gap_end) for r in intervals.coverage_gaps(df, "2024-01-10 00:00:00", "2024-02-10 00:00:00").collect())
    cursor, holes = ts("2024-01-10"), []
    for start, end, _ in want:
        if end <= cursor or start >= ts("2024-02-10"):
            continue
        if start > cursor:
            holes.append((cursor, start))
        cursor = max(cursor, end)
    if cursor < ts("2024-02-10"):
        holes.append((cursor, ts("2024-02-10")))
    assert gaps == holes


def test_a_million_instants_in_one_key_and_day(spark):
    """Key 1 fills a day evenly, key 2 puts 60,000 instants into a fifteenth of a second; no window sees more than a block."""
    step = F.when(F.col("k") == 1, 86_000).otherwise(1)
    ids = spark.range(1_000_000).withColumn("k", F.lit(1)).unionByName(spark.range(60_000).withColumn("k", F.lit(2)))
    at = lambda micros: F.timestamp_micros(F.lit(1_704_067_200_000_000) + micros).cast("timestamp_ntz")
    df = ids.select(F.col("k").alias("source_key"), "id", at(F.col("id") * step).alias("window_start"), at((F.col("id") + 1) * step).alias("window_end"))
    df = df.withColumn("window_end", F.when(F.col("id") % 1000 == 999, F.col("window_start")).otherwise(F.col("window_end")))
    cov = df.withColumn("checked_at", F.lit("2024-02-01").cast(NTZ)).drop("id")
    blocks = intervals._blocked(df.select("source_key", "window_start"), "source_key", "window_start", "day").groupBy("source_key", "_bucket").count()
    sizes = blocks.groupBy("source_key").agg(F.max("count").alias("most"), F.sum("count").alias("n")).orderBy("source_key").collect()
    assert [r.n for r in sizes] == [1_000_000, 60_000] and all(r.most <= intervals.BLOCK for r in sizes)
    length = F.expr("window_end - window_start")
    found = intervals.coalesce_intervals(cov).groupBy("source_key").agg(F.count("*").alias("n"), F.min(length).alias("least"), F.max(length).alias("most"))
    got = {r.source_key: (r.n, r.least, r.most) for r in found.collect()}
    whole = {k: timedelta(microseconds=999 * micros) for k, micros in ((1, 86_000), (2, 1))}
    assert got == {1: (1000, whole[1], whole[1]), 2: (60, whole[2], whole[2])}
    facts = df.filter("id % 7 = 0").select("source_key", F.col("id").alias("version"), F.col("window_start").alias("since"))
    asked = intervals.as_of(df.select("source_key", "id", F.col("window_start").alias("at")), facts, "source_key", "at", "since")
    assert asked.agg(F.count("*"), F.count_if(F.col("version") == F.col("id") - F.col("id") % 7)).first() == (1_060_000, 1_060_000)


def test_as_of_takes_the_later_version_at_a_tie(spark):
    profiles = spark.createDataFrame([(1, 1, ts("2024-01-01")), (1, 2, ts("2024-01-05")), (1, 3, ts("2024-01-05"))], f"profile_id int, version int, effective_from {NTZ}")
    events = spark.createDataFrame([(1, ts("2023-12-31")), (1, ts("2024-01-04")), (1, ts("2024-01-05")), (1, ts("2024-03-01")), (2, ts("2024-03-01"))], f"profile_id int, at {NTZ}")
    got = {(r.profile_id, r["at"]): r.version for r in intervals.profile_as_of(events, profiles).collect()}
    assert got == {(1, ts("2023-12-31")): None, (1, ts("2024-01-04")): 1, (1, ts("2024-01-05")): 3, (1, ts("2024-03-01")): 3, (2, ts("2024-03-01")): None}


def test_positions_of_one_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), (F.col("id") * 7919 % 5003).alias("k"))
    got = ranking.with_position(df, [F.desc("k"), F.col("id")], ["g"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.position, -r.k, r.id))
    for rows in groups.values():
        rows.sort()
        assert [p for p, _, _ in rows] == list(range(1, len(rows) + 1))
        assert [(k, i) for _, k, i in rows] == sorted((k, i) for _, k, i in rows)


def test_weeks_follow_local_midnights_over_daylight_saving(spark):
    profiles = spark.createDataFrame([(1, "America/New_York", 0, 6)], "profile_id int, zone string, weekday int, report_hour int")
    runs = spark.createDataFrame([(1, ts("2024-02-26 05:00:00"), ts("2024-03-04 05:00:00"))], f"profile_id int, window_start {NTZ}, window_end {NTZ}")
    got = [(str(r.window_start), str(r.window_end)) for r in ranking.missing_windows(profiles, runs, "2024-03-19 12:00:00").orderBy("window_start").collect()]
    assert got == [("2024-03-04 05:00:00", "2024-03-11 04:00:00"), ("2024-03-11 04:00:00", "2024-03-18 04:00:00")]
    early = ranking.missing_windows(profiles, runs, "2024-03-18 09:59:00").count()  # before 06:00 local
    assert early == 1


def test_merge_does_not_depend_on_order(spark, folder):
    from checks.records import WINDOW
    from checks.views import Tables

    entries = Tables(spark, folder).v_feed_entries
    one = sorted(map(str, merge.merge_feeds(entries, WINDOW).collect()))
    two = sorted(map(str, merge.merge_feeds(entries.orderBy(F.rand(3)).repartition(5), WINDOW).collect()))
    assert one == two


def test_jobs_accept_empty_input(spark, folder):
    from checks.records import WINDOW
    from checks.views import Tables

    t = Tables(spark, folder)
    none = t.v_feed_entries.limit(0)
    assert merge.merge_feeds(none, WINDOW).count() == 0
    assert merge.latest_active(t.v_change_events.limit(0)).count() == 0
    assert intervals.coalesce_intervals(t.v_coverage.limit(0)).count() == 0
    assert journals.arrival_intervals(t.v_article_checks.limit(0)).count() == 0
    assert graph.connected_records(t.v_records.limit(0), ["doi"]).count() == 0
    counts = merge.change_audit(t.v_change_events.limit(0)).first()
    assert counts.unkeyed == 0 and counts.active_keys == 0


def test_budget_is_refused_not_truncated(spark):
    assert gates.budget_guard(spark.range(5), 5).count() == 5
    with pytest.raises(gates.BudgetExceeded):
        gates.budget_guard(spark.range(6), 5)


def test_failed_feed_is_not_an_empty_feed(spark):
    rows = [("a", "c", "<rss><channel></channel></rss>"), ("b", "c", "<rss><channel><item>"), ("d", "c", "not xml")]
    df = spark.createDataFrame(rows, "feed_key string, category_id string, payload string").withColumn("checked_at", F.lit("2024-01-01").cast(NTZ))
    got = {r.feed_key: (r.feed_status, r.title) for r in feeds.feed_entries(df).collect()}
    assert got == {"a": ("parsed", None), "b": ("failed", None), "d": ("failed", None)}


def test_committed_window_is_refused(spark):
    root = shared_path(spark, "ledger")
    table = {"report": spark.range(3).toDF("n")}
    tables.write_run(table, root, "run-a", "weekly", ("2024-01-01", "2024-01-08"))
    with pytest.raises(tables.WindowCommitted):
        tables.write_run(table, root, "run-b", "weekly", ("2024-01-01", "2024-01-08"))
    tables.write_run({"report": spark.range(2).toDF("n")}, root, "run-c", "weekly", ("2024-01-08", "2024-01-15"))
    assert tables.read_run_table(spark, root, "report").count() == 5
    assert tables.latest_version(spark, root, "report").count() == 2


def landed(spark, df, parts):
    """The rows of ``df`` as ``parts`` files, by time, to be read one per micro-batch."""
    path = shared_path(spark, "landed")
    for n in range(parts):
        df.filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query):
    query.awaitTermination()


def test_streams_of_several_batches_equal_the_batch_jobs(spark, folder):
    from checks.views import Tables

    t = Tables(spark, folder)
    part = (F.col("event_id") % 3).cast("int")
    changes = t.v_change_events.withColumn("part", part)
    out = shared_path(spark, "latest")
    finish(jobs.stream_latest(landed(spark, changes, 3), out))
    key = ["record_key", "identifier", "event_id", "changed_at", "deleted", "dc_type", "dc_date"]
    assert sorted(map(str, jobs.read_latest(spark, out).select(key).collect())) == sorted(map(str, merge.latest_active(t.v_change_events).select(key).collect()))

    matches = t.events.select(F.concat(F.lit("w"), "user_id").alias("work_id"), F.col("event_type").alias("kind"), F.col("ts").alias("matched_at"), part.alias("part"))
    out = shared_path(spark, "notify")
    finish(jobs.stream_notify_once(landed(spark, matches, 3), out))
    told = jobs.read_notifications(spark, out)
    assert told.count() == told.select("work_id", "kind").distinct().count() == matches.select("work_id", "kind").distinct().count()

    first = shared_path(spark, "first")
    finish(jobs.stream_first_seen(landed(spark, t.v_feed_entries.withColumn("part", part), 3), first))
    seen = jobs.read_first_seen(spark, first)
    assert seen.count() == merge.merge_feeds(t.v_feed_entries).count() == seen.select("record_url").distinct().count()


def test_late_rows_wait_aside(spark):
    rows = [(1, "2024-01-02 00:00:00", 0), (2, "2024-01-09 12:00:00", 0), (3, "2024-01-03 00:00:00", 1), (4, "2024-01-16 12:00:00", 1)]
    df = spark.createDataFrame([(i, ts(at), False, p) for i, at, p in rows], f"event_id int, changed_at {NTZ}, deleted boolean, part int")
    out = shared_path(spark, "close")
    finish(jobs.stream_window_close(landed(spark, df, 2), out, days=7, delay_hours=1))
    closed = {str(r.window_start): r.n_changes for r in jobs.read_window_close(spark, out).collect()}
    assert closed == {"2024-01-01 00:00:00": 1, "2024-01-08 00:00:00": 1}
    assert [r.event_id for r in spark.read.parquet(f"{out}/late").collect()] == [3]


def shuffled(rows, parts):
    """``rows`` with a ``part`` that does not follow their order."""
    return rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"))


def as_rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_totals_of_a_stream_do_not_depend_on_order(spark, folder):
    from checks.views import Tables

    t = Tables(spark, folder)
    held, one = shared_path(spark, "telemetry"), shared_path(spark, "telemetry")
    finish(jobs.stream_telemetry(landed(spark, shuffled(t.v_requests, 5), 5), held, delay="1 hour", snapshot_every=2))
    finish(jobs.stream_telemetry(landed(spark, t.v_requests.withColumn("part", F.lit(0)), 1), one))
    assert jobs.read_telemetry(spark, held, late=True).count() > 0
    assert jobs.read_telemetry(spark, one, late=True).count() == 0
    assert as_rows(jobs.read_telemetry(spark, held)) == as_rows(jobs.read_telemetry(spark, one))

    held, now = shared_path(spark, "cache"), "2024-01-30 06:00:00"
    finish(jobs.stream_ttl_cache(landed(spark, shuffled(t.v_lookup_cache.filter(F.col("cached_at") <= now), 5), 5), held, snapshot_every=2))
    newest = t.v_lookup_cache.filter(F.col("cached_at") <= now).groupBy("source", "query").agg(
        F.max_by(F.struct("status", "cached_at", "expires_at"), F.struct("cached_at", "seq")).alias("c")
    ).select("source", "query", "c.*").filter(F.col("expires_at") > ts(now))
    assert newest.count() > 0
    assert as_rows(jobs.read_ttl_cache(spark, held, now)) == as_rows(newest)


def test_snapshots_survive_a_stop_half_way(spark):
    rows = [("a", ts("2024-01-01"), 1, "x", 0), ("b", ts("2024-01-01"), 2, "x", 1), ("a", ts("2024-01-03"), 3, "y", 2), ("a", ts("2024-01-02"), 4, "z", 3)]
    df = spark.createDataFrame(rows, f"record_url string, attempted_at {NTZ}, seq int, reason_code string, part int")
    out = shared_path(spark, "retry")
    path = shared_path(spark, "landed")

    def land(n):
        df.filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(path)
        finish(jobs.stream_retry(spark.readStream.schema(df.drop("part").schema).parquet(path), out, snapshot_every=2))

    def read():
        return {r.record_url: (r.attempts, r.reason_code, str(r.last_attempt), r.exhausted) for r in jobs.read_retry(spark, out, 7, 3).collect()}

    land(0)
    land(1)
    assert totals.finished(spark, f"{out}/snapshot", "upto") == [0]
    land(2)
    before = {"a": (2, "y", "2024-01-03 00:00:00", False), "b": (1, "x", "2024-01-01 00:00:00", False)}
    assert read() == before
    # a snapshot that stopped before its mark, with rows that are not to be read
    spark.range(3).withColumn("record_url", F.lit("half")).write.parquet(f"{out}/snapshot/upto=2")
    totals._delete(spark, f"{out}/snapshot/upto=2/_SUCCESS")
    assert read() == before
    land(3)
    assert totals.finished(spark, f"{out}/snapshot", "upto") == [0, 2]
    assert totals.finished(spark, f"{out}/log", "batch_id") == [1, 2, 3]
    assert read() == {"a": (3, "y", "2024-01-03 00:00:00", True), "b": (1, "x", "2024-01-01 00:00:00", False)}
    # the snapshot that readers may still hold stays, the one before goes
    totals.snapshot(jobs.RETRY, spark, out, 3)
    assert totals.finished(spark, f"{out}/snapshot", "upto") == [2, 3]
    assert totals.finished(spark, f"{out}/log", "batch_id") == [3]
    assert read()["a"] == (3, "y", "2024-01-03 00:00:00", True)


def test_quarantine_snapshots_forget_what_is_past_retention(spark):
    rows = [("old", True, ts("2023-01-01"), 0), ("new", True, ts("2024-06-01"), 1), ("new", False, ts("2024-07-01"), 2), ("kept", True, ts("2024-07-01"), 2)]
    df = spark.createDataFrame(rows, f"record_url string, undated boolean, seen_at {NTZ}, part int")
    out = shared_path(spark, "quarantine")
    finish(jobs.stream_quarantine(landed(spark, df, 3), out, snapshot_every=3))
    assert {r.record_url for r in spark.read.parquet(f"{out}/snapshot/upto=1").collect()} == {"new"}
    assert [r.record_url for r in jobs.read_quarantine(spark, out, "2024-07-02 00:00:00").collect()] == ["kept"]


def test_memory_of_a_stream_is_not_its_log(spark):
    """Known keys are looked up in the state store: the log may be moved away, nothing is told twice."""
    rows = [("w1", "k", ts("2024-01-02"), 0), ("w1", "k", ts("2024-01-01"), 0), (None, "k", ts("2024-01-01"), 0), ("w1", "k", ts("2023-01-01"), 1), ("w2", "k", ts("2024-01-05"), 1), (None, "k", ts("2024-01-01"), 1)]
    df = spark.createDataFrame(rows, f"work_id string, kind string, matched_at {NTZ}, part int")
    out, path = shared_path(spark, "notify"), shared_path(spark, "landed")
    told = []
    for n in range(2):
        df.filter(F.col("part") == n).drop("part").write.mode("append").parquet(path)
        finish(jobs.stream_notify_once(spark.readStream.schema(df.drop("part").schema).parquet(path), out))
        told.append(sorted((str(r.work_id), str(r.matched_at)) for r in jobs.read_notifications(spark, out).collect()))
        totals._delete(spark, f"{out}/log")
    assert told == [[("None", "2024-01-01 00:00:00"), ("w1", "2024-01-01 00:00:00")], [("w2", "2024-01-05 00:00:00")]]

    feed = spark.createDataFrame([("u1", "T", 0), ("u2", "B", 0), ("u2", "A", 0), ("u0", "known", 1), ("u1", "Later", 1), ("u3", None, 1)], "record_url string, title string, part int")
    baseline = spark.createDataFrame([("u0",), ("u9",), (None,)], "record_url string")
    out, path = shared_path(spark, "first"), shared_path(spark, "landed")
    for n in range(2):
        feed.filter(F.col("part") == n).drop("part").write.mode("append").parquet(path)
        finish(jobs.stream_first_seen(spark.readStream.schema("record_url string, title string").parquet(path), out, baseline=baseline))
    assert {r.record_url: r.title for r in jobs.read_first_seen(spark, out).collect()} == {"u1": "T", "u2": "A", "u3": None}


def test_coverage_waits_for_every_page(spark):
    day = ts("2024-01-01")
    rows = [("a", 1, 2, 0), ("b", 1, 1, 0), ("a", 2, 2, 1), ("c", 1, 2, 1)]
    df = spark.createDataFrame(
        [(r, n, m, 7, day, day + timedelta(days=1), day + timedelta(days=2), p) for r, n, m, p in rows],
        f"request_id string, page_no int, n_pages int, source_key int, window_start {NTZ}, window_end {NTZ}, checked_at {NTZ}, part int",
    )
    out = shared_path(spark, "coverage")
    finish(jobs.stream_coverage(landed(spark, df, 2), out))
    assert {r.request_id for r in spark.read.parquet(f"{out}/log").collect()} == {"a", "b"}
    assert jobs.read_coverage(spark, out).count() == 1


def test_transition_rules(spark):
    queue = spark.createDataFrame([("g", "u1", "pending", None), ("g", "u2", "reviewed", None), ("g", "u3", "blocked", ts("2024-01-01"))], f"grp string, url string, status string, blocked_since {NTZ}")
    moves = spark.createDataFrame([("g", "u1", "blocked", "x"), ("g", "u2", "dismissed", "x"), ("g", "u3", "blocked", "x"), ("g", "u9", "blocked", "x")], "grp string, url string, decision string, note string")
    after, refused = state.queue_transition(queue, moves, "2024-02-01 00:00:00")
    assert {r.url: (r.status, str(r.blocked_since)) for r in after.collect()} == {
        "u1": ("blocked", "2024-02-01 00:00:00"), "u2": ("reviewed", "None"), "u3": ("blocked", "2024-01-01 00:00:00"),
    }
    assert {r.url: r.refusal for r in refused.collect()} == {"u2": "reviewed_is_final", "u9": "unknown_link"}


def test_cross_check_takes_longer_author_lists(spark):
    shape = "title string, authors array<string>, venue string, year int, issue string"
    ours = spark.createDataFrame([
        ("u1", "A Title", ["Ann Lee"], "V", 2020, "01"), ("u2", "A Title", ["Ann Lee", "Bo Reid"], "V", 2020, "2"), ("u3", "Else", None, "V", 2020, "1"),
        ("u4", "A title", ["Bo Reid"], "V", 2020, "1"), ("u5", "A title", ["ann lee"], None, 2020, "1"), ("u6", "Gone", ["X"], "V", 2020, "1"),
    ], "url string, " + shape)
    others = spark.createDataFrame([
        (1, "a title", ["Ann LEE", "Cy"], "v", 2020, "1"), (2, "A Title", ["Ann Lee", "Bo Reid", "Cy"], "V", 2020, "02"), (3, "else", ["Z"], "V", None, "1"),
    ], "record_id long, " + shape)
    got = {r.url: (r.status, r.other_id) for r in journals.cross_check(ours, others).collect()}
    assert got == {
        "u1": ("corroborated", 1), "u2": ("corroborated", 2), "u3": ("partial", 3), "u4": ("conflict", None), "u5": ("partial", 1), "u6": ("unverified", None),
    }


def test_corroborate_folds_all_texts_of_a_row_at_once(spark):
    """Width, case, separators in the text, missing and empty fields; one call of a Python function per row."""
    columns = "url string, title string, authors array<string>, venue string, year int, issue string"
    ours = [("u1", "ＡＢ Straße", ["Ann É", "Bo\x1e"], "V 1", 2020, "1"), ("u2", "T", ["A"], None, 2020, "1"), ("u3", "T", [], "", 2020, None),
            ("u4", "T\x1e2", ["A", "B"], "V", 2020, "2"), ("u5", "T", ["A"], "V", 2020, None)]
    theirs = [("u1", "ab STRASSE", ["ann é", "bo"], "v-1", 2020, "01"), ("u2", "t", ["a"], None, 2020, "1"), ("u3", "t", [], "", 2020, "1"),
              ("u4", "T2", ["B", "A"], "V", 2021, "3"), ("u5", "t", ["a"], "v", 2020, "4")]
    found = journals.corroborate(spark.createDataFrame(ours, columns), spark.createDataFrame(theirs, columns))
    assert {r.url: (r.conflicts, r.status) for r in found.collect()} == {
        "u1": ([], "corroborated"), "u2": (["venue"], "conflict"), "u3": (["authors", "venue"], "conflict"),
        "u4": (["authors", "year", "issue"], "conflict"), "u5": ([], "partial"),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("_compatible_lower(") == 1
