"""Runs: refusals before any read, baselines, conflicts, deferral and catch-up over committed state."""

import pytest
from pyspark.sql import functions as F

from checks.plan_checks import first_works, run_events, second_works
from checks.records import profile_rows
from checks.views import Tables
from shelfmark.operators import gates, merge
from shelfmark.plans import resolve, runs
from shelfmark.sources import tables

WINDOW = ("2024-01-08 00:00:00", "2024-01-15 00:00:00")
ENTRY = "record_url string, title string, category_id string, checked_at string, published_at string, year_hint int, type_hint string, doi_hint string"


def entries(spark, rows):
    df = spark.createDataFrame([(url, title, category, "2024-01-20 00:00:00", None, None, kind, None) for url, title, category, kind in rows], ENTRY)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("checked_at", "published_at")})


def week(spark, folder, rows, window=WINDOW, **options):
    t = Tables(spark, folder)
    state = {"seen": spark.createDataFrame([], runs.SEEN), "unresolved": spark.createDataFrame([], runs.UNRESOLVED), "notified": spark.createDataFrame([], runs.NOTIFIED)}
    return runs.weekly_run(
        entries(spark, rows), run_events(t).limit(0), first_works(t).limit(0), second_works(t).limit(0), profile_rows(t), window, **state, **options,
    )


def test_an_open_window_is_refused_before_any_read(spark, folder):
    broken = spark.range(1).select(F.raise_error(F.lit("read")).alias("category_id"))
    with pytest.raises(gates.WindowNotOver):
        week(spark, folder, [], now="2024-01-14 23:00:00", feeds=broken, baselines=broken)


def test_a_feed_without_baseline_stops_the_run(spark, folder):
    feeds = spark.createDataFrame([("click",), ("new",)], "category_id string")
    with pytest.raises(runs.BaselineRequired, match="new"):
        week(spark, folder, [], now="2024-01-16 00:00:00", feeds=feeds, baselines=feeds.filter("category_id = 'click'"))


def test_a_baseline_takes_only_new_feeds(spark):
    rows = entries(spark, [("u1", "Old", "click", None), ("u2", "Added", "new", None), ("u3", "Other", "unasked", None)])
    feeds = spark.createDataFrame([("click",), ("new",)], "category_id string")
    out = runs.baseline_run(rows, feeds, feeds.filter("category_id = 'click'"), "2024-01-16 00:00:00")
    assert [r.record_url for r in out["seen"].collect()] == ["u2"]
    assert {(r.category_id, str(r.established_at)) for r in out["baselines"].collect()} == {("click", "None"), ("new", "2024-01-16 00:00:00")}


def test_conflicts_are_set_aside_with_a_reason(spark, folder):
    rows = [("u1", "One title", "click", None), ("u1", "Another title", "view", None), ("u2", "Plain", "click", None)]
    out = week(spark, folder, rows)
    assert {(r.record_url, r.reason_code) for r in out["unresolved"].collect()} == {("u1", "conflicting_titles")}
    assert {r.record_url for r in out["report"].collect()} == {"u2"}
    works = spark.createDataFrame([("a", 1, True, "article"), ("b", 2, False, "conflict"), ("c", 2, False, "unknown"), ("d", 1, False, "unknown"), ("e", 2, False, "book")],
                                  "work_id string, n_rows int, doi_conflict boolean, work_type string")
    assert {r.work_id: r.why for r in works.withColumn("why", runs.set_aside_works()).collect()} == {
        "a": "identifier_conflict", "b": "structured_work_type_conflict", "c": "unknown_structured_work_type", "d": None, "e": None}


def test_deferred_records_are_neither_seen_nor_tried(spark, folder):
    rows = [("u1", "One title", "click", None), ("u1", "Another title", "view", None), ("u2", "Plain", "click", None), ("u3", "Failed", "click", None)]
    failed = spark.createDataFrame([("u3",)], "record_url string")
    out = week(spark, folder, rows, lookup_failed=failed, defer=True)
    assert {(r.record_url, r.reason_code) for r in out["deferred"].collect()} == {("u1", "conflicting_titles"), ("u3", "old_work_check_incomplete")}
    assert {r.record_url for r in out["seen"].collect()} == {"u2"} and out["unresolved"].count() == 0
    now = week(spark, folder, rows, lookup_failed=failed)
    assert {r.record_url for r in now["seen"].collect()} == {"u1", "u2", "u3"} and now["unresolved"].count() == 2


@pytest.fixture
def schedule(spark):
    plan = spark.createDataFrame([(1, "UTC", 0, 6)], "profile_id int, zone string, weekday int, report_hour int")
    runs_before = spark.createDataFrame([(1, "2023-12-25 00:00:00", "2024-01-01 00:00:00")], "profile_id int, window_start string, window_end string").select(
        "profile_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")))
    return plan, runs_before


def versions(spark, *stamps):
    rows = [(1, k + 1, at, "interest", f"c{k + 1}") for k, at in enumerate(stamps)]
    return spark.createDataFrame(rows, "profile_id int, version int, effective_from string, role string, category_id string").withColumn(
        "effective_from", F.col("effective_from").cast("timestamp_ntz"))


def test_catch_up_goes_on_after_its_last_committed_week(spark, schedule, tmp_path):
    root, asked = str(tmp_path / "runs"), []

    def run(window, profile, state, defer):
        asked.append((window[0][:10], profile.first().category_id, state["seen"].count(), defer))
        if len(asked) == 2:
            raise RuntimeError("the second week fails")
        seen = spark.createDataFrame([(f"u{k}", "t", "h", [], None, None) for k in range(state["seen"].count() + 1)], runs.SEEN)
        return {"seen": seen, "unresolved": spark.createDataFrame([], runs.UNRESOLVED), "notifications": spark.createDataFrame([], runs.NOTIFIED)}

    plan = (schedule[0], versions(spark, "2023-12-01 00:00:00", "2024-01-15 00:00:00"), schedule[1], "2024-01-23 00:00:00", run, root)
    with pytest.raises(RuntimeError):
        runs.catch_up(*plan)
    assert tables.ledger(spark, root).count() == 1
    assert runs.catch_up(*plan) == ["week-20240115T000000", "week-20240122T000000"]
    # the third version-bound week fell due at six on the 15th, after the new profile came into force
    assert asked == [("2024-01-01", "c1", 0, True), ("2024-01-08", "c2", 1, True), ("2024-01-08", "c2", 1, True), ("2024-01-15", "c2", 2, False)]
    assert runs.catch_up(*plan) == [] and runs.run_state(spark, root)["seen"].count() == 3


def test_catch_up_refuses_before_the_first_run(spark, schedule, tmp_path):
    def run(*_):
        raise AssertionError("no run")

    plan, before = schedule
    with pytest.raises(runs.ProfileBoundary):
        runs.catch_up(plan, versions(spark, "2024-01-09 00:00:00"), before, "2024-01-23 00:00:00", run, str(tmp_path / "a"))
    with pytest.raises(runs.TooManyWindows):
        runs.catch_up(plan, versions(spark, "2023-12-01 00:00:00"), before, "2024-01-23 00:00:00", run, str(tmp_path / "b"), most=2)


def test_records_of_one_title_and_doi_are_looked_up_once(spark, folder, monkeypatch):
    asked = []
    best = resolve.best_works

    def counting(wanted, *rest):
        asked.append(wanted.count())
        return best(wanted, *rest)

    monkeypatch.setattr(resolve, "best_works", counting)
    rows = [(f"https://feed.example.org/rec/U{k}", title, "click", None) for k, title in enumerate(["Record 2"] * 5 + ["Record 3", None, None])]
    found = {r.record_url[-2:]: (r.reason_code, r.title) for r in week(spark, folder, rows)["resolved"].collect()}
    assert asked == [3, 3]  # three titles, in both bibliographies
    assert found == {f"U{k}": (None, title) for k, (_, title, _, _) in enumerate(rows)}


def test_a_week_over_merged_feeds_reports_the_same(spark, folder):
    def broken(frame):
        return frame.withColumn("title", F.raise_error(F.lit("merged again")).cast("string"))

    rows = [("https://feed.example.org/rec/U1", "Record 1", "click", None), ("https://feed.example.org/rec/U1", "Record 1", "view", "preprint")]
    t = Tables(spark, folder)
    state = {"seen": spark.createDataFrame([], runs.SEEN), "unresolved": spark.createDataFrame([], runs.UNRESOLVED), "notified": spark.createDataFrame([], runs.NOTIFIED)}
    again = runs.weekly_run(
        broken(entries(spark, rows)), run_events(t).limit(0), first_works(t).limit(0), second_works(t).limit(0), profile_rows(t), WINDOW, **state,
        merged_feeds=merge.merge_feeds(entries(spark, rows)),
    )
    once = week(spark, folder, rows)
    for name in ("report", "seen", "unresolved"):
        assert sorted(map(str, again[name].collect())) == sorted(map(str, once[name].collect()))
