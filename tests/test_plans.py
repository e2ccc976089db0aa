"""Shapes of physical plans that decide how a job scales."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.catalog import QUERIES
from checks.views import Tables
from shelfmark.operators import gates, journals, merge, ranking


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_filter_and_columns_reach_the_scan(spark, folder):
    text = plan(gates.in_window(Tables(spark, folder).v_change_events, "2024-01-08 00:00:00", "2024-01-15 00:00:00").select("event_id"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_merge_reads_only_its_columns(spark, folder):
    entries = Tables(spark, folder).v_feed_entries
    text = plan(merge.latest_active(Tables(spark, folder).v_change_events.select("record_key", "identifier", "event_id", "changed_at", "deleted")))
    assert "value" not in text.split("ReadSchema")[1]
    assert "props" in plan(merge.merge_feeds(entries)).split("ReadSchema")[1]


def test_rank_filters_are_applied_before_the_shuffle(spark, folder):
    t = Tables(spark, folder)
    articles = t.events.select(F.col("user_id").alias("article_id"), (F.col("user_id") % 3).alias("journal")).distinct()
    checks = t.events.select(F.col("user_id").alias("article_id"), F.col("ts").alias("checked_at"))
    text = plan(ranking.due_checks(articles, checks, "2024-02-01 00:00:00", 1, 5))
    assert text.count("WindowGroupLimit") >= 2


def test_pages_are_taken_without_a_full_sort(spark, folder):
    from checks.ordering import ranked_items

    items = ranked_items(Tables(spark, folder))
    assert "TakeOrderedAndProject" in plan(ranking.paginate(items, 20, 40))
    assert "TakeOrderedAndProject" in plan(ranking.worklist(Tables(spark, folder).v_queue, "2024-01-01 00:00:00", limit=20))


@pytest.mark.parametrize("name", [
    "d02_match_works", "d05_block_counts", "d06_exact_matches", "d14_date_overlap_many", "d17_cross_check", "d18_title_overlap",
    "d22_profile_as_of", "e02_coverage_gaps", "e03_covering_interval", "e09_taxonomy_diff", "f11_issue_coverage", "g10_missing_windows",
])
def test_no_plan_pairs_rows_without_a_key(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_hot_titles_are_counted_not_gathered(spark):
    """A title of 3,000 records and 2,000 peer URLs: a row per record and a row per class and URL."""
    columns = "url string, title string, first_author string, year int"
    records = spark.createDataFrame([(f"r{k}", "Editorial", f"A{k % 3}", 2000 if k % 2 else None) for k in range(3000)] + [("x", "Other", "A0", 2000)], columns)
    peers = spark.createDataFrame([(f"p{k % 2000}", "Editorial", "A0" if k % 2000 < 50 else "", 2000) for k in range(4000)], columns).withColumnRenamed("url", "peer_url")
    overlap, links = journals.title_overlap(records, peers), journals.title_links(peers)
    assert "collect_list" not in plan(overlap) and "array" not in {kind for _, kind in overlap.dtypes}
    got = {(r.status, r.class_key, r.n_links): r.n for r in overlap.groupBy("status", "class_key", "n_links").agg(F.count("*").alias("n")).collect()}
    exact = "editorial\x1fa0\x1f2000"
    assert got == {("same_bibliography", exact, 50): 500, ("needs_review", "editorial", 2000): 2500}
    assert links.count() == 2050 and links.filter(F.col("class_key") == exact).count() == 50


def test_registered_title_overlap_has_every_link(spark):
    """Each record's links follow from its class, and classes that no record names are left out."""
    records = spark.createDataFrame([("r1", "Editorial", "A0", 2000), ("r2", "Editorial", "A1", None), ("r3", "None", "A0", 2000)], "url string, title string, first_author string, year int")
    peers = spark.createDataFrame([("p1", "EDITORIAL", "A0", 2000), ("p2", "Editorial", "A1", None), ("p3", "Other", "A0", 2000)], "peer_url string, title string, first_author string, year int")
    rows = journals.title_overlap_with_links(records, peers).collect()
    links = {r.url: {x.peer_url for x in rows if x.peer_url and x.class_key == r.class_key} for r in rows if r.url}
    assert links == {"r1": {"p1"}, "r2": {"p1", "p2"}} and {r.url: r.n_links for r in rows if r.url} == {"r1": 1, "r2": 2}
    assert len(rows) == 2 + 3


def test_the_query_of_title_overlap_returns_links(spark, folder):
    assert QUERIES["d18_title_overlap"](spark, folder).filter("peer_url IS NOT NULL").count() > 0


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    """A Python worker holds a few MB of texts at a time, however long they are."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("é"), 50_000).alias("text"))
    held = [r.bytes for r in texts.mapInArrow(sizes, "bytes long").collect()]
    assert len(held) > 5 and max(held) < 8_000_000
