"""Checks of ranking, budgets and calendar windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.identity_checks import items
from checks.records import _sparse_sql, sparse, works_of, WORKS
from checks.registry import check
from checks.views import Tables, cat, pick
from shelfmark.operators import merge, ranking

ITEMS = """
    SELECT record_id, title, year, 'https://feed.example.org/rec/' || CASE WHEN record_id % 10 = 0 THEN record_id % 300 ELSE record_id END || '/' || record_id AS record_url,
      CASE WHEN record_id % 4 <> 0 THEN record_id % 9 END AS citations FROM v_records"""
RANKED = f"""
    SELECT record_id, row_number() OVER (ORDER BY citations DESC NULLS LAST, coalesce(year, 0) DESC, lower(title), record_url) AS position FROM ({ITEMS})"""


def ranked_items(t: Tables):
    return items(t).withColumn("record_url", cat(F.col("record_url"), "/", F.col("record_id").cast("string"))).select(
        "record_id", "title", "year", "record_url", "citations"
    )


@check("g01_rank_results", RANKED)
def _(t):
    return ranking.rank_results(ranked_items(t)).select("record_id", "position")


@check("g02_paginate", f"SELECT record_id FROM ({RANKED}) WHERE position > 40 AND position <= 60")
def _(t):
    return ranking.paginate(ranked_items(t), 20, 40).select("record_id")


@check("g02_next_page", f"""
    SELECT record_id FROM ({ITEMS}) WHERE coalesce(citations, -1) < 5
    ORDER BY citations DESC NULLS LAST, coalesce(year, 0) DESC, lower(title), record_url LIMIT 30""")
def _(t):
    last = {"citations": 5, "year": -1, "title": "", "record_url": ""}
    return ranking.next_page(ranked_items(t), last, 30).select("record_id")


@check("g03_report_groups", f"""
    SELECT work_id, report_group, row_number() OVER (PARTITION BY report_group ORDER BY sort_at DESC, lower(title), work_id) AS position
    FROM (SELECT *, coalesce(CASE report_group WHEN 'published' THEN publication_at ELSE availability_at END, observed_at) AS sort_at
      FROM (SELECT *, CASE WHEN freshness = 'confirmed_new' THEN 'published' WHEN freshness_event = 'recently_changed' THEN 'changed' ELSE 'arrived' END AS report_group FROM ({WORKS})))""")
def _(t):
    return ranking.report_groups(works_of(t)).select("work_id", "report_group", "position")


@check("g04_pick_for_lookup", f"""
    WITH c AS (SELECT record_url, CAST(replace(split_part(record_url, '-', 2), '/', '') AS INTEGER) AS n, date_in_window AS eligible FROM ({_sparse_sql()})),
    a AS (SELECT link || '-' || (event_id % 61) AS record_url, max(published_at) AS last FROM v_feed_entries WHERE published_at IS NOT NULL GROUP BY 1),
    j AS (SELECT c.*, n % 10 = 0 AS cached, a.last FROM c LEFT JOIN a USING (record_url))
    SELECT record_url, CASE WHEN cached THEN 'cached' WHEN rn <= 300 THEN 'selected' ELSE 'deferred' END AS lookup
    FROM (SELECT *, row_number() OVER (PARTITION BY cached ORDER BY last ASC NULLS FIRST, eligible DESC, record_url) AS rn FROM j)""")
def _(t):
    from checks.records import WINDOW

    held = merge.merge_feeds(sparse(t), WINDOW)
    candidates = held.select(
        "record_url", (F.split_part("record_url", F.lit("-"), F.lit(2)).cast("int") % 10 == 0).alias("cached"),
        F.col("date_in_window").alias("eligible"),
    )
    attempts = sparse(t).filter("published_at IS NOT NULL").select(
        "record_url", F.col("published_at").alias("attempted_at")
    )
    return ranking.pick_for_lookup(candidates, attempts, 300).select("record_url", "lookup")


@check("g05_fair_budget", """
    WITH g AS (SELECT grp, (row_number() OVER (ORDER BY grp) - 1 - 2) AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT 'c' || (o_custkey % 40) AS grp FROM orders)),
    u AS (SELECT grp, row_number() OVER (ORDER BY unit, ((slot % n) + n) % n) AS rn FROM g, range(1, 4) AS r(unit))
    SELECT grp, count(*) FILTER (WHERE rn <= 100) AS units FROM u GROUP BY grp""")
def _(t):
    groups = t.orders.select(cat("c", (F.col("o_custkey") % 40).cast("string")).alias("grp")).distinct()
    return ranking.fair_budget(groups, 100, 3, 2)


@check("g06_due_checks", """
    WITH a AS (SELECT DISTINCT user_id AS article_id, 'j' || (user_id % 4) AS journal FROM events
               UNION SELECT user_id + 1000, 'j' || (user_id % 4) FROM events WHERE user_id < 20),
    l AS (SELECT user_id AS article_id, max(ts) AS last_checked FROM events GROUP BY 1),
    o AS (SELECT a.*, last_checked, row_number() OVER (PARTITION BY journal ORDER BY last_checked ASC NULLS FIRST, article_id) AS rn FROM a LEFT JOIN l USING (article_id)),
    d AS (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY last_checked ASC NULLS FIRST, article_id) AS due_position FROM o
          WHERE (last_checked IS NULL OR last_checked <= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 12 HOUR))
    SELECT article_id, journal, due_position FROM d WHERE due_position <= 10""")
def _(t):
    u = F.col("user_id")
    journal = cat("j", (u % 4).cast("string")).alias("journal")
    articles = t.events.select(u.alias("article_id"), journal).unionByName(
        t.events.filter("user_id < 20").select((u + 1000).alias("article_id"), journal)
    ).distinct()
    checks = t.events.select(u.alias("article_id"), F.col("ts").alias("checked_at"))
    return ranking.due_checks(articles, checks, "2024-01-30 00:00:00", 12, 10).select("article_id", "journal", "due_position")


@check("g02_page_facts", f"SELECT count(*) AS total, count(*) > 60 AS has_more, CASE WHEN count(*) > 60 THEN 60 END AS next_offset FROM ({RANKED})", ints="next_offset")
def _(t):
    return ranking.page_facts(ranked_items(t), 20, 40)


@check("g07_worklist_facts", """
    SELECT count(*) AS total, count(*) > 2600 AS has_more, CASE WHEN count(*) > 2600 THEN 2600 END AS next_offset
    FROM v_queue WHERE status IN ('pending', 'blocked')""", ints="next_offset")
def _(t):
    return ranking.page_facts(ranking.worklist_rows(t.v_queue), 100, 2500)


@check("g07_worklist", """
    SELECT grp, url, CASE WHEN status = 'blocked' AND blocked_since IS NULL THEN 'blocked_age_unknown'
        WHEN status = 'blocked' AND blocked_since <= TIMESTAMP '2024-01-01' THEN 'long_blocked' ELSE status END AS attention_reason
    FROM v_queue WHERE status IN ('pending', 'blocked')
    ORDER BY CASE WHEN status = 'blocked' AND (blocked_since IS NULL OR blocked_since <= TIMESTAMP '2024-01-01') THEN 0 WHEN status = 'pending' THEN 1 ELSE 2 END,
      CASE WHEN status = 'pending' THEN first_seen END DESC NULLS LAST, CASE WHEN status = 'blocked' THEN coalesce(blocked_since, first_seen) END ASC NULLS FIRST, grp, url
    LIMIT 100 OFFSET 2500""")
def _(t):
    return ranking.worklist(t.v_queue, "2024-01-01 00:00:00", "active", 100, 2500).select("grp", "url", "attention_reason")


def feeds(t: Tables):
    """One feed per customer group with ordered terms; some terms are shared."""
    g = (F.col("o_custkey") % 9).cast("int")
    n = F.col("feed_pos")
    return t.orders.select(g.alias("feed_pos")).distinct().select(
        n, F.when(n % 4 == 3, F.array().cast("array<string>")).otherwise(
            F.array(cat("t", (n % 3).cast("string")), cat("s", n.cast("string")), F.lit("shared"))
        ).alias("terms")
    )


def profile_terms(t: Tables):
    return t.region.select((F.col("r_regionkey") % 3).alias("pos"), F.lower("r_name").alias("term"))


FEEDS = """
    SELECT n AS feed_pos, CASE WHEN n % 4 = 3 THEN CAST([] AS VARCHAR[]) ELSE ['t' || (n % 3), 's' || n, 'shared'] END AS terms
    FROM (SELECT DISTINCT o_custkey % 9 AS n FROM orders)"""
PLAN = f"""
    SELECT term, term_class, row_number() OVER (ORDER BY term_class, a, b) <= 12 AS planned FROM (
      SELECT term, min((c, a, b)) AS place, place.c AS term_class, place.a AS a, place.b AS b FROM (
        SELECT 0 AS c, feed_pos AS a, 0 AS b, terms[1] AS term FROM ({FEEDS}) WHERE len(terms) > 0
        UNION ALL SELECT 1, r_regionkey % 3, 0, lower(r_name) FROM region
        UNION ALL SELECT 2, feed_pos, i - 1, terms[i] FROM ({FEEDS}), range(2, 4) AS r(i) WHERE len(terms) > 0) GROUP BY term)"""
PLAN = PLAN.replace("min((c, a, b)) AS place, place.c AS term_class, place.a AS a, place.b AS b",
                    "min({'c': c, 'a': a, 'b': b}).c AS term_class, min({'c': c, 'a': a, 'b': b}).a AS a, min({'c': c, 'a': a, 'b': b}).b AS b")


@check("g08_query_plan_terms", f"SELECT count(*) AS terms, count(*) FILTER (WHERE planned) AS planned FROM ({PLAN})")
def _(t):
    return ranking.query_plan(feeds(t), profile_terms(t), 12).agg(
        F.count("*").alias("terms"), F.count_if("planned").alias("planned")
    )


@check("g08_query_plan", PLAN.replace("lower(r_name)", "lower(r_name)").replace("r_regionkey % 3, 0", "r_regionkey, 0"), ints="term_class")
def _(t):
    own = t.region.select(F.col("r_regionkey").alias("pos"), F.lower("r_name").alias("term"))
    return ranking.query_plan(feeds(t), own, 12)


@check("g08_query_plan_counts", f"""
    WITH plan AS ({PLAN.replace('r_regionkey % 3, 0', 'r_regionkey, 0')})
    SELECT (SELECT count(*) FROM ({FEEDS}) WHERE len(terms) > 0 AND terms[1] IN (SELECT term FROM plan WHERE planned)) AS planned_feeds,
      (SELECT count(*) FROM plan WHERE NOT planned) AS terms_outside_budget, (SELECT count(*) FROM plan) AS terms""")
def _(t):
    own = t.region.select(F.col("r_regionkey").alias("pos"), F.lower("r_name").alias("term"))
    return ranking.query_plan_counts(feeds(t), ranking.query_plan(feeds(t), own, 12))


@check("g09_date_review_worklist", """
    SELECT venue, year, issue, evidence_url FROM v_issue_evidence
    WHERE reviewed_at >= TIMESTAMP '1998-01-01' AND (label_month IS NULL OR (day IS NOT NULL AND month(day) <> label_month))""", ints="year")
def _(t):
    leads = t.v_issue_evidence.withColumn("first_observed", F.col("reviewed_at")).withColumn(
        "date_conflict", F.coalesce(F.month("day") != F.col("label_month"), F.lit(False))
    )
    return ranking.date_review_worklist(leads, "1998-01-01 00:00:00").select("venue", "year", "issue", "evidence_url")


ZONES = "CASE profile_id % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Europe/Berlin' ELSE 'Asia/Shanghai' END"


def week_profiles(t: Tables):
    p = F.col("profile_id")
    return t.orders.select((F.col("o_custkey") % 60).alias("profile_id")).distinct().select(
        p, pick(p % 3, "America/New_York", "Europe/Berlin", "Asia/Shanghai").alias("zone"),
        (p % 7).cast("int").alias("weekday"), (p % 24).cast("int").alias("report_hour"),
    )


def week_runs(t: Tables):
    """Committed local weeks of each profile that ordered in them."""
    held = t.orders.select(
        (F.col("o_custkey") % 60).alias("profile_id"), F.to_date("o_orderdate").alias("d")
    ).join(week_profiles(t).filter("profile_id % 10 <> 9"), "profile_id")
    end = F.date_sub(F.col("d"), F.pmod(F.weekday("d") - F.col("weekday"), F.lit(7)))
    return held.select(
        "profile_id", ranking.to_utc(F.date_sub(end, 7).cast("timestamp_ntz"), F.col("zone")).alias("window_start"),
        ranking.to_utc(end.cast("timestamp_ntz"), F.col("zone")).alias("window_end"),
    ).distinct()


G10 = f"""
    WITH p AS (SELECT profile_id, {ZONES} AS zone, profile_id % 7 AS weekday, profile_id % 24 AS hour FROM (SELECT DISTINCT o_custkey % 60 AS profile_id FROM orders)),
    r AS (SELECT DISTINCT p.profile_id, zone, d - CAST(((isodow(d) - 1 - weekday) % 7 + 7) % 7 AS INTEGER) AS end_day
      FROM (SELECT o_custkey % 60 AS profile_id, CAST(o_orderdate AS DATE) AS d FROM orders) o JOIN p USING (profile_id) WHERE p.profile_id % 10 <> 9),
    due AS (SELECT p.*, local, CAST(local AS DATE) AS d FROM (SELECT *, TIMESTAMP '2000-07-12 06:00:00' AT TIME ZONE 'UTC' AT TIME ZONE zone AS local FROM p) p),
    latest AS (SELECT profile_id, zone, e - CASE WHEN local < CAST(e AS TIMESTAMP) + to_hours(hour) THEN 7 ELSE 0 END AS end_day
      FROM (SELECT *, d - CAST(((isodow(d) - 1 - weekday) % 7 + 7) % 7 AS INTEGER) AS e FROM due)),
    firsts AS (SELECT profile_id, min(end_day) AS first_end FROM r GROUP BY 1),
    weeks AS (SELECT l.profile_id, l.zone, CAST(l.end_day - CAST(7 * i AS INTEGER) AS DATE) AS end_day FROM latest l LEFT JOIN firsts f USING (profile_id), range(0, 600) AS x(i)
      WHERE CASE WHEN first_end IS NULL THEN i = 0 ELSE l.end_day - CAST(7 * i AS INTEGER) >= first_end END)
    SELECT profile_id, strftime(CAST(w.end_day - 7 AS TIMESTAMP) AT TIME ZONE w.zone AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start,
      strftime(CAST(w.end_day AS TIMESTAMP) AT TIME ZONE w.zone AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_end
    FROM weeks w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.profile_id = w.profile_id AND r.end_day = w.end_day)"""


@check("g10_missing_windows", G10)
def _(t):
    return ranking.missing_windows(week_profiles(t), week_runs(t), "2000-07-12 06:00:00")


@check("g11_rolling_windows", """
    SELECT o_orderkey AS request_id, CASE WHEN days BETWEEN 1 AND 31 THEN 'accepted' ELSE 'refused' END AS status, CASE WHEN days BETWEEN 1 AND 31 THEN strftime((requested_at AT TIME ZONE 'UTC' AT TIME ZONE zone - to_days(days)) AT TIME ZONE zone AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS window_start,
      CASE WHEN days BETWEEN 1 AND 31 THEN strftime(requested_at, '%Y-%m-%d %H:%M:%S') END AS window_end
    FROM (SELECT o_orderkey, o_orderdate + INTERVAL 15 HOUR AS requested_at, CAST(o_orderkey % 33 AS INTEGER) AS days,
        CASE o_custkey % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Europe/Berlin' ELSE 'Asia/Shanghai' END AS zone FROM orders)""")
def _(t):
    requests = t.orders.select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_orderdate") + F.expr("INTERVAL 15 HOUR")).alias("requested_at"),
        (F.col("o_orderkey") % 33).cast("int").alias("days"),
        pick(F.col("o_custkey") % 3, "America/New_York", "Europe/Berlin", "Asia/Shanghai").alias("zone"),
    )
    return ranking.rolling_windows(requests).select("request_id", "status", "window_start", "window_end")
