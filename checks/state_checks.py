"""Checks of the state tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import Tables, cat, pick
from shelfmark.operators import journals, merge, state

NOW = "2024-01-20 00:00:00"


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


@check("i01_establish_baseline", """
    SELECT record_url, array_to_string(list_sort(list(DISTINCT category_id)), '|') AS category_ids, count(*) AS n
    FROM v_feed_entries WHERE category_id NOT IN ('click', 'view') GROUP BY record_url""".replace(", count(*) AS n", ""))
def _(t):
    known = t.v_feed_entries.filter("category_id IN ('click', 'view')")
    return state.establish_baseline(t.v_feed_entries, known).select("record_url", "category_ids")


def seen_state(t: Tables):
    early = t.v_feed_entries.filter(F.col("published_at") < at("2024-01-10 00:00:00"))
    keyed = early.withColumn("record_url", cat(F.col("record_url"), "-", (F.col("event_id") % 7).cast("string")))
    m = merge.merge_feeds(keyed)
    return m.select("record_url", "title", "row_hash", "category_ids", F.col("observed_at").alias("first_seen"), F.col("observed_at").alias("last_seen"))


def seen_current(t: Tables):
    late = t.v_feed_entries.filter(F.col("published_at") >= at("2024-01-10 00:00:00"))
    keyed = late.withColumn("record_url", cat(F.col("record_url"), "-", (F.col("event_id") % 7).cast("string"))).withColumn("title", cat(F.col("title"), " II"))
    return merge.merge_feeds(keyed)


SEEN = """
    WITH o AS (SELECT record_url || '-' || (event_id % 7) AS record_url, min(title) AS title, list_sort(list(DISTINCT category_id)) AS cats, max(checked_at) AS seen_ts
               FROM v_feed_entries WHERE published_at < TIMESTAMP '2024-01-10' GROUP BY 1),
    n AS (SELECT record_url || '-' || (event_id % 7) AS record_url, min(title) || ' II' AS title, list_sort(list(DISTINCT category_id)) AS cats, max(checked_at) AS seen_ts
          FROM v_feed_entries WHERE published_at >= TIMESTAMP '2024-01-10' GROUP BY 1)"""


@check("i02_upsert_seen", SEEN + """
    SELECT record_url, coalesce(n.title, o.title) AS title,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(o.cats, []), coalesce(n.cats, [])))), '|') AS category_ids,
      strftime(coalesce(o.seen_ts, n.seen_ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(coalesce(n.seen_ts, o.seen_ts), '%Y-%m-%d %H:%M:%S') AS last_seen
    FROM o FULL JOIN n USING (record_url)""")
def _(t):
    return state.upsert_seen(seen_state(t), seen_current(t)).drop("row_hash")


@check("h02_candidates_to_process", SEEN + """,
    fresh AS (SELECT record_url, title FROM n WHERE record_url NOT IN (SELECT record_url FROM o)),
    r AS (SELECT record_url, title FROM o WHERE seen_ts <= TIMESTAMP '2024-01-05')
    SELECT record_url, title, 'new' AS origin FROM fresh
    UNION ALL SELECT r.record_url, coalesce(n.title, r.title), CASE WHEN n.title IS NULL THEN 'retry_rebuilt' ELSE 'retry_current' END FROM r LEFT JOIN n USING (record_url)""")
def _(t):
    old, current = seen_state(t), seen_current(t)
    retries = old.filter(F.col("last_seen") <= at("2024-01-05 00:00:00"))
    return state.candidates_to_process(merge.new_records(current, old), retries, current)


@check("i07_due_retries", """
    SELECT record_url, attempts FROM v_unresolved WHERE attempts < 4 AND next_retry_at <= TIMESTAMP '2024-02-05 18:00:00'""", ints="attempts")
def _(t):
    return state.due_retries(t.v_unresolved, "2024-02-05 18:00:00", 4).select("record_url", "attempts")


@check("i07_bump_retries", """
    WITH n AS (SELECT 'https://feed.example.org/rec/U' || u AS record_url, 'Record ' || u AS title,
        CASE WHEN u % 3 <> 0 THEN 'identifier_conflict' END AS reason FROM (SELECT DISTINCT user_id * 2 AS u FROM events))
    SELECT record_url, coalesce(n.title, o.title) AS title, coalesce(n.reason, o.reason_code) AS reason_code,
      coalesce(o.attempts, 0) + (n.title IS NOT NULL)::INT AS attempts,
      strftime(date_trunc('second', CASE WHEN n.title IS NOT NULL THEN TIMESTAMP '2024-02-06' ELSE o.last_attempt END), '%Y-%m-%d %H:%M:%S') AS last_attempt,
      strftime(date_trunc('second', CASE WHEN coalesce(o.attempts, 0) + (n.title IS NOT NULL)::INT >= 5 THEN NULL WHEN n.title IS NOT NULL THEN TIMESTAMP '2024-02-13' ELSE o.next_retry_at END), '%Y-%m-%d %H:%M:%S') AS next_retry_at
    FROM v_unresolved o FULL JOIN n USING (record_url) WHERE n.title IS NULL OR n.reason IS NOT NULL""", ints="attempts")
def _(t):
    u = F.col("u")
    tried = t.events.select((F.col("user_id") * 2).alias("u")).distinct().select(
        cat("https://feed.example.org/rec/U", u.cast("string")).alias("record_url"), cat("Record ", u.cast("string")).alias("title"),
        F.when(u % 3 != 0, "identifier_conflict").alias("reason_code"),
    )
    return state.bump_retries(t.v_unresolved, tried, "2024-02-06 00:00:00", 7, 5)


@check("i08_notify_once", """
    SELECT work_id, kind, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS matched_at
    FROM (SELECT 'w' || user_id AS work_id, event_type AS kind, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20')
    WHERE (work_id, kind) NOT IN (SELECT ('w' || user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-08') GROUP BY work_id, kind""".replace(
        "(work_id, kind) NOT IN (SELECT ('w' || user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-08')",
        "NOT EXISTS (SELECT 1 FROM events e WHERE e.ts < TIMESTAMP '2024-01-08' AND 'w' || e.user_id = work_id AND e.event_type = kind)"))
def _(t):
    rows = t.events.select(cat("w", F.col("user_id").cast("string")).alias("work_id"), F.col("event_type").alias("kind"), F.col("ts").alias("matched_at"))
    return state.notify_once(rows.filter(F.col("matched_at") >= at(NOW)), rows.filter(F.col("matched_at") < at("2024-01-08 00:00:00")))


@check("i09_cache_lookup", """
    WITH c AS (SELECT source, query, arg_max(status, (cached_at, seq)) AS status, arg_max(expires_at, (cached_at, seq)) AS expires_at
               FROM v_lookup_cache WHERE cached_at < TIMESTAMP '2024-01-20' GROUP BY ALL),
    q AS (SELECT DISTINCT s AS source, 'q' || (user_id * 2) AS query FROM events, (VALUES ('crossref'), ('openalex')) v(s))
    SELECT q.source, q.query, CASE WHEN c.status IS NULL THEN 'miss' WHEN expires_at <= TIMESTAMP '2024-01-20' THEN 'expired' WHEN c.status = 'found' THEN 'hit' ELSE 'negative_hit' END AS cache_state
    FROM q LEFT JOIN c USING (source, query)""")
def _(t):
    queries = t.events.select(
        F.explode(F.array(F.lit("crossref"), F.lit("openalex"))).alias("source"), cat("q", (F.col("user_id") * 2).cast("string")).alias("query")
    ).distinct()
    cache = t.v_lookup_cache.filter(F.col("cached_at") < at(NOW))
    return state.cache_lookup(queries, cache, NOW)


def quarantine_inputs(t: Tables):
    k = F.col("k")
    candidates = t.v_unresolved.select("record_url", (F.col("attempts") % 2 == 0).alias("undated"))
    store = t.v_k.groupBy(cat("https://feed.example.org/rec/U", ((F.col("user_id") * 2) % 170).cast("string")).alias("record_url")).agg(
        F.min("ts").alias("first_quarantined"), (F.min("ts") - F.expr("INTERVAL 365 DAY")).alias("_old"), F.max("ts").alias("_new"), F.min("k").alias("k")
    ).select("record_url", "first_quarantined", F.when(k % 2 == 0, F.col("_old")).otherwise(F.col("_new")).alias("last_seen"))
    return candidates, store


QUARANTINE = """
    WITH s AS (SELECT record_url, first_at, CASE WHEN k % 2 = 0 THEN first_at - INTERVAL 365 DAY ELSE last_at END AS last_seen
      FROM (SELECT 'https://feed.example.org/rec/U' || ((user_id * 2) % 170) AS record_url, min(ts) AS first_at, max(ts) AS last_at, min(k) AS k FROM v_k GROUP BY 1)),
    held AS (SELECT * FROM s WHERE last_seen >= TIMESTAMP '2024-01-20' - INTERVAL 365 DAY),
    c AS (SELECT record_url, attempts % 2 = 0 AS undated FROM v_unresolved)"""


@check("i10_quarantine", QUARANTINE + """
    SELECT record_url, undated, CASE WHEN undated THEN CASE WHEN first_at IS NULL THEN 'new' ELSE 'reused' END END AS quarantine
    FROM c LEFT JOIN held USING (record_url)""")
def _(t):
    return state.quarantine(*quarantine_inputs(t), NOW)[0]


@check("i10_quarantine_store", QUARANTINE + """
    SELECT record_url, strftime(date_trunc('second', first_at), '%Y-%m-%d %H:%M:%S') AS first_quarantined, strftime(date_trunc('second', last_seen), '%Y-%m-%d %H:%M:%S') AS last_seen
    FROM held WHERE record_url NOT IN (SELECT record_url FROM c)
    UNION ALL SELECT record_url, strftime(date_trunc('second', coalesce(first_at, TIMESTAMP '2024-01-20')), '%Y-%m-%d %H:%M:%S'), '2024-01-20 00:00:00'
    FROM c LEFT JOIN held USING (record_url) WHERE undated""")
def _(t):
    return state.quarantine(*quarantine_inputs(t), NOW)[1]


@check("i11_attempt_rotation", """
    SELECT record_url, strftime(date_trunc('second', max(seen_ts)), '%Y-%m-%d %H:%M:%S') AS attempted_at FROM (
      SELECT link AS record_url, published_at AS seen_ts FROM v_feed_entries WHERE published_at >= TIMESTAMP '2024-02-15' - INTERVAL 31 DAY
      UNION ALL SELECT record_url, TIMESTAMP '2024-02-15' FROM v_unresolved WHERE reason_code <> 'old_work_check_incomplete' AND attempts = 1) GROUP BY record_url""")
def _(t):
    log = t.v_feed_entries.filter("published_at IS NOT NULL").select("record_url", F.col("published_at").alias("attempted_at"))
    return state.attempt_rotation(log, t.v_unresolved.filter("attempts = 1"), "2024-02-15 00:00:00")


def evidence_versions(t: Tables):
    key = F.regexp_extract("evidence_url", r"(\d+)$", 1).cast("int")
    base = t.v_issue_evidence.withColumn("n", key).withColumn("evidence_url", cat("https://evidence.example.org/", (key % 50).cast("string")))
    # one row per key: evidence URLs were folded on purpose
    one = F.min(F.struct("status", "n", "label_month", "day", "reviewed_at")).alias("r")
    rows = base.groupBy("venue", "year", "issue", "evidence_url").agg(one).select("venue", "year", "issue", "evidence_url", "r.*")
    old = rows.filter("n % 3 <> 0").select("venue", "year", "issue", "evidence_url", "label_month", "day", "status", F.when(F.col("status") == "reviewed", F.col("reviewed_at")).alias("reviewed_at"))
    new = rows.filter("n % 4 <> 0").select(
        "venue", "year", "issue", "evidence_url", F.when(F.col("n") % 5 != 0, F.col("label_month") % 12 + 1).alias("label_month"),
        F.date_add("day", 1).alias("day"), F.when(F.col("n") % 2 == 0, "reviewed").otherwise("pending").alias("status"),
        F.when(F.col("n") % 2 == 0, F.col("reviewed_at") + F.expr("INTERVAL 3 DAY")).alias("reviewed_at"),
    )
    return old, new


@check("i12_upsert_issue_evidence", """
    WITH b AS (SELECT venue, year, issue, 'https://evidence.example.org/' || (n % 50) AS evidence_url, status, n, label_month, day, reviewed_at
               FROM (SELECT *, CAST(regexp_extract(evidence_url, '([0-9]+)$', 1) AS INTEGER) AS n FROM v_issue_evidence)),
    rows AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY venue, year, issue, evidence_url ORDER BY status, n, label_month NULLS FIRST, day NULLS FIRST, reviewed_at) AS rn FROM b) WHERE rn = 1),
    o AS (SELECT * REPLACE (CASE WHEN status = 'reviewed' THEN reviewed_at END AS reviewed_at) FROM rows WHERE n % 3 <> 0),
    w AS (SELECT venue, year, issue, evidence_url, CASE WHEN n % 5 <> 0 THEN label_month % 12 + 1 END AS label_month, day + 1 AS day,
        CASE WHEN n % 2 = 0 THEN 'reviewed' ELSE 'pending' END AS status, CASE WHEN n % 2 = 0 THEN reviewed_at + INTERVAL 3 DAY END AS reviewed_at FROM rows WHERE n % 4 <> 0),
    j AS (SELECT coalesce(o.venue, w.venue) AS venue, coalesce(o.year, w.year) AS year, coalesce(o.issue, w.issue) AS issue, coalesce(o.evidence_url, w.evidence_url) AS evidence_url,
        w.venue IS NULL AS no_new, o.venue IS NULL AS no_old, coalesce(o.status = 'reviewed', FALSE) AS done,
        o.label_month AS om, w.label_month AS wm, o.day AS od, w.day AS wd, o.status AS os, w.status AS ws, o.reviewed_at AS orv, w.reviewed_at AS wrv
      FROM o FULL JOIN w ON o.venue = w.venue AND o.year = w.year AND o.issue = w.issue AND o.evidence_url = w.evidence_url)
    SELECT venue, year, issue, evidence_url, CASE WHEN no_new OR (done AND ws = 'pending') THEN om ELSE wm END AS label_month,
      strftime(CASE WHEN no_new OR (done AND ws = 'pending') THEN od ELSE wd END, '%Y-%m-%d') AS day, CASE WHEN no_new OR done THEN os ELSE ws END AS status,
      strftime(CASE WHEN no_new OR done THEN orv ELSE wrv END, '%Y-%m-%d %H:%M:%S') AS reviewed_at FROM j""", ints="year label_month")
def _(t):
    return state.upsert_issue_evidence(*evidence_versions(t))


@check("i13_upsert_journal_issue", """
    WITH o AS (SELECT 'k' || (o_custkey % 700) AS issue_key, min(o_orderdate) AS a, max(o_orderdate) AS b, CASE WHEN min(o_orderkey) % 2 = 0 THEN 3 END AS m, 'u' || min(o_orderkey) AS url FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1),
    n AS (SELECT 'k' || (o_custkey % 700) AS issue_key, max(o_orderdate) + INTERVAL 900 DAY AS b, CASE WHEN min(o_orderkey) % 3 = 0 THEN 4 END AS m, CASE WHEN min(o_orderkey) % 5 <> 0 THEN 'v' || min(o_orderkey) END AS url FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1)
    SELECT issue_key, strftime(coalesce(o.a, n.b), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(coalesce(n.b, o.b), '%Y-%m-%d %H:%M:%S') AS last_seen,
      coalesce(n.m, o.m) AS label_month, coalesce(n.url, o.url) AS url FROM o FULL JOIN n USING (issue_key)""", ints="label_month")
def _(t):
    key = cat("k", (F.col("o_custkey") % 700).cast("string")).alias("issue_key")
    low = F.min("o_orderkey")
    old = t.orders.filter("o_custkey % 3 <> 0").groupBy(key).agg(
        F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"), F.when(low % 2 == 0, 3).alias("label_month"), cat("u", low.cast("string")).alias("url")
    )
    new = t.orders.filter("o_custkey % 4 <> 0").groupBy(key).agg(
        (F.max("o_orderdate") + F.expr("INTERVAL 900 DAY")).alias("seen_at"), F.when(low % 3 == 0, 4).alias("label_month"),
        F.when(low % 5 != 0, cat("v", low.cast("string"))).alias("url"),
    )
    return state.upsert_journal_issue(old, new)


def queue_and_links(t: Tables):
    queue = t.v_queue.filter("url NOT LIKE '%7'").withColumn("last_seen", F.col("first_seen"))
    links = t.v_queue.select(
        "grp", cat("https://post.example.org/s/", (F.regexp_extract("url", r"(\d+)$", 1).cast("int") * 2 % 15000).cast("string")).alias("url"),
        "source_url", (F.col("first_seen") + F.expr("INTERVAL 40 DAY")).alias("seen_at"),
    )
    return queue, links


@check("i14_queue_merge", """
    WITH q AS (SELECT * FROM v_queue WHERE url NOT LIKE '%7'),
    l AS (SELECT grp, 'https://post.example.org/s/' || (CAST(regexp_extract(url, '([0-9]+)$', 1) AS INTEGER) * 2 % 15000) AS url, source_url, first_seen + INTERVAL 40 DAY AS seen_ts FROM v_queue),
    n AS (SELECT grp, url, arg_min(source_url, (seen_ts, source_url)) AS source_url, min(seen_ts) AS lo, max(seen_ts) AS hi FROM l GROUP BY ALL)
    SELECT grp, url, coalesce(q.source_url, n.source_url) AS source_url, coalesce(status, 'pending') AS status,
      strftime(date_trunc('second', coalesce(first_seen, lo)), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(date_trunc('second', coalesce(hi, first_seen)), '%Y-%m-%d %H:%M:%S') AS last_seen,
      status IS NULL AS inserted FROM q FULL JOIN n USING (grp, url)""")
def _(t):
    return state.queue_merge(*queue_and_links(t))


def decisions(t: Tables):
    n = F.regexp_extract("url", r"(\d+)$", 1).cast("int")
    return t.v_queue.filter(n % 3 == 0).select(
        "grp", F.when(n % 33 == 0, cat(F.col("url"), "x")).otherwise(F.col("url")).alias("url"),
        pick(n % 4, "reviewed", "blocked", "dismissed", "lost").alias("decision"), F.when(n % 5 != 0, "seen").alias("note"),
    )


DECIDED = """
    WITH q AS (SELECT *, CAST(regexp_extract(url, '([0-9]+)$', 1) AS INTEGER) AS n FROM v_queue),
    d AS (SELECT grp, CASE WHEN n % 33 = 0 THEN url || 'x' ELSE url END AS url, CASE n % 4 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'blocked' WHEN 2 THEN 'dismissed' ELSE 'lost' END AS decision,
        CASE WHEN n % 5 <> 0 THEN 'seen' ELSE '' END AS note FROM q WHERE n % 3 = 0),
    j AS (SELECT grp, url, decision, q.status, q.blocked_since, CASE WHEN decision IS NULL THEN NULL WHEN q.status IS NULL THEN 'unknown_link' WHEN decision = 'lost' THEN 'invalid_decision'
        WHEN q.status = 'reviewed' THEN 'reviewed_is_final' WHEN decision = 'reviewed' AND q.status NOT IN ('pending', 'blocked') THEN 'not_reviewable'
        WHEN decision <> 'reviewed' AND note = '' THEN 'reason_missing' END AS refusal FROM q FULL JOIN d USING (grp, url))"""


@check("i15_queue_transition", DECIDED + """
    SELECT grp, url, CASE WHEN decision IS NOT NULL AND refusal IS NULL THEN decision ELSE status END AS status,
      strftime(date_trunc('second', CASE WHEN decision = 'blocked' AND refusal IS NULL AND (status <> 'blocked' OR blocked_since IS NULL) THEN TIMESTAMP '2024-01-20' ELSE blocked_since END), '%Y-%m-%d %H:%M:%S') AS blocked_since
    FROM j WHERE status IS NOT NULL""")
def _(t):
    return state.queue_transition(t.v_queue, decisions(t), NOW)[0].select("grp", "url", "status", "blocked_since")


@check("i15_refused_decisions", DECIDED + " SELECT grp, url, decision, refusal FROM j WHERE refusal IS NOT NULL")
def _(t):
    return state.queue_transition(t.v_queue, decisions(t), NOW)[1]


@check("i16_daily_allowance", """
    WITH g AS (SELECT DISTINCT event_type || '-' || user_id AS grp, CASE user_id % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Europe/Berlin' ELSE 'Asia/Shanghai' END AS zone FROM events)
    SELECT grp, zone, strftime(TIMESTAMP '2024-01-20 02:00:00' AT TIME ZONE 'UTC' AT TIME ZONE zone, '%Y-%m-%d') AS local_day,
      NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type || '-' || e.user_id = grp AND e.ts <= TIMESTAMP '2024-01-20 02:00:00' + INTERVAL 2 DAY
        AND CAST(e.ts AT TIME ZONE 'UTC' AT TIME ZONE zone AS DATE) = CAST(TIMESTAMP '2024-01-20 02:00:00' AT TIME ZONE 'UTC' AT TIME ZONE zone AS DATE)) AS allowed
    FROM g""")
def _(t):
    grp = cat(F.col("event_type"), "-", F.col("user_id").cast("string")).alias("grp")
    groups = t.events.select(grp, pick(F.col("user_id") % 3, "America/New_York", "Europe/Berlin", "Asia/Shanghai").alias("zone")).distinct()
    return state.daily_allowance(groups, t.events.select(grp, F.col("ts").alias("observed_at")), "2024-01-20 02:00:00")


@check("i17_register_profile", """
    SELECT profile_id, version, CASE WHEN version % 3 = 0 THEN 'added' WHEN profile_id % 7 = 0 THEN 'refused' ELSE 'unchanged' END AS outcome FROM v_profiles""")
def _(t):
    hashed = t.v_profiles.withColumn("content_hash", F.sha2(F.concat_ws("|", F.col("profile_id").cast("string"), F.date_format("effective_from", "yyyyMMdd")), 256))
    new = hashed.withColumn("content_hash", F.when(F.col("profile_id") % 7 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    return state.register_profile(hashed.filter("version % 3 <> 0"), new)[1]


def catalogue_scan(t: Tables):
    held = t.v_catalogue.filter("last_observed = 0").groupBy("issue", "title").agg(F.min("author").alias("author")).withColumn(
        "first_observed", at("2024-01-01 00:00:00")).withColumn("last_observed", at("2024-01-01 00:00:00"))
    scanned = t.v_catalogue.filter("last_observed IN (0, 1)").select("issue", "title", "author")
    pages = t.v_catalogue.select("issue", (F.regexp_extract("issue", r"src(\d+)", 1).cast("int") % 4 != 1).alias("complete"))
    return state.catalogue_upsert(held, scanned, pages, NOW)


@check("i18_catalogue_upsert", """
    WITH o AS (SELECT DISTINCT issue, title, author FROM v_catalogue WHERE last_observed = 0),
    n AS (SELECT DISTINCT issue, title, author FROM v_catalogue WHERE last_observed IN (0, 1) AND CAST(regexp_extract(issue, 'src([0-9]+)', 1) AS INTEGER) % 4 <> 1)
    SELECT issue, title, coalesce(n.author, o.author) AS author, CASE WHEN o.author IS NULL THEN '2024-01-20 00:00:00' ELSE '2024-01-01 00:00:00' END AS first_observed,
      CASE WHEN n.author IS NULL THEN '2024-01-01 00:00:00' ELSE '2024-01-20 00:00:00' END AS last_observed FROM o FULL JOIN n USING (issue, title)""")
def _(t):
    return catalogue_scan(t)[0]


@check("i18_completed_scans", """
    SELECT issue, count(*) AS article_count, CAST(sum(CAST('0x' || substring(sha256(title), 1, 15) AS HUGEINT)) AS VARCHAR) AS title_digest, '2024-01-20 00:00:00' AS last_completed
    FROM (SELECT DISTINCT issue, title FROM v_catalogue WHERE last_observed IN (0, 1) AND CAST(regexp_extract(issue, 'src([0-9]+)', 1) AS INTEGER) % 4 <> 1) GROUP BY issue""")
def _(t):
    return catalogue_scan(t)[1]


@check("i19_run_ledger_check", """
    SELECT run_id, concat_ws('|', CASE WHEN k % 11 = 0 THEN 'window_start_not_before_end' END, CASE WHEN k % 13 = 0 AND k % 11 <> 0 THEN 'window_not_over' END,
      CASE WHEN k % 5 = 0 THEN 'execution_time_unverified' END, CASE WHEN k % 5 <> 0 AND k % 13 = 0 AND k % 11 <> 0 THEN 'started_before_window_end' END,
      CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN 'completed_before_start' END, CASE WHEN k % 3 = 0 THEN 'queue_not_supplied' END,
      CASE WHEN k % 3 <> 0 AND k % 17 = 0 THEN 'queue_mode_differs' END, CASE WHEN k % 3 <> 0 AND k % 19 = 0 THEN 'queue_window_differs' END) AS findings
    FROM (SELECT event_id AS run_id, k FROM v_k)""")
def _(t):
    k, ts = F.col("k"), F.col("ts")
    day = lambda n: F.make_dt_interval(F.lit(n))
    runs = t.v_k.select(
        F.col("event_id").alias("run_id"), F.lit("weekly").alias("mode"), ts.alias("window_start"),
        F.when(k % 11 == 0, ts).when(k % 13 == 0, ts + day(7000)).otherwise(ts + day(7)).alias("window_end"),
        F.when(k % 5 != 0, ts + day(8)).alias("started_at"), F.when(k % 5 != 0, ts + F.when(k % 7 == 0, day(7)).otherwise(day(9))).alias("completed_at"), k.alias("k"),
    )
    queues = runs.filter("k % 3 <> 0").select(
        "run_id", F.when(k % 17 == 0, "search").otherwise("weekly").alias("mode"), "window_start",
        F.when(k % 19 == 0, F.col("window_end") + day(1)).otherwise(F.col("window_end")).alias("window_end"),
    )
    return state.run_ledger_check(runs, queues, "2026-01-01 00:00:00")


def decided_articles(t: Tables):
    d = F.col("doc_id")
    held = t.labels.filter("doc_id % 2 = 0").select(d.alias("article_id"), F.lit("other").alias("work_type"), F.lit("unreviewed").alias("interest"), at("2024-01-01 00:00:00").alias("reviewed_at"))
    new = t.labels.select(
        d.alias("article_id"), cat("https://a.example.org/", F.when(d % 7 == 0, d + 1).otherwise(d).cast("string")).alias("article_url"),
        F.when(F.col("quality") == 1, "research").otherwise("other").alias("work_type"),
        F.when(d % 5 == 0, "odd").when(F.col("toxic") == 1, "relevant").otherwise("unreviewed").alias("interest"), at(NOW).alias("reviewed_at"),
    )
    articles = t.documents.select(d.alias("article_id"), cat("https://a.example.org/", d.cast("string")).alias("url"))
    return journals.article_review(held, new, articles)


REASONED = """
    SELECT doc_id AS article_id, quality, toxic, CASE WHEN doc_id % 7 = 0 THEN 'article_not_collected' WHEN doc_id % 5 = 0 THEN 'invalid_interest'
      WHEN quality = 0 AND toxic = 1 THEN 'interest_needs_research' END AS reason FROM labels"""


@check("i21_article_review", f"""
    SELECT article_id, CASE WHEN reason IS NOT NULL THEN 'other' WHEN quality = 1 THEN 'research' ELSE 'other' END AS work_type,
      CASE WHEN reason IS NULL AND toxic = 1 THEN 'relevant' ELSE 'unreviewed' END AS interest,
      CASE WHEN reason IS NULL THEN '2024-01-20 00:00:00' ELSE '2024-01-01 00:00:00' END AS reviewed_at
    FROM ({REASONED}) WHERE reason IS NULL OR article_id % 2 = 0""")
def _(t):
    return decided_articles(t)[0]


@check("i21_refused_reviews", f"SELECT article_id, reason FROM ({REASONED}) WHERE reason IS NOT NULL")
def _(t):
    return decided_articles(t)[1].select("article_id", "reason")
