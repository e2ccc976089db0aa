"""Checks of interval, journal, summary and catalogue jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.identity_checks import IDENT, RATIOS, ident_records
from checks.registry import check
from checks.views import Tables, cat, pick
from shelfmark.operators import identity, intervals, journals, merge, summaries

ISLANDS = """
    SELECT source_key, min(s) AS window_start, max(e) AS window_end, max(checked_at) AS checked_at FROM (
      SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, max(e) OVER (PARTITION BY source_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (
          SELECT source_key, window_start AS s, least(window_end, checked_at) AS e, checked_at FROM v_coverage WHERE window_start < least(window_end, checked_at))))
    GROUP BY source_key, island"""


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


@check("e01_coalesce_intervals", f"SELECT source_key, {stamp('window_start')}, {stamp('window_end')}, {stamp('checked_at')} FROM ({ISLANDS})")
def _(t):
    return intervals.coalesce_intervals(t.v_coverage)


@check("e02_coverage_gaps", f"""
    WITH c AS (SELECT source_key, greatest(window_start, TIMESTAMP '1996-01-01') AS s, least(window_end, TIMESTAMP '1999-01-01') AS e FROM ({ISLANDS})
               WHERE window_end > TIMESTAMP '1996-01-01' AND window_start < TIMESTAMP '1999-01-01'),
    k AS (SELECT DISTINCT source_key, TIMESTAMP '1996-01-01' AS s, TIMESTAMP '1996-01-01' AS e FROM v_coverage),
    u AS (FROM c UNION ALL FROM k),
    g AS (SELECT source_key, max(e) OVER (PARTITION BY source_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS gap_start,
        coalesce(lead(s) OVER (PARTITION BY source_key ORDER BY s, e), TIMESTAMP '1999-01-01') AS gap_end FROM u)
    SELECT source_key, {stamp('gap_start')}, {stamp('gap_end')} FROM g WHERE gap_start < gap_end""")
def _(t):
    return intervals.coverage_gaps(t.v_coverage, "1996-01-01 00:00:00", "1999-01-01 00:00:00")


def asked_windows(t: Tables):
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"),
        F.when(F.col("l_orderkey") % 101 != 0, F.col("l_suppkey")).alias("source_key"),
        F.col("l_shipdate").alias("window_start"),
        (F.col("l_shipdate") + F.make_dt_interval((F.col("l_quantity") % 9 + 1).cast("int"))).alias("window_end"),
    )


@check("e03_covering_interval", f"""
    SELECT w.request_id, strftime(i.window_start, '%Y-%m-%d %H:%M:%S') AS covered_start, strftime(i.window_end, '%Y-%m-%d %H:%M:%S') AS covered_end
    FROM (SELECT l_orderkey * 10 + l_linenumber AS request_id, CASE WHEN l_orderkey % 101 <> 0 THEN l_suppkey END AS source_key, l_shipdate AS s, l_shipdate + to_days(CAST(l_quantity % 9 + 1 AS INTEGER)) AS e
          FROM lineitem) w
    LEFT JOIN ({ISLANDS}) i ON w.source_key = i.source_key AND i.window_start <= w.s AND i.window_end >= w.e""")
def _(t):
    return intervals.covering_interval(t.v_coverage, asked_windows(t)).select("request_id", "covered_start", "covered_end")


@check("e04_prune_history", """
    SELECT (SELECT count(*) FROM v_change_events) AS events_before,
      (SELECT count(*) FROM v_change_events WHERE changed_at >= TIMESTAMP '2024-01-15') AS events_after,
      (SELECT count(*) FROM v_coverage) AS coverage_before,
      (SELECT count(*) FROM v_coverage WHERE window_end > TIMESTAMP '2024-01-15' - INTERVAL 9000 DAY) AS coverage_after""")
def _(t):
    shifted = t.v_coverage.withColumn("window_end", F.col("window_end") + F.expr("INTERVAL 9000 DAY"))
    return intervals.prune_history(t.v_change_events, shifted, "2024-01-15 00:00:00")[2]


@check("e04_clipped_coverage", """
    SELECT source_key, strftime(greatest(window_start, TIMESTAMP '1998-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start,
      strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at
    FROM v_coverage WHERE window_end > TIMESTAMP '1998-01-01'""")
def _(t):
    return intervals.prune_history(t.v_change_events, t.v_coverage, "1998-01-01 00:00:00")[1]


@check("d22_profile_as_of", """
    SELECT o.l_orderkey AS event_id, p.version, strftime(p.effective_from, '%Y-%m-%d %H:%M:%S') AS effective_from
    FROM (SELECT l_orderkey, CASE WHEN l_partkey % 97 <> 0 THEN l_partkey % 500 END AS profile_id, CASE WHEN l_orderkey % 101 <> 0 THEN l_shipdate END AS at FROM lineitem) o
    ASOF LEFT JOIN v_profiles p ON o.profile_id = p.profile_id AND o.at >= p.effective_from""", ints="version")
def _(t):
    events = t.lineitem.select(
        F.col("l_orderkey").alias("event_id"), F.when(F.col("l_partkey") % 97 != 0, F.col("l_partkey") % 500).alias("profile_id"),
        F.when(F.col("l_orderkey") % 101 != 0, F.col("l_shipdate")).alias("at"),
    )
    return intervals.profile_as_of(events, t.v_profiles).select("event_id", "version", "effective_from")


LABELLED = """
    SELECT url, year, label_month, CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_shipdate AS DATE) END AS day, l_linenumber = 6 AS date_conflict
    FROM (SELECT v.*, l.l_orderkey, l.l_linenumber, l.l_shipdate FROM v_issue_records v JOIN lineitem l ON v.url = 'https://list.example.org/' || l.l_orderkey || '/' || l.l_linenumber)"""


def labelled(t: Tables):
    keys = t.lineitem.select(
        cat("https://list.example.org/", F.col("l_orderkey").cast("string"), "/", F.col("l_linenumber").cast("string")).alias("url"),
        F.when(F.col("l_orderkey") % 3 == 0, F.to_date("l_shipdate")).alias("day"), (F.col("l_linenumber") == 6).alias("date_conflict"),
    )
    return t.v_issue_records.select("url", "year", "label_month").join(keys, "url")


@check("d14_date_overlap", f"""
    SELECT url, CASE WHEN date_conflict THEN 'conflict' WHEN lo IS NULL THEN 'unknown'
        WHEN lo < TIMESTAMP '1998-03-09 05:00:00' AND hi > TIMESTAMP '1998-03-02 05:00:00' THEN 'inside' ELSE 'outside' END AS overlap
    FROM (SELECT *, coalesce(CAST(day AS TIMESTAMP), CAST(m AS TIMESTAMP)) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS lo,
        coalesce(CAST(day + 1 AS TIMESTAMP), CAST(m + INTERVAL 1 MONTH AS TIMESTAMP)) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS hi
      FROM (SELECT *, CASE WHEN label_month IS NOT NULL THEN make_date(year, label_month, 1) END AS m FROM ({LABELLED})))""")
def _(t):
    return intervals.date_overlap(labelled(t), "1998-03-02 05:00:00", "1998-03-09 05:00:00", "America/New_York").select("url", "overlap")


@check("d14_date_overlap_many", f"""
    SELECT url AS record_id, strftime(window_start, '%Y-%m-%d') AS window_id FROM ({LABELLED}) r JOIN v_runs w
    ON make_date(r.year, r.label_month, 1) < w.window_end AND make_date(r.year, r.label_month, 1) + INTERVAL 1 MONTH > w.window_start
    WHERE NOT date_conflict AND r.label_month IS NOT NULL AND day IS NOT NULL""")
def _(t):
    windows = t.v_runs.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_id"), "window_start", "window_end", F.lit("UTC").alias("zone"))
    records = labelled(t).filter("day IS NOT NULL").withColumnRenamed("url", "record_id")
    return intervals.date_overlap_many(records, windows)


ISSUES = """
    SELECT venue, year, issue, CASE WHEN count(DISTINCT label_month) = 1 THEN min(label_month) END AS label_month,
      count(DISTINCT label_month) > 1 AS label_conflict FROM v_issue_records GROUP BY venue, year, issue"""


@check("d15_date_evidence", f"""
    WITH f AS (SELECT venue, year, issue, min(label_month) AS ll, max(label_month) AS lh, min(CASE WHEN year(day) = year THEN month(day) END) AS dl,
        max(CASE WHEN year(day) = year THEN month(day) END) AS dh, min(day) AS d1, max(day) AS d2,
        min(evidence_url) FILTER (WHERE label_month IS NOT NULL OR day IS NOT NULL) AS date_evidence_url
      FROM v_issue_evidence WHERE status = 'reviewed' GROUP BY ALL),
    j AS (SELECT i.*, f.* EXCLUDE (venue, year, issue), i.label_month IS NULL AND ll IS NULL AS use_days FROM ({ISSUES}) i LEFT JOIN f USING (venue, year, issue)),
    b AS (SELECT *, least(label_month, ll, CASE WHEN use_days THEN dl END) AS low, greatest(label_month, lh, CASE WHEN use_days THEN dh END) AS high FROM j)
    SELECT venue, year, issue, CASE WHEN NOT (coalesce(low <> high, FALSE) OR label_conflict) THEN low END AS label_month,
      coalesce(low <> high, FALSE) OR label_conflict AS date_conflict, CASE WHEN d1 = d2 THEN strftime(d1, '%Y-%m-%d') END AS day, date_evidence_url FROM b""",
    ints="year label_month")
def _(t):
    issues = merge.group_issues(t.v_issue_records)
    return journals.date_evidence(issues, t.v_issue_evidence).select(
        "venue", "year", "issue", "label_month", "date_conflict", "day", "date_evidence_url"
    )


@check("d16_corroborate", """
    SELECT url, conflicts, CASE WHEN conflicts <> '' THEN 'conflict' WHEN p % 7 = 0 THEN 'partial' ELSE 'corroborated' END AS status
    FROM (SELECT url, p, concat_ws('|', CASE WHEN p % 5 = 0 THEN 'title' END, CASE WHEN p % 11 = 0 THEN 'venue' END, CASE WHEN p % 13 = 0 THEN 'year' END,
        CASE WHEN p % 7 <> 0 AND p % 17 = 0 THEN 'issue' END) AS conflicts
      FROM (SELECT url, min(CAST(substring(title, 2) AS INTEGER)) AS p FROM v_issue_records GROUP BY url))""")
def _(t):
    p = F.regexp_extract("title", r"(\d+)", 1).cast("int")
    one = F.min(F.struct("p", "title", "authors", "venue", "year", "issue")).alias("r")  # URLs repeat in this table
    records = t.v_issue_records.withColumn("p", p).groupBy("url").agg(one).select("url", "r.*")
    evidence = records.select(
        "url", F.when(p % 5 == 0, "Other").otherwise(F.lower("title")).alias("title"), F.upper("authors").alias("authors"),
        F.when(p % 11 == 0, "Else").otherwise(F.regexp_replace("venue", " ", "-")).alias("venue"),
        F.when(p % 13 == 0, F.col("year") + 1).otherwise(F.col("year")).alias("year"),
        F.when(p % 17 == 0, cat("9", F.col("issue"))).otherwise(cat("0", F.col("issue"))).alias("issue"),
    )
    ours = records.withColumn("issue", F.when(p % 7 != 0, F.col("issue")))
    return journals.corroborate(ours, evidence)


def checked_sides(t: Tables):
    """Two tables of titled records, from odd and even order lines, with many shared titles and missing fields."""
    p, n = F.col("l_partkey"), F.col("l_orderkey")

    def side(line):
        return t.lineitem.filter(F.col("l_linenumber") % 2 == line % 2).select(
            (n * 10 + F.col("l_linenumber")).alias("record_id"),
            cat("https://x.example.org/", n.cast("string"), "/", F.col("l_linenumber").cast("string"), "/", p.cast("string"), "/",
                F.col("l_suppkey").cast("string"), "/", F.date_format("l_shipdate", "yyyyMMdd")).alias("url"),
            F.when(n % 3 == 0, "Editorial").otherwise(cat("T", (p % 900).cast("string"))).alias("title"),
            F.when(n % 5 != line % 5, cat("V", (F.col("l_suppkey") % 3).cast("string"))).alias("venue"),
            F.when(n % 7 != line % 7, F.year("l_shipdate")).alias("year"),
            F.when(n % 11 != line % 11, (F.month("l_shipdate") % 3).cast("string")).alias("issue"),
            F.when(n % 4 != line % 4, cat("A", (p % 2).cast("string"))).alias("authors"),
            cat("A", (p % 4).cast("string")).alias("first_author"), cat("https://p.example.org/", n.cast("string")).alias("peer_url"),
        )

    return side(1), side(2)


def _side(line: int) -> str:
    return f"""SELECT l_orderkey * 10 + l_linenumber AS record_id, 'https://x.example.org/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || strftime(l_shipdate, '%Y%m%d') AS url,
        CASE WHEN l_orderkey % 3 = 0 THEN 'Editorial' ELSE 'T' || (l_partkey % 900) END AS title,
        CASE WHEN l_orderkey % 5 <> {line % 5} THEN 'V' || (l_suppkey % 3) END AS venue,
        CASE WHEN l_orderkey % 7 <> {line % 7} THEN year(l_shipdate) END AS year,
        CASE WHEN l_orderkey % 11 <> {line % 11} THEN CAST(month(l_shipdate) % 3 AS VARCHAR) END AS issue,
        CASE WHEN l_orderkey % 4 <> {line % 4} THEN 'A' || (l_partkey % 2) END AS authors, 'A' || (l_partkey % 4) AS first_author,
        'https://p.example.org/' || l_orderkey AS peer_url FROM lineitem WHERE l_linenumber % 2 = {line % 2}"""


@check("d17_cross_check", f"""
    WITH a AS ({_side(1)}), b AS (SELECT title, venue, year, issue, authors, min(record_id) AS record_id FROM ({_side(2)}) GROUP BY ALL),
    p AS (SELECT a.url, b.record_id AS other_id, CASE WHEN a.venue <> b.venue OR a.year <> b.year OR a.issue <> b.issue OR a.authors <> b.authors THEN 2
        WHEN a.venue IS NULL OR b.venue IS NULL OR a.year IS NULL OR b.year IS NULL OR a.issue IS NULL OR b.issue IS NULL OR a.authors IS NULL OR b.authors IS NULL THEN 1 ELSE 0 END AS rank
      FROM a JOIN b ON a.title = b.title)
    SELECT a.url, CASE min(rank) WHEN 0 THEN 'corroborated' WHEN 1 THEN 'partial' WHEN 2 THEN 'conflict' ELSE 'unverified' END AS status,
      CASE WHEN min(rank) < 2 THEN arg_min(other_id, (rank, other_id)) END AS other_id
    FROM a LEFT JOIN p USING (url) GROUP BY a.url""")
def _(t):
    return journals.cross_check(*checked_sides(t))


EXACT_TITLE = "lower(title) || chr(31) || lower(first_author) || chr(31) || year"


@check("d18_title_overlap", f"""
    WITH a AS ({_side(1)}), b AS ({_side(2)}),
    every AS (SELECT lower(title) AS class_key, count(DISTINCT peer_url) AS n_links FROM b GROUP BY 1),
    exact AS (SELECT {EXACT_TITLE} AS class_key, count(DISTINCT peer_url) AS n_links FROM b WHERE year IS NOT NULL GROUP BY 1),
    found AS (SELECT a.url, CASE WHEN x.n_links IS NOT NULL THEN 'same_bibliography' ELSE 'needs_review' END AS status,
        coalesce(x.class_key, e.class_key) AS class_key, coalesce(x.n_links, e.n_links) AS n_links
      FROM a JOIN every e ON lower(title) = e.class_key LEFT JOIN exact x ON {EXACT_TITLE} = x.class_key),
    links AS (SELECT DISTINCT lower(title) AS class_key, peer_url FROM b UNION ALL SELECT DISTINCT {EXACT_TITLE}, peer_url FROM b WHERE year IS NOT NULL)
    SELECT url, status, class_key, n_links, NULL::VARCHAR AS peer_url FROM found
    UNION ALL SELECT NULL, NULL, class_key, NULL, peer_url FROM links WHERE class_key IN (SELECT class_key FROM found)""", ints="n_links")
def _(t):
    return journals.title_overlap_with_links(*checked_sides(t))


@check("d18_title_links", f"""
    WITH b AS ({_side(2)})
    SELECT DISTINCT lower(title) AS class_key, peer_url FROM b UNION ALL SELECT DISTINCT {EXACT_TITLE}, peer_url FROM b WHERE year IS NOT NULL""")
def _(t):
    return journals.title_links(checked_sides(t)[1])


@check("d19_article_hits", f"""
    WITH RECURSIVE {IDENT}, placed AS (SELECT *, 'V' || (record_id // 2 % 3) AS venue, 2000 + record_id // 4 % 2 AS year, '1' AS issue FROM ident),
    pairs AS (
      SELECT l.record_id AS l, coalesce(l.doi = r.doi, FALSE) AS shared, l.title_fold AS lt, r.title_fold AS rt,
        CASE WHEN l.surname IS NOT NULL AND r.surname IS NOT NULL THEN
          l.words = r.words OR (l.surname = r.surname AND (l.initial = '' OR r.initial = '' OR l.initial = r.initial)) END AS ac,
        least(len(l.tokens), len(r.tokens)) AS few,
        len(list_intersect(l.tokens, r.tokens)) / nullif(len(list_distinct(list_concat(l.tokens, r.tokens))), 0) AS jac,
        l.venue = r.venue AND l.year = r.year AND l.issue = r.issue AS place
      FROM placed l JOIN placed r ON l.record_id % 2 = 0 AND r.record_id % 2 = 1), {RATIOS},
    judged AS (SELECT *, CASE WHEN shared OR lt = rt THEN CASE WHEN ac = FALSE THEN 1 ELSE 2 END WHEN lt IS NULL OR rt IS NULL THEN 0
        WHEN ac AND (few >= 3 AND jac >= 0.84 OR ratio >= 0.92) THEN 2 WHEN ac AND few >= 3 AND (jac >= 0.5 OR ratio >= 0.65) THEN 1 ELSE 0 END AS level
        FROM pairs LEFT JOIN ratios USING (lt, rt))
    SELECT i.record_id, CASE WHEN bool_or(level = 2 AND place AND ac) THEN 'hit' WHEN max(level) > 0 THEN 'review' ELSE 'miss' END AS status
    FROM ident i LEFT JOIN judged ON l = i.record_id WHERE i.record_id % 2 = 0 GROUP BY i.record_id""")
def _(t):
    d = F.col("record_id")
    every = identity.identities(ident_records(t)).withColumn(
        "venue", cat("V", (F.floor(d / 2) % 3).cast("string"))
    ).withColumn("year", (2000 + F.floor(d / 4) % 2).cast("int")).withColumn("issue", F.lit("1"))
    return journals.article_hits(every.filter("record_id % 2 = 0"), every.filter("record_id % 2 = 1"))


def scans(t: Tables):
    """Completed scans of each issue; every seventh has a wrong count."""
    number = F.regexp_extract("issue", r"src(\d+)", 1).cast("int")
    return t.v_catalogue.filter("last_observed = 4").groupBy("issue").agg(
        F.count("*").alias("n"), journals.title_digest(F.col("title")).alias("title_digest")
    ).select(
        "issue", (F.col("n") + F.when(number % 7 == 0, 1).otherwise(0)).alias("article_count"), "title_digest",
        F.lit(4).alias("last_completed"),
    )


COMPLETE = """
    SELECT issue FROM v_catalogue WHERE last_observed = 4 AND CAST(regexp_extract(issue, 'src([0-9]+)', 1) AS INTEGER) % 7 <> 0 GROUP BY issue"""
TERM = "regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '\\s+', '', 'g')"


@check("d23_catalogue_search", f"""
    SELECT article_id, matched_fields FROM (
      SELECT article_id, concat_ws('|',
        CASE WHEN contains({TERM.format('title')}, 'thenter') OR contains({TERM.format('title')}, 'und') THEN 'title' END,
        CASE WHEN contains({TERM.format('keywords')}, 'thenter') OR contains({TERM.format('keywords')}, 'und') THEN 'keywords' END,
        CASE WHEN contains({TERM.format('abstract')}, 'thenter') OR contains({TERM.format('abstract')}, 'und') THEN 'abstract' END) AS matched_fields
      FROM v_catalogue WHERE last_observed = 4 AND issue IN ({COMPLETE}))
    WHERE matched_fields <> ''""")
def _(t):
    return journals.catalogue_search(t.v_catalogue, scans(t), ["The nter", "Und "]).select("article_id", "matched_fields")


@check("d24_locate_targets", """
    WITH lists AS (
      SELECT link AS url, 1 AS priority, 'feed' AS list_name, min(event_id) AS position FROM v_feed_entries WHERE category_id = 'click' GROUP BY 1
      UNION ALL SELECT link, 2, 'wide', min(event_id) FROM v_feed_entries GROUP BY 1)
    SELECT url, coalesce(arg_min(list_name, priority), 'not_located') AS list_name, arg_min(position, priority) AS position
    FROM (SELECT link AS url FROM v_feed_entries UNION SELECT 'https://feed.example.org/rec/U' || (user_id * 2) FROM events) LEFT JOIN lists USING (url) GROUP BY url""")
def _(t):
    e = t.v_feed_entries
    lists = e.filter("category_id = 'click'").select(
        F.lit(1).alias("priority"), F.lit("feed").alias("list_name"), F.col("event_id").alias("position"), F.col("link").alias("url")
    ).unionByName(e.select(
        F.lit(2).alias("priority"), F.lit("wide").alias("list_name"), F.col("event_id").alias("position"), F.col("link").alias("url")
    ))
    others = t.events.select(cat("https://feed.example.org/rec/U", (F.col("user_id") * 2).cast("string")).alias("url"))
    return journals.locate_targets(e.select(F.col("link").alias("url")).unionByName(others), lists)


@check("f09_arrival_intervals", """
    WITH h AS (SELECT article_id, source, min(checked_at) FILTER (WHERE status = 'hit') AS first_hit, arg_max(status, (checked_at, status)) AS latest_status
               FROM v_article_checks GROUP BY ALL),
    m AS (SELECT c.article_id, c.source, max(checked_at) AS last_complete_miss FROM v_article_checks c JOIN h USING (article_id, source)
          WHERE status = 'miss' AND complete AND (first_hit IS NULL OR checked_at < first_hit) GROUP BY ALL)
    SELECT article_id, source, strftime(date_trunc('second', first_hit), '%Y-%m-%d %H:%M:%S') AS first_hit, latest_status,
      strftime(date_trunc('second', last_complete_miss), '%Y-%m-%d %H:%M:%S') AS last_complete_miss,
      CASE WHEN first_hit IS NOT NULL AND last_complete_miss IS NOT NULL THEN 'interval_censored' WHEN first_hit IS NOT NULL THEN 'left_censored'
        WHEN last_complete_miss IS NOT NULL THEN 'right_censored_on_search_surface' ELSE 'unknown' END AS arrival_evidence
    FROM h LEFT JOIN m USING (article_id, source)""")
def _(t):
    return journals.arrival_intervals(t.v_article_checks)


@check("f10_arrival_summary", """
    WITH h AS (SELECT article_id % 60 + 1000 * (checked_at < TIMESTAMP '2024-01-05')::INT AS a, source, min(checked_at) FILTER (WHERE status = 'hit') AS first_hit
               FROM v_article_checks GROUP BY ALL),
    m AS (SELECT a, c.source, max(checked_at) AS miss FROM (SELECT *, article_id % 60 + 1000 * (checked_at < TIMESTAMP '2024-01-05')::INT AS a FROM v_article_checks) c
          JOIN h USING (a, source) WHERE status = 'miss' AND complete AND (first_hit IS NULL OR checked_at < first_hit) GROUP BY ALL)
    SELECT source, count(*) AS observed_articles, count(first_hit) AS ever_hit, count(*) FILTER (WHERE first_hit IS NULL AND miss IS NOT NULL) AS searched_without_hit,
      count(*) FILTER (WHERE first_hit IS NOT NULL AND miss IS NOT NULL) AS arrival_intervals, count(*) FILTER (WHERE first_hit IS NULL AND miss IS NULL) AS unknown_or_failed
    FROM h LEFT JOIN m USING (a, source) GROUP BY source""")
def _(t):
    split = t.v_article_checks.withColumn(
        "article_id", F.col("article_id") % 60 + 1000 * (F.col("checked_at") < F.lit("2024-01-05").cast("timestamp_ntz")).cast("int")
    )
    return journals.arrival_summary(journals.arrival_intervals(split))


def article_reviews(t: Tables):
    return t.labels.select(
        F.col("doc_id").alias("article_id"),
        F.when(F.col("quality") == 1, "research").when(F.col("doc_id") % 5 == 0, "uncertain").otherwise("other").alias("work_type"),
        F.when(F.col("quality") == 0, "unreviewed").when(F.col("toxic") == 1, "irrelevant").when(F.col("doc_id") % 3 == 0, "uncertain")
        .otherwise("relevant").alias("interest"),
    )


@check("f11_issue_coverage", f"""
    WITH latest AS (SELECT article_id, source, arg_max(status, (checked_at, status)) AS status, arg_max(complete, (checked_at, status)) AS complete
                    FROM v_article_checks GROUP BY ALL),
    r AS (SELECT doc_id AS article_id, CASE WHEN quality = 1 THEN 'research' WHEN doc_id % 5 = 0 THEN 'uncertain' ELSE 'other' END AS kind,
        CASE WHEN quality = 0 THEN 'unreviewed' WHEN toxic = 1 THEN 'irrelevant' WHEN doc_id % 3 = 0 THEN 'uncertain' ELSE 'relevant' END AS interest FROM labels),
    j AS (SELECT c.issue, coalesce(kind, 'unreviewed') AS kind, interest, coalesce(a.status, 'unchecked') AS sa, coalesce(a.complete, FALSE) AS ca,
        coalesce(b.status, 'unchecked') AS sb, coalesce(b.complete, FALSE) AS cb
      FROM v_catalogue c LEFT JOIN r USING (article_id) LEFT JOIN (SELECT * FROM latest WHERE source = 'a') a ON a.article_id = c.article_id
      LEFT JOIN (SELECT * FROM latest WHERE source = 'b') b ON b.article_id = c.article_id),
    s AS (SELECT issue, count(*) AS publisher_records, count(*) FILTER (WHERE kind = 'research') AS type_research, count(*) FILTER (WHERE kind = 'other') AS type_other,
        count(*) FILTER (WHERE kind = 'uncertain') AS type_uncertain, count(*) FILTER (WHERE kind = 'unreviewed') AS type_unreviewed,
        count(*) FILTER (WHERE kind = 'research' AND interest = 'relevant') AS interest_relevant, count(*) FILTER (WHERE kind = 'research' AND interest = 'uncertain') AS interest_uncertain,
        count(*) FILTER (WHERE sa = 'hit') AS a_hit, count(*) FILTER (WHERE sa = 'unchecked') AS a_unchecked, count(*) FILTER (WHERE ca) AS a_complete_queries,
        count(*) FILTER (WHERE sb = 'miss') AS b_miss, count(*) FILTER (WHERE kind = 'research' AND NOT (cb AND sb IN ('hit', 'miss'))) AS b_unresolved
      FROM j GROUP BY issue)
    SELECT s.*, done AS toc_complete, CASE WHEN done THEN publisher_records END AS reference_denominator,
      CASE WHEN done AND type_unreviewed = 0 AND type_uncertain = 0 THEN type_research END AS research_denominator,
      CASE WHEN done AND type_unreviewed = 0 AND type_uncertain = 0 AND interest_uncertain = 0 THEN interest_relevant END AS interest_denominator
    FROM (SELECT s.*, issue IN ({COMPLETE}) AS done FROM s) s""".replace("SELECT s.*, done AS toc_complete", "SELECT s.* EXCLUDE (done), done AS toc_complete"))
def _(t):
    out = journals.issue_coverage(t.v_catalogue, scans(t), article_reviews(t), t.v_article_checks, ["a", "b"])
    return out.select(
        "issue", "publisher_records", "type_research", "type_other", "type_uncertain", "type_unreviewed", "interest_relevant",
        "interest_uncertain", "a_hit", "a_unchecked", "a_complete_queries", "b_miss", "b_unresolved", "toc_complete",
        "reference_denominator", "research_denominator", "interest_denominator",
    )


@check("f12_queue_summary", """
    SELECT grp, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'blocked') AS blocked,
      count(*) FILTER (WHERE status = 'dismissed') AS dismissed, count(*) FILTER (WHERE status = 'reviewed') AS reviewed, count(*) AS total,
      count(*) FILTER (WHERE status = 'blocked' AND blocked_since <= TIMESTAMP '2023-12-20') AS long_blocked,
      count(*) FILTER (WHERE status = 'blocked' AND blocked_since IS NULL) AS blocked_age_unknown FROM v_queue GROUP BY grp""")
def _(t):
    return summaries.queue_summary(t.v_queue, "2023-12-20 00:00:00")


@check("f13_telemetry_summary", """
    SELECT source, grouping(source) AS is_total, count(*) AS logical_requests, count(*) FILTER (WHERE outcome = 'success' AND attempts = 1) AS first_attempt_successes,
      count(*) FILTER (WHERE outcome = 'success' AND attempts > 1) AS retried_successes, count(*) FILTER (WHERE outcome <> 'success') AS failed_requests,
      sum(attempts) AS attempts, sum(wait_centis) AS wait_centis, count(*) FILTER (WHERE deferred) AS deferred_long_retry_after,
      arg_max(rate_limit, seq) FILTER (WHERE rate_limit IS NOT NULL) AS rate_limit
    FROM v_requests GROUP BY ROLLUP (source)""", ints="is_total attempts wait_centis rate_limit")
def _(t):
    return summaries.telemetry_summary(t.v_requests)


@check("f14_workload", """
    SELECT reason_code, count(*) AS n, CASE reason_code WHEN 'old_work_check_incomplete' THEN 'automatic_retry' ELSE 'human_review' END AS handled_by
    FROM v_unresolved GROUP BY reason_code""")
def _(t):
    return summaries.workload(t.v_unresolved)


@check("f15_run_funnel", """
    SELECT strftime(checked_at, '%Y-%m-%d') AS run_id, stage, count(*) AS n_rows, count(DISTINCT link) AS n_records
    FROM (SELECT checked_at, link, unnest(['entry', CASE WHEN published_at IS NOT NULL THEN 'dated' END, CASE WHEN doi_hint IS NOT NULL THEN 'doi' END]) AS stage FROM v_feed_entries)
    WHERE stage IS NOT NULL GROUP BY ALL""")
def _(t):
    stages = F.array_compact(F.array(
        F.lit("entry"), F.when(F.col("published_at").isNotNull(), "dated"), F.when(F.col("doi_hint").isNotNull(), "doi")
    ))
    rows = t.v_feed_entries.select(
        F.date_format("checked_at", "yyyy-MM-dd").alias("run_id"), "record_url", F.explode(stages).alias("stage")
    )
    return summaries.run_funnel(rows)


@check("f16_source_status", """
    SELECT *, CASE WHEN result_pages = 0 THEN 'failed' WHEN failures > 0 OR truncations > 0 THEN 'partial' ELSE 'success' END AS status
    FROM (SELECT source || '-' || (seq % 2000) AS source, count(*) FILTER (WHERE outcome = 'success') AS result_pages, count(*) FILTER (WHERE outcome <> 'success') AS failures,
      count(*) FILTER (WHERE deferred) AS truncations FROM v_requests GROUP BY 1)""")
def _(t):
    split = t.v_requests.withColumn("source", cat(F.col("source"), "-", (F.col("seq") % 2000).cast("string"))).withColumn("truncated", F.col("deferred"))
    return summaries.source_status(split)


@check("f17_first_review_in_window", """
    SELECT venue, year, issue, strftime(min(reviewed_at), '%Y-%m-%d %H:%M:%S') AS reviewed_at, arg_min(evidence_url, (reviewed_at, evidence_url)) AS evidence_url
    FROM v_issue_evidence WHERE status = 'reviewed' GROUP BY venue, year, issue
    HAVING min(reviewed_at) >= TIMESTAMP '1998-01-01' AND min(reviewed_at) < TIMESTAMP '1998-02-01'""", ints="year")
def _(t):
    return journals.first_review_in_window(t.v_issue_evidence, "1998-01-01 00:00:00", "1998-02-01 00:00:00")


@check("f18_distinct_leads", """
    SELECT venue, year, issue, evidence_url, strftime(day, '%Y-%m-%d') AS day FROM (
      SELECT *, row_number() OVER (PARTITION BY venue, year, issue ORDER BY coalesce(-(day - DATE '1970-01-01'), 0), evidence_url) AS rn FROM v_issue_evidence) WHERE rn = 1""", ints="year")
def _(t):
    return journals.distinct_leads(t.v_issue_evidence).select("venue", "year", "issue", "evidence_url", "day")


@check("f19_issues_in_window", """
    SELECT venue, year, issue, evidence_url FROM v_issue_evidence WHERE status = 'reviewed' AND
      CASE WHEN day IS NOT NULL THEN day BETWEEN DATE '1998-02-10' AND DATE '1998-03-05'
        ELSE make_date(year, label_month, 1) BETWEEN DATE '1998-02-01' AND DATE '1998-03-01' END""", ints="year")
def _(t):
    return journals.issues_in_window(t.v_issue_evidence, "1998-02-10", "1998-03-05").select("venue", "year", "issue", "evidence_url")


@check("f20_evidence_labels", """
    SELECT labels, count(*) AS n_pairs, count(DISTINCT user_id) AS n_records
    FROM (SELECT user_id, array_to_string(list_sort(list_filter([CASE WHEN k % 2 = 0 THEN 'title' END, CASE WHEN k % 3 = 0 THEN 'author' END, 'doi'], lambda x: x IS NOT NULL)), '+') AS labels FROM v_k)
    GROUP BY labels""")
def _(t):
    k = F.col("k")
    pairs = t.v_k.select(
        F.col("user_id").alias("record_url"),
        F.array_compact(F.array(F.when(k % 2 == 0, "title"), F.when(k % 3 == 0, "author"), F.lit("doi"))).alias("labels"),
    )
    return summaries.evidence_labels(pairs)


@check("f21_field_states", """
    SELECT field, count(*) FILTER (WHERE state = 'value') AS n_value, count(*) FILTER (WHERE state = 'null') AS n_null, count(*) FILTER (WHERE state = 'absent') AS n_absent
    FROM (SELECT 'k' AS field, CASE event_id % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'null' ELSE 'value' END AS state FROM events
          UNION ALL SELECT 'other', CASE WHEN event_id % 3 = 0 THEN 'value' ELSE 'absent' END FROM events) GROUP BY field""")
def _(t):
    e = F.col("event_id")
    rows = t.events.select(
        F.when(e % 3 == 0, F.lit('{"other": "x"}')).when(e % 3 == 1, F.lit('{"k": null}')).otherwise(F.col("props")).alias("json")
    )
    return summaries.field_states(rows, ["k", "other"])


@check("f22_store_summary", """
    SELECT source_key, coalesce(n_events, 0) AS n_events, coalesce(n_intervals, 0) AS n_intervals, coalesce(n_staged, 0) AS n_staged
    FROM (SELECT CAST(o_custkey % 150 AS BIGINT) AS source_key, count(*) AS n_events FROM orders GROUP BY 1)
    FULL JOIN (SELECT source_key, count(*) AS n_intervals FROM v_coverage GROUP BY 1) USING (source_key)
    FULL JOIN (SELECT user_id + 100 AS source_key, count(*) AS n_staged FROM events GROUP BY 1) USING (source_key)""")
def _(t):
    events = t.orders.select((F.col("o_custkey") % 150).alias("source_key"))
    staged = t.events.select((F.col("user_id") + 100).alias("source_key"))
    return summaries.store_summary(events, t.v_coverage, staged)


@check("f23_last_profile_version", """
    SELECT o_orderstatus AS run_kind, arg_max(o_custkey, (o_orderdate, o_orderkey, o_custkey)) AS profile_version
    FROM orders WHERE o_orderpriority NOT LIKE '1-%' GROUP BY 1""")
def _(t):
    runs = t.orders.select(
        F.col("o_orderstatus").alias("run_kind"), F.when(F.col("o_orderpriority").startswith("1-"), "failed").otherwise("success").alias("status"),
        F.col("o_custkey").alias("profile_version"), F.col("o_orderdate").alias("window_end"), F.col("o_orderkey").alias("completed_at"),
    )
    return summaries.last_profile_version(runs)


@check("h03_coverage_rows", """
    SELECT 'feed' AS scan, event_type AS source, count(*) AS entries, CAST(NULL AS BIGINT) AS failures FROM events GROUP BY 2
    UNION ALL SELECT 'request', source, NULL, count(*) FILTER (WHERE outcome <> 'success') FROM v_requests GROUP BY 2""")
def _(t):
    feed = t.v_feed_entries.groupBy(F.col("category_id").alias("source")).agg(F.count("*").alias("entries")).withColumn("scan", F.lit("feed"))
    request = summaries.source_status(t.v_requests.withColumn("truncated", F.lit(False))).select("source", "failures").withColumn("scan", F.lit("request"))
    return summaries.coverage_rows([feed, request])


@check("a12_import_checked_catalogue", """
    SELECT issue, coalesce(n, 0) AS n, concat_ws('|', CASE WHEN nr IS NULL THEN 'issue_not_reviewed' END, CASE WHEN nr > 1 THEN 'issue_reviewed_twice' END,
      CASE WHEN lo <> hi THEN 'dates_disagree' END, CASE WHEN declared <> coalesce(n, 0) THEN 'count_mismatch' END, CASE WHEN nt <> coalesce(n, 0) THEN 'titles_repeat' END,
      CASE WHEN nb > 0 THEN 'blank_title' END, CASE WHEN coalesce(n, 0) NOT BETWEEN 5 AND 30 THEN 'size_out_of_bounds' END) AS reasons
    FROM (SELECT issue, count(*) AS n, count(DISTINCT title) AS nt, count(*) FILTER (WHERE trim(title) = '') AS nb FROM v_catalogue GROUP BY issue)
    FULL JOIN (SELECT issue, count(*) AS nr, min(declared) AS declared, min(d) AS lo, max(d) AS hi FROM (
        SELECT issue, n AS declared, DATE '2024-01-01' AS d FROM (SELECT issue, count(*) AS n FROM v_catalogue GROUP BY issue) WHERE n % 4 <> 0
        UNION ALL SELECT issue, n + 1, DATE '2024-01-02' FROM (SELECT issue, count(*) AS n FROM v_catalogue GROUP BY issue) WHERE n % 5 = 0) GROUP BY issue) USING (issue)""")
def _(t):
    sizes = t.v_catalogue.groupBy("issue").agg(F.count("*").alias("n"))
    one = sizes.filter("n % 4 <> 0").select("issue", F.col("n").alias("declared_count"), F.lit("2024-01-01").cast("date").alias("declared_date"))
    two = sizes.filter("n % 5 = 0").select("issue", (F.col("n") + 1).alias("declared_count"), F.lit("2024-01-02").cast("date").alias("declared_date"))
    return journals.import_checked_catalogue(t.v_catalogue, one.unionByName(two), (5, 30))
