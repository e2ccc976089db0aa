"""Checks of gates, merges, profiles and taxonomies."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import Tables, cat, pick
from shelfmark.operators import gates, merge, taxonomy

START, END = "2024-01-08 00:00:00", "2024-01-15 00:00:00"
WINDOW = (START, END)

# Merged records in SQL, as the twins of several checks use them.
MERGED = f"""
    SELECT record_url, min(title) AS title, list_sort(list(DISTINCT category_id)) AS cats, max(checked_at) AS observed_at,
      min(published_at) AS first_feed_date, max(published_at) AS last_feed_date,
      coalesce(bool_or(published_at >= TIMESTAMP '{START}' AND published_at < TIMESTAMP '{END}'), FALSE) AS date_in_window,
      coalesce(list_sort(list(DISTINCT year_hint) FILTER (WHERE year_hint IS NOT NULL)), []) AS years,
      coalesce(list_sort(list(DISTINCT type_hint) FILTER (WHERE type_hint IS NOT NULL)), []) AS types,
      count(DISTINCT doi_hint) AS n_dois, min(doi_hint) AS doi
    FROM v_feed_entries GROUP BY record_url"""
LATEST = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY changed_at DESC, identifier DESC, event_id DESC) AS rn
                   FROM v_change_events WHERE record_key IS NOT NULL) WHERE rn = 1 AND NOT deleted"""
ENRICHED = f"""
    SELECT m.*, l.changed_at, l.identifier AS change_record_id, l.dc_type AS change_type, l.dc_date
    FROM ({MERGED}) m LEFT JOIN ({LATEST}) l ON lower(replace(m.record_url, 'https://feed.example.org/rec/', '')) = l.record_key"""


def sparse(t: Tables):
    """Records with few entries each, so that absent dates, years and DOIs occur."""
    keyed = t.v_feed_entries.withColumn(
        "record_url", F.concat("record_url", F.lit("-"), (F.col("event_id") % 61).cast("string"))
    )
    return keyed




def _sparse_sql() -> str:
    return MERGED.replace("FROM v_feed_entries", "FROM (SELECT * REPLACE (record_url || '-' || (event_id % 61) AS record_url) FROM v_feed_entries)")


def sparse_enriched(t: Tables):
    events = t.v_change_events.withColumn(
        "record_key", F.concat("record_key", F.lit("-"), (F.col("event_id") % 67).cast("string"))
    )
    return merge.enrich_with_changes(merge.merge_feeds(sparse(t), WINDOW), merge.latest_active(events))


SPARSE_ENRICHED = f"""
    SELECT m.*, l.changed_at, l.identifier AS change_record_id, l.dc_type AS change_type, l.dc_date,
      CASE WHEN l.dc_date IS NULL THEN years ELSE list_concat(years, [CAST(l.dc_date AS INTEGER)]) END AS all_years
    FROM ({_sparse_sql()}) m LEFT JOIN ({LATEST.replace("FROM v_change_events", "FROM (SELECT * REPLACE (record_key || '-' || (event_id % 67) AS record_key) FROM v_change_events)")}) l
    ON lower(replace(m.record_url, 'https://feed.example.org/rec/', '')) = l.record_key"""


@check("f01_merge_feeds", f"""
    SELECT record_url, title, FALSE AS title_conflict, array_to_string(cats, '|') AS category_ids,
      strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at,
      strftime(date_trunc('second', first_feed_date), '%Y-%m-%d %H:%M:%S') AS first_feed_date,
      strftime(date_trunc('second', last_feed_date), '%Y-%m-%d %H:%M:%S') AS last_feed_date, date_in_window,
      array_to_string(years, '|') AS year_hints, array_to_string(types, '|') AS type_hints, n_dois, doi,
      sha256(record_url || chr(31) || title || chr(31) || array_to_string(cats, chr(31))) AS row_hash
    FROM ({MERGED})""", ints="n_dois")
def _(t):
    return merge.merge_feeds(t.v_feed_entries, WINDOW)


@check("f01_feed_values", """
    SELECT DISTINCT record_url, 'date' AS kind, strftime(published_at, '%Y-%m-%d %H:%M:%S.%f') AS value
    FROM v_feed_entries WHERE published_at IS NOT NULL
    UNION SELECT record_url, 'year', CAST(year_hint AS VARCHAR) FROM v_feed_entries WHERE year_hint IS NOT NULL
    UNION SELECT record_url, 'doi', doi_hint FROM v_feed_entries WHERE doi_hint IS NOT NULL
    UNION SELECT record_url, 'type', type_hint FROM v_feed_entries WHERE type_hint IS NOT NULL""")
def _(t):
    return merge.feed_values(t.v_feed_entries)


@check("f01_title_conflicts", """
    SELECT *, count(*) OVER (PARTITION BY record_url) AS n_titles FROM (
      SELECT DISTINCT record_url, lower(title) || CASE WHEN event_id % 1000 = 0 THEN ' x' ELSE '' END AS title_norm
      FROM v_feed_entries)
    QUALIFY n_titles > 1""")
def _(t):
    marked = t.v_feed_entries.withColumn(
        "title", F.when(F.col("event_id") % 1000 == 0, F.concat("title", F.lit(": X"))).otherwise(F.upper("title"))
    )
    return merge.title_conflicts(marked)


@check("f02_latest_active", f"""
    SELECT record_key, identifier, event_id, strftime(date_trunc('second', changed_at), '%Y-%m-%d %H:%M:%S') AS changed_at,
      deleted, dc_type, dc_date FROM ({LATEST})""")
def _(t):
    return merge.latest_active(t.v_change_events)


@check("f02_change_audit", """
    SELECT sum(n) AS events, coalesce(sum(n) FILTER (WHERE record_key IS NULL), 0) AS unkeyed,
      coalesce(sum(n - 1) FILTER (WHERE record_key IS NOT NULL), 0) AS duplicates,
      count(*) FILTER (WHERE record_key IS NOT NULL AND gone) AS deleted_keys,
      count(*) FILTER (WHERE record_key IS NOT NULL AND NOT gone) AS active_keys
    FROM (SELECT record_key, count(*) AS n, arg_max(deleted, (changed_at, event_id)) AS gone FROM v_change_events GROUP BY record_key)""",
    ints="events unkeyed duplicates")
def _(t):
    return merge.change_audit(t.v_change_events)


@check("f03_group_issues", """
    SELECT sha256(replace(lower(venue), ' ', '') || '|' || year || '|' || issue) AS issue_key, venue, year, issue,
      CASE WHEN count(DISTINCT label_month) = 1 THEN min(label_month) END AS label_month,
      count(DISTINCT label_month) > 1 AS label_conflict, count(DISTINCT url) AS n_records,
      array_to_string(list_sort(list(DISTINCT query)), '|') AS queries
    FROM v_issue_records GROUP BY venue, year, issue""", ints="year label_month")
def _(t):
    return merge.group_issues(t.v_issue_records)


@check("c01_in_window", f"""
    SELECT event_id, record_key FROM v_change_events
    WHERE changed_at >= TIMESTAMP '{START}' AND changed_at < TIMESTAMP '{END}'""")
def _(t):
    return gates.in_window(t.v_change_events, START, END).select("event_id", "record_key")


@check("c01_window_counts", f"""
    SELECT count(*) FILTER (WHERE inside) AS kept, count(*) FILTER (WHERE NOT inside) AS excluded,
      count(*) FILTER (WHERE inside AND record_key IS NULL) AS unkeyed, TRUE AS window_over
    FROM (SELECT *, changed_at >= TIMESTAMP '{START}' AND changed_at < TIMESTAMP '{END}' AS inside FROM v_change_events)""")
def _(t):
    return gates.window_counts(t.v_change_events, START, END, "2024-02-01 00:00:00")


FRESH = """
    SELECT record_id, CASE WHEN event = 'indexed' OR event IS NULL THEN 'source_record_updated' WHEN inferred THEN 'uncertain'
        WHEN source = 'feed-observed-at' THEN 'source_record_updated'
        WHEN precision = 'year' AND date_trunc('year', l_shipdate) + INTERVAL 1 YEAR <= TIMESTAMP '1998-03-02' THEN 'newly_indexed_old_work'
        WHEN precision = 'month' AND date_trunc('month', l_shipdate) + INTERVAL 1 MONTH <= TIMESTAMP '1998-03-02' THEN 'newly_indexed_old_work'
        WHEN precision <> 'day' THEN 'uncertain'
        WHEN l_shipdate >= TIMESTAMP '1998-03-02' AND l_shipdate < TIMESTAMP '1998-06-01' THEN 'confirmed_new'
        WHEN l_shipdate < TIMESTAMP '1998-03-02' THEN 'newly_indexed_old_work' ELSE 'uncertain' END AS freshness
    FROM v_date_values"""


@check("c02_assess_freshness", FRESH)
def _(t):
    return gates.assess_freshness(t.v_date_values, "1998-03-02 00:00:00", "1998-06-01 00:00:00").select(
        "record_id", "freshness"
    )


@check("c03_window_candidates", f"""
    SELECT record_url, mode FROM ({SPARSE_ENRICHED}), (VALUES ('loaded'), ('failed')) AS m(mode)
    WHERE NOT (len(all_years) > 0 AND NOT list_contains(all_years, 2024))
      AND (last_feed_date IS NULL OR date_in_window)
      AND (mode = 'failed' OR NOT (last_feed_date IS NULL AND len(years) = 0 AND changed_at IS NULL))""")
def _(t):
    base = sparse_enriched(t)
    both = [
        gates.window_candidates(base, START, END, ok).select("record_url", F.lit(mode).alias("mode"))
        for ok, mode in ((True, "loaded"), (False, "failed"))
    ]
    return both[0].unionByName(both[1])


@check("c04_arrival_eligible", f"""
    SELECT record_url, NOT (len(all_years) > 0 AND NOT list_contains(all_years, 2024)) AND (
        len(types) > 0 OR change_type IS NOT NULL OR list_contains(all_years, 2024) OR date_in_window
        OR coalesce(changed_at >= TIMESTAMP '{START}' AND changed_at < TIMESTAMP '{END}', FALSE)) AS eligible
    FROM ({SPARSE_ENRICHED})""")
def _(t):
    base = sparse_enriched(t)
    return base.select("record_url", gates.arrival_eligible(base, START, END).alias("eligible"))


@check("c05_undated_stock", f"""
    SELECT record_url, changed_at IS NOT NULL AND last_feed_date IS NULL AND len(all_years) = 0 AND n_dois = 0
      AND len(types) = 0 AND NOT coalesce(change_type IN ('preprint', 'workingpaper'), FALSE) AS undated
    FROM (SELECT * REPLACE (CASE WHEN changed_at IS NULL THEN years ELSE years END AS all_years) FROM ({SPARSE_ENRICHED}))""")
def _(t):
    base = sparse_enriched(t).withColumn("change_year_hints", F.array().cast("array<int>"))
    return base.select("record_url", gates.undated_stock(base).alias("undated"))


def year_reviews(t: Tables):
    return t.v_unresolved.filter("attempts % 2 = 0").select(
        F.concat("record_url", F.lit("-"), F.col("attempts").cast("string")).alias("record_url"),
        F.when(F.col("attempts") != 4, 2024).alias("publication_year"),
    )


@check("c06_year_hint_gate", f"""
    SELECT m.record_url, CASE WHEN len(years) > 0 OR r.publication_year IS NOT NULL THEN 'pass' ELSE 'year_review_pending' END AS gate
    FROM ({_sparse_sql()}) m LEFT JOIN (SELECT record_url || '-' || attempts AS record_url,
        CASE WHEN attempts <> 4 THEN 2024 END AS publication_year FROM v_unresolved WHERE attempts % 2 = 0) r
    ON m.record_url = r.record_url""")
def _(t):
    return gates.year_hint_gate(merge.merge_feeds(sparse(t), WINDOW), year_reviews(t)).select("record_url", "gate")


def filter_items(t: Tables):
    d = F.col("record_id")
    return t.v_records.select(
        d, F.when(d % 9 != 0, F.col("year")).alias("year"),
        pick(d % 7, "article", "preprint", "book", "unknown", "conflict", "journal_article", "review-article").alias("work_type"),
        (d % 10 == 0).alias("is_excluded"), (d % 8 != 0).alias("in_scope"),
    )


FILTERED = """
    SELECT record_id, CASE WHEN record_id % 10 = 0 THEN 'excluded_category' WHEN record_id % 8 = 0 THEN 'filtered_out'
        WHEN record_id % 7 IN (3, 4) THEN 'type_unverified' WHEN record_id % 7 = 2 THEN 'unsupported_type'
        WHEN record_id % 7 IN (5, 6) THEN 'filtered_out'
        WHEN record_id % 9 = 0 THEN 'year_unknown' WHEN year < 2005 OR year > 2020 THEN 'filtered_out' END AS drop_reason
    FROM v_records"""


@check("c07_search_filters", FILTERED)
def _(t):
    return gates.search_filters(filter_items(t), ["article", "preprint"], 2005, 2020).select("record_id", "drop_reason")


@check("c07_drop_counts", f"SELECT drop_reason, count(*) AS n FROM ({FILTERED}) GROUP BY drop_reason")
def _(t):
    marked = gates.search_filters(filter_items(t), ["article", "preprint"], 2005, 2020)
    return marked.groupBy("drop_reason").agg(F.count("*").alias("n"))


@check("c08_supported_type", """
    SELECT record_id, raw_type IN ('article', 'journal-article') AS supported FROM v_records""")
def _(t):
    return t.v_records.select("record_id", gates.supported_type(F.col("raw_type")).alias("supported"))


@check("c09_budget_guard", "SELECT record_url FROM v_unresolved")
def _(t):
    return gates.budget_guard(t.v_unresolved.select("record_url"), 1_000_000)


@check("d01_enrich_with_changes", f"""
    SELECT record_url, strftime(date_trunc('second', changed_at), '%Y-%m-%d %H:%M:%S') AS changed_at, change_record_id,
      change_type, coalesce(dc_date, '') AS change_years FROM ({ENRICHED})""")
def _(t):
    out = merge.enrich_with_changes(merge.merge_feeds(t.v_feed_entries, WINDOW), merge.latest_active(t.v_change_events))
    return out.select(
        "record_url", "changed_at", "change_record_id", "change_type",
        F.coalesce(F.array_join("change_year_hints", "|"), F.lit("")).alias("change_years"),
    )


def works_of(t: Tables):
    """Works over the merged sparse records, with varied freshness."""
    m = merge.merge_feeds(sparse(t), WINDOW)
    n = F.conv(F.substring(F.sha2("record_url", 256), 1, 4), 16, 10).cast("int")
    return m.select(
        F.col("record_url").alias("work_id"), "title", "observed_at", "category_ids", "record_url",
        F.when(n % 5 == 0, "book").otherwise("article").alias("work_type"),
        pick(n % 4, "confirmed_new", "confirmed_source_arrival", "uncertain", "confirmed_source_arrival").alias("freshness"),
        F.when(n % 3 == 0, "recently_changed").otherwise("recently_arrived").alias("freshness_event"),
        F.when(n % 7 != 0, F.col("first_feed_date")).alias("publication_at"),
        F.when(n % 6 != 0, F.col("last_feed_date")).alias("availability_at"),
    )


WORKS = f"""
    SELECT record_url AS work_id, title, observed_at, cats, record_url,
      CASE WHEN n % 5 = 0 THEN 'book' ELSE 'article' END AS work_type,
      CASE n % 4 WHEN 0 THEN 'confirmed_new' WHEN 2 THEN 'uncertain' ELSE 'confirmed_source_arrival' END AS freshness,
      CASE WHEN n % 3 = 0 THEN 'recently_changed' ELSE 'recently_arrived' END AS freshness_event,
      CASE WHEN n % 7 <> 0 THEN first_feed_date END AS publication_at,
      CASE WHEN n % 6 <> 0 THEN last_feed_date END AS availability_at
    FROM (SELECT *, CAST('0x' || substring(sha256(record_url), 1, 4) AS INTEGER) AS n FROM ({_sparse_sql()}))"""


def profile_rows(t: Tables):
    rows = [("interest", "click"), ("interest", "view"), ("excluded", "error")]
    return t.spark.createDataFrame(rows, "role string, category_id string")


@check("d02_match_works", f"""
    SELECT work_id, array_to_string(list_filter(cats, lambda c: c IN ('click', 'view')), '|') AS matched,
      array_to_string(list_filter(cats, lambda c: c = 'error'), '|') AS excluded,
      CASE WHEN work_type = 'book' THEN 'unsupported_work_type' WHEN freshness = 'uncertain' THEN 'not_confirmed_new'
        WHEN list_contains(cats, 'error') THEN 'excluded_category_match'
        WHEN NOT (list_contains(cats, 'click') OR list_contains(cats, 'view')) THEN 'no_category_overlap'
        WHEN work_id LIKE '%-7' THEN 'already_notified' ELSE 'notify' END AS decision
    FROM ({WORKS})""")
def _(t):
    works = works_of(t)
    log = works.filter("work_id LIKE '%-7'").select("work_id")
    return taxonomy.match_works(works, profile_rows(t), log).select("work_id", "matched", "excluded", "decision")


def selections(t: Tables):
    rows = [("Brand#2", True), ("Brand#17", True), ("SMALL", True), ("ECONOMY", False)]
    return t.spark.createDataFrame(rows, "category_id string, include_descendants boolean")


DESCENDANTS = """
    SELECT r AS root_id, c AS category_id FROM (
      SELECT unnest(['Brand#2', 'Brand#17', 'SMALL', 'ECONOMY']) AS r) roots, LATERAL (SELECT r AS c
      UNION SELECT category_id FROM v_taxonomy WHERE active AND list_contains(parent_ids, r) AND r <> 'ECONOMY')"""
RECURSIVE = """
    WITH RECURSIVE walk AS (
      SELECT category_id AS root_id, category_id FROM v_taxonomy WHERE category_id IN ('Brand#2', 'Brand#17', 'SMALL', 'ECONOMY')
      UNION
      SELECT w.root_id, n.category_id FROM walk w JOIN v_taxonomy n ON list_contains(n.parent_ids, w.category_id)
      WHERE n.active AND w.root_id <> 'ECONOMY')"""


@check("e06_expand_categories", RECURSIVE + " SELECT DISTINCT category_id FROM walk")
def _(t):
    return taxonomy.expand_categories(t.v_taxonomy, selections(t))


@check("d03_category_groups", RECURSIVE + """
    SELECT item_id, count(DISTINCT root_id) AS n_hit, count(DISTINCT root_id) >= 4 AS in_scope
    FROM (SELECT p_partkey AS item_id, 'P' || p_partkey AS category_id FROM part
          UNION ALL SELECT p_partkey, p_type FROM part) m
    LEFT JOIN walk USING (category_id) GROUP BY item_id""")
def _(t):
    groups = taxonomy.category_groups(t.v_taxonomy, t.v_taxonomy.filter("active"), selections(t))
    members = t.part.select(
        F.col("p_partkey").alias("item_id"),
        F.explode(F.array(cat("P", F.col("p_partkey").cast("string")), F.col("p_type"))).alias("category_id"),
    )
    return taxonomy.match_groups(members, groups, 4, "all")


RULES = [
    {"pattern": "(?i) und | der ", "name": "Brand#1", "source": "verified_alias"},
    {"pattern": "(?i) the .{0,20} of ", "name": "Brand#2", "source": "verified_alias", "include_descendants": True},
    {"pattern": "(?i) les ", "name": "SMALL", "source": "contextual_mapping", "needs_context": True},
    {"pattern": "(?i) del ", "name": "small ring", "source": "explicit_work"},
    {"pattern": "(?i) los ", "name": "Nowhere", "source": "explicit_work"},
]


@check("d04_alias_match", """
    WITH hits AS (
      SELECT doc_id AS text_id, 0 AS rule, 'brand#1' AS name, 'verified_alias' AS source, FALSE AS include_descendants
      FROM documents WHERE regexp_matches(text, '(?i) und | der ')
      UNION ALL SELECT doc_id, 1, 'brand#2', 'verified_alias', TRUE FROM documents WHERE regexp_matches(text, '(?i) the .{0,20} of ')
      UNION ALL SELECT doc_id, 2, 'small', 'contextual_mapping', FALSE FROM documents WHERE regexp_matches(text, '(?i) les ') AND regexp_matches(text, '(?i) avec ')
      UNION ALL SELECT doc_id, 3, 'small ring', 'explicit_work', FALSE FROM documents WHERE regexp_matches(text, '(?i) del ')
      UNION ALL SELECT doc_id, 4, 'nowhere', 'explicit_work', FALSE FROM documents WHERE regexp_matches(text, '(?i) los ')),
    names AS (SELECT lower(trim(name)) AS name, count(*) AS n, min(category_id) AS id FROM v_taxonomy WHERE active GROUP BY 1)
    SELECT text_id, rule, h.name, source, include_descendants, CASE WHEN n = 1 THEN id END AS category_id,
      CASE WHEN n = 1 THEN 'selected' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS outcome
    FROM hits h LEFT JOIN names USING (name)""", ints="rule")
def _(t):
    texts = t.documents.select(F.col("doc_id").alias("text_id"), "text")
    return taxonomy.alias_match(texts, t.v_taxonomy, RULES, "(?i) avec ")


@check("d20_new_records", f"""
    SELECT record_url FROM ({_sparse_sql()}) WHERE record_url NOT IN (
      SELECT record_url || '-' || (event_id % 61) FROM v_feed_entries WHERE checked_at < TIMESTAMP '{END}')""")
def _(t):
    known = sparse(t).filter(F.col("checked_at") < gates.instant(END))
    return merge.new_records(merge.merge_feeds(sparse(t)), known).select("record_url")


@check("d21_already_reported", """
    SELECT venue, year, issue, count(*) FILTER (WHERE status = 'reviewed') > 0 AS reported
    FROM v_issue_evidence GROUP BY venue, year, issue""", ints="year")
def _(t):
    leads = t.v_issue_evidence.select("venue", "year", "issue").distinct()
    log = t.v_issue_evidence.filter("status = 'reviewed'")
    return merge.already_reported(leads, log, ["venue", "year", "issue"])


@check("e07_taxonomy_violations", """
    WITH nodes AS (
      SELECT CASE WHEN p_partkey % 301 = 0 THEN 'P1' ELSE category_id END AS category_id,
             CASE WHEN p_partkey % 97 = 0 THEN ' ' ELSE name END AS name,
             CASE WHEN p_partkey % 101 = 0 THEN ['missing', p_type] ELSE parent_ids END AS parent_ids, primary_parent_id
      FROM v_taxonomy LEFT JOIN part ON category_id = 'P' || p_partkey),
    links AS (SELECT category_id AS child, unnest(parent_ids) AS parent FROM nodes)
    SELECT 'duplicate_id' AS violation, category_id, CAST(count(*) AS VARCHAR) AS detail FROM nodes GROUP BY category_id HAVING count(*) > 1
    UNION ALL SELECT 'empty_name', category_id, NULL FROM nodes WHERE trim(name) = ''
    UNION ALL SELECT 'missing_parent', child, parent FROM links WHERE parent NOT IN (SELECT category_id FROM nodes)
    UNION ALL SELECT 'primary_parent_not_parent', category_id, primary_parent_id FROM nodes
      WHERE primary_parent_id IS NOT NULL AND NOT list_contains(parent_ids, primary_parent_id)
    UNION ALL SELECT 'declared_count', NULL, CAST(count(*) AS VARCHAR) FROM nodes HAVING count(*) <> 7""")
def _(t):
    keys = t.part.select("p_partkey", F.col("p_type").alias("kind"), cat("P", F.col("p_partkey").cast("string")).alias("category_id"))
    joined = t.v_taxonomy.join(keys, "category_id", "left")
    k = F.col("p_partkey")
    nodes = joined.select(
        F.when(k % 301 == 0, "P1").otherwise(F.col("category_id")).alias("category_id"),
        F.when(k % 97 == 0, " ").otherwise(F.col("name")).alias("name"),
        F.when(k % 101 == 0, F.array(F.lit("missing"), F.col("kind"))).otherwise(F.col("parent_ids")).alias("parent_ids"),
        "primary_parent_id", "active",
    )
    return taxonomy.taxonomy_violations(nodes, declared=7)


@check("e08_find_by_name", """
    SELECT name, coalesce(n, 0) AS n_found, CASE WHEN n = 1 THEN id END AS category_id
    FROM (SELECT DISTINCT upper(name) AS name FROM v_taxonomy) w LEFT JOIN (
      SELECT lower(trim(name)) AS key, count(*) AS n, min(category_id) AS id FROM v_taxonomy WHERE active GROUP BY 1) f
    ON lower(trim(w.name)) = f.key""")
def _(t):
    return taxonomy.find_by_name(t.v_taxonomy, t.v_taxonomy.select(F.upper("name").alias("name")))


DIFF = """
    SELECT category_id, change, CASE WHEN change = 'modified' THEN kinds ELSE '' END AS kinds,
      CASE WHEN change = 'modified' THEN array_to_string(list_sort(list_filter(np, lambda x: NOT list_contains(op, x))), '|') ELSE '' END AS added_parents,
      CASE WHEN change = 'modified' THEN array_to_string(list_sort(list_filter(op, lambda x: NOT list_contains(np, x))), '|') ELSE '' END AS removed_parents,
      n_same_name, same_name_id
    FROM (SELECT coalesce(o.category_id, n.category_id) AS category_id, o.parent_ids AS op, n.parent_ids AS np,
        concat_ws('|', CASE WHEN o.name <> n.name THEN 'renamed' END, CASE WHEN list_sort(o.parent_ids) <> list_sort(n.parent_ids) THEN 'parents_changed' END,
          CASE WHEN o.primary_parent_id IS DISTINCT FROM n.primary_parent_id THEN 'primary_parent_changed' END,
          CASE WHEN o.active <> n.active THEN 'active_status_changed' END) AS kinds,
        CASE WHEN o.category_id IS NULL THEN 'added' WHEN n.category_id IS NULL THEN 'removed'
          WHEN o.name <> n.name OR list_sort(o.parent_ids) <> list_sort(n.parent_ids) OR o.primary_parent_id IS DISTINCT FROM n.primary_parent_id OR o.active <> n.active THEN 'modified' END AS change,
        CASE WHEN n.category_id IS NULL THEN lower(o.name) END AS key
      FROM v_taxonomy_old o FULL JOIN v_taxonomy_new n ON o.category_id = n.category_id) d
    LEFT JOIN (SELECT lower(name) AS key, count(*) AS n_same_name, min(category_id) AS same_name_id FROM v_taxonomy_new WHERE active GROUP BY 1) USING (key)
    WHERE change IS NOT NULL"""


@check("e09_taxonomy_diff", DIFF)
def _(t):
    return taxonomy.taxonomy_diff(t.v_taxonomy_old, t.v_taxonomy_new)


@check("e10_taxonomy_impact", f"""
    WITH diff AS ({DIFF}),
    before AS (SELECT 'Brand#2' AS category_id UNION SELECT category_id FROM v_taxonomy_old WHERE active AND list_contains(parent_ids, 'Brand#2')),
    after AS (SELECT 'Brand#2' AS category_id UNION SELECT category_id FROM v_taxonomy_new WHERE active AND list_contains(parent_ids, 'Brand#2')),
    roles AS (SELECT 'Brand#2' AS category_id, 'confirmed' AS role UNION ALL SELECT 'P19', 'proposed' UNION ALL SELECT 'P26', 'excluded'
      UNION ALL SELECT category_id, 'expanded' FROM before UNION ALL SELECT category_id, 'expanded_new' FROM after),
    grouped AS (SELECT category_id, list_sort(list(DISTINCT role)) AS roles FROM roles GROUP BY category_id),
    judged AS (
      SELECT g.category_id, array_to_string(roles, '|') AS roles,
        concat_ws('|', CASE WHEN o.category_id IS NULL THEN 'newly_expanded_category' END,
          CASE WHEN o.category_id IS NOT NULL AND n.category_id IS NULL THEN 'removed' END,
          CASE WHEN d.change = 'modified' THEN d.kinds END,
          CASE WHEN o.category_id IS NOT NULL AND NOT n.active THEN 'inactive' END,
          CASE WHEN g.category_id IN (FROM after) AND g.category_id NOT IN (FROM before) THEN 'entered_expanded_interest_set' END,
          CASE WHEN g.category_id IN (FROM before) AND g.category_id NOT IN (FROM after) THEN 'left_expanded_interest_set' END) AS impacts,
        CASE WHEN g.category_id IN (FROM after) AND g.category_id NOT IN (FROM before) THEN 'missing'
             WHEN g.category_id NOT IN (FROM after) AND g.category_id IN (FROM before) THEN 'extra' END AS feed_state
      FROM grouped g LEFT JOIN v_taxonomy_old o ON g.category_id = o.category_id LEFT JOIN v_taxonomy_new n ON g.category_id = n.category_id
      LEFT JOIN diff d ON g.category_id = d.category_id),
    acted AS (SELECT *, CASE WHEN impacts LIKE '%removed%' OR impacts LIKE '%inactive%' THEN 'block_and_review_category_identity'
        WHEN impacts LIKE '%expanded%' THEN 'review_scope_and_feed_baseline'
        WHEN impacts <> '' THEN 'review_and_create_new_profile_version' END AS action
      FROM judged WHERE impacts <> '' OR feed_state IS NOT NULL)
    SELECT *, CASE WHEN (SELECT count(*) FROM acted WHERE action = 'block_and_review_category_identity') > 0 THEN 'blocked'
      WHEN (SELECT count(*) FROM acted) > 0 THEN 'review_required' ELSE 'ready' END AS overall FROM acted""")
def _(t):
    tracked = t.spark.createDataFrame(
        [("Brand#2", "confirmed", True), ("P19", "proposed", False), ("P26", "excluded", False)],
        "category_id string, role string, include_descendants boolean",
    )
    feeds = t.v_taxonomy_old.filter("active AND (category_id = 'Brand#2' OR array_contains(parent_ids, 'Brand#2'))")
    return taxonomy.taxonomy_impact(t.v_taxonomy_old, t.v_taxonomy_new, tracked, feeds)


@check("e11_scope_estimate", RECURSIVE + """,
    wanted AS (SELECT DISTINCT category_id FROM walk),
    held AS (SELECT category_id FROM v_taxonomy WHERE active AND list_contains(parent_ids, 'Brand#3'))
    SELECT *, CASE WHEN added > 50 THEN 'very_broad' WHEN added > 10 THEN 'broad' ELSE 'bounded' END AS breadth, added > 10 AS warning_required
    FROM (SELECT (SELECT count(*) FROM wanted) AS requested, (SELECT count(*) FROM held) AS current,
      (SELECT count(*) FROM (FROM wanted UNION FROM held)) AS projected,
      (SELECT count(*) FROM (FROM wanted EXCEPT FROM held)) AS added,
      (SELECT count(*) FROM (FROM wanted INTERSECT FROM held)) AS already_covered)""")
def _(t):
    held = t.v_taxonomy.filter("active AND array_contains(parent_ids, 'Brand#3')")
    return taxonomy.scope_estimate(t.v_taxonomy, selections(t), held)


@check("h01_scope_delta", """
    SELECT category_id, CASE WHEN n IS NULL THEN 'left_only' WHEN o IS NULL THEN 'right_only' ELSE 'both' END AS side
    FROM (SELECT category_id, 1 AS o FROM v_taxonomy_old) FULL JOIN (SELECT category_id, 1 AS n FROM v_taxonomy_new) USING (category_id)""")
def _(t):
    return taxonomy.scope_delta(t.v_taxonomy_old, t.v_taxonomy_new)
