"""DuckDB forms of the same views."""

VIEWS = {
    "v_k": """
        SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "v_feed_entries": """
        SELECT event_id, event_type AS category_id,
               CAST(date_trunc('day', ts) AS TIMESTAMP) AS checked_at,
               'https://feed.example.org/rec/U' || user_id AS link,
               'https://feed.example.org/rec/U' || user_id AS record_url,
               'Record ' || user_id AS title,
               CASE WHEN k % 4 <> 0 THEN ts END AS published_at,
               CASE WHEN k % 3 = 0 THEN 2015 + k % 10 END AS year_hint,
               CASE WHEN k % 5 = 0 THEN '10.1000/u' || user_id END AS doi_hint,
               CASE k % 6 WHEN 0 THEN 'preprint' WHEN 1 THEN 'working-paper'
                    WHEN 2 THEN 'forthcoming-article' END AS type_hint
        FROM v_k""",
    "v_change_events": """
        SELECT event_id, CASE WHEN k <> 99 THEN 'oai:x:/rec/U' || user_id END AS identifier,
               CASE WHEN k <> 99 THEN 'u' || user_id END AS record_key,
               ts AS changed_at, event_type = 'error' AS deleted,
               CASE k % 4 WHEN 0 THEN 'preprint' WHEN 1 THEN 'article'
                    WHEN 2 THEN 'workingpaper' END AS dc_type,
               CAST(2015 + k % 10 AS VARCHAR) AS dc_date
        FROM v_k""",
    "v_taxonomy": """
        SELECT 'R' AS category_id, 'All' AS name, CAST([] AS VARCHAR[]) AS parent_ids,
               CAST(NULL AS VARCHAR) AS primary_parent_id, TRUE AS active
        UNION ALL
        SELECT id, id, ['R'], 'R', TRUE
        FROM (SELECT p_brand AS id FROM part UNION SELECT p_type FROM part)
        UNION ALL
        SELECT 'P' || p_partkey, p_name, list_sort([p_brand, p_type]), p_brand, p_partkey % 13 <> 0
        FROM part""",
    "v_taxonomy_old": """
        SELECT 'R' AS category_id, 'All' AS name, CAST([] AS VARCHAR[]) AS parent_ids,
               CAST(NULL AS VARCHAR) AS primary_parent_id, TRUE AS active
        UNION ALL
        SELECT id, id, ['R'], 'R', TRUE
        FROM (SELECT p_brand AS id FROM part WHERE p_partkey % 17 <> 0
              UNION SELECT p_type FROM part WHERE p_partkey % 17 <> 0)
        UNION ALL
        SELECT 'P' || p_partkey, p_name, list_sort([p_brand, p_type]), p_brand, p_partkey % 13 <> 0
        FROM part WHERE p_partkey % 17 <> 0""",
    "v_taxonomy_new": """
        SELECT 'R' AS category_id, 'All' AS name, CAST([] AS VARCHAR[]) AS parent_ids,
               CAST(NULL AS VARCHAR) AS primary_parent_id, TRUE AS active
        UNION ALL
        SELECT id, id, ['R'], 'R', TRUE
        FROM (SELECT p_brand AS id FROM part WHERE p_partkey % 19 <> 0
              UNION SELECT p_type FROM part WHERE p_partkey % 19 <> 0)
        UNION ALL
        SELECT 'P' || p_partkey,
               CASE WHEN p_partkey % 23 = 0 THEN p_name || ' II' ELSE p_name END,
               CASE WHEN p_partkey % 29 = 0 THEN [p_type] ELSE list_sort([p_brand, p_type]) END,
               CASE WHEN p_partkey % 29 = 0 THEN p_type ELSE p_brand END,
               p_partkey % 13 <> 0
        FROM part WHERE p_partkey % 19 <> 0""",
    "v_profiles": """
        SELECT o_custkey AS profile_id, o_orderdate AS effective_from,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS version
        FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)""",
    "v_records": """
        SELECT doc_id AS record_id, text AS title, 'Author ' || source AS author,
               CASE WHEN doc_id % 3 = 0 THEN '10.1/' || (doc_id % 400) END AS doi_raw,
               CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || (doc_id % 400) END AS doi,
               2000 + doc_id % 25 AS year,
               CASE WHEN doc_id % 2 = 0 THEN 'openalex' ELSE 'crossref' END AS provider,
               CASE doc_id % 7 WHEN 0 THEN 'article' WHEN 1 THEN 'journal-article' WHEN 2 THEN 'book'
                    WHEN 3 THEN 'report' WHEN 4 THEN 'other' WHEN 5 THEN 'dataset'
                    ELSE 'Unsafe Type!' END AS raw_type
        FROM documents""",
    "v_folded": """
        SELECT *, trim(regexp_replace(replace(replace(strip_accents(lower(title)), 'ß', 'ss'), '&', ' and '),
                       '[^\\p{L}\\p{N}]+', ' ', 'g')) AS title_fold
        FROM v_records""",
    "v_type_evidence": """
        SELECT doc_id AS record_id, 'openalex' AS provider,
               CASE doc_id % 7 WHEN 0 THEN 'article' WHEN 1 THEN 'book' WHEN 2 THEN 'report'
                    WHEN 3 THEN 'preprint' WHEN 4 THEN 'other' WHEN 5 THEN 'review'
                    ELSE 'Odd Type' END AS raw_type, 'structured' AS method
        FROM documents
        UNION ALL
        SELECT doc_id, 'crossref',
               CASE doc_id % 5 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'monograph'
                    WHEN 2 THEN 'posted-content' WHEN 4 THEN 'other' END, 'structured'
        FROM documents WHERE doc_id % 5 <> 3
        UNION ALL
        SELECT doc_id, 'openalex', 'book-review', 'document-inspection'
        FROM labels WHERE quality = 1""",
    "v_date_values": """
        SELECT key AS record_id,
               CASE key % 4 WHEN 0 THEN strftime(l_shipdate, '%Y')
                    WHEN 1 THEN strftime(l_shipdate, '%Y-%m')
                    ELSE strftime(l_shipdate, '%Y-%m-%d') END AS value,
               CASE key % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS precision,
               key % 10 = 0 AS inferred,
               CASE l_returnflag WHEN 'A' THEN 'crossref' WHEN 'N' THEN 'openalex'
                    ELSE 'feed-observed-at' END AS source,
               CASE WHEN key % 14 = 0 THEN NULL WHEN key % 9 = 0 THEN 'indexed'
                    WHEN key % 2 = 0 THEN 'recently_published'
                    ELSE 'recently_published_online' END AS event,
               l_shipdate
        FROM (SELECT *, l_orderkey * 10 + l_linenumber AS key FROM lineitem)""",
    "v_coverage": """
        SELECT l_suppkey AS source_key, l_shipdate AS window_start,
               l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS window_end,
               l_shipdate + INTERVAL 30 DAY AS checked_at
        FROM lineitem""",
    "v_runs": """
        SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS window_start,
               CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) + INTERVAL 7 DAY AS window_end
        FROM orders""",
    "v_issue_records": """
        SELECT 'T' || l_partkey AS title, 'Supplier ' || l_suppkey AS authors,
               'Venue ' || l_suppkey AS venue, year(l_shipdate) AS year,
               CAST(month(l_shipdate) AS VARCHAR) AS issue,
               CASE WHEN l_quantity < 30 THEN
                    least(month(l_shipdate) + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END, 12) END AS label_month,
               'https://list.example.org/' || l_orderkey || '/' || l_linenumber AS url,
               'q' || (l_partkey % 5) AS query
        FROM lineitem""",
    "v_issue_evidence": """
        SELECT venue, year, issue, status,
               CASE WHEN key % 3 <> 0 THEN month(first_day) END AS label_month,
               CASE WHEN key % 2 = 0 THEN CAST(first_day AS DATE) END AS day,
               last_day + INTERVAL 40 DAY AS reviewed_at,
               'https://evidence.example.org/' || key AS evidence_url
        FROM (SELECT 'Venue ' || l_suppkey AS venue, year(l_shipdate) AS year,
                     CAST(month(l_shipdate) AS VARCHAR) AS issue,
                     CASE WHEN l_linestatus = 'F' THEN 'reviewed' ELSE 'pending' END AS status,
                     min(l_shipdate) AS first_day, max(l_shipdate) AS last_day, min(l_orderkey) AS key
              FROM lineitem GROUP BY ALL)""",
    "v_catalogue": """
        SELECT doc_id AS article_id, source || '-' || lang AS issue, text AS title,
               lang || ' ' || source AS abstract, source AS keywords, source AS author,
               doc_id % 5 AS last_observed
        FROM documents""",
    "v_article_checks": """
        SELECT user_id AS article_id,
               CASE WHEN event_type IN ('click', 'view') THEN 'a' ELSE 'b' END AS source,
               ts AS checked_at,
               CASE k % 4 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' WHEN 2 THEN 'review' ELSE 'failed' END AS status,
               (k // 4) % 2 = 1 AS complete
        FROM v_k""",
    "v_queue": """
        SELECT event_type AS grp, 'https://post.example.org/s/' || event_id AS url,
               'https://post.example.org/u/' || user_id AS source_url,
               CASE k % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'blocked' WHEN 2 THEN 'dismissed'
                    ELSE 'reviewed' END AS status,
               ts AS first_seen,
               CASE WHEN k % 3 = 0 AND k % 4 = 1 THEN ts - to_days(k) END AS blocked_since
        FROM v_k""",
    "v_requests": """
        SELECT event_type AS source, CASE WHEN k % 9 = 0 THEN 'failure' ELSE 'success' END AS outcome,
               1 + k % 3 AS attempts, CAST(round(value * 100) AS BIGINT) AS wait_centis, event_id AS seq,
               CASE WHEN k % 2 = 0 THEN k END AS rate_limit, k = 27 AS deferred, ts
        FROM v_k""",
    "v_lookup_cache": """
        SELECT CASE WHEN event_id % 2 = 0 THEN 'crossref' ELSE 'openalex' END AS source,
               'q' || user_id AS query,
               CASE WHEN k % 2 = 0 THEN 'found' ELSE 'not_found' END AS status, ts AS cached_at,
               CASE WHEN k % 2 = 0 THEN ts + INTERVAL 24 HOUR ELSE ts + INTERVAL 15 MINUTE END AS expires_at,
               event_id AS seq
        FROM v_k""",
    "v_unresolved": """
        SELECT 'https://feed.example.org/rec/U' || user_id AS record_url, 'Record ' || user_id AS title,
               CASE user_id % 5 WHEN 0 THEN 'old_work_check_incomplete' WHEN 1 THEN 'identifier_conflict'
                    WHEN 2 THEN 'structured_work_type_conflict'
                    WHEN 3 THEN 'semantic_identity_review_required'
                    ELSE 'unknown_structured_work_type' END AS reason_code,
               CAST(count(*) % 6 AS INTEGER) AS attempts, max(ts) AS last_attempt,
               max(ts) + INTERVAL 7 DAY AS next_retry_at
        FROM v_k GROUP BY user_id""",
}
