"""The registered queries of the operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import chat, cover, lm, near_dups, packing, pieces, quality, spellings, substrings, turns, url_lists, vectors, warc
from shelfmark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(job):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return job(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__ = job.__name__
        QUERIES[job.__name__] = run
        if sql:
            ORACLES[job.__name__] = sql
        return job

    return register


@query()
def op1_pack_documents(table) -> DataFrame:
    return packing.pack_documents(table("documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op4_sentence_pieces(table) -> DataFrame:
    return pieces.encoding_digests(table("documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op7_quality_forest(table) -> DataFrame:
    return quality.quality_verdicts(table("documents"), table("labels"))


@query()
def op8_near_duplicates(table) -> DataFrame:
    return near_dups.near_duplicates(table("documents")).drop("text_hash")


REPEATED_WINDOWS = r"""
WITH words AS (
    SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents
), windows AS (
    SELECT r, i, array_to_string(w[i:i + 34], ' ') AS seq
    FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), repeated AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY md5(seq), length(seq)) AS n FROM windows) WHERE n > 1
), flat AS (
    SELECT doc_id, r, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0
), judged AS (
    SELECT f.doc_id, f.r, f.i, f.word, EXISTS (SELECT 1 FROM repeated p WHERE p.r = f.r AND p.i BETWEEN f.i - 34 AND f.i) AS gone
    FROM flat f
), kept AS (
    SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM judged GROUP BY r
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept USING (r)
"""


@query(REPEATED_WINDOWS)
def op2_repeated_passages(table) -> DataFrame:
    return substrings.removal_digests(table("documents"))


@query()
def op10_log_bilinear_scores(table) -> DataFrame:
    return lm.scores(table("documents"))


@query()
def op9_nearest_vectors(table) -> DataFrame:
    return vectors.search(table("embeddings"), F.col("vec_id") % 100 == 0)


PAGE_RECORDS = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p
), b AS (
    SELECT *, list_reduce(list_transform(range(0, 8), lambda i: translate(
        to_base(CAST('0x' || substr(sha, 5 * i + 1, 5) AS BIGINT), 32, 4),
        '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), lambda x, y: x || y) AS digest FROM f
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""


@query(PAGE_RECORDS)
def op3_warc_round_trip(table) -> DataFrame:
    return warc.page_records(table("pages"))


LISTED_PAGES = r"""
WITH captures AS (
    SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS fetched_on,
        nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1) AS path
    FROM pages
), hosts AS (
    SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS n FROM (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL)
), domains AS (
    SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS n
    FROM (SELECT DISTINCT regexp_extract(host, '([^.]*\.[^.]*)$', 1) AS host FROM hosts WHERE contains(host, '.'))
), log AS (
    SELECT host AS key, 'block' AS verdict, ['ads', 'adult', 'malware', 'spam'][n % 4 + 1] AS category, n % 200 AS day, TRUE AS active FROM hosts WHERE n % 3 = 0
    UNION ALL SELECT host, 'block', ['ads', 'adult', 'malware', 'spam'][n % 4 + 1], n % 200 + 40, FALSE FROM hosts WHERE n % 6 = 0
    UNION ALL SELECT host, 'block', ['ads', 'adult', 'malware', 'spam'][n % 4 + 1], n % 200 + 90, TRUE FROM hosts WHERE n % 12 = 0
    UNION ALL SELECT host || '/en', 'allow', 'exception', n % 150, TRUE FROM hosts WHERE n % 5 = 0
    UNION ALL SELECT host, 'block', 'parked', 100, TRUE FROM domains WHERE n % 2 = 0
    UNION ALL SELECT host, 'block', 'parked', 131, FALSE FROM domains WHERE n % 2 = 0
), spans AS (
    SELECT key, verdict, category, DATE '2024-01-01' + CAST(day AS INT) AS valid_from,
        DATE '2024-01-01' + CAST(lead(day) OVER (PARTITION BY key, verdict, category ORDER BY day) AS INT) AS valid_to, active
    FROM (SELECT key, verdict, category, day, bool_or(active) AS active FROM log GROUP BY ALL)
), keyed AS (
    SELECT DISTINCT url, fetched_on, unnest(list_concat(
        [array_to_string(l[-k:], '.') FOR k IN range(2, len(l) + 1)],
        [host || '/' || array_to_string(s[1:k], '/') FOR k IN range(1, len(s) + 1)])) AS key
    FROM (SELECT url, fetched_on, host, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM captures WHERE host IS NOT NULL)
), hits AS (
    SELECT url, fetched_on, k.key, min(verdict) AS verdict, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories
    FROM keyed k JOIN spans s ON k.key = s.key AND active AND fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to)
    GROUP BY ALL
), best AS (
    SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY url, fetched_on ORDER BY length(key) DESC, key DESC) = 1
)
SELECT c.page_id, c.host, strftime(c.fetched_on, '%Y-%m-%d') AS fetched_on, coalesce(b.verdict, 'pass') AS verdict, b.key AS matched_key, b.categories
FROM captures c LEFT JOIN best b ON c.url = b.url AND c.fetched_on = b.fetched_on
"""


@query(LISTED_PAGES)
def op5_temporal_url_lists(table) -> DataFrame:
    pages = table("pages")
    found = url_lists.judged(url_lists.derived_captures(pages), url_lists.derived_entries(pages))
    return found.withColumn("fetched_on", F.date_format("fetched_on", "yyyy-MM-dd"))


@query()
def op6_repaired_chats(table) -> DataFrame:
    return chat.formatted(table("conversations"))


@query()
def op11_embedding_classes(table) -> DataFrame:
    return cover.near_vectors(table("embeddings"))


@query()
def op12_spelling_variants(table) -> DataFrame:
    return spellings.spelling_groups(table("documents"))


@query()
def op13_repaired_conversations(table) -> DataFrame:
    return turns.repair_digests(table("conversations"))
