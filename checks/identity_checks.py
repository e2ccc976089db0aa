"""Checks of identity, type and grouping jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import Tables, cat, pick
from shelfmark import vocab
from shelfmark.functions import normalise as N
from shelfmark.operators import graph, identity, merge, reviews, types
from shelfmark.session import cut

TOKENS = (
    "list_sort(list_distinct(list_filter(string_split(title_fold, ' '), lambda x: x <> '' AND NOT list_contains("
    + repr(sorted(vocab.TITLE_STOPWORDS)) + ", x))))"
)
IDENT = f"""base AS (
    SELECT 2 * p_partkey AS record_id, p_partkey % 6 AS form, 'src' || (p_partkey % 200) AS s, p_name || ' of ' || p_brand || ' ' || p_type AS title,
      CASE WHEN p_partkey % 3 = 0 THEN '10.1000/' || (p_partkey % 100) END AS doi FROM part
    UNION ALL
    SELECT 2 * p_partkey + 1, (p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) % 6, 'src' || (p_partkey % 200),
      CASE p_partkey % 4 WHEN 0 THEN p_name || ' of ' || p_brand || ' ' || p_type WHEN 1 THEN p_name || 's of ' || p_brand || ' ' || p_type
        WHEN 2 THEN p_name || ' and ' || p_type || ' ' || p_size ELSE p_type || ' ' || p_name || ' by ' || p_brand END,
      CASE WHEN p_partkey % 5 = 0 THEN '10.1000/' || (p_partkey % 100) END FROM part),
    ident AS MATERIALIZED (
    SELECT record_id, nullif(title_fold, '') AS title_fold, doi,
      CASE form WHEN 4 THEN NULL ELSE s END AS surname,
      CASE form WHEN 2 THEN s WHEN 3 THEN 'bea ' || s WHEN 4 THEN NULL ELSE 'author ' || s END AS words,
      CASE form WHEN 2 THEN '' WHEN 3 THEN 'b' WHEN 4 THEN NULL ELSE 'a' END AS initial,
      {TOKENS} AS tokens
    FROM (SELECT *, trim(regexp_replace(replace(replace(strip_accents(lower(title)), 'ß', 'ss'), '&', ' and '),
                       '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS title_fold FROM base))"""
PAIRS = IDENT + """,
    pairs AS (
      SELECT l.record_id AS l, r.record_id AS r, l.title_fold AS lt, r.title_fold AS rt, l.words AS lw, r.words AS rw,
        l.initial AS li, r.initial AS ri,
        coalesce(l.doi = r.doi, FALSE) AS shared,
        CASE WHEN l.surname IS NOT NULL AND r.surname IS NOT NULL THEN
          l.words = r.words OR (l.surname = r.surname AND (l.initial = '' OR r.initial = '' OR l.initial = r.initial)) END AS ac,
        least(len(l.tokens), len(r.tokens)) AS few,
        len(list_intersect(l.tokens, r.tokens)) / nullif(len(list_distinct(list_concat(l.tokens, r.tokens))), 0) AS jac
      FROM ident l JOIN ident r ON l.record_id % 2 = 0 AND r.record_id % 2 = 1)"""
# The share of characters in matching blocks, longest block first, then left and right of it:
# cells of equal characters, maximal diagonal runs, and a recursion over the open segments.
RATIOS = """wanted AS MATERIALIZED (SELECT DISTINCT lt, rt FROM pairs WHERE ac AND lt <> rt),
    cells AS (SELECT lt, rt, i, unnest([j FOR j IN range(1, length(rt) + 1) IF substr(rt, j, 1) = substr(lt, i, 1)]) AS j
      FROM (SELECT lt, rt, unnest(range(1, length(lt) + 1)) AS i FROM wanted)),
    diagonals AS MATERIALIZED (SELECT lt, rt, min(i) AS i, min(j) AS j, count(*) AS n
      FROM (SELECT *, i - row_number() OVER (PARTITION BY lt, rt, i - j ORDER BY i) AS g FROM cells) GROUP BY lt, rt, i - j, g),
    segments AS (
      SELECT lt, rt, 1 AS al, length(lt) + 1 AS ah, 1 AS bl, length(rt) + 1 AS bh, 0 AS matched FROM wanted
      UNION ALL
      SELECT lt, rt, u.al, u.ah, u.bl, u.bh, u.matched FROM (
        SELECT lt, rt, unnest([{'al': al, 'ah': m.i, 'bl': bl, 'bh': m.j, 'matched': -m.k}, {'al': m.i - m.k, 'ah': ah, 'bl': m.j - m.k, 'bh': bh, 'matched': 0}]) AS u
        FROM (SELECT lt, rt, al, ah, bl, bh, min({'k': low - high, 'i': low, 'j': low - d}) AS m FROM (
          SELECT s.*, r.i - r.j AS d, greatest(r.i, s.al, s.bl + r.i - r.j) AS low, least(r.i + r.n, s.ah, s.bh + r.i - r.j) AS high
          FROM segments s JOIN diagonals r ON s.lt = r.lt AND s.rt = r.rt) WHERE high > low GROUP BY lt, rt, al, ah, bl, bh))),
    ratios AS MATERIALIZED (SELECT lt, rt, 2.0 * sum(matched) / (length(lt) + length(rt)) AS ratio FROM segments GROUP BY lt, rt)"""
PAIRS = PAIRS + ", " + RATIOS + """,
    judged AS (
      SELECT *, CASE WHEN shared OR lt = rt THEN CASE WHEN ac = FALSE THEN 'review_required' ELSE 'equivalent' END
        WHEN lt IS NULL OR rt IS NULL THEN 'distinct'
        WHEN ac AND (ratio >= 0.92 OR few >= 3 AND jac >= 0.84) THEN 'equivalent'
        WHEN ac AND few >= 3 AND (ratio >= 0.65 OR jac >= 0.5) THEN 'review_required' ELSE 'distinct' END AS level
      FROM pairs LEFT JOIN ratios USING (lt, rt))"""


def ident_records(t: Tables):
    """Even ids: a record per part; odd ids: the same with other spellings of title and author."""
    k = F.col("p_partkey")
    source, own = cat("src", (k % 200).cast("string")), cat(F.col("p_name"), " of ", F.col("p_brand"), " ", F.col("p_type"))
    other = F.when(k % 4 == 0, own).when(k % 4 == 1, cat(F.col("p_name"), "s of ", F.col("p_brand"), " ", F.col("p_type"))).when(
        k % 4 == 2, cat(F.col("p_name"), " and ", F.col("p_type"), " ", F.col("p_size").cast("string"))
    ).otherwise(cat(F.col("p_type"), " ", F.col("p_name"), " by ", F.col("p_brand")))

    def shape(key, form, title, dois):
        return t.part.select(
            key.alias("record_id"), title.alias("title"),
            F.when(form == 1, cat(source, ", Author")).when(form == 2, source).when(form == 3, cat("Bea ", source))
            .when(form == 4, F.lit(None)).otherwise(cat("Author ", source)).alias("author"),
            F.when(k % dois == 0, cat("10.1000/", (k % 100).cast("string"))).alias("doi"),
        )

    left = shape(2 * k, k % 6, own, 3)
    right = shape(2 * k + 1, (k + F.when(k % 3 == 0, 1).otherwise(0)) % 6, other, 5)
    return left.unionByName(right)


def sides(t: Tables):
    every = cut(identity.identities(ident_records(t)))
    return every.filter("record_id % 2 = 0"), every.filter("record_id % 2 = 1")


@check("d05_block_counts", f"""
    WITH {IDENT}, r AS (SELECT * FROM ident WHERE record_id % 2 = 1)
    SELECT record_id, (SELECT count(*) FROM r WHERE r.title_fold = l.title_fold) AS n_title,
      (SELECT count(*) FROM r WHERE r.doi = l.doi) AS n_doi, (SELECT count(*) FROM r WHERE r.surname = l.surname) AS n_surname,
      (SELECT count(*) FROM r WHERE r.words = l.words) AS n_words
    FROM ident l WHERE record_id % 2 = 0""")
def _(t):
    return identity.block_counts(*sides(t))


@check("d06_exact_matches", f"""
    WITH RECURSIVE {PAIRS}
    SELECT i.record_id, count(*) FILTER (WHERE level = 'equivalent') AS n_equivalent,
      count(*) FILTER (WHERE level = 'review_required') AS n_review, min(r) FILTER (WHERE level = 'equivalent') AS match_id
    FROM ident i LEFT JOIN (SELECT * FROM judged WHERE shared OR lt = rt) ON l = record_id
    WHERE i.record_id % 2 = 0 GROUP BY i.record_id""")
def _(t):
    return identity.exact_matches(*sides(t))


@check("d06_compare_identity", f"""
    WITH RECURSIVE {PAIRS}
    SELECT DISTINCT lt AS left_title, lw AS left_words, li AS left_initial, rt AS right_title, rw AS right_words, ri AS right_initial, level,
      'compatible_first_author|' || CASE level WHEN 'equivalent' THEN concat_ws('|', CASE WHEN ratio >= 0.92 THEN 'high_title_sequence_similarity' END,
        CASE WHEN few >= 3 AND jac >= 0.84 THEN 'same_title_content_tokens' END) ELSE 'partial_title_similarity' END AS evidence
    FROM (SELECT * EXCLUDE (level), CASE WHEN ratio >= 0.92 OR few >= 3 AND jac >= 0.84 THEN 'equivalent'
        WHEN few >= 3 AND (ratio >= 0.65 OR jac >= 0.5) THEN 'review_required' END AS level FROM judged WHERE ac AND lt <> rt) WHERE level IS NOT NULL""")
def _(t):
    return identity.near_names(*sides(t))


@check("d07_pick_unique", f"""
    WITH RECURSIVE {PAIRS}
    SELECT i.record_id, count(*) FILTER (WHERE level = 'equivalent') AS n_equivalent,
      count(*) FILTER (WHERE level = 'review_required') AS n_review,
      CASE WHEN count(*) FILTER (WHERE level = 'equivalent') = 1 THEN min(r) FILTER (WHERE level = 'equivalent') END AS match_id,
      CASE count(*) FILTER (WHERE level = 'equivalent') WHEN 0 THEN 'none' WHEN 1 THEN 'accepted' ELSE 'ambiguous' END AS outcome
    FROM ident i LEFT JOIN judged ON l = record_id WHERE i.record_id % 2 = 0 GROUP BY i.record_id""")
def _(t):
    return identity.pick_unique(identity.identity_counts(*sides(t)))


@check("d08_doi_lookup", f"""
    WITH {IDENT}, w AS (SELECT doi, min(record_id % 83) AS low, max(record_id % 83) AS high FROM ident WHERE record_id % 2 = 1 AND doi IS NOT NULL GROUP BY doi)
    SELECT record_id, CASE WHEN l.doi IS NULL THEN 'no_doi' WHEN low IS NULL THEN 'not_found' WHEN low = high THEN 'found' ELSE 'ambiguous' END AS doi_state,
      CASE WHEN low = high THEN low END AS work_key
    FROM ident l LEFT JOIN w ON l.doi = w.doi WHERE record_id % 2 = 0""")
def _(t):
    records = ident_records(t)  # only ids and DOIs are asked for, so no title is folded
    left, right = records.filter("record_id % 2 = 0"), records.filter("record_id % 2 = 1")
    works = right.withColumn("work_key", F.col("record_id") % 83)
    return identity.doi_lookup(left, works).select("record_id", "doi_state", "work_key")


@check("d09_title_lookup", f"""
    WITH RECURSIVE {PAIRS}
    SELECT i.record_id, count(l) AS n_same_title, count(*) FILTER (WHERE ac IS NOT FALSE AND l IS NOT NULL) AS n_equivalent,
      CASE WHEN count(*) FILTER (WHERE ac IS NOT FALSE AND l IS NOT NULL) = 1 THEN min(r) FILTER (WHERE ac IS NOT FALSE) END AS match_id,
      CASE WHEN count(*) FILTER (WHERE ac IS NOT FALSE AND l IS NOT NULL) = 1 THEN 'accepted'
        WHEN count(*) FILTER (WHERE ac IS NOT FALSE AND l IS NOT NULL) > 1 THEN 'ambiguous'
        WHEN count(l) > 0 THEN 'identity_mismatch' ELSE 'no_title_candidate' END AS outcome
    FROM ident i LEFT JOIN (SELECT * FROM judged WHERE lt = rt) ON l = record_id WHERE i.record_id % 2 = 0 GROUP BY i.record_id""")
def _(t):
    return identity.title_lookup(*sides(t))


@check("d10_dedupe_decisions", f"""
    WITH {IDENT}, w AS (SELECT *, CASE WHEN record_id % 4 = 0 THEN 'W' || (record_id % 90) END AS sid,
        CASE WHEN record_id % 5 = 0 THEN 'book' ELSE 'article' END AS kind FROM ident),
    p AS (SELECT l.record_id AS l, coalesce(l.sid = r.sid, FALSE) AS s, coalesce(l.doi = r.doi, FALSE) AS d, coalesce(l.title_fold = r.title_fold, FALSE) AS t,
        l.kind = r.kind AS k,
        CASE WHEN l.surname IS NOT NULL AND r.surname IS NOT NULL THEN
          l.words = r.words OR (l.surname = r.surname AND (l.initial = '' OR r.initial = '' OR l.initial = r.initial)) END AS ac
      FROM w l JOIN w r ON l.record_id <> r.record_id)
    SELECT w.record_id, count(*) FILTER (WHERE p.s OR (d AND ac IS NOT FALSE AND k)) AS n_automatic_merge,
      count(*) FILTER (WHERE NOT (p.s OR (d AND ac IS NOT FALSE AND k)) AND (d OR t OR coalesce(ac, FALSE))) AS n_candidate_duplicate
    FROM w LEFT JOIN p ON l = record_id GROUP BY w.record_id""")
def _(t):
    d = F.col("record_id")
    works = identity.identities(ident_records(t)).withColumn(
        "source_id", F.when(d % 4 == 0, cat("W", (d % 90).cast("string")))
    ).withColumn("work_type", F.when(d % 5 == 0, "book").otherwise("article"))
    return identity.dedupe_decisions(works)


def open_pairs(t: Tables):
    """Record pairs to review, one per event, bound to their facts."""
    k, u = F.col("k"), F.col("user_id").cast("string")
    return t.v_k.select(
        cat("https://feed.example.org/rec/U", u).alias("record_url"),
        F.when(F.col("event_type") == "click", "openalex").otherwise("crossref").alias("source"),
        cat("X", F.col("event_id").cast("string")).alias("external_id"),
        N.row_hash(F.col("user_id"), F.col("event_id"), k).alias("fingerprint"), k.alias("k"),
    )


def pair_reviews(pairs):
    k = F.col("k")
    return pairs.filter(k % 5 != 0).select(
        "record_url", "source", "external_id",
        F.when(k % 7 == 0, F.sha2("fingerprint", 256)).otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(k % 2 == 0, "equivalent").otherwise("distinct").alias("decision"),
    )


OPEN_PAIRS = """
    SELECT 'https://feed.example.org/rec/U' || user_id AS record_url,
      CASE WHEN event_type = 'click' THEN 'openalex' ELSE 'crossref' END AS source, 'X' || event_id AS external_id,
      CASE WHEN k % 5 <> 0 AND k % 7 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'equivalent' ELSE 'distinct' END END AS applied, k
    FROM v_k"""


@check("d11_apply_identity_reviews", f"""
    SELECT *, CASE WHEN n_pending > 0 THEN 'pending' WHEN n_equivalent > 1 THEN 'several_equivalent' WHEN n_equivalent = 1 THEN 'equivalent' ELSE 'distinct' END AS state,
      CASE WHEN n_pending = 0 AND n_equivalent = 1 THEN one END AS external_id
    FROM (SELECT record_url, count(*) AS n_pairs, count(*) FILTER (WHERE applied IS NULL) AS n_pending,
        count(*) FILTER (WHERE applied = 'equivalent') AS n_equivalent, min(external_id) FILTER (WHERE applied = 'equivalent') AS one
      FROM ({OPEN_PAIRS}) GROUP BY record_url)""".replace("SELECT *,", "SELECT * EXCLUDE (one),", 1))
def _(t):
    pairs = open_pairs(t)
    return reviews.apply_identity_reviews(pairs.drop("k"), pair_reviews(pairs))


@check("i20_review_decision_overlap", f"""
    SELECT source, count(*) AS open_pairs, count(applied) AS covered_pairs FROM ({OPEN_PAIRS}) GROUP BY source""")
def _(t):
    pairs = open_pairs(t)
    return reviews.review_decision_overlap(pairs.drop("k"), pair_reviews(pairs))


MAPPED = """
    SELECT DISTINCT record_id, provider, CASE WHEN raw_type = 'Odd Type' THEN 'unrecognized' ELSE raw_type END AS safe, method,
      CASE WHEN provider = 'openalex' THEN CASE raw_type WHEN 'report' THEN 'working-paper' WHEN 'review' THEN 'review-article' WHEN 'Odd Type' THEN NULL ELSE raw_type END
        ELSE CASE raw_type WHEN 'journal-article' THEN 'article' WHEN 'monograph' THEN 'book' WHEN 'posted-content' THEN 'preprint' ELSE raw_type END END AS kind
    FROM v_type_evidence"""
RESOLVED = f"""
    SELECT record_id, fingerprint,
      CASE WHEN n_rev > 0 THEN rev WHEN n_null > 0 THEN 'unknown' WHEN n_sup > 0 AND n_uns > 0 THEN 'conflict'
        WHEN n_sup > 0 THEN best_specific ELSE best END AS work_type,
      CASE WHEN n_rev > 0 THEN 'reviewed' WHEN n_null > 0 THEN 'unknown' WHEN n_sup > 0 AND n_uns > 0 THEN 'conflict'
        WHEN n_kinds = 1 THEN 'confirmed' ELSE 'compatible' END AS type_status
    FROM (SELECT record_id, count(*) FILTER (WHERE method = 'document-inspection') AS n_rev, min(kind) FILTER (WHERE method = 'document-inspection') AS rev,
        count(*) FILTER (WHERE kind IS NULL) AS n_null, count(*) FILTER (WHERE kind IN ('article','preprint','working-paper','review-article')) AS n_sup,
        count(*) FILTER (WHERE kind IN ('book','book-review')) AS n_uns, count(DISTINCT kind) AS n_kinds,
        arg_min(kind, (p, kind)) FILTER (WHERE kind IS NOT NULL) AS best, arg_min(kind, (p, kind)) FILTER (WHERE kind <> 'other') AS best_specific,
        sha256(array_to_string(list_sort(list(provider || '|' || safe || '|' || coalesce(kind, '') || '|' || method)), chr(30))) AS fingerprint
      FROM (SELECT *, CASE kind WHEN 'book-review' THEN 0 WHEN 'book' THEN 2 WHEN 'review-article' THEN 3 WHEN 'article' THEN 8 WHEN 'preprint' THEN 9 WHEN 'working-paper' THEN 11 ELSE 100 END AS p FROM ({MAPPED}))
      GROUP BY record_id)"""


@check("f06_resolve_type", RESOLVED)
def _(t):
    return types.resolve_type(t.v_type_evidence)


@check("d12_apply_type_reviews", f"""
    SELECT record_id, CASE WHEN record_id % 6 = 0 AND record_id % 4 <> 3 AND type_status <> 'reviewed' AND record_id % 18 <> 0 THEN 'letter' ELSE work_type END AS work_type,
      CASE WHEN record_id % 6 = 0 AND record_id % 4 <> 3 AND type_status <> 'reviewed' AND record_id % 18 <> 0 THEN 'reviewed' ELSE type_status END AS type_status
    FROM ({RESOLVED})""")
def _(t):
    d = F.col("record_id")
    resolved = types.resolve_type(t.v_type_evidence)
    titles = t.v_records.select("record_id", N.title_norm(F.col("title")).alias("title_norm"))
    base = resolved.join(titles, "record_id").filter(d % 6 == 0)
    one = base.select(
        "record_id", "title_norm", F.lit("letter").alias("work_type"),
        F.array(F.sha2("fingerprint", 256), F.when(d % 4 != 3, F.col("fingerprint")).otherwise(F.lit("-"))).alias("fingerprints"),
    )
    two = base.filter(d % 18 == 0).select(
        "record_id", "title_norm", F.lit("editorial").alias("work_type"), F.array("fingerprint").alias("fingerprints")
    )
    return types.apply_type_reviews(resolved, titles, one.unionByName(two))


@check("d13_apply_bibliographic_reviews", """
    SELECT record_id, reviewed, CASE WHEN reviewed THEN 'Verified ' || record_id ELSE title END AS title,
      CASE WHEN reviewed THEN author ELSE author END AS author,
      CASE WHEN reviewed THEN coalesce(rdoi, doi) ELSE doi END AS doi, CASE WHEN reviewed THEN ryear END AS reviewed_year
    FROM (SELECT *, CASE WHEN record_id % 3 = 0 THEN '10.1000/' || (record_id % 400) END AS rdoi,
        CASE WHEN record_id % 4 <> 0 THEN 2000 + (record_id + CASE WHEN record_id % 7 = 0 THEN 1 ELSE 0 END) % 25 END AS ryear,
        record_id % 2 = 0 AND record_id % 10 <> 0 AND record_id % 14 <> 0 AND regexp_matches(title, '[\\p{L}\\p{N}]')
          OR (record_id % 2 = 0 AND record_id % 10 <> 0 AND record_id % 28 = 0 AND regexp_matches(title, '[\\p{L}\\p{N}]')) AS reviewed
      FROM v_records)""", ints="reviewed_year")
def _(t):
    d = F.col("record_id")
    url = cat("https://feed.example.org/rec/", d.cast("string"))
    base = t.v_records.withColumn("record_url", url)
    candidates = base.select(
        "record_id", "record_url", "title", "author", "doi",
        F.when(F.col("doi").isNull(), 0).otherwise(1).alias("n_dois"), F.array("year").alias("year_hints"),
    )
    decided = base.filter(d % 2 == 0).select(
        cat(F.col("record_url"), "/").alias("record_url"), F.upper("title").alias("source_title"),
        F.when(d % 10 == 0, "Other Person").otherwise(F.col("author")).alias("source_author"),
        cat("Verified ", d.cast("string")).alias("verified_title"), F.col("author").alias("verified_author"),
        F.col("doi").alias("review_doi"),
        F.when(d % 4 != 0, 2000 + (d + F.when(d % 7 == 0, 1).otherwise(0)) % 25).cast("int").alias("review_year"),
    )
    return reviews.apply_bibliographic_reviews(candidates, decided).select(
        "record_id", "title", "author", "doi", "reviewed_year", "reviewed"
    )


def items(t: Tables):
    d = F.col("record_id")
    return t.v_records.select(
        "record_id", "title", "year",
        F.when(d % 3 == 0, cat("10.1000/", (d % 400).cast("string"))).alias("doi"),
        F.when(d % 7 == 0, cat("W", (d % 250).cast("string"))).alias("provider_id"),
        cat("https://feed.example.org/rec/", F.when(d % 10 == 0, d % 300).otherwise(d).cast("string")).alias("record_url"),
        F.when(d % 4 != 0, d % 9).alias("citations"), F.col("author").alias("category_id"),
    )


GROUPS = """
    WITH RECURSIVE items AS (
      SELECT record_id, title, year, author AS category_id, CASE WHEN record_id % 3 = 0 THEN '10.1000/' || (record_id % 400) END AS doi,
        CASE WHEN record_id % 7 = 0 THEN 'W' || (record_id % 250) END AS provider_id,
        'https://feed.example.org/rec/' || CASE WHEN record_id % 10 = 0 THEN record_id % 300 ELSE record_id END AS record_url,
        CASE WHEN record_id % 4 <> 0 THEN record_id % 9 END AS citations FROM v_records),
    links AS (SELECT DISTINCT a.record_id AS a, b.record_id AS b FROM items a JOIN items b
      ON a.doi = b.doi UNION SELECT a.record_id, b.record_id FROM items a JOIN items b ON a.provider_id = b.provider_id
      UNION SELECT a.record_id, b.record_id FROM items a JOIN items b ON a.record_url = b.record_url),
    walk AS (SELECT record_id AS a, record_id AS b FROM items UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a),
    groups AS (SELECT a AS record_id, min(b) AS group_id FROM walk GROUP BY a)"""


@check("e05_connected_records", GROUPS + " SELECT * FROM groups")
def _(t):
    return graph.connected_records(items(t), ["doi", "provider_id", "record_url"])


@check("f05_merge_items", GROUPS + """
    SELECT group_id, count(*) AS n_records, min(title) AS title, min(doi) AS doi, min(record_url) AS record_url,
      CASE WHEN count(DISTINCT year) = 1 THEN min(year) END AS year, CASE WHEN count(DISTINCT citations) = 1 THEN min(citations) END AS citations,
      array_to_string(list_sort(list(DISTINCT category_id)), '|') AS category_ids
    FROM items JOIN groups USING (record_id) GROUP BY group_id""", ints="year citations")
def _(t):
    held = items(t)
    return graph.merge_items(held, graph.connected_records(held, ["doi", "provider_id", "record_url"]))


@check("f07_earliest_version", """
    SELECT group_id, coalesce(arg_min(record_id, (published, record_id)) FILTER (WHERE published IS NOT NULL),
        CASE WHEN count(DISTINCT record_id) = 1 THEN min(record_id) END) AS record_id, strftime(min(published), '%Y-%m-%d %H:%M:%S') AS published
    FROM (SELECT o_orderkey AS record_id, o_custkey AS group_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS published FROM orders)
    GROUP BY group_id""")
def _(t):
    works = t.orders.select(
        F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("group_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("published"),
    )
    return types.earliest_version(works)


@check("f04_merge_work", """
    SELECT work_id, min(title) AS title, min(doi) AS doi, count(DISTINCT coalesce(doi, '')) > 1 AS doi_conflict,
      strftime(date_trunc('second', min(observed_at)), '%Y-%m-%d %H:%M:%S') AS observed_at, min(record_url) AS record_url, count(*) AS n_rows,
      CASE WHEN ok THEN min(freshness) ELSE 'uncertain' END AS freshness,
      CASE WHEN ok THEN min(freshness_event) ELSE 'conflicting_resolution_evidence' END AS freshness_event,
      CASE WHEN ok THEN min(publication_date) END AS publication_date
    FROM (SELECT *, (count(DISTINCT freshness) OVER w = 1) AND (count(DISTINCT freshness_event) OVER w = 1) AND (count(DISTINCT coalesce(publication_date, '')) OVER w = 1) AS ok
      FROM (SELECT 'w' || user_id || '-' || (event_id % 40) AS work_id, 'Record ' || user_id AS title, CASE WHEN k % 9 <> 0 THEN '10.1000/u' || user_id END AS doi,
          ts AS observed_at, 'r' || event_id AS record_url, CASE WHEN k < 50 THEN 'confirmed_new' ELSE 'uncertain' END AS freshness,
          CASE WHEN k < 80 THEN 'recently_published' ELSE 'indexed' END AS freshness_event, CASE WHEN k % 2 = 0 THEN '2024-01-01' END AS publication_date FROM v_k)
      WINDOW w AS (PARTITION BY work_id)) GROUP BY work_id, ok""")
def _(t):
    k, u, e = F.col("k"), F.col("user_id").cast("string"), F.col("event_id")
    works = t.v_k.select(
        cat("w", u, "-", (e % 40).cast("string")).alias("work_id"), cat("Record ", u).alias("title"),
        F.when(k % 9 != 0, cat("10.1000/u", u)).alias("doi"), F.col("ts").alias("observed_at"),
        cat("r", e.cast("string")).alias("record_url"),
        F.when(k < 50, "confirmed_new").otherwise("uncertain").alias("freshness"),
        F.when(k < 80, "recently_published").otherwise("indexed").alias("freshness_event"),
        F.when(k % 2 == 0, "2024-01-01").alias("publication_date"),
    )
    return merge.merge_work(works)


@check("f04_work_members", """
    SELECT DISTINCT 'w' || user_id AS work_id, link AS record_url, category_id FROM (SELECT *, replace(title, 'Record ', '') AS user_id FROM v_feed_entries)""")
def _(t):
    merged = merge.merge_feeds(t.v_feed_entries)
    works = merged.withColumn("work_id", cat("w", F.regexp_replace("title", "Record ", "")))
    return merge.work_members(works)


def review_rows(t: Tables):
    """Decision rows with planted faults, one per event."""
    k, e = F.col("k"), F.col("event_id")
    return t.v_k.select(
        e.alias("event_id"),
        cat("https://feed.example.org/rec/E", F.when(k == 1, F.lit("dup")).otherwise(e.cast("string"))).alias("record_url"),
        F.when(k % 10 == 0, " ").otherwise("A title").alias("title"),
        F.when(k % 11 == 0, "poem").otherwise("book-review").alias("work_type"),
        F.when(k % 13 == 0, "xyz").otherwise(F.sha2(e.cast("string"), 256)).alias("fingerprint"),
        F.lit("seen").alias("note"),
        F.when(k % 17 == 0, F.array(F.lit("http://x.example.org"))).otherwise(F.array(F.lit("https://x.example.org/a"))).alias("evidence_urls"),
        F.when(k % 19 != 0, F.col("ts")).alias("reviewed_at"),
        F.when(k % 2 == 0, "openalex").otherwise("crossref").alias("source"),
        cat("X", e.cast("string")).alias("external_id"),
        F.when(k % 23 == 0, "maybe").otherwise("distinct").alias("decision"),
        F.lit("A title").alias("source_title"), F.lit("Ann Lee").alias("source_author"), F.lit("A Title").alias("verified_title"),
        F.when(k % 29 == 0, "bad").when(k % 31 != 0, "doi:10.1000/x").alias("doi"),
        F.when(k % 3 == 0, 2020).alias("publication_year"),
    )


REVIEW_SQL = {
    "identity": "CASE WHEN k % 17 = 0 THEN 'invalid_evidence_urls' END, CASE WHEN k % 19 = 0 THEN 'missing_reviewed_at' END, CASE WHEN k % 13 = 0 THEN 'invalid_fingerprint' END, CASE WHEN k % 23 = 0 THEN 'invalid_decision' END",
    "type": "CASE WHEN k % 10 = 0 THEN 'missing_title' END, CASE WHEN k % 17 = 0 THEN 'invalid_evidence_urls' END, CASE WHEN k % 19 = 0 THEN 'missing_reviewed_at' END, CASE WHEN k % 13 = 0 THEN 'invalid_fingerprint' END, CASE WHEN k % 11 = 0 THEN 'invalid_work_type' END, CASE WHEN k = 1 THEN 'duplicate_key' END",
    "bibliography": "CASE WHEN k % 17 = 0 THEN 'invalid_evidence_urls' END, CASE WHEN k % 19 = 0 THEN 'missing_reviewed_at' END, CASE WHEN k % 29 = 0 THEN 'invalid_doi' END, CASE WHEN (k % 29 = 0 OR k % 31 = 0) AND k % 3 <> 0 THEN 'no_doi_or_year' END, CASE WHEN k = 1 THEN 'duplicate_key' END",
}

for kind, rules in REVIEW_SQL.items():
    @check(f"a11_review_table_{kind}", f"SELECT event_id, concat_ws('|', {rules}) AS violations FROM v_k")
    def _(t, kind=kind):
        return reviews.review_table(review_rows(t), kind).select("event_id", "violations")
