"""Checks of the resolver and of whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.records import END, MERGED, SPARSE_ENRICHED, START, WINDOW, _sparse_sql, profile_rows, sparse, sparse_enriched
from checks.registry import check, plain
from checks.views import Tables, cat, pick
from shelfmark import vocab
from shelfmark.operators import merge, ranking, reviews, taxonomy
from shelfmark.plans import runs
from shelfmark.plans.resolve import candidate_identities, resolve_records, work_identities
from shelfmark.session import configure, cut, shared_path
from shelfmark.sources import tables


def first_works(t: Tables) -> DataFrame:
    """One bibliography over every second user's record."""
    u = F.col("u")
    h = F.floor(u / 2)
    doi = F.when(u % 14 == 0, cat("10.1000/x", u.cast("string"))).otherwise(cat("10.1000/u", u.cast("string")))
    return t.events.select(F.col("user_id").alias("u")).distinct().filter("u % 2 = 0").select(
        doi.alias("work_key"), doi.alias("doi"), cat("Record ", u.cast("string")).alias("title"), F.array().cast("array<string>").alias("authors"),
        pick(h % 8, "journal-article", "journal-article", "book", "posted-content", "journal-article", "Odd Type!", "monograph", "journal-article").alias("raw_type"),
        pick(h % 4, "2024-01-10", "2023-06", "2022").alias("value"), pick(h % 4, "day", "month", "year").alias("precision"),
        pick(h % 4, "recently_published_online", "recently_assigned_to_issue").alias("event"), F.lit(None).cast("bigint").alias("citations"),
    )


def second_works(t: Tables) -> DataFrame:
    """The other bibliography over every third user's record, some of them twice."""
    u = F.col("u")
    h = F.floor(u / 3)
    base = t.events.select(F.col("user_id").alias("u")).distinct().filter("u % 3 = 0")
    twice = base.withColumn("mark", F.explode(F.when(u % 15 == 0, F.array(F.lit(""), F.lit("b"))).otherwise(F.array(F.lit("")))))
    return twice.select(
        cat("W", u.cast("string"), F.col("mark")).alias("work_key"), F.when(F.col("mark") == "", cat("10.1000/u", u.cast("string"))).alias("doi"),
        cat("Record ", u.cast("string")).alias("title"), F.array().cast("array<string>").alias("authors"),
        pick(h % 4, "article", "preprint", "article", "book").alias("raw_type"), pick(h % 3, "2024-01-12", "2020-05-05").alias("value"),
        pick(h % 3, "day", "day").alias("precision"), pick(h % 3, "recently_published", "recently_published").alias("event"),
        F.when(u % 2 == 0, u % 11).alias("citations"),
    )


def sql_list(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


TYPE_ROWS = ", ".join(f"('{p}', '{r}', '{k}')" for p, kinds in vocab.TYPE_MAP.items() for r, k in kinds.items())
PLACES = " ".join(f"WHEN '{name}' THEN {n}" for n, name in enumerate(vocab.TYPE_PREFERENCE))


def resolved_types(evidence: str) -> str:
    """Type resolution of ``(id, provider, raw_type)`` rows without reviewed evidence."""
    return f"""
    SELECT id, CASE WHEN nulls > 0 THEN 'unknown' WHEN sup > 0 AND uns > 0 THEN 'conflict' WHEN sup > 0 THEN specific ELSE best END AS work_type
    FROM (SELECT id, count(*) FILTER (WHERE kind IS NULL) AS nulls, count(*) FILTER (WHERE kind IN ({sql_list(vocab.SUPPORTED_TYPES)})) AS sup,
        count(*) FILTER (WHERE kind NOT IN ({sql_list(vocab.SUPPORTED_TYPES + ['other'])})) AS uns,
        arg_min(kind, (place, kind)) FILTER (WHERE kind IS NOT NULL) AS best, arg_min(kind, (place, kind)) FILTER (WHERE kind <> 'other') AS specific
      FROM (SELECT e.id, m.kind, CASE m.kind {PLACES} ELSE 100 END AS place FROM ({evidence}) e
            LEFT JOIN (VALUES {TYPE_ROWS}) m(p, r, kind) ON e.provider = m.p AND lower(e.raw_type) = m.r) GROUP BY id)"""


def resolved_sql(candidates: str, failed: str = "record_url LIKE '%-7'", has1: str = "u % 2 = 0", unclear1: str = "FALSE", window: tuple = WINDOW) -> str:
    return f"""
    WITH c AS (SELECT *, CAST(split_part(title, ' ', 2) AS INTEGER) AS u FROM ({candidates})),
    w AS (SELECT *, {has1} AS has1, CASE WHEN {has1} THEN CASE WHEN u % 14 = 0 THEN '10.1000/x' || u ELSE '10.1000/u' || u END END AS doi1,
        CASE u // 2 % 8 WHEN 2 THEN 'book' WHEN 3 THEN 'posted-content' WHEN 5 THEN 'Odd Type!' WHEN 6 THEN 'monograph' ELSE 'journal-article' END AS raw1,
        CASE u // 2 % 4 WHEN 0 THEN '2024-01-10' WHEN 1 THEN '2023-06' WHEN 2 THEN '2022' END AS value1, u // 2 % 4 AS form1, {has1} AND u // 2 % 4 = 0 AS settled,
        CASE u // 3 % 4 WHEN 1 THEN 'preprint' WHEN 3 THEN 'book' ELSE 'article' END AS raw2, CASE u // 3 % 3 WHEN 0 THEN '2024-01-12' WHEN 1 THEN '2020-05-05' END AS value2 FROM c),
    x AS (SELECT *, u % 3 = 0 AND u % 15 <> 0 AND NOT settled AS has2, u % 15 = 0 AND NOT settled OR {unclear1} AS unclear FROM w),
    ev AS (SELECT record_url AS id, 'feed-description' AS provider, unnest(types) AS raw_type FROM x
      UNION ALL SELECT record_url, 'change-log', change_type FROM x WHERE change_type IS NOT NULL
      UNION ALL SELECT record_url, 'crossref', raw1 FROM x WHERE has1 UNION ALL SELECT record_url, 'openalex', raw2 FROM x WHERE has2),
    ty AS ({resolved_types('FROM ev')}),
    y AS (SELECT x.*, coalesce(ty.work_type, 'article') AS kind,
        CASE WHEN has1 AND form1 IN (0, 1) THEN value1 WHEN has2 AND value2 IS NOT NULL THEN value2 END AS value,
        CASE WHEN has1 AND form1 IN (0, 1) THEN CASE form1 WHEN 0 THEN 'recently_published_online' ELSE 'recently_assigned_to_issue' END WHEN has2 AND value2 IS NOT NULL THEN 'recently_published' END AS event,
        coalesce(doi1, CASE WHEN has2 THEN '10.1000/u' || u END) AS wdoi
      FROM x LEFT JOIN ty ON ty.id = record_url),
    z AS (SELECT *, CASE WHEN unclear THEN 'semantic_identity_review_required' WHEN NOT has1 AND NOT has2 AND {failed} THEN 'old_work_check_incomplete'
        WHEN has1 AND has2 AND doi1 <> '10.1000/u' || u THEN 'identifier_conflict' WHEN kind = 'conflict' THEN 'structured_work_type_conflict'
        WHEN kind = 'unknown' THEN 'unknown_structured_work_type' END AS reason_code,
        CASE WHEN value IS NULL THEN 'uncertain' WHEN value = '2023-06' THEN 'newly_indexed_old_work' WHEN CAST(value AS TIMESTAMP) < TIMESTAMP '{window[0]}' THEN 'newly_indexed_old_work'
          WHEN CAST(value AS TIMESTAMP) < TIMESTAMP '{window[1]}' THEN 'confirmed_new' ELSE 'uncertain' END AS fresh,
        len(all_years) > 0 AND list_max(all_years) < 2024 AS stale FROM y)
    SELECT record_url, reason_code, CASE WHEN reason_code IS NULL THEN coalesce('work:doi:' || wdoi, 'work:record:' || sha256(record_url)) END AS work_id,
      CASE WHEN reason_code IS NULL THEN kind END AS work_type,
      CASE WHEN reason_code IS NULL THEN CASE WHEN fresh <> 'uncertain' THEN fresh WHEN stale THEN 'newly_indexed_old_work' ELSE 'confirmed_source_arrival' END END AS freshness,
      CASE WHEN reason_code IS NULL THEN CASE WHEN fresh <> 'uncertain' THEN event WHEN stale THEN 'newly_indexed_old_work' WHEN changed_at IS NOT NULL THEN 'recently_changed' ELSE 'recently_arrived' END END AS freshness_event,
      CASE WHEN reason_code IS NULL THEN value END AS publication_date, cats, title,
      (SELECT list({{'p': ev.provider, 'r': ev.raw_type}}) FROM ev WHERE ev.id = z.record_url) AS evl FROM z"""


@check("f08_resolve_records", f"SELECT * EXCLUDE (cats, title, evl) FROM ({resolved_sql(SPARSE_ENRICHED)})")
def _(t):
    candidates = sparse_enriched(t)
    failed = candidates.filter("record_url LIKE '%-7'").select("record_url")
    out, _evidence = resolve_records(candidates, first_works(t), second_works(t), WINDOW, lookup_failed=failed)
    return out.select("record_url", "reason_code", "work_id", "work_type", "freshness", "freshness_event", "publication_date")


def named_works(t: Tables) -> DataFrame:
    """The first bibliography with authors: a quarter of its works name someone else, so that
    their records need a decision, and a quarter have a title that is only near."""
    u = F.split_part("title", F.lit(" "), F.lit(2))
    author = F.when(u.cast("int") % 8 == 2, "Bob Ray").otherwise(cat("Ann Lee", u))
    return first_works(t).withColumn("authors", F.array(author)).withColumn(
        "title", F.when(u.cast("int") % 8 == 4, cat("Records ", u)).otherwise(F.col("title")))


def signed(records: DataFrame) -> DataFrame:
    return records.withColumn("title", cat("Lee", F.split_part("title", F.lit(" "), F.lit(2)), ", Ann: ", F.col("title")))


def identity_decisions(candidates: DataFrame, works: DataFrame) -> DataFrame:
    """Equivalent, distinct and stale decisions in turn; every fourth pair has none."""
    left = candidate_identities(candidates).select(*(F.col(c).alias(f"l_{c}") for c in reviews.DECIDED_FACTS))
    right = work_identities(works).select(*(F.col(c).alias(f"r_{c}") for c in [*reviews.DECIDED_FACTS, "value"]))
    u = F.split_part("l_title", F.lit(" "), F.lit(2)).cast("int")
    turn = F.floor(u / 8) % 4
    mark = reviews.identity_fingerprint("l_", "r_")
    return left.join(right, F.col("l_title") == F.col("r_title")).filter((u % 8 == 2) & (turn < 3)).select(
        F.col("l_record_id").alias("record_url"), F.lit("crossref").alias("source"), F.col("r_record_id").alias("external_id"),
        F.when(turn == 2, F.sha2(mark, 256)).otherwise(mark).alias("fingerprint"), F.when(turn == 1, "distinct").otherwise("equivalent").alias("decision"),
    )


@check("f08_decided_records", f"""SELECT * EXCLUDE (cats, title, evl) FROM ({resolved_sql(
    SPARSE_ENRICHED, has1="(u % 2 = 0 AND (u % 8 <> 2 OR u // 8 % 4 = 0))", unclear1="(u % 8 = 2 AND u // 8 % 4 >= 2)")})""")
def _(t):
    candidates, works = signed(sparse_enriched(t)), named_works(t)
    failed = candidates.filter("record_url LIKE '%-7'").select("record_url")
    out, _evidence = resolve_records(candidates, works, second_works(t), WINDOW, lookup_failed=failed, decisions=identity_decisions(candidates, works))
    return out.select("record_url", "reason_code", "work_id", "work_type", "freshness", "freshness_event", "publication_date")


def run_events(t: Tables):
    """Change events on the keys of the sparse records."""
    return t.v_change_events.withColumn("record_key", F.concat("record_key", F.lit("-"), (F.col("event_id") % 67).cast("string")))


def enriched_sql(start: str, end: str) -> str:
    """Merged records with the latest change inside a window."""
    return SPARSE_ENRICHED.replace(
        "(event_id % 67) AS record_key) FROM v_change_events)",
        f"(event_id % 67) AS record_key) FROM v_change_events WHERE changed_at >= TIMESTAMP '{start}' AND changed_at < TIMESTAMP '{end}')",
    )


IN_WINDOW = enriched_sql(START, END)


def matched_sql(resolved: str, interest: tuple = ("click", "view"), notified: str = "FALSE") -> str:
    return f"""
    WITH r AS ({resolved}), ev2 AS (SELECT work_id AS id, e.p AS provider, e.r AS raw_type FROM (SELECT work_id, unnest(evl) AS e FROM r WHERE work_id IS NOT NULL)), m AS (
      SELECT work_id, CASE WHEN count(DISTINCT freshness) = 1 AND count(DISTINCT freshness_event) = 1 AND count(DISTINCT coalesce(publication_date, '')) = 1 THEN min(freshness) ELSE 'uncertain' END AS freshness,
        CASE WHEN count(*) = 1 THEN min(work_type) ELSE coalesce(min(ty2.again), min(work_type)) END AS work_type, list_distinct(flatten(list(cats))) AS cats, count(*) AS n
      FROM r LEFT JOIN (SELECT id, work_type AS again FROM ({resolved_types('FROM ev2')})) ty2 ON ty2.id = work_id WHERE work_id IS NOT NULL GROUP BY work_id)
    SELECT work_id, freshness, CASE WHEN work_type NOT IN ({sql_list(vocab.SUPPORTED_TYPES)}) THEN 'unsupported_work_type' WHEN freshness NOT IN ('confirmed_new', 'confirmed_source_arrival') THEN 'not_confirmed_new'
      WHEN list_contains(cats, 'error') THEN 'excluded_category_match' WHEN NOT list_has_any(cats, [{sql_list(interest)}]) THEN 'no_category_overlap' WHEN {notified} THEN 'already_notified' ELSE 'notify' END AS decision
    FROM m WHERE NOT (n > 1 AND work_type IN ('conflict', 'unknown'))"""


def seen_rows(t: Tables):
    m = merge.merge_feeds(sparse(t).filter("published_at < TIMESTAMP_NTZ '2024-01-05 00:00:00'"))
    return m.select("record_url", "title", "row_hash", "category_ids", F.col("observed_at").alias("first_seen"), F.col("observed_at").alias("last_seen"))


def empty_unresolved(t: Tables):
    """Stored retries: records of every tenth user, some no longer in any feed."""
    return t.v_unresolved.filter("attempts < 3").select(
        cat(F.col("record_url"), "-", (F.length("title") % 3 + 58).cast("string")).alias("record_url"), "title", "reason_code", "attempts", "last_attempt",
        (F.col("next_retry_at") - F.expr("INTERVAL 40 DAY")).alias("next_retry_at"),
    )


NEW_OR_DUE = f"""SELECT e.* FROM ({IN_WINDOW}) e WHERE record_url NOT IN (SELECT record_url || '-' || (event_id % 61) FROM v_feed_entries WHERE published_at < TIMESTAMP '2024-01-05')
    OR record_url IN (SELECT record_url || '-' || (length(title) % 3 + 58) FROM v_unresolved WHERE attempts < 3 AND next_retry_at - INTERVAL 40 DAY <= TIMESTAMP '{END}')"""


def weekly(t: Tables):
    log = t.events.limit(0).select(F.lit("").alias("work_id"), F.lit("").alias("kind"), F.col("ts").alias("matched_at"))
    return runs.weekly_run(
        sparse(t), run_events(t), first_works(t), second_works(t), profile_rows(t), WINDOW, seen_rows(t), empty_unresolved(t), log,
    )


@check("i03_weekly_run", matched_sql(resolved_sql(NEW_OR_DUE, "FALSE")))
def _(t):
    return weekly(t)["report"].select("work_id", "freshness", "decision")


@check("i03_weekly_notifications", f"""
    SELECT work_id, 'weekly_new_papers' AS kind FROM ({matched_sql(resolved_sql(NEW_OR_DUE, 'FALSE'))}) WHERE decision = 'notify'""")
def _(t):
    return weekly(t)["notifications"].select("work_id", "kind")


WANTED = f"""
    SELECT * FROM ({IN_WINDOW}) WHERE NOT (len(all_years) > 0 AND NOT list_contains(all_years, 2024)) AND (last_feed_date IS NULL OR date_in_window)
      AND NOT (last_feed_date IS NULL AND len(years) = 0 AND changed_at IS NULL)"""


@check("i04_on_demand", f"""
    WITH w AS ({WANTED}),
    m AS (SELECT *, changed_at IS NOT NULL AND last_feed_date IS NULL AND len(all_years) = 0 AND n_dois = 0 AND len(types) = 0 AND NOT coalesce(change_type IN ('preprint', 'workingpaper'), FALSE) AS undated,
        len(types) > 0 OR change_type IS NOT NULL OR list_contains(all_years, 2024) OR date_in_window OR changed_at IS NOT NULL AS eligible FROM w),
    p AS (SELECT *, n_dois = 1 OR row_number() OVER (PARTITION BY n_dois = 1 ORDER BY eligible DESC, record_url) <= 200 AS taken FROM m WHERE NOT undated),
    r AS ({resolved_sql('SELECT * FROM p WHERE taken', 'FALSE')})
    SELECT record_url, 'quarantined' AS stage FROM m WHERE undated UNION ALL SELECT record_url, 'deferred' FROM p WHERE NOT taken
    UNION ALL SELECT record_url, coalesce(reason_code, 'resolved') FROM r""")
def _(t):
    return runs.on_demand(
        sparse(t), run_events(t), first_works(t), second_works(t), profile_rows(t), WINDOW, budget=200
    )[1]


def search_inputs(t: Tables):
    groups = t.spark.createDataFrame([("g1", "click"), ("g1", "view"), ("g2", "purchase")], "root_id string, category_id string")
    excluded = t.spark.createDataFrame([("error",)], "category_id string")
    n = F.regexp_extract("title", r"(\d+)", 1)
    reviewed = t.v_unresolved.filter("attempts = 1").select(
        cat(F.col("record_url"), "-5/").alias("record_url"), cat("RECORD ", n, "!").alias("source_title"), F.lit("Lee, A.").alias("source_author"),
        cat("Verified ", n).alias("verified_title"), F.lit("Ann Lee").alias("verified_author"), F.lit(None).cast("string").alias("review_doi"),
        F.lit(2022).alias("review_year"),
    )
    return groups, excluded, reviewed


def search(t: Tables):
    groups, excluded, reviewed = search_inputs(t)
    rare = (F.col("category_id") == "error") & (F.col("event_id") % 50 != 0)
    shown = sparse(t).withColumn("title", cat("Lee, Ann: ", F.col("title"))).withColumn(
        "category_id", F.when(rare, "view").otherwise(F.col("category_id"))
    )
    return runs.paper_search(
        shown, second_works(t), groups, 2, excluded, reviewed, mode="any", years=(2015, 2023)
    )


RARE_ERRORS = _sparse_sql().replace(
    "AS record_url) FROM v_feed_entries)",
    "AS record_url, CASE WHEN category_id = 'error' AND event_id % 50 <> 0 THEN 'view' ELSE category_id END AS category_id) FROM v_feed_entries)",
)
SEARCH = f"""
    WITH m AS (SELECT *, CAST(split_part(title, ' ', 2) AS INTEGER) AS u FROM ({RARE_ERRORS})),
    rv AS (SELECT record_url || '-5' AS record_url, 2022 AS y FROM v_unresolved WHERE attempts = 1),
    v AS (SELECT m.*, CASE WHEN n_dois = 0 AND (len(years) = 0 OR list_contains(years, 2022)) THEN rv.y END AS y FROM m LEFT JOIN rv USING (record_url)),
    g AS (SELECT *, len(years) > 0 OR y IS NOT NULL AS pass FROM v),
    k AS (SELECT *, u % 15 = 0 OR (y IS NOT NULL AND u % 3 = 0 AND u // 3 % 3 < 2) AS unclear, u % 3 = 0 AS has FROM g WHERE pass),
    ev AS (SELECT record_url AS id, 'feed-description' AS provider, unnest(types) AS raw_type FROM k
      UNION ALL SELECT record_url, 'openalex', CASE u // 3 % 4 WHEN 1 THEN 'preprint' WHEN 3 THEN 'book' ELSE 'article' END FROM k WHERE has AND NOT unclear),
    it AS (SELECT k.record_url, cats, CASE WHEN has THEN 'W' || u WHEN doi IS NOT NULL THEN doi ELSE k.record_url END AS gid,
        coalesce(y, CASE WHEN has THEN CASE u // 3 % 3 WHEN 0 THEN 2024 WHEN 1 THEN 2020 END END) AS year, CASE WHEN has AND u % 2 = 0 THEN u % 11 END AS citations
      FROM k WHERE NOT unclear),
    ev3 AS (SELECT gid AS id, provider, raw_type FROM ev JOIN it ON it.record_url = ev.id), ty AS ({resolved_types('FROM ev3')}),
    gr AS (SELECT min(record_url) AS record_url, count(*) AS n_records, coalesce(min(ty.work_type), 'unknown') AS kind,
        CASE WHEN count(DISTINCT year) = 1 THEN min(year) END AS year, CASE WHEN count(DISTINCT citations) = 1 THEN min(citations) END AS citations, list_distinct(flatten(list(cats))) AS cats FROM it LEFT JOIN ty ON ty.id = gid GROUP BY gid),
    f AS (SELECT *, CASE WHEN list_contains(cats, 'error') THEN 'excluded_category' WHEN NOT list_has_any(cats, ['click', 'view', 'purchase']) THEN 'filtered_out'
        WHEN kind IN ('unknown', 'conflict') THEN 'type_unverified' WHEN kind NOT IN ({sql_list(vocab.SUPPORTED_TYPES)}) THEN 'unsupported_type' WHEN year IS NULL THEN 'year_unknown'
        WHEN year < 2015 OR year > 2023 THEN 'filtered_out' END AS drop_reason FROM gr)"""


@check("i05_paper_search", SEARCH + " SELECT record_url, n_records, kind AS work_type, year, citations FROM f WHERE drop_reason IS NULL", ints="year citations")
def _(t):
    return search(t)[0].select("record_url", "n_records", "work_type", "year", "citations")


@check("i05_search_set_aside", SEARCH + """
    SELECT reason, count(*) AS n FROM (SELECT 'year_review_pending' AS reason FROM g WHERE NOT pass UNION ALL SELECT 'identity_unverified' FROM k WHERE unclear
      UNION ALL SELECT drop_reason FROM f WHERE drop_reason IS NOT NULL) GROUP BY reason""")
def _(t):
    return search(t)[1].groupBy("reason").agg(F.count("*").alias("n"))


EARLY = "published_at < {0}'2024-01-03 00:00:00'"
WEEKS = [("2024-01-01 00:00:00", "2024-01-08 00:00:00"), ("2024-01-08 00:00:00", "2024-01-15 00:00:00"), ("2024-01-15 00:00:00", "2024-01-22 00:00:00")]
# the profile of the first week, and the one in force from 10 January on
INTERESTS = [("click", "view"), ("purchase", "view")]


def profile_versions(t: Tables) -> DataFrame:
    rows = [(1, v, at, "interest", c) for v, at in ((1, "2023-12-01 00:00:00"), (2, "2024-01-10 00:00:00")) for c in INTERESTS[v - 1]]
    rows += [(1, v, at, "excluded", "error") for v, at in ((1, "2023-12-01 00:00:00"), (2, "2024-01-10 00:00:00"))]
    return t.spark.createDataFrame(rows, "profile_id int, version int, effective_from string, role string, category_id string").withColumn(
        "effective_from", F.col("effective_from").cast("timestamp_ntz"))


def caught_up(t: Tables) -> str:
    """A baseline of what was there early, then three missing weeks on the state each leaves; the folder of the runs."""
    schedule = t.region.filter("r_regionkey = 0").select(F.lit(1).alias("profile_id"), F.lit("UTC").alias("zone"), F.lit(0).alias("weekday"), F.lit(6).alias("report_hour"))
    elsewhere = t.spark.createDataFrame([(1, "2023-12-25 00:00:00", "2024-01-01 00:00:00")], "profile_id int, window_start string, window_end string").select(
        "profile_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"))
    root, entries, changes = shared_path(t.spark, "catch-up"), sparse(t), run_events(t)
    merged = cut(merge.merge_feeds(entries))
    feeds = cut(entries.select("category_id").distinct())
    none = t.spark.createDataFrame([], "category_id string")
    failed = merged.filter("record_url LIKE '%-7'").select("record_url")
    start = runs.baseline_run(entries.filter(EARLY.format("TIMESTAMP_NTZ ")), feeds, none, "2024-01-01 00:00:00")
    tables.write_run(start, root, "baseline", "baseline", ("2024-01-01 00:00:00", "2024-01-01 00:00:00"))

    def week(window, profile, held, defer):
        return runs.weekly_run(
            entries, changes, first_works(t), second_works(t), profile, window, held["seen"], held["unresolved"], held["notified"],
            now="2024-01-23 00:00:00", feeds=feeds, baselines=held["baselines"], lookup_failed=failed, defer=defer,
            merged_feeds=merged,
        )

    runs.catch_up(schedule, profile_versions(t), elsewhere, "2024-01-23 00:00:00", week, root)
    return root


def catch_up_sql(wanted: str) -> str:
    early = MERGED.replace("FROM v_feed_entries", f"FROM (SELECT * REPLACE (record_url || '-' || (event_id % 61) AS record_url) FROM v_feed_entries WHERE {EARLY.format('TIMESTAMP ')})")
    parts = [f"known AS MATERIALIZED (SELECT record_url FROM ({early}))"]
    for k, week in enumerate(WEEKS):
        pool = "record_url NOT IN (SELECT record_url FROM known)" if k == 0 else f"record_url IN (SELECT record_url FROM r{k - 1} WHERE reason_code IS NOT NULL)"
        resolved = resolved_sql(f"SELECT * FROM ({enriched_sql(*week)}) WHERE {pool}", window=week)
        before = " OR ".join(f"work_id IN (SELECT work_id FROM n{j} WHERE decision = 'notify')" for j in range(k)) or "FALSE"
        parts.append(f"r{k} AS MATERIALIZED ({resolved})")
        parts.append(f"n{k} AS MATERIALIZED ({matched_sql(f'SELECT * FROM r{k}', INTERESTS[min(k, 1)], f'({before})')})")
    return f"WITH {', '.join(parts)} {wanted}"


@check("i06_catch_up", catch_up_sql(" UNION ALL ".join(
    f"SELECT 'week-{end[:10].replace('-', '')}T000000' AS run_id, work_id, freshness, decision FROM n{k}" for k, (_, end) in enumerate(WEEKS))))
def _(t):
    """Reports of three missing weeks of one profile, across a change of the profile."""
    return tables.read_run_table(t.spark, caught_up(t), "report").select("run_id", "work_id", "freshness", "decision")


@check("i06_deferred_records", catch_up_sql(" UNION ALL ".join(
    f"SELECT 'week-{WEEKS[k][1][:10].replace('-', '')}T000000' AS run_id, record_url, reason_code FROM r{k} WHERE reason_code IS NOT NULL" for k in (0, 1))))
def _(t):
    """Records that all weeks but the last left to a later one."""
    return tables.read_run_table(t.spark, caught_up(t), "deferred").select("run_id", "record_url", "reason_code")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Feed merge, profile expansion, matching and report groups in one plan."""
    configure(spark)
    t = Tables(spark, folder)
    kinds = t.events.select(F.col("event_type").alias("category_id")).distinct()
    leaves = kinds.select(
        "category_id", F.col("category_id").alias("name"), F.array(F.lit("all")).alias("parent_ids"),
        F.lit("all").alias("primary_parent_id"), F.lit(True).alias("active"),
    )
    root = t.region.filter("r_regionkey = 0").select(
        F.lit("all").alias("category_id"), F.lit("All").alias("name"), F.array().cast("array<string>").alias("parent_ids"),
        F.lit(None).cast("string").alias("primary_parent_id"), F.lit(True).alias("active"),
    )
    picked = spark.createDataFrame([("all", True)], "category_id string, include_descendants boolean")
    interest = taxonomy.expand_categories(root.unionByName(leaves), picked).filter("category_id <> 'error'")
    profile = interest.select(F.lit("interest").alias("role"), "category_id").unionByName(
        spark.createDataFrame([("excluded", "error")], "role string, category_id string")
    )
    merged = merge.merge_feeds(sparse(t), WINDOW)
    works = merged.select(
        F.col("record_url").alias("work_id"), "title", "observed_at", "category_ids", F.lit("article").alias("work_type"),
        F.when(F.col("date_in_window"), "confirmed_new").otherwise("confirmed_source_arrival").alias("freshness"),
        F.when(F.col("date_in_window"), "recently_published").otherwise("recently_arrived").alias("freshness_event"),
        F.col("last_feed_date").alias("publication_at"), F.col("first_feed_date").alias("availability_at"),
    )
    matched = taxonomy.match_works(works, profile)
    grouped = ranking.report_groups(matched.filter("decision = 'notify'"))
    return plain(grouped.select("report_group", "position", "work_id", "title", "matched", "sort_at"))


@check("flagship_report", f"""
    WITH m AS ({_sparse_sql()}), w AS (SELECT *, CASE WHEN date_in_window THEN 'published' ELSE 'arrived' END AS report_group,
      coalesce(CASE WHEN date_in_window THEN last_feed_date ELSE first_feed_date END, observed_at) AS sort_at FROM m WHERE NOT list_contains(cats, 'error'))
    SELECT report_group, row_number() OVER (PARTITION BY report_group ORDER BY sort_at DESC, lower(title), record_url) AS position, record_url AS work_id, title,
      array_to_string(cats, '|') AS matched, strftime(date_trunc('second', sort_at), '%Y-%m-%d %H:%M:%S') AS sort_at FROM w""")
def _(t):
    return flagship(t.spark, t.folder)
