"""Run state as tables: every update takes the last version and returns the next.

File tables have no MERGE, so an update is a full outer join on the table's key;
unchanged rows pass through.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.operators import merge
from shelfmark.operators.gates import instant


def establish_baseline(entries: DataFrame, baselined: DataFrame) -> DataFrame:
    """Merged records of the feeds that have no baseline yet, to be stored unreported."""
    fresh = entries.join(baselined.select("category_id").distinct(), "category_id", "left_anti")
    return merge.merge_feeds(fresh)


def upsert_seen(state: DataFrame, current: DataFrame) -> DataFrame:
    """Keep first_seen, replace last_seen, title and hash, only ever add categories.

    ``state``: ``record_url, title, row_hash, category_ids, first_seen, last_seen``;
    ``current``: ``record_url, title, row_hash, category_ids, observed_at``.
    """
    old = state.select("record_url", F.struct(*[c for c in state.columns if c != "record_url"]).alias("o"))
    new = current.select("record_url", F.struct("title", "row_hash", "category_ids", "observed_at").alias("n"))
    empty = F.array().cast("array<string>")
    both = old.join(new, "record_url", "full_outer")
    return both.select(
        "record_url",
        F.coalesce("n.title", "o.title").alias("title"),
        F.coalesce("n.row_hash", "o.row_hash").alias("row_hash"),
        F.array_sort(F.array_union(F.coalesce("o.category_ids", empty), F.coalesce("n.category_ids", empty))).alias("category_ids"),
        F.coalesce("o.first_seen", "n.observed_at").alias("first_seen"),
        F.coalesce(F.greatest("o.last_seen", "n.observed_at"), "o.last_seen").alias("last_seen"),
    )


def candidates_to_process(new: DataFrame, retries: DataFrame, current: DataFrame) -> DataFrame:
    """New records plus due retries; a retry uses the current version of its record,
    or the stored one when the feed no longer carries it."""
    columns = ["record_url", "title"]
    fresh = new.select(*columns, F.lit("new").alias("origin"))
    due = retries.join(new.select("record_url"), "record_url", "left_anti").select("record_url", F.col("title").alias("_stored"))
    again = due.join(current.select("record_url", F.col("title").alias("_current")), "record_url", "left").select(
        "record_url", F.coalesce("_current", "_stored").alias("title"),
        F.when(F.col("_current").isNotNull(), "retry_current").otherwise("retry_rebuilt").alias("origin"),
    )
    return fresh.unionByName(again)


def due_retries(unresolved: DataFrame, as_of, max_attempts: int) -> DataFrame:
    return unresolved.filter((F.col("attempts") < max_attempts) & (F.col("next_retry_at") <= instant(as_of)))


def bump_retries(unresolved: DataFrame, attempted: DataFrame, as_of, after_days: int, max_attempts: int) -> DataFrame:
    """Next version of the unresolved table.

    ``attempted`` holds this run's ``record_url, title, reason_code`` (NULL reason:
    resolved, so the row leaves).  Exhausted rows keep no next date.
    """
    old = unresolved.select("record_url", F.struct(*[c for c in unresolved.columns if c != "record_url"]).alias("o"))
    new = attempted.select("record_url", F.struct("title", "reason_code").alias("n"))
    tried = F.col("n").isNotNull()
    attempts = F.coalesce("o.attempts", F.lit(0)) + F.when(tried, 1).otherwise(0)
    later = instant(as_of) + F.make_dt_interval(F.lit(after_days))
    return (
        old.join(new, "record_url", "full_outer").filter(~tried | F.col("n.reason_code").isNotNull())
        .select(
            "record_url", F.coalesce("n.title", "o.title").alias("title"),
            F.coalesce("n.reason_code", "o.reason_code").alias("reason_code"), attempts.alias("attempts"),
            F.when(tried, instant(as_of)).otherwise(F.col("o.last_attempt")).alias("last_attempt"),
            F.when(attempts >= max_attempts, F.lit(None)).when(tried, later).otherwise(F.col("o.next_retry_at")).alias("next_retry_at"),
        )
    )


def notify_once(matches: DataFrame, log: DataFrame) -> DataFrame:
    """New notifications: at most one per work and kind, ever."""
    keys = ["work_id", "kind"]
    body = F.struct(*[c for c in matches.columns if c not in keys])
    first = matches.groupBy(*keys).agg(F.min_by(body, F.col("matched_at")).alias("b")).select(*keys, "b.*")
    return first.join(log.select(*keys).distinct(), keys, "left_anti")


def cache_lookup(queries: DataFrame, cache: DataFrame, now) -> DataFrame:
    """``hit``, ``negative_hit``, ``expired`` or ``miss`` per query from its newest entry."""
    keys = ["source", "query"]
    newest = cache.groupBy(*keys).agg(F.max_by(F.struct("status", "expires_at"), F.struct("cached_at", "seq")).alias("c"))
    state = (
        F.when(F.col("c").isNull(), "miss").when(F.col("c.expires_at") <= instant(now), "expired")
        .when(F.col("c.status") == "found", "hit").otherwise("negative_hit")
    )
    return queries.join(newest, keys, "left").select(*queries.columns, state.alias("cache_state"))


def cache_store(results: DataFrame, now, by_title: bool = False) -> DataFrame:
    """Cache rows of fresh look-ups with their expiry."""
    hit = f"INTERVAL {vocab.TITLE_MINUTES} MINUTE" if by_title else f"INTERVAL {vocab.HIT_HOURS} HOUR"
    lasting = F.when(F.col("status") == "found", instant(now) + F.expr(hit)).otherwise(
        instant(now) + F.expr(f"INTERVAL {vocab.MISS_MINUTES} MINUTE")
    )
    return results.withColumn("cached_at", instant(now)).withColumn("expires_at", lasting)


def quarantine(candidates: DataFrame, store: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Undated records kept out of look-ups for a year after they were last seen.

    ``candidates`` holds ``record_url, undated``.  Returns the candidates with
    ``quarantine`` (``new``, ``reused`` or NULL) and the next store version:
    rows with new evidence and rows past retention leave.
    """
    keep_from = instant(now) - F.expr(f"INTERVAL {vocab.QUARANTINE_DAYS} DAY")
    held = store.filter(F.col("last_seen") >= keep_from)
    joined = candidates.join(held.select("record_url", F.col("first_quarantined").alias("_first")), "record_url", "left")
    mark = F.when(F.col("undated"), F.when(F.col("_first").isNull(), "new").otherwise("reused"))
    marked = joined.withColumn("quarantine", mark)
    seen = marked.filter("undated").select(
        "record_url", F.coalesce("_first", instant(now)).alias("first_quarantined"), instant(now).alias("last_seen")
    )
    absent = held.join(candidates.select("record_url"), "record_url", "left_anti").select("record_url", "first_quarantined", "last_seen")
    return marked.drop("_first"), absent.unionByName(seen)


def attempt_rotation(log: DataFrame, tried: DataFrame, now) -> DataFrame:
    """Last attempt per record within the memory; failed transports are not recorded."""
    fresh = tried.filter("reason_code IS NULL OR reason_code <> 'old_work_check_incomplete'").select(
        "record_url", instant(now).alias("attempted_at")
    )
    oldest = instant(now) - F.expr(f"INTERVAL {vocab.ATTEMPT_DAYS} DAY")
    return (
        log.select("record_url", "attempted_at").unionByName(fresh).filter(F.col("attempted_at") >= oldest)
        .groupBy("record_url").agg(F.max("attempted_at").alias("attempted_at"))
    )


def upsert_issue_evidence(state: DataFrame, observed: DataFrame) -> DataFrame:
    """Reviewed rows win: pending observations never overwrite them, and the first
    review time does not change.  One observation per key."""
    keys = ["venue", "year", "issue", "evidence_url"]
    fields = ["label_month", "day", "status", "reviewed_at"]
    old = state.select(*keys, F.struct(*fields).alias("o"))
    new = observed.select(*keys, F.struct(*fields).alias("n"))
    reviewed = F.col("o.status") == "reviewed"
    shielded = reviewed & (F.col("n.status") == "pending")
    def newer(field, guard):
        return F.when(F.col("n").isNull() | F.coalesce(guard & F.col("o").isNotNull(), F.lit(False)), F.col(f"o.{field}")).otherwise(F.col(f"n.{field}"))
    return old.join(new, keys, "full_outer").select(
        *keys, newer("label_month", shielded).alias("label_month"), newer("day", shielded).alias("day"),
        newer("status", reviewed).alias("status"), newer("reviewed_at", reviewed).alias("reviewed_at"),
    )


def upsert_journal_issue(state: DataFrame, observed: DataFrame) -> DataFrame:
    """Replace last_seen and URL, keep first_seen, fill the month but never erase it."""
    old = state.select("issue_key", F.struct("first_seen", "last_seen", "label_month", "url").alias("o"))
    new = observed.select("issue_key", F.struct("seen_at", "label_month", "url").alias("n"))
    return old.join(new, "issue_key", "full_outer").select(
        "issue_key", F.coalesce("o.first_seen", "n.seen_at").alias("first_seen"),
        F.coalesce("n.seen_at", "o.last_seen").alias("last_seen"),
        F.coalesce("n.label_month", "o.label_month").alias("label_month"), F.coalesce("n.url", "o.url").alias("url"),
    )


def queue_merge(queue: DataFrame, links: DataFrame) -> DataFrame:
    """Insert new links as pending with their first source; known ones only get a new
    last_seen.  ``inserted`` marks the true inserts."""
    keys = ["grp", "url"]
    found = links.groupBy(*keys).agg(
        F.min_by("source_url", F.struct("seen_at", "source_url")).alias("source_url"), F.min("seen_at").alias("_from"), F.max("seen_at").alias("_to")
    )
    old = queue.select(*keys, F.struct("source_url", "status", "first_seen", "last_seen").alias("o"))
    return old.join(found.select(*keys, F.struct("source_url", "_from", "_to").alias("n")), keys, "full_outer").select(
        *keys, F.coalesce("o.source_url", "n.source_url").alias("source_url"),
        F.coalesce("o.status", F.lit("pending")).alias("status"),
        F.coalesce("o.first_seen", "n._from").alias("first_seen"),
        F.coalesce("n._to", "o.last_seen").alias("last_seen"), F.col("o").isNull().alias("inserted"),
    )


def queue_transition(queue: DataFrame, decisions: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Next queue version and refused decisions.

    Pending or blocked rows may become reviewed, blocked or dismissed; reviewed is
    final; a repeated block keeps its first time.  One decision per row.
    """
    keys = ["grp", "url"]
    d = decisions.select(*keys, F.col("decision"), F.coalesce("note", F.lit("")).alias("note"))
    joined = queue.join(d, keys, "full_outer")
    refusal = (
        F.when(F.col("decision").isNull(), None)
        .when(F.col("status").isNull(), "unknown_link")
        .when(~F.col("decision").isin("reviewed", "blocked", "dismissed"), "invalid_decision")
        .when(F.col("status") == "reviewed", "reviewed_is_final")
        .when((F.col("decision") == "reviewed") & ~F.col("status").isin("pending", "blocked"), "not_reviewable")
        .when((F.col("decision") != "reviewed") & (F.trim("note") == ""), "reason_missing")
    )
    judged = joined.withColumn("refusal", refusal)
    applied = F.col("decision").isNotNull() & F.col("refusal").isNull()
    starts = applied & (F.col("decision") == "blocked") & ((F.col("status") != "blocked") | F.col("blocked_since").isNull())
    after = judged.filter("status IS NOT NULL").select(
        *[c for c in queue.columns if c not in ("status", "blocked_since")],
        F.when(applied, F.col("decision")).otherwise(F.col("status")).alias("status"),
        F.when(starts, instant(now)).otherwise(F.col("blocked_since")).alias("blocked_since"),
    )
    return after, judged.filter("refusal IS NOT NULL").select(*keys, "decision", "refusal")


def daily_allowance(groups: DataFrame, scans: DataFrame, now) -> DataFrame:
    """Groups with ``allowed``: FALSE once scanned on the current local day.

    ``groups`` holds ``grp, zone``; scan instants are UTC.
    """
    def day(column, zone):
        return F.to_date(F.convert_timezone(F.lit("UTC"), zone, column))

    today = groups.withColumn("local_day", day(instant(now), F.col("zone")))
    lowest, highest = instant(now) - F.expr("INTERVAL 2 DAY"), instant(now) + F.expr("INTERVAL 2 DAY")
    recent = scans.filter((F.col("observed_at") >= lowest) & (F.col("observed_at") <= highest))
    used = (
        recent.join(groups, "grp").select("grp", day(F.col("observed_at"), F.col("zone")).alias("local_day")).distinct()
        .withColumn("_used", F.lit(True))
    )
    return today.join(used, ["grp", "local_day"], "left").withColumn("allowed", F.col("_used").isNull()).drop("_used")


def register_profile(profiles: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next profile table, and an outcome per new version: ``added``, ``unchanged`` or
    ``refused`` (other content under an existing version)."""
    keys = ["profile_id", "version"]
    held = profiles.select(*keys, F.col("content_hash").alias("_held"))
    judged = new.join(held, keys, "left").withColumn(
        "outcome", F.when(F.col("_held").isNull(), "added").when(F.col("_held") == F.col("content_hash"), "unchanged").otherwise("refused")
    ).drop("_held")
    added = judged.filter("outcome = 'added'").select(*profiles.columns)
    return profiles.unionByName(added), judged.select(*keys, "outcome")


def catalogue_upsert(articles: DataFrame, scanned: DataFrame, pages: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Articles after a scan, and its completed-scan rows.

    ``pages`` holds ``issue, complete`` from the page sequence check; articles of an
    issue with an incomplete page set commit nothing.  Of several rows of one title, the least
    known author stands.
    """
    from shelfmark.operators.journals import title_digest

    ready = pages.groupBy("issue").agg(F.bool_and("complete").alias("_ok")).filter("_ok").select("issue")
    fresh = scanned.join(ready, "issue", "left_semi").groupBy("issue", "title").agg(F.min("author").alias("author"))
    old = articles.select("issue", "title", F.struct("author", "first_observed", "last_observed").alias("o"))
    new = fresh.select("issue", "title", F.struct("author").alias("n"))
    after = old.join(new, ["issue", "title"], "full_outer").select(
        "issue", "title", F.coalesce("n.author", "o.author").alias("author"),
        F.coalesce("o.first_observed", instant(now)).alias("first_observed"),
        F.when(F.col("n").isNotNull(), instant(now)).otherwise(F.col("o.last_observed")).alias("last_observed"),
    )
    scans = fresh.groupBy("issue").agg(
        F.count("*").alias("article_count"), title_digest(F.col("title")).alias("title_digest")
    ).withColumn("last_completed", instant(now))
    return after, scans


def run_ledger_check(runs: DataFrame, queues: DataFrame, now) -> DataFrame:
    """Findings over the whole run log: windows, execution times and bound queues.

    ``runs``: ``run_id, mode, window_start, window_end, started_at, completed_at``;
    ``queues``: ``run_id, mode, window_start, window_end`` of the review queue.
    """
    q = queues.select(
        "run_id", F.col("mode").alias("_mode"), F.col("window_start").alias("_start"), F.col("window_end").alias("_end"),
        F.lit(True).alias("_queued"),
    )
    timed = F.col("started_at").isNotNull() & F.col("completed_at").isNotNull()
    findings = F.array_compact(F.array(
        F.when(F.col("window_start") >= F.col("window_end"), "window_start_not_before_end"),
        F.when(F.col("window_end") > instant(now), "window_not_over"),
        F.when(~timed, "execution_time_unverified"),
        F.when(timed & (F.col("window_end") > F.col("started_at")), "started_before_window_end"),
        F.when(timed & (F.col("completed_at") < F.col("started_at")), "completed_before_start"),
        F.when(timed & (F.col("completed_at") > instant(now)), "completed_in_future"),
        F.when(F.col("_queued").isNull(), "queue_not_supplied"),
        F.when(F.col("_queued") & F.col("_mode").isNotNull() & (F.col("_mode") != F.col("mode")), "queue_mode_differs"),
        F.when(F.col("_queued") & ((F.col("_start") != F.col("window_start")) | (F.col("_end") != F.col("window_end"))), "queue_window_differs"),
    ))
    return runs.join(q, "run_id", "left").select("run_id", findings.alias("findings"))


