"""The three ways of use: weekly run with catch-up, on-demand window, search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import normalise as N
from shelfmark.operators import gates, graph, intervals, merge, ranking, reviews, state, taxonomy
from shelfmark.plans.resolve import asked_identities, best_works, resolve_records, types_of_groups, weighed_evidence, with_asked
from shelfmark.session import cut
from shelfmark.sources import tables


def works_with_categories(resolved: DataFrame, evidence: DataFrame) -> DataFrame:
    """Resolved rows merged per work id, with the union of their categories.

    The type of a work with several rows is resolved again from all their evidence.
    """
    works = resolved.filter("work_id IS NOT NULL")
    merged = merge.merge_work(works)
    extra = works.groupBy("work_id").agg(
        F.min("work_type").alias("_own"), F.min("availability_at").alias("availability_at")
    )
    again = types_of_groups(
        evidence, works.select(F.col("record_url").alias("record_id"), "work_id"), "work_id"
    ).withColumnRenamed("work_type", "_again")
    members = works.select("work_id", F.explode("category_ids").alias("category_id")).groupBy("work_id").agg(
        F.array_sort(F.collect_set("category_id")).alias("category_ids")
    )
    return (
        merged.join(extra, "work_id").join(again, "work_id", "left").join(members, "work_id", "left")
        .withColumn("work_type", F.when(F.col("n_rows") == 1, F.col("_own")).otherwise(F.coalesce("_again", "_own")))
        .withColumn("category_ids", F.coalesce("category_ids", F.array().cast("array<string>"))).drop("_own", "_again")
    )


class BaselineRequired(ValueError):
    """A configured feed has no baseline, so all it holds would count as new."""


def baseline_run(entries: DataFrame, feeds: DataFrame, baselines: DataFrame, at, seen: DataFrame | None = None) -> dict[str, DataFrame]:
    """Stores what feeds without a baseline hold now as seen, unreported; the state a first run starts from.

    ``feeds`` and ``baselines`` hold ``category_id``.  Feeds that have a baseline are not read.
    """
    fresh = feeds.select("category_id").distinct().join(baselines.select("category_id"), "category_id", "left_anti")
    merged = cut(state.establish_baseline(entries.join(fresh, "category_id", "left_semi"), baselines))
    spark = entries.sparkSession
    stored = seen if seen is not None else spark.createDataFrame([], SEEN)
    stamped = fresh.withColumn("established_at", gates.instant(at))
    known = baselines.select("category_id", "established_at") if "established_at" in baselines.columns else baselines.select(
        "category_id", F.lit(None).cast("timestamp_ntz").alias("established_at"))
    return {"seen": state.upsert_seen(stored, merged), "baselines": known.unionByName(stamped)}


SEEN = "record_url string, title string, row_hash string, category_ids array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz"
UNRESOLVED = "record_url string, title string, reason_code string, attempts int, last_attempt timestamp_ntz, next_retry_at timestamp_ntz"
NOTIFIED = "work_id string, kind string, matched_at timestamp_ntz"
TYPE_FAILURES = {"conflict": "structured_work_type_conflict", "unknown": "unknown_structured_work_type"}


def set_aside_works() -> Column:
    """Why a merged work is not reported: its rows name different DOIs, or their types disagree."""
    several = F.col("n_rows") > 1
    reason = F.when(F.col("doi_conflict"), "identifier_conflict")
    for kind, why in TYPE_FAILURES.items():
        reason = reason.when(several & (F.col("work_type") == kind), why)
    return reason


def weekly_run(
    entries: DataFrame, changes: DataFrame, first: DataFrame, second: DataFrame, profile: DataFrame, window: tuple,
    seen: DataFrame, unresolved: DataFrame, notified: DataFrame, max_attempts: int = 5, retry_days: int = 7,
    held: DataFrame | None = None, type_reviews: DataFrame | None = None, *, now=None, feeds: DataFrame | None = None,
    baselines: DataFrame | None = None, lookup_failed: DataFrame | None = None, decisions: DataFrame | None = None, defer: bool = False,
    merged_feeds: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables of one weekly run: report, notifications and the next state.

    New records and due retries are resolved, merged by work, matched to the
    profile and reported once; the resolved table is written out once and every
    branch reads it from there.  Works whose rows disagree on DOI or type leave the report,
    and their records are retried with the reason.

    With ``now``, a window that is not over is refused before any table is read; with ``feeds``
    and ``baselines``, so is a run over a feed without a baseline.  ``lookup_failed`` and
    ``decisions`` are those of :func:`resolve_records`.  With ``defer``, records without a
    work or with uncertain freshness are left to a later window: they are neither seen nor
    tried, and listed in ``deferred``.  ``merged_feeds`` is ``merge.merge_feeds(entries)``, where the
    caller has it written out: nothing here asks which feed dates lie in the window, so
    several weeks over the same entries merge them once.
    """
    start, end = window
    if now is not None:
        gates.refuse_open_window(entries.sparkSession, end, now)
    if feeds is not None and baselines is not None:
        bare = feeds.select("category_id").distinct().join(baselines, "category_id", "left_anti").orderBy("category_id").limit(20).collect()
        if bare:
            raise BaselineRequired(f"baseline required for feeds: {[r.category_id for r in bare]}")
    asked = end if now is None else now
    current = merge.merge_feeds(entries) if merged_feeds is None else merged_feeds
    if merged_feeds is None:
        current = cut(current)  # read by the candidates and by the next state
    due = state.due_retries(unresolved, asked, max_attempts).select("record_url", F.lit(True).alias("due"))
    held_back = seen.select("record_url", F.lit(False).alias("due")).unionByName(due).groupBy("record_url").agg(F.bool_or("due").alias("_due"))
    # new records and due retries, by one join: what is seen and not due stays out
    chosen = current.join(held_back, "record_url", "left").filter("_due IS NULL OR _due").drop("_due")
    candidates = merge.enrich_with_changes(chosen, merge.latest_active(gates.in_window(changes, start, end)))
    outcome, evidence = resolve_records(
        candidates, first, second, window, lookup_failed=lookup_failed, held=held, type_reviews=type_reviews, decisions=decisions
    )
    later = F.col("work_id").isNull() | (F.col("freshness") == "uncertain") if defer else F.lit(False)
    resolved = cut(outcome.withColumn("deferred", later))
    deferred = resolved.filter("deferred").select("record_url", "reason_code")
    resolved = resolved.filter("NOT deferred").drop("deferred")
    merged = cut(works_with_categories(resolved, evidence).withColumn("set_aside", set_aside_works()))
    works = merged.filter("set_aside IS NULL").drop("set_aside")
    aside = merged.filter("set_aside IS NOT NULL").select("work_id", "set_aside")
    decided = cut(taxonomy.match_works(works, profile, notified))
    matches = decided.filter("decision = 'notify'").select("work_id", F.lit("weekly_new_papers").alias("kind"), F.col("observed_at").alias("matched_at"))
    notifications = state.notify_once(matches, notified)
    told = resolved.join(aside, "work_id", "left").withColumn("reason_code", F.coalesce("reason_code", "set_aside"))
    attempted = told.select("record_url", "title", "reason_code").join(
        current.select("record_url", F.col("title").alias("_shown")), "record_url"
    ).select("record_url", F.coalesce("title", "_shown").alias("title"), "reason_code")
    return {
        "report": decided, "notifications": notifications,
        "unresolved": state.bump_retries(unresolved, attempted, asked, retry_days, max_attempts),
        "seen": state.upsert_seen(seen, current.join(deferred, "record_url", "left_anti")), "resolved": resolved, "deferred": deferred,
    }


def on_demand(
    entries: DataFrame, changes: DataFrame, first: DataFrame, second: DataFrame, profile: DataFrame, window: tuple,
    change_feed_ok: bool = True, attempts: DataFrame | None = None, budget: int | None = None, most: int | None = None,
    lookup_failed: DataFrame | None = None, type_reviews: DataFrame | None = None, decisions: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Report of one window without any state, and what became of each candidate.

    ``stage``: ``quarantined`` (only a change stamp speaks for it), ``deferred``
    (beyond the look-up budget) or ``resolved``.  Candidates with a DOI or a hint
    need no extra look-up and are free.
    """
    start, end = window
    merged = merge.merge_feeds(entries, window)
    if change_feed_ok:
        merged = merge.enrich_with_changes(merged, merge.latest_active(gates.in_window(changes, start, end)))
    else:
        merged = merge.enrich_with_changes(merged, merge.latest_active(changes.limit(0)))
    kept = cut(gates.window_candidates(merged, start, end, change_feed_ok))
    if most is not None:
        gates.budget_guard(kept, most)
    marked = kept.withColumn("undated", gates.undated_stock(kept)).withColumn("eligible", gates.arrival_eligible(kept, start, end))
    active = marked.filter("NOT undated").withColumn("cached", F.col("n_dois") == 1)
    tried = attempts if attempts is not None else kept.select("record_url", F.col("observed_at").alias("attempted_at")).limit(0)
    picked = cut(ranking.pick_for_lookup(active, tried, budget))
    candidates = picked.filter("lookup <> 'deferred'")
    outcome, evidence = resolve_records(
        candidates, first, second, window, lookup_failed=lookup_failed, type_reviews=type_reviews, decisions=decisions
    )
    resolved = cut(outcome)
    decided = taxonomy.match_works(works_with_categories(resolved, evidence), profile)
    stages = (
        marked.filter("undated").select("record_url", F.lit("quarantined").alias("stage"))
        .unionByName(picked.filter("lookup = 'deferred'").select("record_url", F.lit("deferred").alias("stage")))
        .unionByName(resolved.select("record_url", F.coalesce("reason_code", F.lit("resolved")).alias("stage")))
    )
    return decided, stages


def paper_search(
    entries: DataFrame, works: DataFrame, groups: DataFrame, n_groups: int, excluded: DataFrame, bibliography: DataFrame,
    mode: str = "any", work_types: list[str] | None = None, years: tuple[int | None, int | None] = (None, None),
    type_reviews: DataFrame | None = None, decisions: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All matching records (to be ranked and paged), and the records set aside with a reason.

    Steps: reviewed corrections (``bibliography``, see
    ``reviews.apply_bibliographic_reviews``), year gate before any look-up,
    identity, grouping by shared identifiers, then the filters in their order.
    """
    shown = N.split_display(F.col("title"))
    merged = cut(merge.merge_feeds(entries))
    facts = merged.select("record_url", shown["title"].alias("title"), shown["author"].alias("author"), "doi", "n_dois", "year_hints")
    corrected = reviews.apply_bibliographic_reviews(facts, bibliography).select(
        "record_url", F.col("title").alias("shown_title"), F.col("doi").alias("shown_doi"), "reviewed", "reviewed_year"
    )
    passes = (F.size("year_hints") > 0) | F.col("reviewed_year").isNotNull()
    bound = F.lit(years != (None, None))
    gated = cut(with_asked(merged.join(corrected, "record_url"), decisions).withColumn(
        "gate", F.when(~bound | passes, "pass").otherwise("year_review_pending")
    ))
    candidates = gated.filter("gate = 'pass'").withColumn("change_type", F.lit(None).cast("string"))
    matched = best_works(cut(asked_identities(candidates)), works, decisions).withColumnRenamed("record_url", "asked")
    known = cut(candidates.join(matched, "asked").drop("asked"))
    work_year = F.left("work.value", F.lit(4)).cast("int")
    other_year = F.col("reviewed") & F.coalesce(work_year != F.col("reviewed_year"), F.lit(False))
    unclear = (F.col("outcome") == "ambiguous") | (F.col("n_dois") > 1) | (F.col("n_review") > 0) | other_year
    identified = known.filter(~unclear)
    evidence = weighed_evidence(candidates, {"openalex": known.select("record_url", "outcome", "work")}, type_reviews)
    citations = works.select(F.col("work_key").alias("_key"), "citations")
    items = (
        identified.join(citations, F.col("work.work_key") == F.col("_key"), "left")
        .select(
            F.col("record_url").alias("record_id"), "record_url",
            F.when(F.col("reviewed"), F.col("shown_title")).otherwise(F.coalesce("work.title", "shown_title")).alias("title"),
            F.coalesce("work.doi", F.when(F.col("work").isNull(), F.col("shown_doi"))).alias("doi"), F.col("work.work_key").alias("provider_id"),
            F.coalesce(F.when(F.col("reviewed"), F.col("reviewed_year")), work_year).alias("year"), "citations", "category_ids",
        )
    )
    items = cut(items)
    grouped = graph.connected_records(items, ["doi", "provider_id", "record_url"])
    one = items.join(grouped, "record_id")
    merged_items = one.groupBy("group_id").agg(
        F.count("*").alias("n_records"), F.min("title").alias("title"), F.min("record_url").alias("record_url"), F.min("doi").alias("doi"),
        F.when(F.min("year") == F.max("year"), F.min("year")).alias("year"),
        F.when(F.min("citations") == F.max("citations"), F.min("citations")).alias("citations"),
    )
    kinds = types_of_groups(evidence, grouped, "group_id")
    merged_items = merged_items.join(kinds, "group_id", "left").withColumn("work_type", F.coalesce("work_type", F.lit("unknown")))
    members = one.select(F.col("group_id").alias("item_id"), F.explode("category_ids").alias("category_id")).distinct()
    scope = taxonomy.match_groups(members, groups, n_groups, mode).select(F.col("item_id").alias("group_id"), "in_scope")
    barred = members.join(excluded.select("category_id").distinct(), "category_id", "left_semi").select(
        F.col("item_id").alias("group_id")
    ).distinct().withColumn("is_excluded", F.lit(True))
    judged = merged_items.join(scope, "group_id", "left").join(barred, "group_id", "left").withColumn(
        "is_excluded", F.coalesce("is_excluded", F.lit(False))
    ).withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
    filtered = gates.search_filters(judged, work_types, *years)
    aside = (
        gated.filter("gate <> 'pass'").select("record_url", F.col("gate").alias("reason"))
        .unionByName(known.filter(unclear).select("record_url", F.lit("identity_unverified").alias("reason")))
        .unionByName(filtered.filter("drop_reason IS NOT NULL").select("record_url", F.col("drop_reason").alias("reason")))
    )
    return filtered.filter("drop_reason IS NULL").drop("drop_reason", "is_excluded", "in_scope"), aside


class TooManyWindows(ValueError):
    """More weeks are missing than one catch-up may run."""


class ProfileBoundary(ValueError):
    """A missing window fell due before the first stored version of the profile."""


def run_state(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The state that the newest committed run left: ``seen``, ``unresolved``, ``notified``, ``baselines``."""
    def newest(name: str, schema: str) -> DataFrame:
        if not tables.exists(spark, f"{root}/{name}"):
            return spark.createDataFrame([], schema)
        return tables.latest_version(spark, root, name).drop("run_id")

    sent = tables.read_run_table(spark, root, "notifications").drop("run_id") if tables.exists(spark, f"{root}/notifications") else spark.createDataFrame([], NOTIFIED)
    return {
        "seen": newest("seen", SEEN), "unresolved": newest("unresolved", UNRESOLVED), "notified": sent,
        "baselines": newest("baselines", "category_id string, established_at timestamp_ntz"),
    }


def due_windows(schedule: DataFrame, versions: DataFrame, runs: DataFrame, as_of) -> DataFrame:
    """Missing weeks with the instant each fell due and the profile version in force then (or NULL)."""
    keyed = schedule.select("profile_id", "zone", "report_hour")
    due = ranking.missing_windows(schedule, runs, as_of).join(keyed, "profile_id")
    local = ranking.to_local(F.col("window_end"), F.col("zone")) + F.make_dt_interval(F.lit(0), F.col("report_hour"))
    timed = due.withColumn("at", ranking.to_utc(local, F.col("zone")))
    stamps = versions.select("profile_id", "version", "effective_from").distinct()
    return intervals.profile_as_of(timed, stamps)


def catch_up(
    schedule: DataFrame, versions: DataFrame, runs: DataFrame, as_of,
    run: Callable[[tuple[str, str], DataFrame, dict[str, DataFrame], bool], dict[str, DataFrame]], root: str, most: int | None = None,
) -> list[str]:
    """Run every missing week of one profile in order, each on the state the last one committed.

    ``schedule`` is the profile's ``(profile_id, zone, weekday, report_hour)``, ``versions`` its
    snapshots as ``(profile_id, version, effective_from, role, category_id)``; ``runs`` are
    weeks committed elsewhere, those of ``root`` are found in its ledger, so a catch-up that
    stopped goes on after its last committed week.  ``run`` gets a window, the profile rows
    in force when it fell due, the state and whether to defer (all windows but the last
    leave uncertain records to later ones), and returns the tables of :func:`weekly_run`.

    Only the bounds of missing weeks come to the driver; with ``most``, more of them are
    refused.  A week that fell due before any stored version is refused before the first run.
    """
    spark = schedule.sparkSession
    columns = ["profile_id", "window_start", "window_end"]
    done = tables.ledger(spark, root).filter("run_kind = 'weekly'").select(*(F.col(c).cast("timestamp_ntz") for c in columns[1:]))
    done = schedule.select("profile_id").join(done, how="cross").unionByName(runs.select(*columns)).distinct()
    missing = due_windows(schedule, versions, done, as_of).orderBy("window_start").collect()
    if most is not None and len(missing) > most:
        raise TooManyWindows(f"more than {most} weeks are missing")
    if any(row.version is None for row in missing):
        raise ProfileBoundary("a week fell due before the first stored version of the profile")
    ran = []
    for place, row in enumerate(missing):
        window = (str(row.window_start), str(row.window_end))
        run_id = f"week-{row.window_end:%Y%m%dT%H%M%S}"
        profile = versions.filter((F.col("profile_id") == row.profile_id) & (F.col("version") == row.version)).select("role", "category_id")
        outputs = run(window, profile, run_state(spark, root), place < len(missing) - 1)
        tables.write_run(outputs, root, run_id, "weekly", window)
        ran.append(run_id)
    return ran
