"""Ordering, pages, budgets and calendar windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.gates import instant
from shelfmark.session import cut_in_order


def with_position(df: DataFrame, order: list[Column], groups: list[str] | None = None, name: str = "position") -> DataFrame:
    """Number rows from 1 in a total order, per group, without one task per group.

    The rows are range-sorted and written once; each partition then only needs
    the count of rows before it, a table of partitions times groups.
    """
    groups = groups or []
    ordered = df.orderBy(*[F.col(g) for g in groups], *order)
    placed = cut_in_order(
        ordered.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    )
    sizes = placed.groupBy("_part", *groups).agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        placed.join(offsets, ["_part", *groups])
        .withColumn(name, F.col("_before") + F.col("_seq") - F.col("_first") + 1)
        .drop("_part", "_seq", "_first", "_before")
    )


def result_order() -> list[Column]:
    """Known citations first and descending, then year, title and URL."""
    return [
        F.col("citations").desc_nulls_last(), F.coalesce(F.col("year"), F.lit(0)).desc(),
        F.lower("title"), F.col("record_url"),
    ]


def rank_results(items: DataFrame, numbered: bool = True) -> DataFrame:
    if numbered:
        return with_position(items, result_order())
    return items.orderBy(*result_order())


def page_facts(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """One row about a page: how many rows match, whether more follow, and where the next page starts."""
    end = F.lit(offset + (limit or 0)).cast("bigint")
    more = (F.col("total") > end) if limit is not None else F.lit(False)
    return rows.agg(F.count("*").alias("total")).select("total", more.alias("has_more"), F.when(more, end).alias("next_offset"))


def paginate(items: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of the ranked results, or all; :func:`page_facts` tells the rest."""
    ranked = items.orderBy(*result_order())
    if offset:
        ranked = ranked.offset(offset)
    return ranked if limit is None else ranked.limit(limit)


def next_page(items: DataFrame, last: dict, limit: int) -> DataFrame:
    """The page after a known last row; its cost does not grow with the page number."""
    year = F.coalesce(F.col("year"), F.lit(0))
    tail = (F.lower("title") > last["title"].lower()) | (
        (F.lower("title") == last["title"].lower()) & (F.col("record_url") > last["record_url"])
    )
    last_year = last.get("year") or 0
    after = (year < last_year) | ((year == last_year) & tail)
    cited = F.col("citations")
    if last.get("citations") is None:
        keep = cited.isNull() & after
    else:
        keep = cited.isNull() | (cited < last["citations"]) | ((cited == last["citations"]) & after)
    return items.filter(keep).orderBy(*result_order()).limit(limit)


def report_groups(matches: DataFrame, numbered: bool = True) -> DataFrame:
    """Published, changed and arrived works, newest first by the group's own date."""
    group = (
        F.when(F.col("freshness") == "confirmed_new", "published")
        .when(F.col("freshness_event") == "recently_changed", "changed")
        .otherwise("arrived")
    )
    shown = F.when(group == "published", F.col("publication_at")).otherwise(F.col("availability_at"))
    placed = matches.withColumn("report_group", group).withColumn("sort_at", F.coalesce(shown, F.col("observed_at")))
    order = [F.col("sort_at").desc(), F.lower("title"), F.col("work_id")]
    if numbered:
        return with_position(placed, order, ["report_group"])
    return placed.orderBy("report_group", *order)


def pick_for_lookup(candidates: DataFrame, attempts: DataFrame, budget: int | None = None) -> DataFrame:
    """Add ``lookup``: ``cached``, ``selected`` or ``deferred``.

    Cached rows are free.  The rest are ordered never tried, oldest try,
    eligible, id; only ``budget`` rows are sorted out, by a per-partition top-k.
    Without a budget all are selected.
    """
    if budget is None:
        return candidates.join(
            attempts.groupBy("record_url").agg(F.max("attempted_at").alias("last_attempt")), "record_url", "left"
        ).withColumn("lookup", F.when(F.col("cached"), "cached").otherwise("selected"))
    last = attempts.groupBy("record_url").agg(F.max("attempted_at").alias("last_attempt"))
    joined = candidates.join(last, "record_url", "left")
    chosen = (
        joined.filter("NOT cached")
        .orderBy(
            F.col("last_attempt").asc_nulls_first(), F.col("eligible").desc(), F.col("record_url")
        ).limit(budget).select("record_url", F.lit(True).alias("_chosen"))
    )
    state = F.when(F.col("cached"), "cached").when(F.col("_chosen"), "selected").otherwise("deferred")
    return joined.join(chosen, "record_url", "left").withColumn("lookup", state).drop("_chosen")


def fair_budget(groups: DataFrame, total: int, per_group: int, ordinal: int) -> DataFrame:
    """Share ``total`` units round-robin over groups from a rotating start.

    At most ``total`` units exist, so a top-k of ``total`` rows is enough.
    """
    numbered = with_position(groups.select("grp").distinct(), [F.col("grp")], name="slot")
    n = numbered.count()
    rotated = F.pmod(F.col("slot") - 1 - F.lit(ordinal), F.lit(max(n, 1)))
    units = numbered.withColumn("turn", rotated).withColumn("unit", F.explode(F.sequence(F.lit(1), F.lit(per_group))))
    given = units.orderBy("unit", "turn").limit(total).groupBy("grp").agg(F.count("*").alias("units"))
    return groups.select("grp").distinct().join(given, "grp", "left").withColumn("units", F.coalesce("units", F.lit(0)))


def due_checks(articles: DataFrame, checks: DataFrame, now, hours: int, n: int) -> DataFrame:
    """The next ``n`` articles per journal: never checked first, then the oldest check;
    those checked within ``hours`` are skipped.
    """
    last = checks.groupBy("article_id").agg(F.max("checked_at").alias("last_checked"))
    joined = articles.join(last, "article_id", "left")
    order = [F.col("last_checked").asc_nulls_first(), F.col("article_id")]
    in_journal = Window.partitionBy("journal").orderBy(*order)
    rested = F.col("last_checked").isNull() | (
        F.col("last_checked") <= instant(now) - F.make_dt_interval(F.lit(0), F.lit(hours))
    )
    return (
        joined.filter(rested).withColumn("due_position", F.row_number().over(in_journal))
        .filter(F.col("due_position") <= n)
    )


def worklist_class(cutoff) -> tuple[Column, Column]:
    """Attention reason and priority class of a queue row."""
    unknown = (F.col("status") == "blocked") & F.col("blocked_since").isNull()
    long = (F.col("status") == "blocked") & (F.col("blocked_since") <= instant(cutoff))
    reason = F.when(unknown, "blocked_age_unknown").when(long, "long_blocked").otherwise(F.col("status"))
    rank = (
        F.when(unknown | F.coalesce(long, F.lit(False)), 0).when(F.col("status") == "pending", 1)
        .when(F.col("status") == "blocked", 2).otherwise(3)
    )
    return reason, rank


def worklist_rows(queue: DataFrame, status: str = "active") -> DataFrame:
    """The queue rows a worklist chooses from."""
    if status == "active":
        return queue.filter(F.col("status").isin("pending", "blocked"))
    return queue if status == "all" else queue.filter(F.col("status") == status)


def worklist(queue: DataFrame, cutoff, status: str = "active", limit: int | None = None, offset: int = 0) -> DataFrame:
    """All rows or a page: overdue and undated blocks, then pending newest first, then other blocks.

    ``page_facts(worklist_rows(queue, status), limit, offset)`` gives the count and the next page.
    """
    reason, rank = worklist_class(cutoff)
    placed = worklist_rows(queue, status).withColumn("attention_reason", reason).withColumn("_rank", rank)
    newest = F.when(F.col("status") == "pending", F.col("first_seen"))
    oldest = F.when(F.col("status") == "blocked", F.coalesce("blocked_since", "first_seen"))
    ordered = placed.orderBy("_rank", newest.desc_nulls_last(), oldest.asc_nulls_first(), "grp", "url")
    if offset:
        ordered = ordered.offset(offset)
    return (ordered if limit is None else ordered.limit(limit)).drop("_rank")


def query_plan(feeds: DataFrame, profile_terms: DataFrame, budget: int | None = None) -> DataFrame:
    """Search terms in order: each feed's first, the profile's, the feeds' others.

    ``feeds`` holds ``(feed_pos, terms)``, ``profile_terms`` ``(pos, term)``.
    Each term keeps its first place; ``planned`` marks those within the budget, all if there is none.
    """
    seeds = feeds.filter(F.size("terms") > 0).select(
        F.lit(0).alias("class"), F.col("feed_pos").alias("a"), F.lit(0).alias("b"), F.element_at("terms", 1).alias("term")
    )
    own = profile_terms.select(F.lit(1).alias("class"), F.col("pos").alias("a"), F.lit(0).alias("b"), "term")
    rest = feeds.select("feed_pos", F.posexplode("terms").alias("b", "term")).filter("b > 0").select(
        F.lit(2).alias("class"), F.col("feed_pos").alias("a"), "b", "term"
    )
    first = (
        seeds.unionByName(own).unionByName(rest).groupBy("term")
        .agg(F.min(F.struct("class", "a", "b")).alias("place"))
    )
    planned = first if budget is None else first.orderBy("place").limit(budget)
    planned = planned.select("term", F.lit(True).alias("_in"))
    return first.join(planned, "term", "left").select(
        "term", F.col("place.class").alias("term_class"), F.coalesce("_in", F.lit(False)).alias("planned")
    )


def query_plan_counts(feeds: DataFrame, plan: DataFrame) -> DataFrame:
    """Feeds whose first term made the plan, and terms outside the budget."""
    seeds = feeds.filter(F.size("terms") > 0).select("feed_pos", F.element_at("terms", 1).alias("term"))
    met = seeds.join(plan.filter("planned").select("term"), "term", "left_semi").agg(F.count("*").alias("planned_feeds"))
    outside = plan.agg(F.count_if(~F.col("planned")).alias("terms_outside_budget"), F.count("*").alias("terms"))
    return met.withColumn("_one", F.lit(1)).join(outside.withColumn("_one", F.lit(1)), "_one").drop("_one")


def date_review_worklist(leads: DataFrame, start) -> DataFrame:
    """Leads whose date is missing or in conflict, first observed since the window start."""
    return leads.filter(
        (F.col("first_observed") >= instant(start)) & (F.col("label_month").isNull() | F.col("date_conflict"))
    )


def to_local(column: Column, zone: Column | str) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone if isinstance(zone, Column) else F.lit(zone), column)


def to_utc(column: Column, zone: Column | str) -> Column:
    return F.convert_timezone(zone if isinstance(zone, Column) else F.lit(zone), F.lit("UTC"), column)


def latest_due_end(as_of: Column, zone: Column, weekday: Column, report_hour: Column) -> Column:
    """Local date on which the latest due week ended (weekday 0 is Monday)."""
    local = to_local(as_of, zone)
    day = F.to_date(local)
    behind = F.pmod(F.weekday(day) - weekday, F.lit(7))
    end = F.date_sub(day, behind)
    due = end.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), report_hour)
    return F.when(local < due, F.date_sub(end, 7)).otherwise(end)


def missing_windows(profiles: DataFrame, runs: DataFrame, as_of) -> DataFrame:
    """Every due week since a profile's first success that has no committed run.

    ``profiles`` holds ``(profile_id, zone, weekday, report_hour)``, ``runs``
    ``(profile_id, window_start, window_end)`` in UTC.  Weeks are counted on
    local dates, so their UTC length changes with daylight saving.
    """
    first = runs.groupBy("profile_id").agg(F.min("window_start").alias("_first"))
    end = latest_due_end(instant(as_of), F.col("zone"), F.col("weekday"), F.col("report_hour"))
    base = profiles.join(first, "profile_id", "left").withColumn("_end", end)
    weeks = F.when(
        F.col("_first").isNull(), F.lit(0)
    ).otherwise(
        F.greatest(F.lit(-1), F.floor(F.datediff("_end", F.to_date(to_local(F.col("_first"), F.col("zone")))) / 7) - 1)
    ).cast("int")
    each = base.withColumn("_weeks", weeks).filter("_weeks >= 0").select(
        "profile_id", "zone", "_end", F.explode(F.sequence(F.lit(0), F.col("_weeks"))).alias("_back")
    )
    end_day = F.date_sub(F.col("_end"), F.col("_back") * 7)
    windows = each.select(
        "profile_id",
        to_utc(F.date_sub(end_day, 7).cast("timestamp_ntz"), F.col("zone")).alias("window_start"),
        to_utc(end_day.cast("timestamp_ntz"), F.col("zone")).alias("window_end"),
    )
    return windows.join(runs.select("profile_id", "window_start", "window_end"), ["profile_id", "window_start", "window_end"], "left_anti")


def rolling_windows(requests: DataFrame) -> DataFrame:
    """UTC bounds of the last ``days`` (1 to 31) local days of each request.

    Other requests are ``refused`` and have no bounds; ``status`` says which.
    """
    local_end = to_local(F.col("requested_at"), F.col("zone"))
    start = to_utc(local_end - F.make_dt_interval(F.col("days")), F.col("zone"))
    fine = F.coalesce(F.col("days").between(1, 31), F.lit(False))
    return requests.withColumns({
        "status": F.when(fine, "accepted").otherwise("refused"), "window_start": F.when(fine, start), "window_end": F.when(fine, F.col("requested_at")),
    })
