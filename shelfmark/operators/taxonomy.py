"""Jobs on the multi-parent category graph and on interest profiles.

A node table has ``category_id, name, parent_ids, primary_parent_id, active``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("parent_ids").alias("parent_id"), F.col("category_id").alias("child_id"))


def expand_by_root(nodes: DataFrame, selections: DataFrame) -> DataFrame:
    """``(root_id, category_id)``: each selected id with its active descendants.

    One join per level of the graph; a node already reached is not walked again,
    so several parents and shared branches cost nothing extra.  An inactive node
    ends its branch.  Each level is written to the shared folder.
    """
    links = cut(
        edges(nodes).join(nodes.filter("active").select(F.col("category_id").alias("child_id")), "child_id")
    )
    chosen = selections.join(nodes.filter("active").select("category_id"), "category_id", "left_semi")
    reached = cut(
        chosen.select(F.col("category_id").alias("root_id"), "category_id").distinct()
    )
    frontier = chosen.filter("include_descendants").select(
        F.col("category_id").alias("root_id"), F.col("category_id").alias("parent_id")
    ).distinct()
    while True:
        found = frontier.join(links, "parent_id").select("root_id", F.col("child_id").alias("category_id")).distinct()
        fresh = cut(found.join(reached, ["root_id", "category_id"], "left_anti"))
        if fresh.isEmpty():
            return reached
        reached = cut(reached.unionByName(fresh))
        frontier = fresh.select("root_id", F.col("category_id").alias("parent_id"))


def expand_categories(nodes: DataFrame, selections: DataFrame) -> DataFrame:
    return expand_by_root(nodes, selections).select("category_id").distinct()


def match_works(works: DataFrame, profile: DataFrame, notified: DataFrame | None = None) -> DataFrame:
    """Add matched and excluded categories and the ordered decision.

    ``profile`` holds ``(role, category_id)`` with roles ``interest`` and
    ``excluded``; ``works`` needs ``work_id, category_ids, work_type, freshness``.
    """
    from shelfmark.operators.gates import supported_type

    roles = profile.select("role", "category_id").distinct()
    hits = (
        works.select("work_id", F.explode("category_ids").alias("category_id")).join(roles, "category_id")
        .groupBy("work_id").agg(
            F.array_sort(F.collect_set(F.when(F.col("role") == "interest", F.col("category_id")))).alias("matched"),
            F.array_sort(F.collect_set(F.when(F.col("role") == "excluded", F.col("category_id")))).alias("excluded"),
        )
    )
    empty = F.array().cast("array<string>")
    joined = works.join(hits, "work_id", "left").withColumn("matched", F.coalesce("matched", empty)).withColumn(
        "excluded", F.coalesce("excluded", empty)
    )
    if notified is None:
        joined = joined.withColumn("_notified", F.lit(False))
    else:
        log = notified.select("work_id").distinct().withColumn("_notified", F.lit(True))
        joined = joined.join(log, "work_id", "left").withColumn("_notified", F.coalesce("_notified", F.lit(False)))
    confirmed = F.col("freshness").isin("confirmed_new", "confirmed_source_arrival")
    decision = (
        F.when(~supported_type(F.col("work_type")), "unsupported_work_type")
        .when(~confirmed, "not_confirmed_new")
        .when(F.size("category_ids") == 0, "awaiting_categories")
        .when(F.size("excluded") > 0, "excluded_category_match")
        .when(F.size("matched") == 0, "no_category_overlap")
        .when(F.col("_notified"), "already_notified")
        .otherwise("notify")
    )
    return joined.withColumn("decision", decision).drop("_notified")


def category_groups(nodes: DataFrame, profile_ids: DataFrame, selected: DataFrame) -> DataFrame:
    """``(root_id, category_id)`` groups of a search, held inside the profile."""
    return expand_by_root(nodes, selected).join(profile_ids.select("category_id").distinct(), "category_id", "left_semi")


def match_groups(members: DataFrame, groups: DataFrame, n_groups: int, mode: str = "any") -> DataFrame:
    """Items with ``in_scope``: any or all selected groups hit.

    ``members`` holds ``(item_id, category_id)`` rows.
    """
    if mode not in ("any", "all"):
        raise ValueError("mode must be 'any' or 'all'")
    hits = members.join(groups, "category_id").groupBy("item_id").agg(
        F.count_distinct("root_id").alias("n_hit")
    )
    needed = n_groups if mode == "all" else 1
    return members.select("item_id").distinct().join(hits, "item_id", "left").select(
        "item_id", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        (F.coalesce("n_hit", F.lit(0)) >= needed).alias("in_scope"),
    )


def alias_match(texts: DataFrame, nodes: DataFrame, rules: list[dict], context: str) -> DataFrame:
    """Interest texts -> categories by ordered regular-expression rules.

    Rules are configuration (``pattern, name, source``, optional
    ``include_descendants`` and ``needs_context``), so they become columns of one
    scan instead of a join on patterns.  ``outcome`` is ``selected`` for a unique
    active category name, ``ambiguous`` for several, ``unknown`` for none.
    """
    spec = "rule INT, name_key STRING, source STRING, include_descendants BOOLEAN"
    table = texts.sparkSession.createDataFrame(
        [
            (i, r["name"].strip().casefold(), r["source"], bool(r.get("include_descendants", False)))
            for i, r in enumerate(rules)
        ],
        spec,
    )
    tests = []
    for position, rule in enumerate(rules):
        re.compile(rule["pattern"])
        test = F.col("text").rlike(rule["pattern"])
        if rule.get("needs_context"):
            test = test & F.col("text").rlike(context)
        tests.append(F.when(test, F.lit(position)))
    hit = texts.select("text_id", F.explode(F.array_compact(F.array(*tests))).alias("rule"))
    names = nodes.filter("active").groupBy(F.lower(F.trim("name")).alias("name_key")).agg(
        F.count("*").alias("n_named"), F.min("category_id").alias("category_id")
    )
    named = F.broadcast(table).join(names, "name_key", "left")  # one row per rule
    outcome = F.when(F.col("n_named") == 1, "selected").when(F.col("n_named") > 1, "ambiguous").otherwise("unknown")
    return hit.join(F.broadcast(named), "rule").select(
        "text_id", "rule", F.col("name_key").alias("name"), "source", "include_descendants",
        F.when(F.col("n_named") == 1, F.col("category_id")).alias("category_id"), outcome.alias("outcome"),
    )


def cyclic_edges(nodes: DataFrame) -> DataFrame:
    """Edges left after repeatedly peeling parents that are nobody's child and
    children that are nobody's parent: exactly the edges on or between cycles."""
    left = cut(edges(nodes).distinct())
    size = left.count()
    while size:
        kept = cut(
            left.join(left.select(F.col("child_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
            .join(left.select(F.col("parent_id").alias("child_id")).distinct(), "child_id", "left_semi")
            .select("parent_id", "child_id")
        )
        count = kept.count()
        if count == size:
            break
        left, size = kept, count
    return left


def taxonomy_violations(nodes: DataFrame, declared: int | None = None) -> DataFrame:
    """``(violation, category_id, detail)`` rows; an empty result is a sound snapshot."""
    def rows(df, kind, detail):
        return df.select(F.lit(kind).alias("violation"), "category_id", detail.cast("string").alias("detail"))

    counted = nodes.groupBy("category_id").agg(F.count("*").alias("n")).filter("n > 1")
    links = edges(nodes)
    missing = links.join(nodes.select(F.col("category_id").alias("parent_id")), "parent_id", "left_anti").withColumnRenamed(
        "child_id", "category_id"
    )
    stray = nodes.filter("primary_parent_id IS NOT NULL AND NOT array_contains(parent_ids, primary_parent_id)")
    parts = [
        rows(counted, "duplicate_id", F.col("n")),
        rows(nodes.filter("trim(name) = ''"), "empty_name", F.lit(None)),
        rows(missing, "missing_parent", F.col("parent_id")),
        rows(stray, "primary_parent_not_parent", F.col("primary_parent_id")),
        rows(cyclic_edges(nodes).withColumnRenamed("child_id", "category_id"), "cycle", F.col("parent_id")),
    ]
    if declared is not None:
        total = nodes.agg(F.count("*").alias("n")).filter(F.col("n") != declared)
        parts.append(rows(total.withColumn("category_id", F.lit(None).cast("string")), "declared_count", F.col("n")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def find_by_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Active exact-name hits; only a unique hit yields a category."""
    keyed = nodes.filter("active").groupBy(F.lower(F.trim("name")).alias("_key")).agg(
        F.count("*").alias("n_found"), F.min("category_id").alias("category_id")
    )
    wanted = names.select("name").distinct().withColumn("_key", F.lower(F.trim("name")))
    return wanted.join(keyed, "_key", "left").select(
        "name", F.coalesce("n_found", F.lit(0)).alias("n_found"),
        F.when(F.col("n_found") == 1, F.col("category_id")).alias("category_id"),
    )


def taxonomy_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and modified categories with change kinds and parent deltas.

    A removed category lists how many active new ones bear its name, and the
    first of them.
    """
    shape = F.struct("name", "parent_ids", "primary_parent_id", "active")
    both = (
        old.select("category_id", shape.alias("o"))
        .join(new.select("category_id", shape.alias("n")), "category_id", "full_outer")
    )
    sorted_equal = F.array_sort("o.parent_ids") == F.array_sort("n.parent_ids")
    kinds = F.array_compact(F.array(
        F.when(F.col("o.name") != F.col("n.name"), "renamed"),
        F.when(~sorted_equal, "parents_changed"),
        F.when(~F.col("o.primary_parent_id").eqNullSafe(F.col("n.primary_parent_id")), "primary_parent_changed"),
        F.when(F.col("o.active") != F.col("n.active"), "active_status_changed"),
    ))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size(kinds) > 0, "modified")
    names = new.filter("active").groupBy(F.lower(F.trim("name")).alias("_key")).agg(
        F.count("*").alias("n_same_name"), F.min("category_id").alias("same_name_id")
    )
    empty = F.array().cast("array<string>")
    changed = both.withColumn("change", change).filter("change IS NOT NULL").select(
        "category_id", "change",
        F.when(F.col("change") == "modified", kinds).otherwise(empty).alias("kinds"),
        F.when(F.col("change") == "modified", F.array_sort(F.array_except("n.parent_ids", "o.parent_ids"))).otherwise(empty).alias("added_parents"),
        F.when(F.col("change") == "modified", F.array_sort(F.array_except("o.parent_ids", "n.parent_ids"))).otherwise(empty).alias("removed_parents"),
        F.when(F.col("change") == "removed", F.lower(F.trim(F.col("o.name")))).alias("_key"),
    )
    return changed.join(names, "_key", "left").drop("_key")


def taxonomy_impact(old: DataFrame, new: DataFrame, tracked: DataFrame, feeds: DataFrame) -> DataFrame:
    """Effect of a new snapshot on tracked categories.

    ``tracked`` holds ``(category_id, role, include_descendants)``; ``feeds`` the
    configured feed categories.  Each affected id gets its roles, impact kinds
    and an action; ``overall`` repeats the worst state on every row.
    """
    confirmed = tracked.filter("role = 'confirmed'").select("category_id", "include_descendants")
    before = expand_categories(old, confirmed)
    after = expand_categories(new, confirmed)
    roles = (
        tracked.select("category_id", "role")
        .unionByName(before.select("category_id", F.lit("expanded").alias("role")))
        .unionByName(after.select("category_id", F.lit("expanded_new").alias("role")))
        .groupBy("category_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    )
    diff = taxonomy_diff(old, new).select("category_id", "change", "kinds")
    state = new.select("category_id", F.col("active").alias("new_active"))
    feed_ids = feeds.select("category_id").distinct().withColumn("has_feed", F.lit(True))
    rows = roles.join(diff, "category_id", "left").join(state, "category_id", "left").join(
        feed_ids, "category_id", "left"
    )
    was, now = F.array_contains("roles", "expanded"), F.array_contains("roles", "expanded_new")
    known = old.select("category_id", F.lit(True).alias("_in_old"))
    rows = rows.join(known, "category_id", "left")
    in_old, in_new = F.col("_in_old").isNotNull(), F.col("new_active").isNotNull()
    impacts = F.concat(
        F.array_compact(F.array(
            F.when(~in_old, "newly_expanded_category"), F.when(in_old & ~in_new, "removed"),
        )),
        F.when(F.col("change") == "modified", F.col("kinds")).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(in_old & in_new & ~F.col("new_active"), "inactive"),
            F.when(~was & now, "entered_expanded_interest_set"),
            F.when(was & ~now, "left_expanded_interest_set"),
        )),
    )
    feed = F.when(now & F.col("has_feed").isNull(), "missing").when(~now & F.col("has_feed").isNotNull(), "extra")
    lost = F.arrays_overlap("impacts", F.array(F.lit("removed"), F.lit("inactive")))
    scope = F.exists("impacts", lambda v: v.rlike("expanded"))
    judged = (
        rows.withColumn("impacts", impacts).withColumn("feed_state", feed)
        .filter((F.size("impacts") > 0) | F.col("feed_state").isNotNull())
        .withColumn("action", F.when(lost, "block_and_review_category_identity")
                    .when(scope, "review_scope_and_feed_baseline")
                    .when(F.size("impacts") > 0, "review_and_create_new_profile_version"))
    )
    worst = judged.agg(
        F.when(F.count_if(F.col("action") == "block_and_review_category_identity") > 0, "blocked")
        .when(F.count("*") > 0, "review_required").otherwise("ready").alias("overall")
    )
    return judged.select("category_id", "roles", "impacts", "feed_state", "action").withColumn("_one", F.lit(1)).join(
        F.broadcast(worst.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")


# Additions beyond which a scope change needs a warning.
BROAD_ADDITION = 10
VERY_BROAD_ADDITION = 50


def scope_estimate(nodes: DataFrame, requested: DataFrame, current: DataFrame) -> DataFrame:
    """One row of counts for an additive scope change, and how broad it is."""
    wanted = expand_categories(nodes, requested).withColumn("wanted", F.lit(1))
    held = current.select("category_id").distinct().withColumn("held", F.lit(1))
    counts = wanted.join(held, "category_id", "full_outer").agg(
        F.count("wanted").alias("requested"), F.count("held").alias("current"),
        F.count("*").alias("projected"),
        F.count_if(F.col("wanted").isNotNull() & F.col("held").isNull()).alias("added"),
        F.count_if(F.col("wanted").isNotNull() & F.col("held").isNotNull()).alias("already_covered"),
    )
    level = F.when(F.col("added") > VERY_BROAD_ADDITION, "very_broad").when(
        F.col("added") > BROAD_ADDITION, "broad"
    ).otherwise("bounded")
    return counts.withColumn("breadth", level).withColumn("warning_required", level != "bounded")


def scope_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(category_id, side)``: ``both``, ``left_only`` or ``right_only``."""
    a = left.select("category_id").distinct().withColumn("_a", F.lit(1))
    b = right.select("category_id").distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return a.join(b, "category_id", "full_outer").select("category_id", side.alias("side"))
