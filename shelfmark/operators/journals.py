"""Jobs on journal issues, catalogues and searches of external sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import normalise as N
from shelfmark.operators import identity
from shelfmark.operators.gates import within
from shelfmark.session import cut


def title_digest(column: Column) -> Column:
    """A digest of a set of titles that does not depend on order and adds up over
    partitions, so no issue's titles are ever gathered in one place."""
    part = F.conv(F.substring(F.sha2(column, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.sum(part).cast("string")


def date_evidence(issues: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Add month and day from reviewed publisher evidence of the same bibliography.

    Explicit labels win over days; more than one month is a conflict, kept as such.
    """
    def keyed(df):
        return df.withColumn("_venue", N.title_norm(F.col("venue"))).withColumn("_issue", N.issue_no(F.col("issue")))

    facts = (
        keyed(reviewed.filter("status = 'reviewed'")).withColumn(
            "_day_month", F.when(F.year("day") == F.col("year"), F.month("day"))
        )
        .groupBy("_venue", "year", "_issue").agg(
            F.min("label_month").alias("_label_low"), F.max("label_month").alias("_label_high"),
            F.min("_day_month").alias("_day_low"), F.max("_day_month").alias("_day_high"),
            F.min("day").alias("_first_day"), F.max("day").alias("_last_day"),
            F.min(F.when(F.col("label_month").isNotNull() | F.col("day").isNotNull(), F.col("evidence_url"))).alias("date_evidence_url"),
        )
    )
    joined = keyed(issues).join(facts, ["_venue", "year", "_issue"], "left")
    own = F.col("label_month")
    # days speak only where neither the issue nor the evidence names a month
    use_days = own.isNull() & F.col("_label_low").isNull()
    low = F.least(own, F.col("_label_low"), F.when(use_days, F.col("_day_low")))
    high = F.greatest(own, F.col("_label_high"), F.when(use_days, F.col("_day_high")))
    conflict = F.coalesce(low != high, F.lit(False)) | F.coalesce(F.col("label_conflict"), F.lit(False))
    return joined.select(
        *[c for c in issues.columns if c not in ("label_month", "label_conflict")],
        F.when(~conflict, low).alias("label_month"), conflict.alias("date_conflict"),
        F.when(F.col("_first_day") == F.col("_last_day"), F.col("_first_day")).alias("day"), "date_evidence_url",
    )


def _names(df: DataFrame, column: str) -> Column:
    """Compact author names of a text or an array column, in order; NULL if there are none."""
    value = F.col(column)
    if dict(df.dtypes)[column] == "string":
        value = F.array(value)
    # folded as one text: a Python function cannot run inside an array transform
    folded = F.split(N.casefold(F.array_join(value, "\x1f")), "\x1f")
    names = F.filter(F.transform(folded, lambda v: F.regexp_replace(v, r"[^\p{L}\p{N}]", "")), lambda v: v != "")
    return F.when(F.size(names) > 0, names)


def corroborate(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Field-by-field comparison with the reviewed evidence of the same URL."""
    fields = ["title", "venue", "authors"]

    def text(df: DataFrame, field: str) -> Column:
        value = F.array_join(field, "\x1f") if dict(df.dtypes)[field].startswith("array") else F.col(field)
        return F.coalesce(F.translate(value, "\x1e", ""), F.lit(""))

    e = evidence.select("url", *[text(evidence, c).alias(f"e_{c}") for c in fields], *[F.col(c).alias(f"e_{c}") for c in ("year", "issue")])
    joined = records.select("url", *[text(records, c).alias(c) for c in fields], "year", "issue").join(e, "url")
    # all texts of a row are folded as one: each call of a Python function would carry a column of its own
    folded = F.split(N.casefold(F.concat_ws("\x1e", *fields, *[f"e_{c}" for c in fields])), "\x1e", -1)
    joined = joined.withColumn("_folded", folded)

    def bare(k: int) -> Column:
        return F.regexp_replace(F.col("_folded")[k], r"[^\p{L}\p{N}]", "")

    def names(k: int) -> Column:
        found = F.transform(F.split(F.col("_folded")[k], "\x1f"), lambda v: F.regexp_replace(v, r"[^\p{L}\p{N}]", ""))
        return F.filter(found, lambda v: v != "")

    known = F.col("year").isNotNull() & F.col("issue").isNotNull()
    conflicts = F.array_compact(F.array(
        F.when(~N.same_text(bare(0), bare(3)), "title"),
        F.when(~((F.size(names(2)) > 0) & (names(2) == names(5))), "authors"),
        F.when(~N.same_text(bare(1), bare(4)), "venue"),
        F.when(F.col("year") != F.col("e_year"), "year"),
        F.when(N.issue_no(F.col("issue")) != N.issue_no(F.col("e_issue")), "issue"),
    ))
    status = F.when(F.size(conflicts) > 0, "conflict").when(~known, "partial").otherwise("corroborated")
    return joined.select("url", conflicts.alias("conflicts"), status.alias("status"))


# Fields compared by ``cross_check``; a NULL on either side is not a conflict.
CHECK_FIELDS = ["venue", "year", "issue", "authors"]


def cross_check(records: DataFrame, others: DataFrame) -> DataFrame:
    """Best comparison of each record with other records of the same title.

    ``corroborated`` (all fields known and equal) beats ``partial`` (no conflict,
    something unknown) beats ``conflict``; no record of the title is
    ``unverified``, which never means absent.  Rows of a title are matched by
    equal keys over the fields both sides know, so a title borne by many records
    (every issue's editorial) yields no pairs.  Authors agree when the other
    record's list begins with this one's: it offers a key per prefix of its list.

    Equal rows are one class before any key is made, and keys are only made for the sets of known
    fields that occur on both sides; of these at most 16 of each side reach the driver.
    """
    def prepared(df, keep):
        compacted = df.withColumn("_title", N.compact(F.col("title"))).withColumn("_v_venue", N.compact(F.col("venue")))
        return compacted.select(
            keep, F.when(F.col("_title") != "", F.col("_title")).alias("_title"),
            F.when(F.col("_v_venue") != "", F.col("_v_venue")).alias("venue"), F.col("year").cast("string").alias("year"),
            N.issue_no(F.when(F.col("issue") != "", F.col("issue"))).alias("issue"),
            _names(df, "authors").alias("names"),
        ).filter("_title IS NOT NULL").withColumn("authors", F.array_join("names", "\x1e"))

    fields = ["_title", *CHECK_FIELDS, "names"]
    known = F.array_join(F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in CHECK_FIELDS])), ",")
    theirs = cut(prepared(others, F.col("record_id").alias("other_id")).groupBy(*fields).agg(
        F.min("other_id").alias("other_id")
    ).withColumn("known", known))
    # one text per class, in which a missing field differs from every value
    mark = F.sha2(F.to_json(F.struct("_title", *CHECK_FIELDS)), 256)
    rows = cut(prepared(records, F.col("url")).withColumn("class", mark).withColumn("known", known))
    ours = cut(rows.drop("url").distinct())

    def sets(df):
        return [tuple(f for f in r.known.split(",") if f) for r in df.select("known").distinct().collect()]

    our_sets, their_sets = sets(ours), sets(theirs)

    def key(theirs_know: Column, fields) -> Column:
        """Title and the values of those of ``fields`` that this side knows; missing ones are skipped."""
        shared = F.concat_ws(",", *[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields])
        return F.concat_ws("\x1f", F.col("_title"), theirs_know, shared, *[F.col(f) for f in fields])

    any_of_title = F.concat_ws("\x1f", F.col("_title"), F.lit("*"))
    lengths = F.sequence(F.lit(1), F.size("names"))
    placed = theirs.select("*", F.posexplode_outer(F.when(F.col("names").isNotNull(), lengths)).alias("_place", "_length")).withColumn(
        "authors", F.array_join(F.slice("names", F.lit(1), F.col("_length")), "\x1e")
    )
    once = F.coalesce(F.col("_place"), F.lit(0)) == 0
    offered = [F.when(once, any_of_title), *[F.when(once | F.lit("authors" in mine), key(F.col("known"), mine)) for mine in our_sets]]
    asked = [F.struct(any_of_title.alias("probe"), F.lit(2).alias("rank"))]
    for has in their_sets:
        complete = (F.col("known") == ",".join(CHECK_FIELDS)) & F.lit(len(has) == len(CHECK_FIELDS))
        asked.append(F.struct(key(F.lit(",".join(has)), has).alias("probe"), F.when(complete, 0).otherwise(1).alias("rank")))
    index = placed.select("other_id", F.explode(F.array_distinct(F.array_compact(F.array(*offered)))).alias("probe")).groupBy("probe").agg(
        F.min("other_id").alias("other_id")
    )
    judged = (
        ours.select("class", F.explode(F.array(*asked)).alias("q")).select("class", "q.*").join(index, "probe").groupBy("class").agg(
            F.min("rank").alias("rank"), F.min(F.when(F.col("rank") == 0, F.col("other_id"))).alias("exact_id"),
            F.min(F.when(F.col("rank") == 1, F.col("other_id"))).alias("partial_id"),
        )
    )
    best = rows.select("url", "class").join(judged, "class").groupBy("url").agg(
        *[F.min(c).alias(c) for c in ("rank", "exact_id", "partial_id")]
    )
    rank = F.col("rank")
    status = F.when(rank == 0, "corroborated").when(rank == 1, "partial").when(rank == 2, "conflict").otherwise("unverified")
    return records.select("url").join(best, "url", "left").select(
        "url", status.alias("status"), F.coalesce("exact_id", "partial_id").alias("other_id")
    )


def _title_classes(df: DataFrame) -> DataFrame:
    """Add ``_title_key`` and, with an author and a year, ``_exact_key`` to rows with a title."""
    title, author = N.compact(F.col("title")), N.compact(F.col("first_author"))
    keyed = df.withColumn("_title_key", title).filter("_title_key <> ''")
    return keyed.withColumn("_exact_key", F.when(
        (author != "") & F.col("year").isNotNull(),
        F.concat(F.col("_title_key"), F.lit("\x1f"), author, F.lit("\x1f"), F.col("year").cast("string")),
    ))


def title_links(peers: DataFrame) -> DataFrame:
    """Distinct ``(class_key, peer_url)``: the URLs of each title, and of each title, first author and year."""
    keys = F.array_compact(F.array("_title_key", "_exact_key"))
    return _title_classes(peers).filter("peer_url IS NOT NULL").select(F.explode(keys).alias("class_key"), "peer_url").distinct()


def title_overlap(records: DataFrame, peers: DataFrame) -> DataFrame:
    """Records whose exact title another bibliography holds; nothing is merged.

    ``same_bibliography`` needs the first author and the year too, else
    ``needs_review``.  The ``n_links`` links are the rows of :func:`title_links`
    under ``class_key``, so a hot title is one count, not its URLs on every record.
    """
    counts = title_links(peers).groupBy("class_key").agg(F.count("*").alias("n_links"))
    every = counts.select(F.col("class_key").alias("_title_key"), F.col("n_links").alias("_n_title"))
    exact = counts.select(F.col("class_key").alias("_exact_key"), F.col("n_links").alias("_n_exact"))
    found = F.col("_n_exact").isNotNull()
    return _title_classes(records).join(every, "_title_key").join(exact, "_exact_key", "left").select(
        "url", F.when(found, "same_bibliography").otherwise("needs_review").alias("status"),
        F.when(found, F.col("_exact_key")).otherwise(F.col("_title_key")).alias("class_key"),
        F.coalesce("_n_exact", "_n_title").alias("n_links"),
    )


def title_overlap_with_links(records: DataFrame, peers: DataFrame) -> DataFrame:
    """The rows of :func:`title_overlap`, and under them every link of the classes they name.

    Rows with a ``url`` are records, rows with a ``peer_url`` are links: a record's links are those
    of its ``class_key``, each written once however many records share them.
    """
    overlap = cut(title_overlap(records, peers))
    links = title_links(peers).join(overlap.select("class_key").distinct(), "class_key", "left_semi")
    return overlap.unionByName(links, allowMissingColumns=True)


def article_hits(articles: DataFrame, external: DataFrame) -> DataFrame:
    """``hit``, ``review`` or ``miss`` of each article in one external source.

    Both sides are ``identity.identities`` with ``venue, year, issue``.  A hit is
    an equivalent with a known author whose venue, year and issue agree.
    """
    place = ["venue", "year", "issue"]
    articles, external = cut(articles), cut(external)
    near = cut(identity.near_counts(articles, external, equal_pairs=True))
    counts = identity.identity_counts(articles, external, counted=near)
    hits = identity.class_counts(articles, external, [
        identity.Route(["title_fold", *place], same=1), identity.Route(["doi", *place], same=1)
    ]).filter("n_same > 0").select("record_id")
    equal = near.filter("equal AND right_profile IS NOT NULL").select("left_profile", "right_profile")
    wanted = articles.select("record_id", F.col("profile").alias("left_profile"), *place)
    offered = external.select(F.col("profile").alias("right_profile"), *place).distinct()
    met = wanted.drop("record_id").distinct().join(equal, "left_profile").join(offered, ["right_profile", *place], "left_semi")
    placed = wanted.join(met, ["left_profile", *place], "left_semi").select("record_id")
    hit = hits.unionByName(placed).distinct().withColumn("_hit", F.lit(True))
    found = (F.col("n_equivalent") + F.col("n_review")) > 0
    return counts.join(hit, "record_id", "left").select(
        "record_id", F.when(F.col("_hit"), "hit").when(found, "review").otherwise("miss").alias("status")
    )


def completed_issues(articles: DataFrame, scans: DataFrame) -> DataFrame:
    """Issues whose current article count and titles equal their completed scan."""
    current = (
        articles.join(scans.select("issue", "last_completed"), "issue")
        .filter(F.col("last_observed") == F.col("last_completed"))
        .groupBy("issue").agg(F.count("*").alias("_n"), title_digest(F.col("title")).alias("_digest"))
    )
    complete = (F.col("_n") == F.col("article_count")) & (F.col("_digest") == F.col("title_digest"))
    return scans.join(current, "issue", "left").withColumn("complete", F.coalesce(complete, F.lit(False)))


def catalogue_search(articles: DataFrame, scans: DataFrame, terms: list[str]) -> DataFrame:
    """Articles of complete issues that contain a term, with the fields that do."""
    ready = completed_issues(articles, scans).filter("complete").select("issue", "last_completed")
    current = articles.join(ready, "issue").filter(F.col("last_observed") == F.col("last_completed"))
    wanted = [t for t in dict.fromkeys("".join(t.casefold().split()) for t in terms) if t]
    marks = []
    for field in ("title", "keywords", "abstract"):
        text = N.term_norm(F.col(field))
        test = F.lit(False)
        for term in wanted:
            test = test | text.contains(term)
        marks.append(F.when(test, F.lit(field)))
    return current.withColumn("matched_fields", F.array_compact(F.array(*marks))).filter(F.size("matched_fields") > 0).drop(
        "last_completed"
    )


def import_checked_catalogue(articles: DataFrame, issues: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Gate of hand-checked catalogues, one row per issue with the reasons against it.

    ``issues`` holds ``issue, declared_count, declared_date`` and how it was
    reviewed; an accepted issue has no reasons.  ``sizes`` bounds the articles of an issue.
    """
    held = articles.groupBy("issue").agg(
        F.count("*").alias("n"), F.count_distinct("title").alias("n_titles"),
        F.count_if(F.trim("title") == "").alias("n_blank"),
    )
    reviewed = issues.groupBy("issue").agg(
        F.count("*").alias("n_reviews"), F.min("declared_count").alias("declared"), F.min("declared_date").alias("_low"),
        F.max("declared_date").alias("_high"),
    )
    n = F.coalesce("n", F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(F.col("n_reviews").isNull(), "issue_not_reviewed"),
        F.when(F.col("n_reviews") > 1, "issue_reviewed_twice"),
        F.when(F.col("_low") != F.col("_high"), "dates_disagree"),
        F.when(F.col("declared") != n, "count_mismatch"),
        F.when(F.col("n_titles") != n, "titles_repeat"),
        F.when(F.col("n_blank") > 0, "blank_title"),
        *([F.when(~n.between(*sizes), "size_out_of_bounds")] if sizes else []),
    ))
    return held.join(reviewed, "issue", "full_outer").select("issue", n.alias("n"), reasons.alias("reasons"))


def locate_targets(targets: DataFrame, lists: DataFrame) -> DataFrame:
    """Where each target URL occurs over several result lists.

    ``lists`` holds ``(priority, list_name, position, url)``; the first list in
    priority order wins, a target in none is ``not_located``.
    """
    placed = lists.groupBy("url").agg(F.min(F.struct("priority", "position", "list_name")).alias("p"))
    return targets.select("url").distinct().join(placed, "url", "left").select(
        "url", F.coalesce("p.list_name", F.lit("not_located")).alias("list_name"), F.col("p.position").alias("position")
    )


def first_review_in_window(issues: DataFrame, start, end) -> DataFrame:
    """First review of each issue, kept only if it falls inside the window."""
    first = issues.filter("status = 'reviewed'").groupBy("venue", "year", "issue").agg(
        F.min("reviewed_at").alias("reviewed_at"),
        F.min_by("evidence_url", F.struct("reviewed_at", "evidence_url")).alias("evidence_url"),
    )
    return first.filter(within(F.col("reviewed_at"), start, end)).orderBy(F.desc("reviewed_at"), F.desc("venue"), F.desc("year"), F.desc("issue"))


def distinct_leads(issues: DataFrame) -> DataFrame:
    """One row per issue: the first in display order (newest day, then evidence URL)."""
    body = F.struct(*[c for c in issues.columns if c not in ("venue", "year", "issue")])
    order = F.struct(F.coalesce(-F.unix_date("day"), F.lit(0)), F.col("evidence_url"))
    return issues.groupBy("venue", "year", "issue").agg(F.min_by(body, order).alias("b")).select("venue", "year", "issue", "b.*")


def issues_in_window(issues: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Reviewed issues by exact day, or by label month within the months of the range."""
    lo, hi = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    month = F.make_date("year", "label_month", F.lit(1))
    by_month = month.between(F.trunc(lo, "month"), F.trunc(hi, "month"))
    return issues.filter("status = 'reviewed'").filter(
        F.when(F.col("day").isNotNull(), F.col("day").between(lo, hi)).otherwise(by_month)
    )


def arrival_intervals(checks: DataFrame) -> DataFrame:
    """Per article and source: last complete miss before the first hit, the first
    hit, the latest status and what the pair of them proves."""
    first = checks.groupBy("article_id", "source").agg(
        F.min(F.when(F.col("status") == "hit", F.col("checked_at"))).alias("first_hit"),
        F.max_by("status", F.struct("checked_at", "status")).alias("latest_status"),
    )
    miss = (F.col("status") == "miss") & F.col("complete")
    before = F.col("first_hit").isNull() | (F.col("checked_at") < F.col("first_hit"))
    misses = checks.filter(miss).join(first.select("article_id", "source", "first_hit"), ["article_id", "source"]).filter(before).groupBy(
        "article_id", "source"
    ).agg(F.max("checked_at").alias("last_complete_miss"))
    evidence = (
        F.when(F.col("first_hit").isNotNull() & F.col("last_complete_miss").isNotNull(), "interval_censored")
        .when(F.col("first_hit").isNotNull(), "left_censored")
        .when(F.col("last_complete_miss").isNotNull(), "right_censored_on_search_surface").otherwise("unknown")
    )
    return first.join(misses, ["article_id", "source"], "left").withColumn("arrival_evidence", evidence)


def arrival_summary(intervals: DataFrame) -> DataFrame:
    hit, miss = F.col("first_hit").isNotNull(), F.col("last_complete_miss").isNotNull()
    return intervals.groupBy("source").agg(
        F.count("*").alias("observed_articles"), F.count_if(hit).alias("ever_hit"),
        F.count_if(~hit & miss).alias("searched_without_hit"),
        F.count_if(F.col("arrival_evidence") == "interval_censored").alias("arrival_intervals"),
        F.count_if(F.col("arrival_evidence") == "unknown").alias("unknown_or_failed"),
    )


STATUSES = ["hit", "miss", "review", "failed", "incomplete", "unavailable", "unchecked"]


def issue_coverage(articles: DataFrame, scans: DataFrame, reviews: DataFrame, checks: DataFrame, sources: list[str]) -> DataFrame:
    """Per issue: completeness, decided types and interests, latest check per source.

    Denominators stay NULL until everything they count is decided; they are
    never filled with zero.
    """
    latest = checks.filter(F.col("source").isin(sources)).groupBy("article_id", "source").agg(
        F.max_by(F.struct("status", "complete"), F.struct("checked_at", "status")).alias("c")
    )
    # one row per article: the latest check of every source side by side
    wide = latest.groupBy("article_id").pivot("source", sources).agg(F.first("c"))
    r = reviews.select("article_id", "work_type", "interest")
    rows = articles.select("issue", "article_id", "title").join(r, "article_id", "left").join(wide, "article_id", "left")
    kind = F.coalesce("work_type", F.lit("unreviewed"))
    research = kind == "research"
    interest = F.when(research, F.coalesce("interest", F.lit("unreviewed")))
    aggregates = [F.count("*").alias("publisher_records")]
    for name in ("research", "other", "uncertain", "unreviewed"):
        aggregates.append(F.count_if(kind == name).alias(f"type_{name}"))
    for name in ("relevant", "irrelevant", "uncertain", "unreviewed"):
        aggregates.append(F.count_if(F.coalesce(interest == name, F.lit(False))).alias(f"interest_{name}"))
    for source in sources:
        status = F.coalesce(F.col(f"{source}.status"), F.lit("unchecked"))
        complete = F.coalesce(F.col(f"{source}.complete"), F.lit(False))
        for name in STATUSES:
            aggregates.append(F.count_if(status == name).alias(f"{source}_{name}"))
        aggregates.append(F.count_if(complete).alias(f"{source}_complete_queries"))
        aggregates.append(F.count_if(research & ~(complete & status.isin("hit", "miss"))).alias(f"{source}_unresolved"))
    sums = rows.groupBy("issue").agg(*aggregates)
    ready = completed_issues(articles, scans).select("issue", "complete")
    complete = F.coalesce("complete", F.lit(False))
    decided = complete & (F.col("type_unreviewed") == 0) & (F.col("type_uncertain") == 0)
    out = sums.join(ready, "issue", "left").withColumn("toc_complete", complete)
    out = out.withColumn("reference_denominator", F.when(complete, F.col("publisher_records")))
    out = out.withColumn("research_denominator", F.when(decided, F.col("type_research")))
    out = out.withColumn("interest_denominator", F.when(
        decided & (F.col("interest_unreviewed") == 0) & (F.col("interest_uncertain") == 0), F.col("interest_relevant")
    ))
    for source in sources:
        out = out.withColumn(f"{source}_visibility_denominator", F.when(
            F.col(f"{source}_unresolved") == 0, F.col("research_denominator")
        ))
    return out.drop("complete")


def article_review(reviews: DataFrame, decisions: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New review table and rejected decisions.

    A decision needs an exact collected article and URL; an interest needs the
    research type.  The latest decision of an article wins.
    """
    known = articles.select("article_id", F.col("url").alias("_url"))
    joined = decisions.join(known, "article_id", "left")
    reason = (
        F.when(F.col("_url").isNull() | (F.col("_url") != F.col("article_url")), "article_not_collected")
        .when(~F.col("work_type").isin("research", "other", "uncertain"), "invalid_work_type")
        .when(~F.col("interest").isin("relevant", "irrelevant", "uncertain", "unreviewed"), "invalid_interest")
        .when((F.col("work_type") != "research") & (F.col("interest") != "unreviewed"), "interest_needs_research")
    )
    judged = joined.withColumn("reason", reason).drop("_url")
    columns = ["article_id", "work_type", "interest", "reviewed_at"]
    accepted = judged.filter("reason IS NULL").select(*columns)
    latest = reviews.select(*columns).unionByName(accepted).groupBy("article_id").agg(
        F.max_by(F.struct("work_type", "interest", "reviewed_at"), F.struct("reviewed_at", "work_type", "interest")).alias("r")
    ).select("article_id", "r.*")
    return latest, judged.filter("reason IS NOT NULL")


