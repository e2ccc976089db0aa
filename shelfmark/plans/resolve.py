"""Resolving merged feed records against two bibliographies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import normalise as N
from shelfmark.operators import gates, identity, reviews, types
from shelfmark.session import cut


def candidate_identities(candidates: DataFrame) -> DataFrame:
    """Merged candidates as identity rows; the display title gives title and author."""
    shown = N.split_display(F.col("title"))
    return identity.identities(
        candidates.select(F.col("record_url").alias("record_id"), shown["title"].alias("title"), shown["author"].alias("author"), "doi")
    )


def with_asked(candidates: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Candidates with ``asked``, the key of their look-up.

    A look-up depends on the shown title and the DOI only, so records that share both ask once;
    where ``decisions`` name single records, each record asks for itself.
    """
    title = F.coalesce(F.concat(F.length("title").cast("string"), F.lit(":"), "title"), F.lit("-"))
    facts = F.concat(title, F.coalesce(F.concat(F.lit("="), "doi"), F.lit("")))
    return candidates.withColumn("asked", facts if decisions is None else F.col("record_url"))


def asked_identities(candidates: DataFrame) -> DataFrame:
    """One identity row per ``asked`` of :func:`with_asked`, under it as the id."""
    return candidate_identities(candidates.select(F.col("asked").alias("record_url"), "title", "doi").distinct())


def work_identities(works: DataFrame) -> DataFrame:
    """Bibliography rows as identity rows keyed by ``work_key``."""
    return identity.identities(works.select(
        F.col("work_key").alias("record_id"), "title", F.try_element_at("authors", F.lit(1)).alias("author"), "doi", "value"
    ))


def best_works(wanted: DataFrame, works: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """``record_url`` with outcome and the fields of its unique equivalent work.

    ``wanted`` are candidate identities, written out; ``decisions`` are those on pairs with
    this bibliography (see ``reviews.decided_pairs``).
    """
    offered = cut(work_identities(works))
    near = cut(identity.near_pairs(wanted, offered).select("left_profile", "right_profile", "level"))
    picked = identity.pick_unique(identity.identity_counts(wanted, offered, near))
    if decisions is not None:
        picked = reviews.with_decisions(picked, reviews.decided_pairs(wanted, offered, near, decisions))
    fields = ["work_key", "doi", "title", "authors", "raw_type", "value", "precision", "event"]
    found = works.select(F.col("work_key").alias("match_id"), F.struct(*fields).alias("work"))
    return picked.join(found, "match_id", "left").select(F.col("record_id").alias("record_url"), "outcome", "n_review", "work")


def type_evidence(candidates: DataFrame, matched: dict[str, DataFrame]) -> DataFrame:
    """Evidence rows of each candidate: change log, feed hints, matched works."""
    hints = candidates.select("record_url", F.explode("type_hints").alias("raw_type")).select(
        "record_url", F.lit("feed-description").alias("provider"), "raw_type", F.lit("explicit-feed-label").alias("method")
    )
    changes = candidates.filter("change_type IS NOT NULL").select(
        "record_url", F.lit("change-log").alias("provider"), F.col("change_type").alias("raw_type"), F.lit("structured").alias("method")
    )
    rows = hints.unionByName(changes)
    for provider, found in matched.items():
        rows = rows.unionByName(found.filter("outcome = 'accepted' AND trim(work.raw_type) <> ''").select(
            "record_url", F.lit(provider).alias("provider"), F.col("work.raw_type").alias("raw_type"), F.lit("structured").alias("method")
        ))
    return rows.withColumnRenamed("record_url", "record_id")


def weighed_evidence(candidates: DataFrame, matched: dict[str, DataFrame], reviews: DataFrame | None) -> DataFrame:
    """Mapped evidence rows of each candidate, with its applicable document inspections."""
    columns = ["record_id", "provider", "safe_type", "canonical_type", "method"]
    mapped = types.mapped_evidence(type_evidence(candidates, matched)).select(*columns)
    if reviews is None:
        return mapped
    shown = N.split_display(F.col("title"))
    titles = candidates.select(F.col("record_url").alias("record_id"), N.title_norm(shown["title"]).alias("title_norm"))
    settled = types.applicable_reviews(types.resolve_mapped(mapped), titles, reviews)
    return mapped.unionByName(settled.select(
        "record_id", F.lit("document-review").alias("provider"), F.col("work_type").alias("safe_type"),
        F.col("work_type").alias("canonical_type"), F.lit("document-inspection").alias("method"),
    ))


def types_of_groups(evidence: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """``group, work_type`` resolved again from the evidence of all members.

    ``members`` holds ``(record_id, group)``.
    """
    return types.resolve_mapped(evidence.join(members, "record_id").drop("record_id"), group).select(group, "work_type")


def resolve_records(
    candidates: DataFrame, first: DataFrame, second: DataFrame, window: tuple, lookup_failed: DataFrame | None = None,
    held: DataFrame | None = None, type_reviews: DataFrame | None = None, decisions: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One row per candidate, a resolved work or a reason code, and the type evidence.

    ``first`` and ``second`` are the two bibliographies in order of precedence.
    Evidence is weighed in a fixed order: disagreeing titles, explicit review label, open identity
    review, failed look-up, DOI conflict, type failure, dated publication (first
    source, then second), and last the feed's own arrival evidence.  ``held``
    lists records with open identity pairs, ``lookup_failed`` those whose look-up
    did not finish; ``type_reviews`` are document inspections (see
    ``types.apply_type_reviews``), ``decisions`` identity decisions with their ``source``
    (``crossref`` or ``openalex``).  The second bibliography is only searched for records
    that the first gives no exactly dated event.
    """
    start, end = window
    candidates = cut(with_asked(candidates, decisions))  # read by both look-ups and by the evidence
    wanted = cut(asked_identities(candidates))

    def told(source: str) -> DataFrame | None:
        return None if decisions is None else decisions.filter(F.col("source") == source)

    one = best_works(wanted, first, told("crossref")).select(
        F.col("record_url").alias("asked"), F.col("outcome").alias("first_outcome"), F.col("n_review").alias("first_review"), F.col("work").alias("w1")
    )
    one = cut(one)
    settled = F.coalesce(F.col("w1.event").isNotNull() & F.col("w1.precision").isin("day", "second"), F.lit(False))
    open_ = one.filter(~settled).select(F.col("asked").alias("record_id"))
    two = best_works(cut(wanted.join(open_, "record_id", "left_semi")), second, told("openalex")).select(
        F.col("record_url").alias("asked"), F.col("outcome").alias("second_outcome"), F.col("n_review").alias("second_review"), F.col("work").alias("w2")
    )
    base = cut(
        candidates.join(one.join(two, "asked", "left"), "asked").drop("asked")
        .withColumn("second_review", F.coalesce("second_review", F.lit(0))).withColumn("second_outcome", F.coalesce("second_outcome", F.lit("none")))
    )
    evidence = weighed_evidence(candidates, {
        "crossref": base.select("record_url", F.col("first_outcome").alias("outcome"), F.col("w1").alias("work")),
        "openalex": base.select("record_url", F.col("second_outcome").alias("outcome"), F.col("w2").alias("work")),
    }, type_reviews)
    resolved = types.resolve_mapped(evidence).select(F.col("record_id").alias("record_url"), "work_type", "type_status")
    base = types.with_default_type(base, resolved, key="record_url")
    for name, rows in (("_failed", lookup_failed), ("_held", held)):
        if rows is None:
            base = base.withColumn(name, F.lit(False))
        else:
            mark = rows.select("record_url").distinct().withColumn(name, F.lit(True))
            base = base.join(mark, "record_url", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    shown = N.split_display(F.col("title"))
    explicit = N.explicit_review_label(shown["title"])
    none_found = F.col("w1").isNull() & F.col("w2").isNull()
    ambiguous = (
        F.col("_held") | (F.col("first_outcome") == "ambiguous") | (F.col("second_outcome") == "ambiguous")
        | (F.col("w1").isNull() & (F.col("first_review") > 0)) | (F.col("w2").isNull() & (F.col("second_review") > 0))
    )
    reason = (
        F.when(F.col("title_conflict"), "conflicting_titles").when(explicit, None).when(ambiguous, "semantic_identity_review_required")
        .when(none_found & F.col("_failed"), "old_work_check_incomplete")
        .when(F.col("w1.doi") != F.col("w2.doi"), "identifier_conflict")
        .when(F.col("type_status") == "conflict", "structured_work_type_conflict")
        .when(F.col("type_status") == "unknown", "unknown_structured_work_type")
    )
    dated_one = F.col("w1.value").isNotNull() & F.col("w1.event").isNotNull()
    dated_two = F.col("w2.value").isNotNull()
    chosen = base.withColumn("reason_code", reason).withColumn("explicit", explicit).withColumn(
        "value", F.when(dated_one, F.col("w1.value")).when(dated_two, F.col("w2.value"))
    ).withColumn(
        "precision", F.when(dated_one, F.col("w1.precision")).when(dated_two, F.col("w2.precision"))
    ).withColumn("source", F.when(dated_one, "crossref").when(dated_two, "openalex")).withColumn(
        "event", F.when(dated_one, F.col("w1.event")).when(dated_two, F.lit("recently_published"))
    ).withColumn("inferred", F.lit(False))
    fresh = gates.assess_freshness(chosen, start, end)
    # without decisive publication evidence the feed's own arrival decides
    years = F.concat(F.col("year_hints"), F.coalesce("change_year_hints", F.array().cast("array<int>")))
    stale = (F.size(years) > 0) & (F.array_max(years) < F.year(gates.instant(start)))
    arrival = F.when(stale, "newly_indexed_old_work").otherwise("confirmed_source_arrival")
    native = F.col("value").isNull() | (F.col("freshness") == "uncertain")
    arrival_event = (
        F.when(stale, "newly_indexed_old_work").when(F.col("changed_at").isNotNull(), "recently_changed")
        .otherwise("recently_arrived")
    )
    doi = F.coalesce("w1.doi", F.when(F.col("w1").isNull(), F.col("w2.doi")))
    ok = F.col("reason_code").isNull()
    outcome = fresh.select(
        "record_url", "reason_code",
        F.when(ok, F.when(F.col("explicit"), N.work_id(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("record_url")))
               .otherwise(N.work_id(doi, F.col("w2.work_key"), F.col("record_url")))).alias("work_id"),
        F.when(ok, F.coalesce(F.when(~F.col("explicit"), F.coalesce("w1.title", "w2.title")), shown["title"])).alias("title"),
        F.when(ok & ~F.col("explicit"), doi).alias("doi"),
        F.when(ok, F.when(F.col("explicit"), "book-review").otherwise(F.col("work_type"))).alias("work_type"),
        F.when(ok, F.when(F.col("explicit"), "uncertain").when(native, arrival).otherwise(F.col("freshness"))).alias("freshness"),
        F.when(ok, F.when(F.col("explicit"), "explicit_unsupported_bibliographic_form").when(native, arrival_event).otherwise(F.col("event"))).alias("freshness_event"),
        F.when(ok & ~F.col("explicit"), F.col("value")).alias("publication_date"),
        F.when(ok, F.coalesce("changed_at", "first_feed_date", "observed_at")).alias("availability_at"),
        "observed_at", "category_ids",
    )
    return outcome, evidence
