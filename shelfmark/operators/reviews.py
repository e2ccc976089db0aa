"""Applying human decisions only while the evidence they were made on still stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions import normalise as N


def authors_compatible(left: Column, right: Column) -> Column:
    """TRUE, FALSE or NULL (not comparable) for two ``author_keys`` structs."""
    known = (left["surname"] != "") & (right["surname"] != "")
    initials = (left["initial"] == "") | (right["initial"] == "") | (left["initial"] == right["initial"])
    agree = (left["name_words"] == right["name_words"]) | ((left["surname"] == right["surname"]) & initials)
    return F.when(known, agree)


def pair_fingerprint(columns: list[str]) -> Column:
    """Binds a decision to every displayed fact of both records."""
    return N.row_hash(*[F.col(c) for c in columns])


def apply_identity_reviews(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per record: open pairs and the settled equivalents.

    ``pairs`` are review-required pairs with ``record_url, source, external_id,
    fingerprint``; ``reviews`` add ``decision``.  A decision counts only while
    its fingerprint equals the pair's.  Any open pair holds the record.
    """
    keys = ["record_url", "source", "external_id"]
    decided = reviews.select(*keys, F.col("fingerprint").alias("_seen"), "decision")
    current = F.col("_seen") == F.col("fingerprint")
    judged = pairs.join(decided, keys, "left").withColumn("applied", F.when(current, F.col("decision")))
    return judged.groupBy("record_url").agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("applied").isNull()).alias("n_pending"),
        F.count_if(F.col("applied") == "equivalent").alias("n_equivalent"),
        F.min(F.when(F.col("applied") == "equivalent", F.col("external_id"))).alias("_one"),
    ).withColumn(
        "state", F.when(F.col("n_pending") > 0, "pending").when(F.col("n_equivalent") > 1, "several_equivalent")
        .when(F.col("n_equivalent") == 1, "equivalent").otherwise("distinct")
    ).withColumn("external_id", F.when(F.col("state") == "equivalent", F.col("_one"))).drop("_one")


DECIDED_FACTS = ["record_id", "title", "author", "doi"]


def identity_fingerprint(left: str, right: str) -> Column:
    """Binds an identity decision to all that was shown of both records, whose columns carry a prefix."""
    return pair_fingerprint([f"{left}{c}" for c in DECIDED_FACTS] + [f"{right}{c}" for c in [*DECIDED_FACTS, "value"]])


def decided_pairs(left: DataFrame, right: DataFrame, near: DataFrame, decisions: DataFrame) -> DataFrame:
    """``(record_id, external_id, decision, value)``: the decisions that count, one row per pair.

    ``left`` and ``right`` are ``identity.identities`` (``right`` with its date ``value``),
    ``near`` their near pairs by profile, ``decisions`` hold ``record_url, external_id,
    fingerprint, decision``.  Only decided pairs are judged, by joins on their ids, so the
    work grows with the decisions and not with the pairs that could be decided.  A decision
    counts while the pair still needs one and still shows the facts it was made on; two
    that contradict each other count as none.
    """
    fields = [*DECIDED_FACTS, "title_fold", "name_words", "surname", "initial", "profile"]
    told = decisions.select("record_url", "external_id", "fingerprint", "decision").distinct()
    pairs = (
        told.join(left.select(*(F.col(c).alias(f"l_{c}") for c in fields)), F.col("record_url") == F.col("l_record_id"))
        .join(right.select(*(F.col(c).alias(f"r_{c}") for c in [*fields, "value"])), F.col("external_id") == F.col("r_record_id"))
        .filter(F.col("fingerprint") == identity_fingerprint("l_", "r_"))
    )
    def author(side: str) -> Column:
        return F.struct(*(F.col(f"{side}{c}").alias(c) for c in ("name_words", "surname", "initial")))

    exact = F.coalesce(F.col("l_doi") == F.col("r_doi"), F.lit(False)) | F.coalesce(F.col("l_title_fold") == F.col("r_title_fold"), F.lit(False))
    conflict = F.coalesce(~authors_compatible(author("l_"), author("r_")), F.lit(False))
    levels = near.filter("level = 'review_required'").select(
        F.col("left_profile").alias("l_profile"), F.col("right_profile").alias("r_profile"), F.lit(True).alias("_near")
    ).distinct()
    judged = pairs.join(levels, ["l_profile", "r_profile"], "left")
    open_ = F.when(exact, conflict).otherwise(F.coalesce("_near", F.lit(False)))
    return judged.filter(open_).groupBy(F.col("record_url").alias("record_id"), "external_id").agg(
        F.min("decision").alias("decision"), F.max("decision").alias("_other"), F.min("r_value").alias("value")
    ).filter("decision = _other").drop("_other")


def with_decisions(picked: DataFrame, decided: DataFrame) -> DataFrame:
    """``identity.pick_unique`` rows after the decisions on their review pairs.

    A record is released when every pair that needs a decision has one: to the earliest
    dated equivalent, to an undated one only if it is alone, or to no work at all.
    ``n_review`` then counts the pairs still open; equivalents found without a decision
    beside decided ones stay ambiguous.
    """
    same = F.col("decision") == "equivalent"
    per_record = decided.groupBy("record_id").agg(
        F.count("*").alias("_decided"), F.count_if(same).alias("_same"),
        F.min(F.when(same & F.col("value").isNotNull(), F.struct("value", "external_id"))).alias("_dated"),
        F.min(F.when(same, F.col("external_id"))).alias("_any"),
    ).withColumn("_chosen", F.coalesce("_dated.external_id", F.when(F.col("_same") == 1, F.col("_any"))))
    left = F.col("n_review") - F.coalesce("_decided", F.lit(0))
    free = F.coalesce((F.col("_decided") > 0) & (left == 0) & (F.col("n_equivalent") == 0), F.lit(False))
    clash = F.coalesce((F.col("_same") > 0) & (F.col("n_equivalent") > 0), F.lit(False))
    return picked.join(per_record, "record_id", "left").withColumns({
        "outcome": F.when(free, F.when(F.col("_chosen").isNotNull(), "accepted").otherwise("none")).when(clash, "ambiguous").otherwise(F.col("outcome")),
        "match_id": F.when(free, F.col("_chosen")).when(~clash, F.col("match_id")),
        "n_review": left,
    }).drop("_decided", "_same", "_dated", "_any", "_chosen")


def review_decision_overlap(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Open pairs per source that a decision with the same fingerprint already covers."""
    keys = ["record_url", "source", "external_id", "fingerprint"]
    marked = pairs.join(reviews.select(*keys).distinct().withColumn("_covered", F.lit(1)), keys, "left")
    return marked.groupBy("source").agg(
        F.count("*").alias("open_pairs"), F.count("_covered").alias("covered_pairs")
    )


def apply_bibliographic_reviews(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Corrected title, author, DOI and year where the source facts still agree.

    ``candidates``: ``record_url, title, author, doi, n_dois, year_hints``;
    ``reviews`` (one row per URL): ``source_title, source_author, verified_title,
    verified_author, review_doi, review_year``.
    """
    r = reviews.select(
        F.regexp_replace("record_url", "/+$", "").alias("record_url"),
        N.title_norm(F.col("source_title")).alias("_source_title"),
        N.author_keys(F.col("source_author")).alias("_source_author"),
        N.author_keys(F.col("verified_author")).alias("_verified_keys"),
        "verified_title", "verified_author", "review_doi", "review_year",
    )
    joined = candidates.join(r, "record_url", "left")
    own = N.author_keys(F.col("author"))
    applies = (
        (F.col("_source_title") == N.title_norm(F.col("title")))
        & authors_compatible(own, F.col("_source_author"))
        & authors_compatible(F.col("_source_author"), F.col("_verified_keys"))
        & ((F.col("n_dois") == 0) | ((F.col("n_dois") == 1) & (F.col("review_doi") == F.col("doi"))))
        & (
            F.col("review_year").isNull() | (F.size("year_hints") == 0)
            | F.array_contains("year_hints", F.coalesce("review_year", F.lit(-1)))
        )
    )
    use = F.coalesce(applies, F.lit(False))
    return joined.withColumn("reviewed", use).select(
        *[c for c in candidates.columns if c not in ("title", "author", "doi")],
        F.when(use, F.col("verified_title")).otherwise(F.col("title")).alias("title"),
        F.when(use, F.col("verified_author")).otherwise(F.col("author")).alias("author"),
        F.when(use, F.coalesce("review_doi", "doi")).otherwise(F.col("doi")).alias("doi"),
        F.when(use, F.col("review_year")).alias("reviewed_year"), "reviewed",
    )


# Which columns each kind of decision table needs, and the key it must not repeat.
REVIEW_KINDS = {
    "identity": (["record_url", "source", "external_id"], ["fingerprint", "decision", "note"]),
    "type": (["record_url"], ["title", "work_type", "fingerprint", "note"]),
    "bibliography": (["record_url"], ["source_title", "source_author", "verified_title", "note"]),
}


def review_table(rows: DataFrame, kind: str, most_urls: int | None = None) -> DataFrame:
    """Add ``violations``, an array that is empty for usable rows.

    Every kind needs its texts, https ``evidence_urls``, one at least and
    ``most_urls`` at most, and a ``reviewed_at``; keys must be unique.
    """
    keys, texts = REVIEW_KINDS[kind]
    rules = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"missing_{c}") for c in keys + texts]
    urls = F.col("evidence_urls")
    rules.append(F.when(
        urls.isNull() | (F.size(urls) < 1) | (F.lit(most_urls is not None) & (F.size(urls) > (most_urls or 0))) | F.exists(urls, lambda u: ~u.rlike(r"^https://[^/@\s]+")),
        "invalid_evidence_urls",
    ))
    rules.append(F.when(F.col("reviewed_at").isNull(), "missing_reviewed_at"))
    if kind in ("identity", "type"):
        rules.append(F.when(~F.col("fingerprint").rlike(vocab.FINGERPRINT), "invalid_fingerprint"))
    if kind == "identity":
        rules.append(F.when(~F.col("decision").isin("equivalent", "distinct"), "invalid_decision"))
    if kind == "type":
        rules.append(F.when(~F.col("work_type").isin(vocab.REVIEWABLE_TYPES), "invalid_work_type"))
    if kind == "bibliography":
        doi = N.doi_norm(F.col("doi"))
        rules.append(F.when(F.col("doi").isNotNull() & doi.isNull(), "invalid_doi"))
        rules.append(F.when(doi.isNull() & F.col("publication_year").isNull(), "no_doi_or_year"))
    keyed = rows
    for c in keys:
        keyed = keyed.withColumn(f"_{c}", F.regexp_replace(c, "/+$", "") if c == "record_url" else F.col(c))
    marks = [f"_{c}" for c in keys]
    repeated = keyed.groupBy(*marks).agg(F.count("*").alias("_n")).filter("_n > 1")
    rules.append(F.when(F.col("_n") > 1, "duplicate_key"))
    return keyed.join(repeated, marks, "left").withColumn(
        "violations", F.array_compact(F.array(*rules))
    ).drop("_n", *marks)
