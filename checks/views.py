"""Spark forms of the views by which the driver tables stand in for record data."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(selector: Column, *values) -> Column:
    """Value by small integer; values that are ``None`` or out of range give NULL."""
    chosen = F.lit(None).cast("string")
    for position, value in reversed(list(enumerate(values))):
        if value is not None:
            chosen = F.when(selector == position, F.lit(value)).otherwise(chosen)
    return chosen


def cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


class Tables:
    """The driver tables of one scale folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name.startswith("v_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def v_k(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.withColumn("k", k)

    @cached_property
    def v_feed_entries(self) -> DataFrame:
        k, user = F.col("k"), F.col("user_id").cast("string")
        return self.v_k.select(
            "event_id",
            F.col("event_type").alias("category_id"),
            F.date_trunc("day", "ts").cast("timestamp_ntz").alias("checked_at"),
            cat("https://feed.example.org/rec/U", user).alias("link"),
            cat("https://feed.example.org/rec/U", user).alias("record_url"),
            cat("Record ", user).alias("title"),
            F.when(k % 4 != 0, F.col("ts")).alias("published_at"),
            F.when(k % 3 == 0, 2015 + k % 10).alias("year_hint"),
            F.when(k % 5 == 0, cat("10.1000/u", user)).alias("doi_hint"),
            pick(k % 6, "preprint", "working-paper", "forthcoming-article").alias("type_hint"),
        )

    @cached_property
    def v_change_events(self) -> DataFrame:
        k, user = F.col("k"), F.col("user_id").cast("string")
        return self.v_k.select(
            "event_id",
            F.when(k != 99, cat("oai:x:/rec/U", user)).alias("identifier"),
            F.when(k != 99, cat("u", user)).alias("record_key"),
            F.col("ts").alias("changed_at"),
            (F.col("event_type") == "error").alias("deleted"),
            pick(k % 4, "preprint", "article", "workingpaper").alias("dc_type"),
            (2015 + k % 10).cast("string").alias("dc_date"),
        )

    @cached_property
    def v_taxonomy(self) -> DataFrame:
        return self._taxonomy(self.part)

    def _taxonomy(self, part: DataFrame, renamed: bool = False) -> DataFrame:
        none = F.array().cast("array<string>")
        shape = ["category_id", "name", "parent_ids", "primary_parent_id", "active"]
        root = self.region.limit(1).select(
            F.lit("R").alias("category_id"), F.lit("All").alias("name"), none.alias("parent_ids"),
            F.lit(None).cast("string").alias("primary_parent_id"), F.lit(True).alias("active"),
        )
        groups = (
            part.select(F.explode(F.array("p_brand", "p_type")).alias("category_id")).distinct()
            .select(
                "category_id", F.col("category_id").alias("name"),
                F.array(F.lit("R")).alias("parent_ids"), F.lit("R").alias("primary_parent_id"),
                F.lit(True).alias("active"),
            )
        )
        key = F.col("p_partkey")
        name, parents = F.col("p_name"), F.array("p_brand", "p_type")
        if renamed:
            name = F.when(key % 23 == 0, cat(name, " II")).otherwise(name)
            parents = F.when(key % 29 == 0, F.array("p_type")).otherwise(parents)
            primary = F.when(key % 29 == 0, F.col("p_type")).otherwise(F.col("p_brand"))
        else:
            primary = F.col("p_brand")
        leaves = part.select(
            cat("P", key.cast("string")).alias("category_id"), name.alias("name"),
            F.array_sort(parents).alias("parent_ids"), primary.alias("primary_parent_id"),
            (key % 13 != 0).alias("active"),
        )
        return root.select(shape).unionByName(groups).unionByName(leaves)

    @cached_property
    def v_taxonomy_old(self) -> DataFrame:
        return self._taxonomy(self.part.filter("p_partkey % 17 <> 0"))

    @cached_property
    def v_taxonomy_new(self) -> DataFrame:
        return self._taxonomy(self.part.filter("p_partkey % 19 <> 0"), renamed=True)

    @cached_property
    def v_profiles(self) -> DataFrame:
        dates = self.orders.select("o_custkey", "o_orderdate").distinct()
        from pyspark.sql import Window

        version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate"))
        return dates.select(
            F.col("o_custkey").alias("profile_id"), version.alias("version"),
            F.col("o_orderdate").alias("effective_from"),
        )

    @cached_property
    def v_records(self) -> DataFrame:
        d = F.col("doc_id")
        return self.documents.select(
            d.alias("record_id"),
            F.col("text").alias("title"),
            cat("Author ", F.col("source")).alias("author"),
            F.when(d % 3 == 0, cat("10.1/", (d % 400).cast("string"))).alias("doi_raw"),
            F.when(d % 3 == 0, cat("10.1000/", (d % 400).cast("string"))).alias("doi"),
            (2000 + d % 25).cast("int").alias("year"),
            F.when(d % 2 == 0, F.lit("openalex")).otherwise(F.lit("crossref")).alias("provider"),
            pick(
                d % 7, "article", "journal-article", "book", "report", "other", "dataset", "Unsafe Type!"
            ).alias("raw_type"),
        )

    @cached_property
    def v_type_evidence(self) -> DataFrame:
        d = F.col("doc_id")
        def block(provider, kind):
            return F.struct(
                F.lit(provider).alias("provider"), kind.alias("raw_type"),
                F.lit("structured").alias("method"),
            )
        pairs = F.array(
            block("openalex", pick(d % 7, "article", "book", "report", "preprint", "other", "review", "Odd Type")),
            block("crossref", pick(d % 5, "journal-article", "monograph", "posted-content", None, "other")),
        )
        found = (
            self.documents.select("doc_id", F.explode(pairs).alias("e"))
            .select("doc_id", "e.*").filter("raw_type IS NOT NULL")
        )
        reviewed = self.labels.filter("quality = 1").select(
            "doc_id", F.lit("openalex").alias("provider"), F.lit("book-review").alias("raw_type"),
            F.lit("document-inspection").alias("method"),
        )
        return found.unionByName(reviewed).withColumnRenamed("doc_id", "record_id")

    @cached_property
    def v_date_values(self) -> DataFrame:
        key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        precision = pick(key % 4, "year", "month", "day", "day")
        day = F.date_format("l_shipdate", "yyyy-MM-dd")
        return self.lineitem.select(
            key.alias("record_id"),
            F.when(precision == "year", F.left(day, F.lit(4)))
            .when(precision == "month", F.left(day, F.lit(7))).otherwise(day).alias("value"),
            precision.alias("precision"),
            (key % 10 == 0).alias("inferred"),
            F.when(F.col("l_returnflag") == "A", "crossref")
            .when(F.col("l_returnflag") == "N", "openalex").otherwise("feed-observed-at").alias("source"),
            F.when(key % 14 == 0, F.lit(None)).when(key % 9 == 0, "indexed").when(key % 2 == 0, "recently_published")
            .otherwise("recently_published_online").alias("event"),
        )

    @cached_property
    def v_coverage(self) -> DataFrame:
        days = F.col("l_quantity").cast("int")
        start = F.col("l_shipdate")
        return self.lineitem.select(
            F.col("l_suppkey").alias("source_key"),
            start.alias("window_start"),
            (start + F.make_dt_interval(days)).alias("window_end"),
            (start + F.expr("INTERVAL 30 DAY")).alias("checked_at"),
        )

    @cached_property
    def v_runs(self) -> DataFrame:
        week = F.date_trunc("week", "o_orderdate").cast("timestamp_ntz")
        return (
            self.orders
            .select(week.alias("window_start")).distinct()
            .withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 7 DAY"))
        )

    @cached_property
    def v_issue_records(self) -> DataFrame:
        month = F.month("l_shipdate")
        label = F.when(F.col("l_quantity") < 30, F.least(month + F.when(F.col("l_linenumber") == 7, 1).otherwise(0), F.lit(12)))
        return self.lineitem.select(
            cat("T", F.col("l_partkey").cast("string")).alias("title"),
            cat("Supplier ", F.col("l_suppkey").cast("string")).alias("authors"),
            cat("Venue ", F.col("l_suppkey").cast("string")).alias("venue"),
            F.year("l_shipdate").alias("year"),
            month.cast("string").alias("issue"),
            label.alias("label_month"),
            cat("https://list.example.org/", F.col("l_orderkey").cast("string"), "/",
                F.col("l_linenumber").cast("string")).alias("url"),
            cat("q", (F.col("l_partkey") % 5).cast("string")).alias("query"),
        )

    @cached_property
    def v_issue_evidence(self) -> DataFrame:
        return (
            self.lineitem.groupBy(
                cat("Venue ", F.col("l_suppkey").cast("string")).alias("venue"),
                F.year("l_shipdate").alias("year"),
                F.month("l_shipdate").cast("string").alias("issue"),
                F.when(F.col("l_linestatus") == "F", "reviewed").otherwise("pending").alias("status"),
            )
            .agg(F.min("l_shipdate").alias("day"), F.max("l_shipdate").alias("last_day"),
                 F.min("l_orderkey").alias("key"))
            .select(
                "venue", "year", "issue", "status",
                F.when(F.col("key") % 3 != 0, F.month("day")).alias("label_month"),
                F.when(F.col("key") % 2 == 0, F.to_date("day")).alias("day"),
                (F.col("last_day") + F.expr("INTERVAL 40 DAY")).alias("reviewed_at"),
                cat("https://evidence.example.org/", F.col("key").cast("string")).alias("evidence_url"),
            )
        )

    @cached_property
    def v_catalogue(self) -> DataFrame:
        d = F.col("doc_id")
        return self.documents.select(
            d.alias("article_id"),
            cat(F.col("source"), "-", F.col("lang")).alias("issue"),
            F.col("text").alias("title"),
            cat(F.col("lang"), " ", F.col("source")).alias("abstract"),
            F.col("source").alias("keywords"),
            F.col("source").alias("author"),
            (d % 5).cast("int").alias("last_observed"),
            F.lit(0).alias("first_observed"),
        )

    @cached_property
    def v_article_checks(self) -> DataFrame:
        k = F.col("k")
        return self.v_k.select(
            F.col("user_id").alias("article_id"),
            F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b").alias("source"),
            F.col("ts").alias("checked_at"),
            pick(k % 4, "hit", "miss", "review", "failed").alias("status"),
            (F.floor(k / 4) % 2 == 1).alias("complete"),
        )

    @cached_property
    def v_queue(self) -> DataFrame:
        k = F.col("k")
        status = pick(k % 4, "pending", "blocked", "dismissed", "reviewed")
        rows = self.v_k.select(
            F.col("event_type").alias("grp"),
            cat("https://post.example.org/s/", F.col("event_id").cast("string")).alias("url"),
            cat("https://post.example.org/u/", F.col("user_id").cast("string")).alias("source_url"),
            status.alias("status"),
            F.col("ts").alias("first_seen"),
            F.when((k % 3 == 0) & (status == "blocked"), F.col("ts") - F.make_dt_interval(k)).alias("blocked_since"),
        )
        return rows

    @cached_property
    def v_requests(self) -> DataFrame:
        k = F.col("k")
        return self.v_k.select(
            F.col("event_type").alias("source"),
            F.when(k % 9 == 0, "failure").otherwise("success").alias("outcome"),
            (1 + k % 3).alias("attempts"),
            F.round(F.col("value") * 100).cast("bigint").alias("wait_centis"),
            F.col("event_id").alias("seq"),
            F.when(k % 2 == 0, k).alias("rate_limit"),
            (k == 27).alias("deferred"),
            F.col("ts"),
        )

    @cached_property
    def v_lookup_cache(self) -> DataFrame:
        k = F.col("k")
        found = k % 2 == 0
        return self.v_k.select(
            F.when(F.col("event_id") % 2 == 0, "crossref").otherwise("openalex").alias("source"),
            cat("q", F.col("user_id").cast("string")).alias("query"),
            F.when(found, "found").otherwise("not_found").alias("status"),
            F.col("ts").alias("cached_at"),
            F.when(found, F.col("ts") + F.expr("INTERVAL 24 HOUR"))
            .otherwise(F.col("ts") + F.expr("INTERVAL 15 MINUTE")).alias("expires_at"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def v_unresolved(self) -> DataFrame:
        k = F.col("k")
        return (
            self.v_k.groupBy("user_id").agg(
                F.min("k").alias("k"), F.count("*").alias("attempts"), F.max("ts").alias("last_attempt")
            )
            .select(
                cat("https://feed.example.org/rec/U", F.col("user_id").cast("string")).alias("record_url"),
                cat("Record ", F.col("user_id").cast("string")).alias("title"),
                pick(
                    F.col("user_id") % 5, "old_work_check_incomplete", "identifier_conflict",
                    "structured_work_type_conflict", "semantic_identity_review_required",
                    "unknown_structured_work_type",
                ).alias("reason_code"),
                (F.col("attempts") % 6).cast("int").alias("attempts"),
                F.col("last_attempt"),
                (F.col("last_attempt") + F.expr("INTERVAL 7 DAY")).alias("next_retry_at"),
            )
        )
