"""Counts over queues, requests, runs and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.gates import instant

QUEUE_STATES = ["pending", "blocked", "dismissed", "reviewed"]


def queue_summary(queue: DataFrame, cutoff) -> DataFrame:
    """Rows per state of each group, long-blocked rows and blocks of unknown age."""
    status = F.col("status")
    counts = [F.count_if(status == s).alias(s) for s in QUEUE_STATES]
    blocked = status == "blocked"
    return queue.groupBy("grp").agg(
        *counts, F.count("*").alias("total"),
        F.count_if(blocked & (F.col("blocked_since") <= instant(cutoff))).alias("long_blocked"),
        F.count_if(blocked & F.col("blocked_since").isNull()).alias("blocked_age_unknown"),
    )


def telemetry_summary(requests: DataFrame) -> DataFrame:
    """Request counters per source and, with source NULL, in total."""
    ok = F.col("outcome") == "success"
    limited = F.col("rate_limit").isNotNull()
    return requests.rollup("source").agg(
        F.grouping("source").alias("is_total"),
        F.count("*").alias("logical_requests"),
        F.count_if(ok & (F.col("attempts") == 1)).alias("first_attempt_successes"),
        F.count_if(ok & (F.col("attempts") > 1)).alias("retried_successes"),
        F.count_if(~ok).alias("failed_requests"),
        F.sum("attempts").alias("attempts"),
        F.sum("wait_centis").alias("wait_centis"),
        F.count_if("deferred").alias("deferred_long_retry_after"),
        F.max_by("rate_limit", F.when(limited, F.col("seq"))).alias("rate_limit"),
    )


# Which unresolved reasons need a person and which are retried.
HUMAN_REASONS = [
    "semantic_identity_review_required", "identifier_conflict", "structured_work_type_conflict",
    "unknown_structured_work_type",
]
RETRY_REASONS = ["old_work_check_incomplete"]


def workload(unresolved: DataFrame) -> DataFrame:
    """Unresolved rows per reason and who deals with them."""
    reason = F.col("reason_code")
    who = F.when(reason.isin(HUMAN_REASONS), "human_review").when(reason.isin(RETRY_REASONS), "automatic_retry").otherwise("other")
    return unresolved.groupBy("reason_code").agg(F.count("*").alias("n")).withColumn("handled_by", who)


def run_funnel(stages: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows and distinct records that reached each stage of a run.

    ``stages`` holds ``(run_id, stage, record_url)``.
    """
    distinct = F.approx_count_distinct("record_url") if approximate else F.count_distinct("record_url")
    return stages.groupBy("run_id", "stage").agg(F.count("*").alias("n_rows"), distinct.alias("n_records"))


def source_status(scans: DataFrame) -> DataFrame:
    """``success``, ``partial`` or ``failed`` per source from its page results."""
    ok = F.col("outcome") == "success"
    sums = scans.groupBy("source").agg(
        F.count_if(ok).alias("result_pages"), F.count_if(~ok).alias("failures"), F.count_if("truncated").alias("truncations")
    )
    status = F.when(F.col("result_pages") == 0, "failed").when(
        (F.col("failures") > 0) | (F.col("truncations") > 0), "partial"
    ).otherwise("success")
    return sums.withColumn("status", status)


def evidence_labels(pairs: DataFrame) -> DataFrame:
    """Pairs and records per sorted combination of evidence labels."""
    return pairs.withColumn("labels", F.array_join(F.array_sort("labels"), "+")).groupBy("labels").agg(
        F.count("*").alias("n_pairs"), F.count_distinct("record_url").alias("n_records")
    )


def field_states(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Value, null and absent counts of top-level JSON fields; the three stay apart."""
    keys = F.json_object_keys("json")
    states = []
    for field in fields:
        present = F.array_contains(keys, field)
        value = F.get_json_object("json", f"$.{field}")
        state = F.when(~F.coalesce(present, F.lit(False)), "absent").when(value.isNull(), "null").otherwise("value")
        states.append(F.struct(F.lit(field).alias("field"), state.alias("state")))
    return (
        rows.select(F.explode(F.array(*states)).alias("s")).groupBy("s.field").agg(
            F.count_if(F.col("s.state") == "value").alias("n_value"), F.count_if(F.col("s.state") == "null").alias("n_null"),
            F.count_if(F.col("s.state") == "absent").alias("n_absent"),
        )
    )


def store_summary(events: DataFrame, coverage: DataFrame, staged: DataFrame) -> DataFrame:
    """Events, coverage intervals and staged rows per source."""
    parts = None
    for df, name in ((events, "n_events"), (coverage, "n_intervals"), (staged, "n_staged")):
        counted = df.groupBy("source_key").agg(F.count("*").alias(name))
        parts = counted if parts is None else parts.join(counted, "source_key", "full_outer")
    zero = F.lit(0)
    return parts.select("source_key", *[F.coalesce(c, zero).alias(c) for c in ("n_events", "n_intervals", "n_staged")])


def last_profile_version(runs: DataFrame) -> DataFrame:
    """Profile version of the newest successful run of each kind."""
    return runs.filter("status = 'success'").groupBy("run_kind").agg(
        F.max_by("profile_version", F.struct("window_end", "completed_at", "profile_version")).alias("profile_version")
    )


def coverage_rows(scans: list[DataFrame]) -> DataFrame:
    """One table of source coverage from scans with different columns."""
    out = scans[0]
    for scan in scans[1:]:
        out = out.unionByName(scan, allowMissingColumns=True)
    return out
