"""Writing a run so that its report and state appear together or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import normalise as N

LEDGER = "run_id string, run_kind string, window_start string, window_end string, committed_at timestamp_ntz"


class WindowCommitted(ValueError):
    """The window of this run already has a committed run."""


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """Committed runs; empty before the first.  Any other fault of the ledger is an error."""
    if not exists(spark, f"{root}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger")


def write_run(tables: dict[str, DataFrame], root: str, run_id: str, run_kind: str, window: tuple[str, str]) -> None:
    """Write every table under ``run_id=`` and the ledger row last.

    Readers only see runs of the ledger, so a run that stops half-way leaves
    nothing visible; repeating it overwrites its own folders.  A window that has
    a committed run is refused.  One writer per root.
    """
    spark = next(iter(tables.values())).sparkSession
    same = ledger(spark, root).filter(
        (F.col("run_kind") == run_kind) & (F.col("window_start") == window[0]) & (F.col("window_end") == window[1])
    )
    if not same.isEmpty():
        raise WindowCommitted(f"{run_kind} {window[0]}..{window[1]} is committed")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")
    row = [(run_id, run_kind, window[0], window[1])]
    spark.createDataFrame(row, "run_id string, run_kind string, window_start string, window_end string").withColumn(
        "committed_at", F.current_timestamp().cast("timestamp_ntz")
    ).coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def read_run_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of committed runs only."""
    runs = ledger(spark, root).select("run_id")
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    return rows.withColumn("run_id", F.col("run_id").cast("string")).join(runs, "run_id", "left_semi")


def latest_version(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The state table as the newest committed run that wrote it left it.

    A run is one that wrote the table if it has a folder of it, which an empty table has too.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    writers = [s.getPath().getName().removeprefix("run_id=") for s in files.listStatus(place)]  # one name per run
    wrote = spark.createDataFrame([(w,) for w in writers], "run_id string")
    newest = ledger(spark, root).join(wrote, "run_id", "left_semi").agg(
        F.max_by("run_id", F.struct("window_end", "committed_at")).alias("run_id")
    )
    return read_run_table(spark, root, name).join(F.broadcast(newest), "run_id", "left_semi")


def review_queue(year_pending: DataFrame, unconfirmed: DataFrame, confirmed: DataFrame) -> DataFrame:
    """One row per record that a person may decide on, with its evidence and fingerprint.

    The three inputs give ``record_url, title`` and, where known, ``labels`` (an
    array of evidence texts); ``unconfirmed`` adds its ``reason``.
    """
    none = F.lit(None).cast("string")
    def rows(df, reason, with_labels):
        labels = F.array_sort("labels") if with_labels else F.array().cast("array<string>")
        mark = N.evidence_fingerprint(F.col("labels")) if with_labels else none
        return df.select("record_url", "title", reason.alias("reason"), labels.alias("labels"), mark.alias("evidence_fingerprint"))

    return (
        rows(year_pending, F.lit("year_review_pending"), False)
        .unionByName(rows(unconfirmed.filter(F.col("reason").isin("type_unverified", "identity_unverified")), F.col("reason"), True))
        .unionByName(rows(confirmed, F.lit("confirmed_type"), True))
    )


def write_review_queue(queue: DataFrame, path: str) -> None:
    queue.write.mode("overwrite").json(path)
