"""Session settings, lineage cuts and shared folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change at run time; the cluster keeps its own sizes.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows hold texts of any length; a batch in a Python worker is bounded by bytes
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # a written table needs the shuffle files behind it no longer
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # sets have small fixed domains here, so more groups fit in memory before sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "32768",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A one-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfmark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class NoSharedFolder(RuntimeError):
    """A cluster must name a folder that the driver and all executors share."""


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where none is named, one machine alone gets a temporary folder; a cluster is
    refused, as each executor would write its own disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = context.getCheckpointDir()
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for tables and stream state."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lost executors then cost no earlier work, and the written table has column
    pruning and true sizes for the planner.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables written by :func:`cut` that no later step reads."""
    session = SparkSession.active()
    for table in tables:
        path = session._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_in_order(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: keeps the partitions of ``df`` and the order inside them."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
