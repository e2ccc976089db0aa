"""Totals per key over a stream, as a log of what each micro-batch adds and snapshots of it.

A micro-batch aggregates its own rows and writes them to ``log/batch_id=``; the parts
merge by sums, least and greatest values, so their order does not matter, no row is ever too
late and the stream needs no operator state.  A key with a large share of the rows is one
row per task before the shuffle.

Every ``SNAPSHOT_EVERY`` micro-batches the newest snapshot and the log after it are merged to
``snapshot/upto=``.  Spark writes the mark ``_SUCCESS`` of a folder last, and this mark is the
pointer: readers take the newest marked snapshot and the marked batches after it.  A snapshot
that stopped half-way is not seen and is written again.  The log behind the snapshot *before*
the newest is deleted, so a reader that has just chosen a snapshot has one whole period to end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_EVERY = 20


@dataclass(frozen=True)
class Totals:
    """``columns`` maps a name to its aggregate over rows and to how parts merge (sum, min or max)."""

    keys: tuple[str, ...]
    columns: dict[str, tuple[str, str]]
    # rows of a merged table that a snapshot still needs
    keep: Callable[[DataFrame], DataFrame] | None = None

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.expr(total).alias(name) for name, (total, _) in self.columns.items()])

    def merged(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys).agg(*[F.expr(f"{how}({name})").alias(name) for name, (_, how) in self.columns.items()])


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str, column: str) -> list[int]:
    """Numbers of the folders ``column=<number>`` below ``path`` that are written whole, rising."""
    place, files = _files(spark, path)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    numbers = sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{column}="))
    mark = spark._jvm.org.apache.hadoop.fs.Path
    return [n for n in numbers if files.exists(mark(f"{path}/{column}={n}/_SUCCESS"))]


def _delete(spark: SparkSession, path: str) -> None:
    place, files = _files(spark, path)
    files.delete(place, True)


def parts(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame | None:
    """The newest snapshot and the batches after it, up to batch ``upto``; None before the first."""
    snapshots = [n for n in finished(spark, f"{folder}/snapshot", "upto") if upto is None or n <= upto]
    begin = snapshots[-1] if snapshots else -1
    later = [n for n in finished(spark, f"{folder}/log", "batch_id") if n > begin and (upto is None or n <= upto)]
    paths = [f"{folder}/snapshot/upto={n}" for n in snapshots[-1:]] + [f"{folder}/log/batch_id={n}" for n in later]
    # read as one relation: ``basePath`` is not set, so folder names give no columns
    return spark.read.parquet(*paths) if paths else None


def write_batch(spec: Totals, batch: DataFrame, batch_id: int, folder: str, every: int = SNAPSHOT_EVERY) -> None:
    """Log what a micro-batch adds; a batch that is run again overwrites its own folder."""
    spec.of(batch).write.mode("overwrite").parquet(f"{folder}/log/batch_id={batch_id}")
    if batch_id % every == every - 1:
        # a batch only starts when the one before it is committed and will not be run again
        snapshot(spec, batch.sparkSession, folder, batch_id - 1)


def snapshot(spec: Totals, spark: SparkSession, folder: str, upto: int) -> None:
    """Merge all up to batch ``upto``, which must be committed, and drop what the last snapshot holds."""
    before = [n for n in finished(spark, f"{folder}/snapshot", "upto") if n < upto]
    if upto not in finished(spark, f"{folder}/snapshot", "upto"):
        found = parts(spark, folder, upto)
        if found is None:
            return
        table = spec.merged(found)
        (spec.keep(table) if spec.keep else table).write.mode("overwrite").parquet(f"{folder}/snapshot/upto={upto}")
    if before:
        old = finished(spark, f"{folder}/log", "batch_id")
        for n in (n for n in old if n <= before[-1]):
            _delete(spark, f"{folder}/log/batch_id={n}")
        for n in before[:-1]:
            _delete(spark, f"{folder}/snapshot/upto={n}")


def read(spec: Totals, spark: SparkSession, folder: str) -> DataFrame:
    """Totals of all batches so far."""
    found = parts(spark, folder)
    if found is None:
        raise FileNotFoundError(f"no micro-batch of {folder} is written yet")
    return spec.merged(found)

