"""WARC archives, written and read as Spark text tables, with boundary-chain verification.

Writing: one record per page; among pages with equal payloads the one with the least id is
a response and the others are revisits of it, without a payload.  A record is one line of
Spark's text writer that happens to hold line ends, so archives go to any file system Spark
writes to, gzipped or plain.

Reading: files are split at the version line wherever it stands, also inside payloads.
Each task turns its byte range into candidates, offset and successor offset from the
header's length, and follows chains inside its range.  From the start of each file, pointer
jumping over the ranges' entries and exits finds which entries are reached; only candidates
on the chain from a reached entry are records.  Payloads cut by the end of a range are put
together from the ranges they cross.

Null payloads are empty ones.  Rows that share the least id of a payload are all
responses.  Null ids are never least; a payload that only rows without id hold is a
response each time.  A file whose chain breaks yields the records before the break.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.session import cut, shared_path

MAGIC = "WARC/1.1\r\n"
RECORDS_PER_FILE = 2_000
_HEADER = re.compile(rb"^([A-Za-z0-9-]+):[ \t]*(.*?)[ \t]*\r?$", re.M)
FIELDS = ["WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To"]
NAMES = ["record_type", "record_id", "target_uri", "declared_digest", "refers_to"]
CANDIDATE = (
    "path string, block long, at long, size long, next long, leaves long, "
    + ", ".join(f"{n} string" for n in NAMES) + ", payload_bytes long, payload_at long, payload_digest string, payload binary"
)


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base 32 of a SHA-1 in hex: five hex digits are four base-32 digits."""
    parts = [
        F.translate(
            F.lpad(F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 32), 4, "0"),
            "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
        )
        for k in range(8)
    ]
    return F.concat(*parts)


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
    compression: str = "gzip", date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write a record per row of ``pages``; payloads of fewer than ``least_bytes`` are never revisits."""
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("body"),
    ).withColumn("sha", F.sha1("body"))
    shared = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    rows = rows.join(shared, "sha", "left")
    size = F.octet_length("body")
    revisit = F.coalesce((size >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", page_urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        F.when(revisit, line("WARC-Refers-To", page_urn(F.col("first")))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, 0).otherwise(size).cast("string")),
        F.lit("\r\n"), F.when(revisit, "").otherwise(F.col("body")), F.lit("\r\n\r"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("compression", compression).option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines, with its file and byte range."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """The chunks of one byte range after another."""
    key, held = None, []
    for batch in batches:
        for path, block, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (path, block) != key:
                if key:
                    yield *key, held
                key, held = (path, block), []
            held.append(value)
    if key:
        yield *key, held


def candidates_of(block: int, chunks: list[bytes]) -> tuple[bytes, list[dict]]:
    """The range from its first version line (a file's first range: from its start) and a candidate per version line."""
    magic = MAGIC.encode()
    lead = chunks[0] if block == 0 else b""
    bodies = chunks[1:] if block == 0 else chunks
    data = lead + b"".join(magic + b for b in bodies)
    found, at = [], len(lead)
    for body in bodies:
        start = at + len(magic)
        end = data.find(b"\r\n\r\n", start)
        head = dict(_HEADER.findall(data[start : end + 2])) if end >= 0 else {}
        row = {"at": at, "next": None, "payload_at": None, "payload_bytes": None, "payload_digest": None, "payload": None}
        row |= {n: head.get(f.encode(), b"").decode("utf-8", "replace") or None for n, f in zip(NAMES, FIELDS)}
        if head.get(b"Content-Length", b"").isdigit():
            row["payload_bytes"], row["payload_at"] = int(head[b"Content-Length"]), end + 4
            row["next"] = end + 4 + row["payload_bytes"] + 4
        found.append(row)
        at += len(magic) + len(body)
    return data, found


def _candidates(spark: SparkSession, path: str, with_payload: bool) -> DataFrame:
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in CANDIDATE.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, chunks in _ranges(batches):
            data, found = candidates_of(block, chunks)
            place = {row["at"]: k for k, row in enumerate(found)}
            for row in reversed(found):  # where the chain from here leaves the range
                step = row["next"]
                row["leaves"] = found[place[step]]["leaves"] if step in place else step
                if step is not None and row["payload_at"] + row["payload_bytes"] <= len(data):
                    payload = data[row["payload_at"] : row["payload_at"] + row["payload_bytes"]]
                    row["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    row["payload"] = payload if with_payload else None
            for row in found:
                row |= {"path": file, "block": block, "size": len(data)}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types)], names=names)

    return _chunks(spark, path).mapInArrow(run, CANDIDATE)


def reached_entries(jumps: DataFrame) -> DataFrame:
    """``(path, at)`` reached from offset 0 of each file over ``jumps(path, at, leaves)``, doubling the jump each round."""
    reached = jumps.where("at = 0").select("path", "at")
    hops = jumps.alias("a").join(
        jumps.select("path", "at").alias("b"), F.expr("a.path = b.path AND a.leaves = b.at"), "left_semi"
    )
    hops = cut(hops.select("path", "at", "leaves"))
    while not hops.isEmpty():
        further = reached.join(hops, ["path", "at"]).select("path", F.col("leaves").alias("at"))
        reached = cut(reached.unionByName(further).distinct())
        hops = cut(
            hops.alias("a").join(hops.alias("b"), F.expr("a.path = b.path AND a.leaves = b.at"))
            .select("a.path", "a.at", "b.leaves")
        )
    return reached


def _on_chain(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one range on the chain from its reached entry."""
    rows = rows.sort_values("at", ignore_index=True)
    place = {at: k for k, at in enumerate(rows["at"].tolist())}
    keep, k = [], next(iter(rows.index[rows["entry"]]), None)
    nexts = rows["next"].tolist()
    while k is not None:
        keep.append(k)
        k = None if pd.isna(nexts[k]) else place.get(int(nexts[k]))
    return rows.iloc[keep][["path", "at"]]


def _crossing(spark: SparkSession, path: str, wanted: DataFrame, bases: DataFrame, with_payload: bool) -> DataFrame:
    """Payloads of records that run over the end of their range."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, chunks in _ranges(batches):
            data, _ = candidates_of(block, chunks)
            for lo in range(0, len(data), 1 << 20):
                part = data[lo : lo + (1 << 20)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([lo], pa.int64()), pa.array([part], pa.binary())],
                    names=["path", "block", "lo", "part"],
                )

    parts = _chunks(spark, path).mapInArrow(run, "path string, block long, lo long, part binary").join(bases, ["path", "block"])
    parts = parts.select("path", (F.col("base") + F.col("lo")).alias("lo"), "part")
    cuts = parts.join(wanted, "path").where("lo < payload_at + payload_bytes AND lo + octet_length(part) > payload_at").selectExpr(
        "path", "at", "lo", "payload_bytes",
        "substring(part, int(greatest(payload_at - lo, 0)) + 1, "
        "int(least(payload_at + payload_bytes - lo, octet_length(part)) - greatest(payload_at - lo, 0))) AS part",
    )
    whole = cuts.groupBy("path", "at").agg(F.sort_array(F.collect_list(F.struct("lo", "part"))).alias("parts"))

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [b"".join(p["part"] for p in parts) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([base64.b32encode(hashlib.sha1(b).digest()).decode() for b in bodies]),
                 pa.array([b if with_payload else None for b in bodies], pa.binary())],
                names=["path", "at", "payload_digest", "payload"],
            )

    return whole.mapInArrow(digest, "path string, at long, payload_digest string, payload binary")


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives in ``path``: file, offset, header fields, size and digest of the payload as read."""
    found = cut(_candidates(spark, path, with_payload))
    ranges = found.groupBy("path", "block").agg(F.max("size").alias("size"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # ranges of one file
    bases = ranges.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    moved = found.join(bases, ["path", "block"])
    moved = moved.select(
        "path", "block", *[(F.col(c) + F.col("base")).alias(c) for c in ("at", "next", "leaves", "payload_at")],
        *NAMES, "payload_bytes", "payload_digest", "payload",
    )
    light = moved.select("path", "block", "at", "next", "leaves")
    entries = reached_entries(light.select("path", "at", "leaves")).withColumn("entry", F.lit(True))
    chain = (
        light.join(entries, ["path", "at"], "left").na.fill({"entry": False}).select("path", "block", "at", "next", "entry")
        .groupBy("path", "block").applyInPandas(_on_chain, "path string, at long")
    )
    records = cut(moved.join(chain, ["path", "at"], "left_semi"))
    broken = records.where("payload_digest IS NULL AND payload_bytes IS NOT NULL")
    columns = ["path", "at", *NAMES, "payload_bytes", "payload_digest", "payload"]
    if broken.isEmpty():
        return records.select(*columns)
    mended = _crossing(spark, path, broken.select("path", "at", "payload_at", "payload_bytes"), bases, with_payload)
    fixed = broken.drop("payload_digest", "payload").join(mended, ["path", "at"], "left")
    return records.where("payload_digest IS NOT NULL OR payload_bytes IS NULL").select(*columns).unionByName(fixed.select(*columns))


def page_records(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives, read them back, and give each page its record."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    # plain and a file per task, so that readers split long files into ranges
    write_archives(pages, path, least_bytes=least_bytes, compression="none", records_per_file=0)
    number = r"<urn:page:(-?\d+)>"
    read = read_archives(spark, path).select(
        F.regexp_extract("record_id", number, 1).try_cast("long").alias("page_id"),
        F.regexp_extract(F.coalesce("refers_to", F.lit("")), number, 1).try_cast("long").alias("refers_to"),
        "record_type", "payload_bytes", F.when(F.col("record_type") == "revisit", F.expr("substring(declared_digest, 6)")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )
    bodies = read.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("body_digest")
    ).agg(F.max("payload_bytes").alias("body_bytes"))
    revisits = read.where("record_type = 'revisit'").alias("r").join(
        bodies.alias("b"), F.expr("r.refers_to = b.refers_to AND r.payload_digest = b.body_digest"), "left"
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read.where("record_type = 'response'").select(*columns).unionByName(
        revisits.select("r.page_id", F.col("body_bytes").alias("payload_bytes"), "r.payload_digest", "r.record_type", "r.refers_to")
    )
