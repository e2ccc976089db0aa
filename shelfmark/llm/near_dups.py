"""Near-duplicate classes by BagMinHash signatures, bands and exact verification.

A text is the multiset of its five-word shingles (a shorter text: of one shingle of all
its words).  Its signature comes from Poisson processes over (time, weight): the weight
axis is cut into dyadic blocks, each (shingle, block) has its own process, and a point
counts for a text if it lies below the shingle's multiplicity.  Per component the earliest
point is kept, so two signatures agree in a component with the probability of their
weighted Jaccard similarity.  With 32 bands of 4 components, a pair at similarity 0.8
shares no band with a probability below 1e-7.

Texts with equal word sequences are one node.  Candidates are never all pairs of a bucket:
1. each node is verified against the least node of all its buckets;
2. in buckets that still span several classes, nodes outside the largest class are verified
   against members of it drawn by hash, which joins most of them;
3. nodes of buckets that still do are verified against those of other classes they share a
   prefix shingle with, where what stands before it in either leaves enough weight for the
   threshold, which holds for the first common shingle of any pair at the threshold.  Prefixes
   are in order of rising frequency, so common shingles are in few of them and come late.
So every pair of different classes that shares a band is either verified or proved too
far apart, however large the bucket.

Nulls and texts without words are classes of their own.  Repeated rows share a class.  The
class id is the least document id of its texts (null if they have none).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import gram_hashes, mix, sliced, text_rows, word_hashes, words_of
from shelfmark.operators.graph import components
from shelfmark.session import cut, drop_cut

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
FREQUENCY_BITS, TEXTS_PER_BATCH = 20, 128
TURNS, TRIES = 1, 16
_STEP = np.uint64(0xD1342543DE82EF95)


def shingles_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how often each occurs."""
    if not words:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.unique(gram_hashes(word_hashes(words), min(SHINGLE, len(words))), return_counts=True)


def text_key(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


def bag_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """Earliest point per bag and component, ``n`` x ``m``; bags without elements stay infinite."""
    signature = np.full(n * m, np.inf)
    blocks = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1, 1)
    row = np.repeat(np.arange(len(elements)), blocks)
    block = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    lower = np.where(block == 0, 0.0, 2.0 ** (block - 1))
    width = np.where(block == 0, 1.0, lower)
    weight, bag = weights[row].astype(float), owner[row]
    state = mix(elements[row] + mix(block.astype(np.uint64) + np.uint64(1)))
    total = np.bincount(owner, weights=weights, minlength=n)
    horizon = np.where(total > 0, m * (np.log(m) + 1) / np.maximum(total, 1), -np.inf)

    def wait(state: np.ndarray, width: np.ndarray) -> np.ndarray:
        u = ((mix(state) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        return -np.log(u) / width

    time, turn = wait(state, width), 0
    at = np.flatnonzero(time < horizon[bag])
    while True:
        if not len(at):
            open_ = np.isinf(signature.reshape(n, m).max(axis=1)) & (total > 0)
            if not open_.any():
                return signature.reshape(n, m)
            horizon[open_] *= 2  # some component has no point yet
            at = np.flatnonzero(time < horizon[bag])
            continue
        spot = mix(state[at] ^ _STEP)
        component = (spot % np.uint64(m)).astype(np.int64)
        level = lower[at] + width[at] * ((spot >> np.uint64(11)).astype(float) * 2.0**-53)
        inside = level < weight[at]
        np.minimum.at(signature, bag[at][inside] * m + component[inside], time[at][inside])
        state[at] = mix(state[at] + _STEP)
        time[at] += wait(state[at], width[at])
        if turn < 8 or turn % 16 == 0:
            # a full signature needs no point later than its latest one
            horizon = np.minimum(horizon, np.where(total > 0, signature.reshape(n, m).max(axis=1), -np.inf))
        turn += 1
        at = at[time[at] < horizon[bag[at]]]


def signatures(texts: list[list[bytes]], m: int) -> np.ndarray:
    bags = [shingles_of(w) for w in texts]
    sizes = [len(e) for e, _ in bags]
    if not sum(sizes):
        return np.full((len(texts), m), np.inf)
    return bag_minhash(
        np.concatenate([e for e, _ in bags]), np.concatenate([c for _, c in bags]),
        np.repeat(np.arange(len(texts)), sizes), len(texts), m,
    )


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for r in range(rows):
        key = mix(key * _STEP + bits[:, :, r])
    return key.view(np.int64)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, text_hash, node, bands)`` per document row; no node for texts without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            split = [words_of(t) for t in batch.column("text").to_pylist()]
            keys = band_keys(signatures(split, bands * rows), bands, rows)
            offsets = np.arange(0, (len(split) + 1) * bands, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([text_key(w) if w else None for w in split], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                ],
                names=["doc_id", "text_hash", "node", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, node binary, bands array<long>")


def keyed_texts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            split = [words_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([text_key(w) if w else None for w in split], pa.binary()),
                    pa.array([b" ".join(w) for w in split], pa.binary()),
                ],
                names=["doc_id", "node", "words"],
            )

    return docs.mapInArrow(run, "doc_id long, node binary, words binary").where("node IS NOT NULL")


def weighted_jaccard(a: tuple, b: tuple) -> float:
    (ea, ca), (eb, cb) = a, b
    _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[ia], cb[ib]).sum())
    return both / (int(ca.sum()) + int(cb.sum()) - both)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those ``pairs(u, v)`` whose shingle multisets overlap enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for whole in batches:
            for batch in sliced([whole], "wu"):
                keep = []
                u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
                for a, wa, wb in zip(u, batch.column("wu").to_pylist(), batch.column("wv").to_pylist()):
                    if last[0] != a:
                        last = (a, shingles_of(wa.split()))
                    other = shingles_of(wb.split())
                    na, nb = int(last[1][1].sum()), int(other[1].sum())
                    keep.append(min(na, nb) >= threshold * max(na, nb) and weighted_jaccard(last[1], other) >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, k in zip(c, keep) if k], pa.binary()) for c in (u, v)], names=["u", "v"]
                )

    joined = (
        pairs.join(texts.select(F.col("node").alias("v"), F.col("words").alias("wv")), "v")
        .join(texts.select(F.col("node").alias("u"), F.col("words").alias("wu")), "u")
    )
    return joined.select("u", "v", "wu", "wv").mapInArrow(run, "u binary, v binary")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few rows: rows hold whole texts, of any length."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(TEXTS_PER_BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def verified_links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    with small_batches(pairs.sparkSession):
        return cut(verified(pairs, texts, threshold))


def places(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The place of each shingle in the frequency table."""
    return (mix(shingles ^ _STEP) >> np.uint64(64 - bits)).astype(np.int64)


def shingle_frequency(held: DataFrame, bits: int) -> np.ndarray:
    """How many of the texts ``(node, words)`` hold a shingle of each place: a table of fixed size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for whole in batches:
            for batch in sliced([whole], "words"):
                for words in batch.column("words").to_pylist():
                    np.add.at(total, places(shingles_of(words.split())[0], bits), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    rows = held.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << bits, dtype=np.int64)
    table[rows["place"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return np.minimum(table, np.iinfo(np.int32).max).astype(np.int32)


def prefix_shingles(held: DataFrame, threshold: float) -> DataFrame:
    """``(node, shingle, before, size)``: the first shingles of each node in one order for all, rare ones first.

    A shingle counts if what comes before it weighs at most ``1 - threshold`` of the node.
    Two nodes at the threshold share that much weight that the first shingle they have in
    common is such a one of both.  Any order that is the same for all nodes gives that; the
    frequencies, of places that several shingles may share, only decide how few meet.
    ``held`` are the texts ``(node, words)``, written out.
    ``size`` is the weight of the node and ``before`` what of it stands before the shingle.
    """
    bits = FREQUENCY_BITS
    frequency = shingle_frequency(held, bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced([whole], "words"):
                found, before, sizes = [], [], []
                for words in batch.column("words").to_pylist():
                    elements, counts = shingles_of(words.split())
                    order = np.lexsort((mix(elements ^ _STEP), frequency[places(elements, bits)]))
                    size = int(counts.sum())
                    passed = np.cumsum(counts[order]) - counts[order]
                    first = order[passed <= (1 - threshold) * size + 1e-9]
                    found.append(elements[first])
                    before.append(passed[: len(first)])
                    sizes.append(size)
                row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(row), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(before)),
                     pa.array(np.array(sizes)).take(row)],
                    names=["node", "shingle", "before", "size"],
                )

    return held.mapInArrow(run, "node binary, shingle long, before long, size long")


def cross_pairs(members: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs of nodes with different labels and a common prefix shingle that may be their first at
    the threshold; the largest label of a key is only paired with the others.

    Two nodes at the threshold share at least ``threshold / (1 + threshold)`` of their sizes' sum.
    What stands before the first shingle they have in common is in one of them only, so the rest of
    either must weigh that much.  A shingle so common that it comes late fails this, however many hold it.
    """
    per_label = members.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    major = per_label.groupBy(*keys).agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count("*").alias("labels"))
    held = members.join(major.where("labels > 1"), keys)
    minor = held.where("label <> major").select(*keys, F.col("node").alias("a"), F.col("label").alias("la"), F.col("size").alias("sa"), F.col("before").alias("pa"), "major")
    other = held.select(*keys, F.col("node").alias("b"), F.col("label").alias("lb"), F.col("size").alias("sb"), F.col("before").alias("pb"))
    common = threshold / (1 + threshold) * (F.col("sa") + F.col("sb")) - 1e-6
    enough = (F.col("sa") - F.col("pa") >= common) & (F.col("sb") - F.col("pb") >= common)
    # a pair of two minor labels is met from both sides: keep one of them
    met = minor.join(other, keys).where("la <> lb AND (lb = major OR a < b)").where(enough)
    return met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def drawn_pairs(members: DataFrame, turn: int) -> DataFrame:
    """For each node outside the largest class of a bucket, members of that class: one per
    bucket, drawn by hash, of which a node tries at most ``TRIES`` in a turn."""
    drawn = F.xxhash64("node", "band", F.lit(turn))
    per_label = members.groupBy("band", "label").agg(F.count("*").alias("n"), F.min(F.struct(drawn, "node")).alias("pick"))
    major = per_label.groupBy("band").agg(F.max_by(F.struct("label", "pick"), F.struct("n", "label")).alias("m"))
    met = members.join(major.select("band", F.col("m.label").alias("major"), F.col("m.pick.node").alias("other")), "band").where("label <> major")
    met = met.select("node", "other").distinct()
    order = W.partitionBy("node").orderBy(F.xxhash64("node", "other", F.lit(turn)), "other")
    chosen = met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= TRIES)
    return chosen.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links).select("node", F.col("root").alias("label"))
    return members.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _unresolved(members: DataFrame) -> DataFrame:
    open_ = members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    return members.join(open_, "band", "left_semi")


def narrowed(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that span several classes under ``links``; the table before is dropped."""
    out = cut(_unresolved(_labelled(members.select("band", "node"), links)))
    drop_cut(members)
    return out


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text",
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """``(doc_id, text_hash, class_id, class_rows, head)`` for every document row; ``head`` marks
    the rows of the class's least document (id, then hash of the text; null ids last)."""
    docs = text_rows(docs, doc_id, text).withColumn("text_hash", F.xxhash64("text"))
    sketch = cut(sketches(docs, bands, rows))
    first_row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    nodes = sketch.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.min(first_row).alias("head"), F.count("*").alias("copies"), F.first("bands").alias("bands")
    )
    nodes = cut(nodes)
    owners = cut(sketch.select("doc_id", "text_hash", "node"))
    drop_cut(sketch)  # bands are wide: what is read no more goes before the next table is written
    spread = nodes.select("node", F.explode("bands").alias("band"))
    heads = spread.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut(spread.join(heads, "band"))
    signed, nodes = nodes, cut(nodes.drop("bands"))
    drop_cut(signed)
    held = members.select("node").distinct().join(nodes.select("node", "least_id"), "node")
    texts = cut(
        keyed_texts(docs).alias("t").join(held.alias("h"), F.expr("t.node = h.node AND t.doc_id <=> h.least_id"), "left_semi")
        .select("node", "words").dropDuplicates(["node"])
    )
    # 1. every node against the least node it meets
    tried = cut(members.groupBy("node").agg(F.min("head").alias("u")).where("u < node").select("u", F.col("node").alias("v")))
    links = verified_links(tried, texts, threshold)
    left = members
    # 2. nodes outside the largest class of a bucket against members of it drawn by hash
    for turn in range(TURNS):
        left = narrowed(left, links)
        pairs = cut(drawn_pairs(left, turn).join(tried, ["u", "v"], "left_anti"))
        tried = tried.unionByName(pairs)
        links = links.unionByName(verified_links(pairs, texts, threshold))
    # 3. whatever pairs of different classes are left
    left = narrowed(left, links)
    nodes_left = cut(left.select("node", "label").distinct())
    open_texts = cut(texts.join(nodes_left, "node", "left_semi").select("node", "words"))
    drop_cut(left, texts)
    prefixes = cut(nodes_left.join(prefix_shingles(open_texts, threshold), "node"))
    third = cut(cross_pairs(prefixes, ["shingle"], threshold).join(tried, ["u", "v"], "left_anti"))
    drop_cut(prefixes)
    links = links.unionByName(verified_links(third, open_texts, threshold))
    drop_cut(open_texts)

    roots = components(links)
    classes = nodes.select("node", "head", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    totals = classes.groupBy("root").agg(F.min("head").alias("head"), F.sum("copies").alias("class_rows"))
    by_node = classes.select("node", "root").join(totals, "root").select("node", F.col("head").alias("first"), "class_rows")
    alone = F.col("node").isNull()
    return owners.join(by_node, "node", "left").select(
        "doc_id", "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("class_rows", F.lit(1)).alias("class_rows"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))).alias("head"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document rows of ``docs`` without near duplicates of an earlier id; of rows with the
    same id and text one stays.  Texts without words all stay."""
    heads = near_duplicates(docs, threshold, doc_id, text).where("head").select("doc_id", "text_hash").distinct().alias("h")
    wordless = F.col(f"`{text}`").isNull() | F.col(f"`{text}`").cast("string").rlike(r"^[ \t-\r]*$")
    mark = "_row_hash" + "_" * max(len(c) for c in docs.columns)  # no column has that name
    rest = docs.where(~wordless).withColumn(mark, F.xxhash64(F.col(f"`{text}`").cast("string")))
    same = F.col(f"d.`{doc_id}`").cast("long").eqNullSafe(F.col("h.doc_id")) & (F.col(f"d.{mark}") == F.col("h.text_hash"))
    kept = rest.alias("d").join(heads, same, "left_semi").dropDuplicates([doc_id, mark]).drop(mark)
    return kept.unionByName(docs.where(wordless))
