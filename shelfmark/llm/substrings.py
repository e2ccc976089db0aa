"""Removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words.  Its minimiser is the least hash among its
``GRAM``-word grams; consecutive windows that share its leftmost place form a
super-k-mer.  Equal windows have equal minimisers at different places, so a super-k-mer
whose minimiser occurs once holds no repeat and stays home.  The others travel as one packed string of words to the bucket of
their minimiser.  Equal strings are counted before they are shuffled; in the bucket,
sorting the windows of all its strings by a 128-bit hash of their words counts each.
Strings get back one flag per window, documents the flags of their strings, and words
under a flagged window go.

A minimiser met more than ``HOT`` times (a line many documents share) would fill one
bucket with different neighbourhoods of it: its super-k-mers travel as single windows to
the buckets of their own hashes instead.

Counts, joins and grouping are Spark's; a task holds one slice of texts or the strings of
one bucket run.  Nulls and texts shorter than a window lose nothing.  Rows with the same
id and text are occurrences of their own and are treated alike.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import gram_hashes, mix, sliced, text_rows, word_hashes, words_of
from shelfmark.session import cut, drop_cut

WINDOW = 35
GRAM = 5
HOT = 200_000
RUN_BYTES = 16 << 20
SAME_ROW = "{a}.doc_id <=> {b}.doc_id AND {a}.text_hash = {b}.text_hash"


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """Least gram hash of every ``width`` consecutive grams."""
    least, span = grams, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least


def super_kmers(
    texts: list[list[bytes]], window: int = WINDOW, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, minimiser, first window and number of windows of each super-k-mer of some texts."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    flat = [w for words in texts for w in words]
    if sizes.max(initial=0) < window:
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.uint64), none.astype(np.int32), none.astype(np.int32)
    gram = min(gram, window)
    grams = gram_hashes(word_hashes(flat), gram)
    least = minimisers(grams, window - gram + 1)
    text = np.repeat(np.arange(len(texts)), np.maximum(sizes - window + 1, 0))
    first = np.cumsum(np.maximum(sizes - window + 1, 0)) - np.maximum(sizes - window + 1, 0)
    place = np.arange(len(text)) - first[text]
    at = (np.cumsum(sizes) - sizes)[text] + place  # of the whole windows among all runs of words
    low, lead = least[at], grams[at]
    # a new place of the minimiser starts a new one, even if the hash is the same
    new = np.append(True, (text[1:] != text[:-1]) | (low[1:] != low[:-1]) | (lead[:-1] == low[:-1]))
    starts = np.flatnonzero(new)
    return text[starts], low[starts], place[starts].astype(np.int32), np.diff(np.append(starts, len(text))).astype(np.int32)


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """Every super-k-mer of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            text, mini, first, n = super_kmers([words_of(t) for t in batch.column("text").to_pylist()], window)
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("text_hash").take(row),
                 pa.array(mini.view(np.int64)), pa.array(first), pa.array(n)],
                names=["doc_id", "text_hash", "mini", "first", "n"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, mini long, first int, n int")


def _strings(words: list[bytes], spans: list[dict], window: int) -> Iterator[tuple[int, int, bytes]]:
    """``(bucket, first window, packed string)`` of the travelling super-k-mers of a text."""
    whole = None
    for span in spans:
        first, n = span["first"], span["n"]
        if not span["hot"]:
            yield span["mini"], first, b" ".join(words[first : first + n + window - 1])
            continue
        if whole is None:
            whole = gram_hashes(word_hashes(words), window).view(np.int64)
        for k in range(first, first + n):
            yield int(whole[k]), k, b" ".join(words[k : k + window])


def _packed(held: DataFrame, window: int) -> DataFrame:
    """``(bucket, packed, times)``, counted per slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts: Counter = Counter()
            rows = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "spans", "copies"))
            for text, spans, copies in zip(*rows):
                for bucket, _, packed in _strings(words_of(text), spans, window):
                    counts[bucket, packed] += copies
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()),
                 pa.array(list(counts.values()), pa.int64())],
                names=["bucket", "packed", "times"],
            )

    return held.select("text", "spans", "copies").mapInArrow(run, "bucket long, packed binary, times long")


def _occurrences(held: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row, firsts, keys = [], [], []
            for k, (text, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())):
                for _, first, packed in _strings(words_of(text), spans, window):
                    row.append(k)
                    firsts.append(first)
                    keys.append(hashlib.md5(packed).digest())
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(firsts, pa.int32()), pa.array(keys, pa.binary())],
                names=["doc_id", "text_hash", "first", "key"],
            )

    return held.select("doc_id", "text_hash", "text", "spans").mapInArrow(run, "doc_id long, text_hash long, first int, key binary")


def flagged(packed: list[bytes], times: list[int], window: int) -> Iterator[tuple[bytes, bytes]]:
    """Strings with a window that occurs more than once, and a byte per window saying which."""
    split = [p.split(b" ") for p in packed]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    hashes = word_hashes([w for words in split for w in words])
    windows = sizes - window + 1
    ends = np.cumsum(windows)
    of = np.repeat(np.arange(len(split)), windows)
    at = (np.cumsum(sizes) - sizes)[of] + np.arange(len(of)) - (ends - windows)[of]
    both = np.empty(len(of), dtype=[("a", np.uint64), ("b", np.uint64)])
    both["a"], both["b"] = gram_hashes(hashes, window)[at], gram_hashes(mix(hashes), window)[at]
    order = np.lexsort((both["b"], both["a"]))
    ordered = both[order]
    group = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
    total = np.bincount(group, weights=np.asarray(times)[of][order])
    repeated = np.empty(len(both), dtype=bool)
    repeated[order] = total[group] > 1
    for p, lo, hi in zip(packed, (ends - windows).tolist(), ends.tolist()):
        if repeated[lo:hi].any():
            yield p, repeated[lo:hi].astype(np.uint8).tobytes()


def _bucket_flags(strings: DataFrame, window: int) -> DataFrame:
    """``(key, flags)`` from strings sorted by bucket; whole buckets are judged together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(packed: list, times: list) -> Iterator[pa.RecordBatch]:
            found = list(flagged(packed, times, window)) if packed else []
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.md5(p).digest() for p, _ in found], pa.binary()), pa.array([f for _, f in found], pa.binary())],
                    names=["key", "flags"],
                )

        packed, times, held, last = [], [], 0, None
        for whole in batches:
            for batch in sliced([whole], "packed", 1 << 20):
                buckets = batch.column("bucket").to_pylist()
                for bucket, p, n in zip(buckets, batch.column("packed").to_pylist(), batch.column("times").to_pylist()):
                    if bucket != last and held > RUN_BYTES:
                        yield from judge(packed, times)
                        packed, times, held = [], [], 0
                    packed.append(p)
                    times.append(n)
                    held, last = held + len(p), bucket
        yield from judge(packed, times)

    return strings.mapInArrow(run, "key binary, flags binary")


def kept_words(words: list[bytes], flags: list[dict], window: int) -> list[bytes]:
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for f in flags:
        at = f["first"] + np.flatnonzero(np.frombuffer(f["flags"], dtype=np.uint8))
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
    gone = np.cumsum(cover[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def _removed(held: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept = [
                kept_words(words_of(t), f, window)
                for t, f in zip(batch.column("text").to_pylist(), batch.column("flags").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(k) for k in kept], pa.int64()),
                 pa.array([b" ".join(k).decode("utf-8") for k in kept], pa.string())],
                names=["doc_id", "text_hash", "n_kept", "kept_text"],
            )

    return held.mapInArrow(run, "doc_id long, text_hash long, n_kept long, kept_text string")


def shortened(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``(doc_id, text_hash, n_kept, kept_text)`` of the texts that lose words.

    ``docs`` has ``doc_id``, ``text`` and ``text_hash``, Spark's ``xxhash64`` of the text.
    """
    docs = docs.where("text IS NOT NULL")
    found = cut(_scan(docs, window))
    repeated = found.groupBy("mini").agg(F.count("*").alias("n_mini")).where("n_mini > 1")
    spans = (
        found.join(repeated, "mini").select("doc_id", "text_hash", F.struct("first", "n", "mini", (F.col("n_mini") > hot).alias("hot")).alias("span"))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans"))
    )
    copies = docs.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    spans = cut(spans.alias("s").join(copies.alias("c"), F.expr(SAME_ROW.format(a="s", b="c"))).select("s.*", "copies"))
    drop_cut(found)
    held = cut(
        docs.alias("d").join(spans.alias("s"), F.expr(SAME_ROW.format(a="d", b="s"))).select("s.*", "text")
        .dropDuplicates(["doc_id", "text_hash"])
    )
    drop_cut(spans)
    strings = _packed(held, window).groupBy("bucket", "packed").agg(F.sum("times").alias("times"))
    flags = cut(_bucket_flags(strings.repartition("bucket").sortWithinPartitions("bucket"), window))
    marks = (
        _occurrences(held, window).join(flags, "key").groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("first", "flags")).alias("flags"))
    )
    touched = held.drop("spans", "copies").alias("h").join(marks.alias("m"), F.expr(SAME_ROW.format(a="h", b="m"))).select("h.*", "flags")
    return _removed(touched, window)


def with_hash(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return text_rows(docs, doc_id, text).withColumn("text_hash", F.xxhash64("text"))


def removal_digests(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every document row."""
    docs = with_hash(docs, doc_id, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            split = [words_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(w) for w in split], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split])],
                names=["doc_id", "text_hash", "n_words", "whole_sha256"],
            )

    whole = docs.mapInArrow(run, "doc_id long, text_hash long, n_words long, whole_sha256 string")
    less = shortened(docs, window).select("doc_id", "text_hash", "n_kept", F.sha2("kept_text", 256).alias("sha"))
    return whole.alias("w").join(less.alias("l"), F.expr(SAME_ROW.format(a="w", b="l")), "left").select(
        "w.doc_id", "n_words", (F.col("n_words") - F.coalesce("n_kept", "n_words")).alias("n_removed"),
        F.coalesce("sha", "whole_sha256").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the kept words of each text that loses any, joined by one space; all other
    rows and columns as they were."""
    less = shortened(with_hash(docs, doc_id, text), window).alias("l")
    same = F.col(f"d.`{doc_id}`").cast("long").eqNullSafe(F.col("l.doc_id")) & (F.xxhash64(F.col(f"d.`{text}`").cast("string")) == F.col("l.text_hash"))
    columns = [
        F.coalesce(F.col("l.kept_text"), F.col(f"d.`{c}`")).alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns
    ]
    return docs.alias("d").join(less, same, "left").select(*columns)
