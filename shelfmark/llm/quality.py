"""Quality rules and an isolation forest on their statistics.

Every text gives a row of rule statistics in one pass.  Texts that break a base rule go.
The others are judged by an isolation forest: trees of random splits are grown over the
labelled rows, a row's mean path length says how soon it stands alone, and the cut-off is
calibrated on the same rows so that hardly any row labelled good lies beyond it.  All
labelled rows that pass the base rules take part: each is dealt to at least one tree by a
hash, and the cut-off is read from counts of all their scores in ``BINS`` steps.  Only the
trees, a fixed number of nodes, and these counts reach the driver.

Nulls and texts without words have zero statistics and fail the base rule.  Repeated
document rows are judged one by one; repeated labels count once, and ids labelled both
good and bad are left out of the fit.  Without labels of both kinds nothing but the base
rules rejects.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfmark.llm.common import sliced, text_rows, words_of
from shelfmark.session import cut

SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_unique_words", "n_symbol_words", "n_end_words", "longest_run"]
STATS_SCHEMA = ", ".join(["doc_id long", *(f"{c} long" for c in BASE + EXTRA)])
KEPT_GOOD = 0.998
TREES, SHARE, BAD_SHARE, BINS = 200, 256, 0.03, 100_000
FEATURES = ["f0", "f1", "f2", "f3", "f4", "f5"]


def repeated_words(codes: np.ndarray, owner: np.ndarray, n_texts: int, span: int = 3) -> np.ndarray:
    """Per text, its words in windows of ``span`` words that occur more than once in it."""
    total = np.zeros(n_texts, dtype=np.int64)
    if len(codes) < span:
        return total
    # exact window codes: pair the code so far with the next word and renumber
    window = codes.astype(np.int64)
    width = int(codes.max()) + 1
    for k in range(1, span):
        _, window = np.unique(window[:-1] * width + codes[k:], return_inverse=True)
    whole = owner[: len(window)] == owner[span - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return total
    key = owner[at].astype(np.int64) * (int(window.max()) + 1) + window[at]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    mark = np.zeros(len(codes) + 1, dtype=np.int64)
    hits = at[counts[inverse] > 1]
    np.add.at(mark, hits, 1)
    np.add.at(mark, hits + span, -1)
    covered = np.cumsum(mark[:-1]) > 0
    return np.bincount(owner[covered], minlength=n_texts)


def statistics_of(texts: list[str | None]) -> dict[str, np.ndarray]:
    split = [words_of(t) for t in texts]
    n = len(texts)
    flat = [w for words in split for w in words]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    owner = np.repeat(np.arange(n), counts)
    code: dict[bytes, int] = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for w in flat), dtype=np.int64, count=len(flat))
    known = list(code)
    chars = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8")) for w in known), dtype=np.int64, count=len(known))
    symbols = np.fromiter((len(w) - len(w.translate(None, SYMBOLS)) for w in known), dtype=np.int64, count=len(known))
    ends = np.fromiter((w[-1:] in b".,;:!?" for w in known), dtype=np.int64, count=len(known))

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values[codes] if len(codes) else None, minlength=n).astype(np.int64)

    out = {"n_words": counts, "word_chars": total(chars), "n_symbols": total(symbols)}
    dup, lines = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for k, t in enumerate(texts):
        if t and "\n" in t:
            full = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
            lines[k], dup[k] = len(full), len(full) - len(set(full))
        else:
            lines[k] = counts[k] > 0
    out |= {"n_dup_lines": dup, "n_repeat_words": repeated_words(codes, owner, n), "n_lines": lines}
    out["n_unique_words"] = np.fromiter((len(set(w)) for w in split), dtype=np.int64, count=n)
    out["n_symbol_words"], out["n_end_words"] = total((symbols > 0).astype(np.int64)), total(ends)
    longest = np.zeros(n, dtype=np.int64)
    if len(codes):  # longest run of one word
        starts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])))
        np.maximum.at(longest, owner[starts], np.diff(np.append(starts, len(codes))))
    out["longest_run"] = longest
    return out


def rule_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of statistics per document row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = statistics_of(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), *(pa.array(found[c]) for c in BASE + EXTRA)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, *EXTRA])

    return text_rows(docs, doc_id, text).mapInArrow(run, STATS_SCHEMA)


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios that do not depend on length.  Length and repeated windows are left to the base
    rules.  Repeated lines decide nothing by themselves: they are given as statistics, and
    weigh only through their repeated windows and unique words.  As features, the shares of
    repeated lines and windows hide the other ratios and let more bad rows pass."""
    words = np.maximum(stats["n_words"], 1).astype(float)
    return np.column_stack([
        stats["word_chars"] / words,
        np.log1p(1000 * stats["n_symbols"] / np.maximum(stats["word_chars"], 1)),
        np.log(np.maximum(stats["n_unique_words"], 1) / words),
        stats["n_symbol_words"] / words,
        stats["n_end_words"] / words,
        np.log1p(stats["longest_run"]),
    ])


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Trees of random splits in flat arrays; children of node k are 2k + 1 and 2k + 2."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SHARE, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        self._blank(trees, size)
        for t in range(trees):
            self._grow(t, 0, 0, rows[rng.choice(len(rows), size, replace=False)], rng)

    def _blank(self, trees: int, size: int) -> None:
        """``trees`` empty trees, as deep as shares of ``size`` rows need, up to ``SHARE``."""
        self.depth = max(1, math.ceil(math.log2(max(min(size, SHARE), 2))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, dtype=np.int16)
        self.split = np.zeros((trees, nodes))
        self.path = np.zeros((trees, nodes))
        self.scale = mean_path(size) or 1.0

    @classmethod
    def one(cls, rows: np.ndarray, size: int, seed: int) -> IsolationForest:
        """A single tree over all ``rows``, whatever their order."""
        tree = cls.__new__(cls)
        tree._blank(1, size)
        tree._grow(0, 0, 0, rows, np.random.default_rng(seed))
        return tree

    @classmethod
    def of(cls, grown: list, size: int) -> IsolationForest:
        """The forest of trees that were grown apart."""
        forest = cls.__new__(cls)
        forest._blank(len(grown), size)
        for t, tree in enumerate(grown):
            forest.feature[t], forest.split[t], forest.path[t] = tree.feature, tree.split, tree.path
        return forest

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, rng) -> None:
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth == self.depth or not len(spread):
            self.path[t, node] = depth + mean_path(len(rows))
            return
        f = int(rng.choice(spread))
        at = rng.uniform(rows[:, f].min(), rows[:, f].max())
        left = rows[:, f] < at
        if left.all() or not left.any():
            left = rows[:, f] <= rows[:, f].min()
            at = np.nextafter(rows[:, f].min(), np.inf)
        self.feature[t, node], self.split[t, node] = f, at
        self._grow(t, 2 * node + 1, depth + 1, rows[left], rng)
        self._grow(t, 2 * node + 2, depth + 1, rows[~left], rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]: near 1 for rows that stand alone after few splits."""
        total = np.zeros(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = rows[np.arange(len(rows)), np.maximum(f, 0)] >= split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.scale)


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def steps(score: np.ndarray) -> np.ndarray:
    """Scores as whole steps, in which they are counted and judged."""
    return np.floor(score * BINS).astype(np.int64)


def calibrated(step: np.ndarray, good: np.ndarray, bad: np.ndarray, kept_good: float) -> int:
    """The step beyond which rows go, from the good and bad rows of each step in order: the one
    with the most bad rows gone for each good row gone, among cuts that keep at least
    ``kept_good`` of the good rows."""
    place = math.ceil(kept_good * (int(good.sum()) - 1)) + 1
    least = int(step[np.searchsorted(np.cumsum(good), place)])
    inside = step[(bad > 0) & (step > least)]
    return (least + int(inside[0])) // 2 if len(inside) else least


def copies(good: int, bad: int) -> tuple[int, int, int]:
    """To how many trees a good and a bad row are dealt, and the rows of a tree.

    Every row is in one tree at least, a tree has ``SHARE`` good rows where there are so many, and
    about ``BAD_SHARE`` as many bad ones: many bad rows would hide each other.
    """
    of_good = min(TREES, max(math.ceil(TREES * SHARE / good), math.ceil(bad / (BAD_SHARE * good))))
    of_bad = min(TREES, max(1, round(BAD_SHARE * good * of_good / bad)))
    return of_good, of_bad, max(1, round((good * of_good + bad * of_bad) / TREES))


def labelled_features(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, quality`` and features of every labelled row that passes the base rules."""
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most").drop("most")
    )

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = {c: frame[c].to_numpy() for c in BASE + EXTRA}
            out = pd.DataFrame(features(found), columns=FEATURES)
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            out.insert(1, "quality", frame["quality"].to_numpy())
            yield out[~base_failed(found)]

    schema = "doc_id long, quality int, " + ", ".join(f"{c} double" for c in FEATURES)
    return stats.select("doc_id", *BASE, *EXTRA).join(marks, "doc_id").mapInPandas(run, schema)


def fitted(stats: DataFrame, labels: DataFrame, kept_good: float = KEPT_GOOD):
    """Forest and cut-off from all labelled rows that pass the base rules; None without both kinds."""
    rows = cut(labelled_features(stats, labels))
    counts = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    of_good, of_bad, size = copies(counts[1], counts[0])

    def grow(share: pd.DataFrame) -> pd.DataFrame:
        t = int(share["tree"].iloc[0])
        tree = IsolationForest.one(share[FEATURES].to_numpy(), size, t)
        return pd.DataFrame({
            "tree": [t], "feature": [tree.feature[0].tolist()], "split": [tree.split[0].tolist()], "path": [tree.path[0].tolist()],
        })

    def score(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"step": steps(forest.score(frame[FEATURES].to_numpy())), "quality": frame["quality"].to_numpy()})

    first = F.pmod(F.xxhash64("doc_id", *FEATURES), F.lit(TREES))
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == 1, of_good - 1).otherwise(of_bad - 1)))
    dealt = rows.withColumn("turn", turn).withColumn("tree", ((first + 77 * F.col("turn")) % TREES).cast("int"))
    grown = dealt.select("tree", *FEATURES).groupBy("tree").applyInPandas(
        grow, "tree int, feature array<int>, split array<double>, path array<double>"
    )
    forest = IsolationForest.of(sorted(grown.collect(), key=lambda r: r.tree), size)
    scored = rows.mapInPandas(score, "step long, quality int").groupBy("step").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    ).toPandas().sort_values("step")
    return forest, calibrated(*(scored[c].to_numpy() for c in ("step", "good", "bad")), kept_good)


def verdicts(stats: dict[str, np.ndarray], model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base_failed``, ``kept`` and the anomaly score."""
    failed = base_failed(stats)
    score = model[0].score(features(stats)) if model else np.zeros(len(failed))
    return failed, ~failed & (steps(score) <= model[1] if model else True), score


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, kept_good: float = KEPT_GOOD, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Statistics, ``base_failed``, ``kept`` and ``anomaly_score`` for every document row."""
    held = cut(rule_statistics(docs, doc_id, text))
    model = fitted(held, labels, kept_good)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = {c: batch.column(c).to_numpy() for c in BASE + EXTRA}
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, verdicts(stats, model))],
                names=["doc_id", *BASE, *EXTRA, "base_failed", "kept", "anomaly_score"],
            )

    return held.mapInArrow(run, STATS_SCHEMA + ", base_failed boolean, kept boolean, anomaly_score double")


def kept_documents(
    docs: DataFrame, labels: DataFrame, kept_good: float = KEPT_GOOD, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that are kept, all their columns unchanged.

    Rows are written out with their statistics, so each text is read once for fit and verdict.
    """
    name = "statistics"
    while name in docs.columns:
        name += "_"

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            found = statistics_of(batch.column(batch.schema.get_field_index(text)).to_pylist())
            held = pa.StructArray.from_arrays([pa.array(found[c]) for c in BASE + EXTRA], names=BASE + EXTRA)
            yield pa.RecordBatch.from_arrays([*batch.columns, held], names=[*batch.schema.names, name])

    kind = StructType([StructField(c, LongType()) for c in BASE + EXTRA])
    held = cut(docs.mapInArrow(measure, StructType([*docs.schema.fields, StructField(name, kind)])))
    numbers = held.select(F.col(doc_id).cast("long").alias("doc_id"), *[F.col(name)[c].alias(c) for c in BASE + EXTRA])
    model = fitted(numbers, labels, kept_good)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.schema.get_field_index(name))
            stats = {c: found.field(c).to_numpy() for c in BASE + EXTRA}
            yield batch.drop_columns([name]).filter(pa.array(verdicts(stats, model)[1]))

    return held.mapInArrow(judge, docs.schema)
