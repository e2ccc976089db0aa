"""Nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The tree is grown on the driver over a bounded sample of at most ``SAMPLE`` distinct
vectors, with at most ``MAX_LEAVES`` leaves; every vector is indexed in the leaf it
descends to.  A query walks the tree through a priority queue of branch distances and
visits leaves in that order.  How many is calibrated: for at most ``TRIALS`` queries the
true neighbours are found by brute force over all vectors, and visits widen until the
wanted share of them lies in visited leaves (and enough candidates for ``k``).

Leaves are cut into blocks of bounded size and queries of a leaf likewise, so no task
holds a whole leaf.  Equal vectors are one entry that keeps its ``k + 1`` least ids: no
other id of it can be among the ``k`` nearest of any query.  Distances are computed from
the original vectors in double precision.

Vectors that are null, zero, hold null or non-finite components or have another length
than most take no part, neither do rows without an id.  Equal rows count once; a row with
the query's id is the query's own.  Queries that take no part return no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.session import cut

SAMPLE, MAX_LEAVES, LEAF_SIZE, BRANCH = 65_536, 4_096, 400, 8
TRIALS, RECALL, BLOCK = 256, 0.97, 8_192


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, key, vec)``: the vectors that take part, as bytes of doubles."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    length = sizes["n"] if sizes else 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).astype(float)
            x = flat.reshape(-1, length) + 0.0  # no negative zeros
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            raw = [r.tobytes() for r in x[good]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), pa.array([hashlib.md5(r).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())],
                names=["vec_id", "key", "vec"],
            )

    return rows.where(F.size("v") == length).mapInArrow(run, "vec_id long, key binary, vec binary").dropDuplicates(["vec_id", "key"])


def matrix(raw: Iterable[bytes]) -> np.ndarray:
    rows = list(raw)
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1) if rows else np.empty((0, 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, taken around the mean of ``b`` so that a common offset costs no digits."""
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = squared(x, centres).argmin(axis=1)
        filled = np.unique(near)
        centres = np.stack([x[near == c].mean(axis=0) for c in filled])
    return centres


class Tree:
    """``centres[node]`` are the centres of its children ``children[node]``; a child below 0 is leaf ``-1 - child``."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 3):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self._grow(sample, leaves, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, leaves: int, rng) -> int:
        k = min(BRANCH, leaves, len(x))
        centres = kmeans(x, k, rng) if k > 1 else np.empty((0, 0))
        if len(centres) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.children)
        self.centres.append(centres)
        self.children.append([])
        near = squared(x, centres).argmin(axis=1)
        self.children[node] = [
            self._grow(x[near == c], max(1, round(leaves * (near == c).mean())), rng) for c in range(len(centres))
        ]
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        if not self.children:
            return out
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            near = squared(x[rows], self.centres[node]).argmin(axis=1)
            for c, child in enumerate(self.children[node]):
                mine = rows[near == c]
                if child < 0:
                    out[mine] = -1 - child
                elif len(mine):
                    todo.append((child, mine))
        return out

    def visit(self, q: np.ndarray, enough) -> list[int]:
        """Leaves in best-bin-first order until ``enough(leaves)``."""
        found: list[int] = []
        if not self.children:
            return [0]
        heap = [(0.0, 0)]
        while heap and not enough(found):
            _, node = heapq.heappop(heap)
            while node >= 0:
                apart = ((self.centres[node] - q) ** 2).sum(axis=1)
                best = int(apart.argmin())
                for c, child in enumerate(self.children[node]):
                    if c != best:
                        heapq.heappush(heap, (float(apart[c]), child))
                node = self.children[node][best]
            found.append(-1 - node)
        return found


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query, the places of its ``k`` nearest vectors (more on ties) and exact distances.

    The expanded square errs by a few units of rounding of the squared norms around the
    mean.  All vectors within twice that of the k-th are measured exactly.
    """
    if not len(vectors):
        return
    centre = vectors.mean(axis=0)
    around = vectors - centre
    norms = (around * around).sum(axis=1)
    unit = 4 * (vectors.shape[1] + 8) * np.finfo(np.float64).eps
    for lo in range(0, len(queries), 256):
        asked = queries[lo : lo + 256] - centre
        own = (asked * asked).sum(axis=1)
        near = own[:, None] + norms[None, :] - 2 * asked @ around.T
        for i, row in enumerate(near):
            error = unit * (own[i] + norms.max())
            if len(row) > k and np.isfinite(error):
                at = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + 2 * error)
            else:
                at = np.arange(len(row))
            apart = np.sqrt(((vectors[at] - queries[lo + i]) ** 2).sum(axis=1))
            if len(at) > k:
                kept = apart <= np.partition(apart, k - 1)[k - 1]
                at, apart = at[kept], apart[kept]
            yield lo + i, at, apart


def _best(rows: DataFrame, per: str, k: int) -> DataFrame:
    order = W.partitionBy(per).orderBy("distance", "least_id", "key")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def brute_force(entries: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest entries of a bounded table of queries, by a pass over all entries."""
    keys, points = queries["qkey"].tolist(), matrix(queries["qvec"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("vec")).to_pylist())
            if not len(x):
                continue
            parts = [(keys[i], at, d) for i, at, d in nearest(points, x, k)]
            at = pa.array(np.concatenate([p[1] for p in parts]))
            qkey = [key for key, places, _ in parts for _ in places]
            yield pa.RecordBatch.from_arrays(
                [pa.array(qkey, pa.binary()), pa.array(np.concatenate([p[2] for p in parts]))]
                + [batch.column(batch.schema.get_field_index(c)).take(at) for c in ("key", "least_id", "leaf")],
                names=["qkey", "distance", "key", "least_id", "leaf"],
            )

    return _best(entries.mapInArrow(run, "qkey binary, distance double, key binary, least_id long, leaf long"), "qkey", k)


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    points = cut(usable(vectors, vec_id, vector))
    entries = points.groupBy("key").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("least_id"), F.count("*").alias("rows"))
    entries = cut(entries)
    n = entries.count()
    sample = entries.orderBy("key").limit(SAMPLE).select("vec").toPandas()
    tree = Tree(matrix(sample["vec"]), int(min(MAX_LEAVES, max(1, n // LEAF_SIZE), max(1, len(sample) // 8))))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("vec")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaf_of(x))], names=[*batch.schema.names, "leaf"])

    index = cut(entries.mapInArrow(place, "key binary, vec binary, least_id long, rows long, leaf long"))
    asked = points.where(is_query)
    queries = asked.groupBy("key").agg(F.first("vec").alias("qvec")).withColumnRenamed("key", "qkey")
    # a bounded table: one row per leaf
    held = {r["leaf"]: (r["n"], r["ids"]) for r in index.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.least("rows", F.lit(k + 1))).alias("ids")).collect()}

    trials = queries.orderBy("qkey").limit(TRIALS).toPandas()
    truth = brute_force(index, trials, k + 1).select("qkey", "leaf").toPandas() if len(trials) else pd.DataFrame({"qkey": [], "leaf": []})
    order = {key: {leaf: i for i, leaf in enumerate(tree.visit(q, lambda found: False))} for key, q in zip(trials["qkey"], matrix(trials["qvec"]))}
    needed = sorted(order[key][leaf] + 1 for key, leaf in zip(truth["qkey"], truth["leaf"]))
    visits = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1

    def routes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def enough(found: list[int]) -> bool:
            return len(found) >= visits and sum(held.get(leaf, (0, 0))[1] for leaf in found) > k

        for batch in batches:
            x = matrix(batch.column(1).to_pylist())
            found = [tree.visit(q, enough) for q in x]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array([leaf for f in found for leaf in f], pa.int64())],
                names=["qkey", "qvec", "leaf"],
            )

    routed = cut(queries.select("qkey", "qvec").mapInArrow(routes, "qkey binary, qvec binary, leaf long"))
    asking = {r["leaf"]: r["n"] for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame(
        [(leaf, -(-size // BLOCK), -(-asking.get(leaf, 0) // BLOCK)) for leaf, (size, _) in held.items()] or [(0, 1, 1)],
        "leaf long, parts long, shares long",
    )
    # each block of a leaf meets each share of its queries
    left = (
        routed.join(F.broadcast(blocks), "leaf").withColumn("share", F.pmod(F.xxhash64("qkey"), "shares"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("leaf", "part", "share", "qkey", "qvec")
    )
    right = (
        index.join(F.broadcast(blocks.where("shares > 0")), "leaf").withColumn("part", F.pmod(F.xxhash64("key"), "parts"))
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("leaf", "part", "share", "key", "vec", "least_id")
    )

    def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"qkey": [], "key": [], "least_id": [], "distance": []})
        keys, least, qkeys = v["key"].to_numpy(), v["least_id"].to_numpy(), q["qkey"].to_numpy()
        parts = [(np.repeat(qkeys[i : i + 1], len(at)), keys[at], least[at], d) for i, at, d in nearest(matrix(q["qvec"]), matrix(v["vec"]), k + 1)]
        return pd.DataFrame({c: np.concatenate([p[j] for p in parts]) for j, c in enumerate(["qkey", "key", "least_id", "distance"])})

    by = ["leaf", "part", "share"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, "qkey binary, key binary, least_id long, distance double")
    near = _best(found, "qkey", k + 1)
    ids = points.select("key", "vec_id").withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    listed = near.join(ids, "key")
    listed = listed.withColumn("n", F.row_number().over(W.partitionBy("qkey").orderBy("distance", "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("qkey"))
    pairs = own.join(listed, "qkey").where("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "qkey").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").alias("score"))
