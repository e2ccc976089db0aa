"""Embedding near-duplicates by cover trees and dual traversal.

Vectors of one group (equal label and length) whose cosine reaches a threshold are linked.
On unit vectors that is a threshold on the chord, a metric, so the triangle inequality
holds: every node of a tree has a centre and a covering radius measured over all its
vectors, and two nodes are apart when their centres' chord less both radii exceeds the
threshold, and linked throughout when chord plus radii stay below it.  Both decisions keep a
margin far above rounding; pairs between are compared one by one, in double precision.

*Levels.*  A group of more than ``LEAF_ROWS`` distinct vectors is divided: a bounded sample
of a node's vectors gives centres more than ``r`` apart (its own centre first), ``r`` halving
from level to level and within a node until there are two, and every vector of the node
goes to its nearest centre.  Nodes are divided until small or ``LEVELS`` deep; what is still
large then is dealt into parts by hash, and all parts meet.

*Traversal.*  Pairs of nodes descend level by level as a table, each to the pairs of its
children, and leave it when apart (no rows) or linked throughout (one row, however many links
it stands for).  Pairs of leaves are tasks: both leaves get a tree of the same kind in
memory, over at most ``LEAF_ROWS`` vectors each, and the same traversal runs there.

*Results.*  A task returns one row per vector that has links in it: their number and a
representative, so copies are never spelled out as pairs.  Sums give ``n_links``, the
representatives are the edges of the component search.  Equal vectors of a group are one
entry with its number of rows.

Vectors that are null, zero or hold null or non-finite components, rows without label and
rows without an id link with nothing; each is its own component (a null id has a null one)
and is kept.  Repeated rows are vectors of their own.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.operators.graph import components
from shelfmark.session import cut

LEAF_ROWS, LEVELS, FAN, TASK_ROWS = 4_096, 16, 64, 16_384
LOCAL_LEAF, LOCAL_FAN = 128, 8
MARGIN = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chords between unit vectors, right to about 1e-8."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def rows_of(raw: Iterable[bytes]) -> np.ndarray:
    listed = list(raw)
    return np.frombuffer(b"".join(listed), dtype=np.float64).reshape(len(listed), -1) if listed else np.empty((0, 1))


def spread(x: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows more than ``radius`` apart, the first row among them, each next one the farthest; and chords to all."""
    chosen, near = [0], chords(x, x[:1])
    least = near[:, 0]
    while len(chosen) < most:
        far = int(least.argmax())
        if least[far] <= radius:
            break
        chosen.append(far)
        near = np.column_stack([near, chords(x, x[far : far + 1])])
        least = np.minimum(least, near[:, -1])
    return np.array(chosen), near


class CoverTree:
    """A tree over the rows of ``x``; ``order`` lays every node's rows side by side."""

    def __init__(self, x: np.ndarray, leaf: int = LOCAL_LEAF, fan: int = LOCAL_FAN):
        self.order = np.arange(len(x))
        self.lo, self.hi, self.radius, self.children, centres = [], [], [], [], []
        todo = [(0, len(x), 0, None)]
        while todo:
            lo, hi, centre, parent = todo.pop()
            node = len(self.lo)
            if parent is not None:
                self.children[parent].append(node)
            rows = self.order[lo:hi]
            radius = float(chords(x[rows], x[centre : centre + 1]).max())
            self.lo.append(lo)
            self.hi.append(hi)
            self.radius.append(radius)
            self.children.append([])
            centres.append(centre)
            if hi - lo <= leaf or radius < MARGIN:
                continue
            first = np.flatnonzero(rows == centre)[0]
            rows = np.concatenate([[centre], np.delete(rows, first)])
            chosen, near = spread(x[rows], radius / 2, fan)
            home = near.argmin(axis=1)
            home[chosen] = np.arange(len(chosen))
            self.order[lo:hi] = rows[np.argsort(home, kind="stable")]
            sizes, at = np.bincount(home, minlength=len(chosen)), lo
            for k, size in enumerate(sizes):
                todo.append((at, at + int(size), int(rows[chosen[k]]), node))
                at += int(size)
        self.centres = x[centres]
        self.x = x[self.order]


class Links:
    """Link counts and components over the rows of one or two trees, without a list of pairs."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.counts, self.part = weights, np.zeros(len(weights), dtype=np.int64), np.arange(len(weights))

    def merge(self, parts: np.ndarray) -> None:
        parts = np.unique(parts)
        if len(parts) > 1:
            self.part[np.isin(self.part, parts[1:])] = parts[0]

    def all_between(self, a: np.ndarray, b: np.ndarray) -> None:
        self.counts[a] += self.weights[b].sum()
        if a is b:
            self.counts[a] -= self.weights[a]
        else:
            self.counts[b] += self.weights[a].sum()
        self.merge(self.part[np.concatenate([a, b])])

    def some_between(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        if not linked.any():
            return
        self.counts[a] += linked @ self.weights[b]
        if a is not b:
            self.counts[b] += linked.T @ self.weights[a]
        i, j = np.nonzero(linked)
        n = len(self.part)
        met = np.unique(self.part[a[i]] * n + self.part[b[j]])
        met = met[met // n != met % n]
        if len(met):
            root = np.arange(n)
            for x, y in zip((met // n).tolist(), (met % n).tolist()):
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
            while (root != root[root]).any():
                root = root[root]
            self.part = root[self.part]


def linked_rows(a: np.ndarray, b: np.ndarray, least_cosine: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` reach the cosine; close calls are summed row by row."""
    cosines = a @ b.T
    linked = cosines >= least_cosine
    close = np.abs(cosines - least_cosine) < 1e-12
    if close.any():
        i, j = np.nonzero(close)
        exact = (a[i] * b[j]).sum(axis=1) / np.sqrt((a[i] * a[i]).sum(axis=1) * (b[j] * b[j]).sum(axis=1))
        linked[i, j] = exact >= least_cosine
    return linked


def traverse(links: Links, a: CoverTree, b: CoverTree, ids_a: np.ndarray, ids_b: np.ndarray, least_cosine: float) -> None:
    """Dual traversal of two trees, or of one with itself (``a is b``)."""
    limit = np.sqrt(max(0.0, 2 - 2 * least_cosine))
    if not len(a.x) or not len(b.x):
        return
    between = chords(a.centres, b.centres)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        same = a is b and i == j
        gap, radii = (0.0, 2 * a.radius[i]) if same else (between[i, j], a.radius[i] + b.radius[j])
        if gap - radii > limit + MARGIN:
            continue
        mine, others = ids_a[a.lo[i] : a.hi[i]], ids_b[b.lo[j] : b.hi[j]]
        if gap + radii < limit - MARGIN:
            links.all_between(mine, mine if same else others)
        elif not a.children[i] and not b.children[j]:
            linked = linked_rows(a.x[a.lo[i] : a.hi[i]], b.x[b.lo[j] : b.hi[j]], least_cosine)
            if same:
                np.fill_diagonal(linked, False)
            links.some_between(mine, mine if same else others, linked)
        elif same:
            todo += [(c, d) for k, c in enumerate(a.children[i]) for d in a.children[i][k:]]
        elif a.children[i] and (not b.children[j] or a.radius[i] >= b.radius[j]):
            todo += [(c, j) for c in a.children[i]]
        else:
            todo += [(i, d) for d in b.children[j]]


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``(vec_id, key, grp, vec)``: ``vec`` are doubles, ``key`` and ``grp`` null where a row links with nothing."""
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.col(f"`{label}`").cast("string").alias("label")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([n or 0 for n in pc.list_value_length(batch.column(1)).to_pylist()], dtype=np.int64)
            flat = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).astype(float) + 0.0  # no negative zeros
            ends = np.cumsum(sizes)
            bad, set_ = np.concatenate([[0], np.cumsum(~np.isfinite(flat))]), np.concatenate([[0], np.cumsum(flat != 0)])
            fine = (bad[ends] == bad[ends - sizes]) & (set_[ends] > set_[ends - sizes])
            keys, groups, out = [], [], []
            for ok, end, size, row_id, tag in zip(fine.tolist(), ends.tolist(), sizes.tolist(), batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not ok or row_id is None or tag is None:
                    keys.append(None), groups.append(None), out.append(None)
                    continue
                raw, group = flat[end - size : end].tobytes(), hashlib.md5(f"{size}:{tag}".encode()).hexdigest()
                keys.append(hashlib.md5(raw + group.encode()).hexdigest()), groups.append(group), out.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.string()), pa.array(groups, pa.string()), pa.array(out, pa.binary())], names=["vec_id", "key", "grp", "vec"]
            )

    return rows.mapInArrow(run, "vec_id long, key string, grp string, vec binary")


def centres_of(rows: DataFrame, own: DataFrame, fans: DataFrame, level: int) -> DataFrame:
    """``(node, packed, n)``: centres of each node, from a sample of ``FAN`` vectors by hash.

    ``rows`` hold ``(node, key, vec)``; the node's own centre, from ``own``, comes first, and
    ``fans`` says how many are wanted, so that children come out not far below a leaf's size.
    """
    place = F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64("key", F.lit(level)), "key"))
    sample = rows.withColumn("_place", place).where(F.col("_place") <= FAN)
    packed = sample.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("_place", "vec"))).alias("sample")).join(own.select("node", "centre"), "node", "left").join(fans, "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, kept, counts = [], [], []
            for row in batch.to_pylist():
                raw = ([row["centre"]] if row["centre"] else []) + [s["vec"] for s in row["sample"]]
                x, radius = unit(rows_of(raw)), 2.0**-level
                chosen, _ = spread(x, radius, row["fan"])
                while len(chosen) < 2 and radius > MARGIN:
                    radius /= 2
                    chosen, _ = spread(x, radius, row["fan"])
                nodes.append(row["node"]), kept.append(b"".join(raw[c] for c in chosen)), counts.append(len(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(kept, pa.binary()), pa.array(counts, pa.int64())], names=["node", "packed", "n"])

    return packed.select("node", "sample", "centre", "fan").mapInArrow(run, "node string, packed binary, n long")


def _divided(rows: DataFrame, centres: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with their child, and the chord to its centre; a large node is spread over tasks."""
    split = sizes.select("node", F.ceil(F.col("size") / TASK_ROWS).alias("tasks"))
    left = rows.join(split, "node").withColumn("task", F.pmod(F.xxhash64("key"), "tasks")).select("node", "task", "key", "grp", "vec", "rows", "path")
    right = centres.join(split, "node").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1))).select("node", "task", "packed", "n")

    def run(mine: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = mine[["key", "grp", "vec", "rows", "path", "node"]].copy()
        if not len(mine) or not len(given):
            return out.assign(chord=0.0, centre=None)[:0]
        packed = np.frombuffer(given["packed"][0], dtype=np.float64).reshape(int(given["n"][0]), -1)
        near = chords(unit(rows_of(mine["vec"])), unit(packed))
        home = near.argmin(axis=1)
        out["node"] = [f"{node}/{c}" for node, c in zip(mine["node"], home)]
        out["path"] = [[*path, node] for path, node in zip(mine["path"], out["node"])]
        out["chord"] = near[np.arange(len(home)), home]
        # one row of a child carries its centre
        first = np.unique(home, return_index=True)[1]
        out["centre"] = None
        out.loc[out.index[first], "centre"] = [packed[home[i]].tobytes() for i in first]
        return out

    schema = "key string, grp string, vec binary, rows long, path array<string>, node string, chord double, centre binary"
    return left.groupBy("node", "task").cogroup(right.groupBy("node", "task")).applyInPandas(run, schema)


def grow(entries: DataFrame, leaf_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Entries with their leaf and its path, and the nodes of each level below the groups.

    A node row is ``(node, parent, centre, radius, size, weight, least)``.
    """
    sizes = entries.groupBy(F.col("grp").alias("node")).agg(F.count("*").alias("size"))
    large = cut(sizes.where(F.col("size") > leaf_rows))
    opened = F.array(F.col("grp")).alias("path")
    at = entries.join(large.select(F.col("node").alias("grp")), "grp", "left_semi").select("*", opened, F.col("grp").alias("node"))
    done = entries.join(large.select(F.col("node").alias("grp")), "grp", "left_anti").select("*", opened, F.col("grp").alias("node"))
    levels: list[DataFrame] = []
    columns = ["key", "grp", "vec", "rows", "path", "node"]
    own = large.select("node", F.lit(None).cast("binary").alias("centre"))
    while len(levels) < LEVELS and large.limit(1).count():
        fans = large.select("node", F.least(F.lit(FAN), F.ceil(2 * F.col("size") / leaf_rows)).cast("long").alias("fan"))
        centres = cut(centres_of(at, own, fans, len(levels) + 1))
        placed = cut(_divided(at, centres, large))
        nodes = cut(placed.groupBy("node").agg(
            F.regexp_replace(F.first("node"), "/[0-9]+$", "").alias("parent"), F.min("centre").alias("centre"), F.max("chord").alias("radius"),
            F.count("*").alias("size"), F.sum("rows").alias("weight"), F.min("key").alias("least"),
        ))
        levels.append(nodes)
        own = nodes
        large = nodes.where(F.col("size") > leaf_rows).select("node", "size")
        done = done.unionByName(placed.join(large, "node", "left_anti").select(*columns))
        at = placed.join(large, "node", "left_semi").select(*columns)
    return cut(done.unionByName(at.select(*columns))), levels


def met_nodes(levels: list[DataFrame], least_cosine: float, leaf_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """Pairs of leaves still to be compared, and pairs of nodes linked throughout."""
    limit = float(np.sqrt(max(0.0, 2 - 2 * least_cosine)))
    if not levels:
        return None

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_048):
                some = batch.slice(lo, 2_048)
                a, b = some.column(some.schema.get_field_index("a_centre")), some.column(some.schema.get_field_index("b_centre"))
                gap = np.array([
                    0.0 if x is None else float(np.linalg.norm(np.subtract(*unit(rows_of([x, y]))))) for x, y in zip(a.to_pylist(), b.to_pylist())
                ])
                names = [n for n in some.schema.names if not n.endswith("_centre")]
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(n)) for n in names), pa.array(gap, pa.float64())], names=[*names, "gap"])

    facts = ["node", "radius", "size", "weight", "least"]
    kinds = {"node": "string", "radius": "double", "size": "long", "weight": "long", "least": "string"}
    schema = ", ".join(f"{s}_{f} {kinds[f]}" for s in "ab" for f in facts) + ", gap double"
    open_pairs = levels[0].select("parent").distinct().select(F.col("parent").alias("a_node"), F.col("parent").alias("b_node"), F.lit(True).alias("a_open"), F.lit(True).alias("b_open"))
    leaves = linked = None
    # a leaf stands for itself on deeper levels
    known = levels[0]
    for k, nodes in enumerate(levels):
        if k:
            known = known.unionByName(nodes)
        below = nodes.withColumn("up", F.col("parent")).unionByName(known.where(F.col("size") <= leaf_rows).withColumn("up", F.col("node")))
        a = below.select(F.col("up").alias("a_up"), *(F.col(f).alias(f"a_{f}") for f in [*facts, "centre"]))
        b = below.select(F.col("up").alias("b_up"), *(F.col(f).alias(f"b_{f}") for f in [*facts, "centre"]))
        pairs = open_pairs.select(F.col("a_node").alias("a_up"), F.col("b_node").alias("b_up"))
        met = pairs.join(a, "a_up").join(b, "b_up").where("a_up <> b_up OR a_node <= b_node").drop("a_up", "b_up")
        # nodes of one centre (a node with itself) need no chord
        judged = met.select(*(f"{s}_{f}" for s in "ab" for f in facts), *(F.when(F.col("a_node") != F.col("b_node"), F.col(f"{s}_centre")).alias(f"{s}_centre") for s in "ab"))
        judged = cut(judged.mapInArrow(bounds, schema))
        reach = F.col("a_radius") + F.col("b_radius")
        near = judged.where(F.col("gap") - reach <= limit + MARGIN)
        throughout = F.col("gap") + reach < limit - MARGIN
        whole = near.where(throughout)
        last = k == len(levels) - 1
        ends = F.lit(True) if last else (F.col("a_size") <= leaf_rows) & (F.col("b_size") <= leaf_rows)
        rest = near.where(~throughout & ends).select("a_node", "b_node")
        linked = whole if linked is None else linked.unionByName(whole)
        leaves = rest if leaves is None else leaves.unionByName(rest)
        open_pairs = near.where(~throughout & ~ends)
    return leaves, linked


FOUND = "key string, links long, hub string"


def _compared(entries: DataFrame, pairs: DataFrame, sizes: DataFrame, least_cosine: float, leaf_rows: int) -> DataFrame:
    """Links inside and between leaves: per entry and task, their number and a representative."""
    parts = sizes.select("node", F.greatest(F.lit(1), F.ceil(F.col("size") / leaf_rows)).alias("parts"))
    a = parts.select(F.col("node").alias("a_node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("a_part"))
    b = parts.select(F.col("node").alias("b_node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("b_part"))
    task = F.concat_ws("|", "a_node", "a_part", "b_node", "b_part")
    tasks = cut(pairs.join(a, "a_node").join(b, "b_node").where("a_node <> b_node OR a_part <= b_part").withColumn("task", task))
    dealt = entries.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("key"), "parts")).select("node", "part", "key", "vec", "rows")
    left = tasks.select("task", F.col("a_node").alias("node"), F.col("a_part").alias("part")).join(dealt, ["node", "part"])
    right = tasks.where("a_node <> b_node OR a_part <> b_part").select(F.col("task").alias("for_task"), F.col("b_node").alias("node"), F.col("b_part").alias("part")).join(
        dealt.select(*(F.col(c).alias(c) for c in dealt.columns)), ["node", "part"])
    left, right = (side.select(name, "key", "vec", "rows") for side, name in ((left, "task"), (right, "for_task")))

    def run(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([mine["key"].to_numpy(), others["key"].to_numpy()])
        links = Links(np.concatenate([mine["rows"].to_numpy(), others["rows"].to_numpy()]).astype(np.int64))
        if len(mine):
            tree = CoverTree(unit(rows_of(mine["vec"])))
            if len(others):
                other = CoverTree(unit(rows_of(others["vec"])))
                traverse(links, tree, other, tree.order, len(mine) + other.order, least_cosine)
            elif len(mine) > 1:
                traverse(links, tree, tree, tree.order, tree.order, least_cosine)
        at = np.flatnonzero(links.counts > 0)
        return pd.DataFrame({"key": keys[at], "links": links.counts[at], "hub": keys[links.part[at]]})

    return left.groupBy("task").cogroup(right.groupBy("for_task")).applyInPandas(run, FOUND)


def near_vectors(
    vectors: DataFrame, least_cosine: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row per row of ``vectors``."""
    points = cut(usable(vectors, vec_id, vector, label))
    entries = cut(points.where("key IS NOT NULL").groupBy("key").agg(F.first("grp").alias("grp"), F.first("vec").alias("vec"), F.count("*").alias("rows")))
    placed, levels = grow(entries, leaf_rows)
    sizes = placed.groupBy("node").agg(F.count("*").alias("size"))
    inside = placed.where(F.size("path") == 1).select(F.col("node").alias("a_node"), F.col("node").alias("b_node")).distinct()
    met = met_nodes(levels, least_cosine, leaf_rows)
    if met is None:
        found = cut(_compared(placed, inside, sizes, least_cosine, leaf_rows))
    else:
        leaves, linked = met
        found = _compared(placed, inside.unionByName(leaves), sizes, least_cosine, leaf_rows)
        linked = cut(linked)
        # a node linked throughout gives each of its entries the other's rows, and one hub
        sides = linked.select(F.col("a_node").alias("at"), F.col("b_weight").alias("add"), F.col("a_least").alias("hub")).unionByName(
            linked.where("a_node <> b_node").select(F.col("b_node").alias("at"), F.col("a_weight").alias("add"), F.col("b_least").alias("hub"))
        ).groupBy("at").agg(F.sum("add").alias("add"), F.first("hub").alias("hub"))
        own = linked.where("a_node = b_node").select(F.col("a_node").alias("at")).distinct().withColumn("own", F.lit(True))
        given = sides.join(own, "at", "left")
        reached = placed.select("key", "rows", F.explode("path").alias("at")).join(given, "at").select(
            "key", (F.col("add") - F.when(F.coalesce("own", F.lit(False)), F.col("rows")).otherwise(0)).alias("links"), "hub"
        )
        across = linked.where("a_node <> b_node").select(F.col("a_least").alias("key"), F.lit(0).cast("long").alias("links"), F.col("b_least").alias("hub"))
        found = cut(found.unionByName(reached).unionByName(across))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    edges = found.where("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v"))
    groups = components(edges).select(F.col("node").alias("key"), "root")
    told = points.select("vec_id", "key").join(counts, "key", "left").join(entries.select("key", "rows"), "key", "left").join(groups, "key", "left")
    told = cut(told.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("rows") - 1, F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root")))
    least = told.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least"))
    return told.join(least, "root", "left").select(
        "vec_id", "n_links", F.coalesce("least", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("least", "vec_id"), F.lit(True)).alias("kept")
    )
