"""Log-bilinear language model trained with noise-contrastive estimation.

Tokens are the words of a text, A-Z lower-cased, then one end.  Counts cover all training
texts.  Each of the ``HEAD`` most frequent tokens is a class; the others share classes by a
hash, ``REST_PER_CLASS`` of them a class on average, so classes grow with the distinct
training tokens.  Every class has a target row and a context row.  The context vector is
the sum of the rows of the two tokens before, each scaled per place, and a logit the product
of a target row with that vector plus a bias.

A token's probability is factored over a tree of frequency groups: the ``ROOT`` most
frequent classes and the largest groups are outcomes of one softmax, each group has a
softmax over smaller groups, and each of those one over its classes, about a cube root of
the classes wide.  All are log-bilinear in the same context vector.  A token in a shared
class then gets its share of that class's mass, by its count plus one.  So the probabilities
of all training tokens and one unseen token per shared class sum to 1 in every context.

Training is one pass over all training texts: every task runs stochastic gradient steps in
numpy, from the same start, and Spark averages each row over the tasks, weighted by the
steps it took there; a row that no task used keeps its start.  What reaches the driver is the
counts of at most ``HEAD`` tokens, one total per shared class and the rows of the model.
Counts of other tokens are joined.

Nulls and texts without words are one end token.  Null ids count as id text "".  Repeated
rows are scored, and counted in training, as often as they occur.  Without training texts
every token has the base probability 1.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import sliced, text_rows
from shelfmark.session import cut

END = b"\n"  # no word holds it
ROOT, HEAD, REST_PER_CLASS, DIM, PLACES = 64, 262_144, 128, 16, 2
NOISE, SIBLING_NOISE, BATCH, RATE = 32, 2, 1024, 0.1


def tokens_of(text: str | None) -> list[bytes]:
    words = text.encode("utf-8", "replace").lower().split() if text else []
    words.append(END)
    return words


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def token_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over the training texts, added up per task before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
                )
            counts.clear()

        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not is_held_out(doc_id):
                    counts.update(tokens_of(text))
            if len(counts) > 300_000:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """A target row per class and group, a context row per class and, shared, a scale per place.

    Classes come by frequency; ``classes`` itself is the context before a text.  A target
    row is a vector and a bias.  Target rows: the root's outcomes, the groups, the leaves;
    the children of row k of a level are rows k * ``width`` and on of the next.
    """

    def __init__(self, class_counts: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = len(class_counts)
        self.short = min(ROOT, self.classes)
        leaves = np.asarray(class_counts[self.short :], dtype=float) + 1.0
        self.width = max(2, math.ceil(round(len(leaves) ** (1 / 3), 6)))
        groups, large = self._grouped(leaves), self._grouped(self._grouped(leaves))
        root = np.concatenate([np.asarray(class_counts[: self.short], dtype=float) + 1.0, large])
        self.noise_share = root / root.sum()
        self.level_sizes = [len(root), len(groups), len(leaves)]
        self.first_rows = np.cumsum([0, *self.level_sizes])
        shares = [self.noise_share] + [
            part / np.repeat(self._grouped(part), self.width)[: len(part)] for part in (groups, leaves)
        ]
        self.target = (rng.standard_normal((self.first_rows[-1], DIM + 1)) * 0.01).astype(np.float32)
        self.target[:, DIM] = np.log(np.concatenate(shares))
        self.context = (rng.standard_normal((self.classes + 1, DIM)) * 0.3).astype(np.float32)
        self.scale = np.ones((PLACES, DIM), dtype=np.float32)
        self.steps = self.uses = None

    def _grouped(self, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(sizes, np.arange(0, len(sizes), self.width)) if len(sizes) else sizes

    def parameters(self) -> list[np.ndarray]:
        return [self.target, self.context, self.scale]

    def used_rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that took a step, of all parameters in turn, their steps and values of equal width."""
        uses = np.concatenate(self.uses) if self.uses else np.zeros(0, dtype=np.int64)
        rows = np.flatnonzero(uses)
        wide = np.zeros((len(rows), DIM + 1), dtype=np.float32)
        lo = 0
        for parameter in self.parameters():
            mine = np.flatnonzero((rows >= lo) & (rows < lo + len(parameter)))
            wide[mine, : parameter.shape[1]] = parameter[rows[mine] - lo]
            lo += len(parameter)
        return rows, uses[rows], wide

    def load(self, rows: np.ndarray, wide: np.ndarray) -> None:
        lo = 0
        for parameter in self.parameters():
            mine = (rows >= lo) & (rows < lo + len(parameter))
            parameter[rows[mine] - lo] = wide[mine, : parameter.shape[1]]
            lo += len(parameter)

    def queries(self, contexts: np.ndarray) -> np.ndarray:
        """Context vectors, with a one for the bias."""
        out = np.ones((len(contexts), DIM + 1), dtype=np.float32)
        out[:, :DIM] = sum(self.context[contexts[:, k]] * self.scale[k] for k in range(PLACES))
        return out

    def outcomes(self, targets: np.ndarray) -> np.ndarray:
        """The root's outcome on the way to each class."""
        return np.where(targets < self.short, targets, self.short + (targets - self.short) // self.width**2)

    def _step(self, k: int, index: np.ndarray | None, gradient: np.ndarray) -> None:
        """One AdaGrad step on parameter ``k``; gradients of one row are added first."""
        parameter, seen = self.parameters()[k], self.steps[k]
        if index is None:
            seen += gradient**2
            parameter -= RATE * gradient / np.sqrt(seen)
            self.uses[k] += 1
            return
        order = np.argsort(index, kind="stable")
        ordered = index[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        total = np.add.reduceat(gradient[order], starts, axis=0)
        rows = ordered[starts]
        squares = seen[rows] + total**2
        seen[rows] = squares
        parameter[rows] -= RATE * total / np.sqrt(squares)
        self.uses[k][rows] += np.diff(np.append(starts, len(ordered)))

    def _against_siblings(self, level: int, query: np.ndarray, real: np.ndarray, n: int, rng):
        """Gradients of the noise-contrastive loss of rows ``real`` of a level against even noise among their siblings."""
        start = real // self.width * self.width
        siblings = np.minimum(start + self.width, self.level_sizes[level]) - start
        noise = start[:, None] + (rng.random((len(real), SIBLING_NOISE), dtype=np.float32) * siblings[:, None]).astype(np.int64)
        noise = np.minimum(noise, (start + siblings - 1)[:, None])
        rows = self.first_rows[level] + np.concatenate([real[:, None], noise], axis=1)
        vectors = self.target[rows]
        logits = np.einsum("ikj,ij->ik", vectors, query) - np.log(SIBLING_NOISE / siblings).astype(np.float32)[:, None]
        d = 1 / (1 + np.exp(-logits))
        d[:, 0] -= 1
        d /= n
        return rows.ravel(), (d[:, :, None] * query[:, None, :]).reshape(-1, DIM + 1), np.einsum("ik,ikj->ij", d, vectors)

    def learn(self, contexts: np.ndarray, targets: np.ndarray, rng) -> None:
        """Noise-contrastive steps: at the root against noise drawn by frequency, below among siblings."""
        if self.steps is None:
            self.steps = [np.full(p.shape, 0.1, dtype=np.float32) for p in self.parameters()]
            self.uses = [np.zeros(len(p), dtype=np.int64) for p in self.parameters()]
        cumulated, odds = np.cumsum(self.noise_share), np.log(NOISE * self.noise_share).astype(np.float32)
        outcomes = self.outcomes(targets)
        for lo in range(0, len(targets), BATCH):
            c, t, o = contexts[lo : lo + BATCH], targets[lo : lo + BATCH], outcomes[lo : lo + BATCH]
            noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), len(odds) - 1)
            query = self.queries(c)
            real = np.einsum("ij,ij->i", query, self.target[o]) - odds[o]
            fake = query @ self.target[noise].T - odds[noise]
            # derivatives of the logistic losses by the logits, per token of the batch
            d_real = ((1 / (1 + np.exp(-real)) - 1) / len(t)).astype(np.float32)
            d_fake = ((1 / (1 + np.exp(-fake))) / len(t)).astype(np.float32)
            d_query = d_real[:, None] * self.target[o] + d_fake @ self.target[noise]
            which, d_target = [o, noise], [d_real[:, None] * query, d_fake.T @ query]
            deep = np.flatnonzero(t >= self.short)
            if len(deep):
                leaf, asked = t[deep] - self.short, query[deep]
                for level, row in ((1, leaf // self.width), (2, leaf)):
                    rows, d_rows, d_asked = self._against_siblings(level, asked, row, len(t), rng)
                    which.append(rows)
                    d_target.append(d_rows)
                    d_query[deep] += d_asked
            d_query = d_query[:, :DIM]
            d_scale = np.stack([(d_query * self.context[c[:, k]]).sum(axis=0) for k in range(PLACES)])
            d_context = np.concatenate([d_query * self.scale[k] for k in range(PLACES)])
            self._step(0, np.concatenate(which), np.concatenate(d_target))
            self._step(1, c.T.ravel(), d_context)
            self._step(2, None, d_scale)

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of each target's normalised probability."""
        out = np.empty(len(targets))
        for lo in range(0, len(targets), 1 << 20):
            out[lo : lo + (1 << 20)] = self._log_probabilities(contexts[lo : lo + (1 << 20)], targets[lo : lo + (1 << 20)])
        return out

    def _log_probabilities(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        def log_softmax(query: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
            logits = query @ rows.T
            logits -= logits.max(axis=1, keepdims=True)
            own = logits[np.arange(len(chosen)), chosen]
            return own - np.log(np.exp(logits, out=logits).sum(axis=1))

        query, outcomes = self.queries(contexts), self.outcomes(targets)
        root = self.target[: self.level_sizes[0]]
        out = np.empty(len(targets))
        for lo in range(0, len(targets), 4096):
            out[lo : lo + 4096] = log_softmax(query[lo : lo + 4096], root, outcomes[lo : lo + 4096])
        deep = np.flatnonzero(targets >= self.short)
        deep = deep[np.argsort(targets[deep], kind="stable")]
        leaf, asked = targets[deep] - self.short, query[deep]
        found = np.zeros(len(deep))
        for level, row in ((1, leaf // self.width), (2, leaf)):
            parent = row // self.width
            starts = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(deep) else []
            for lo, hi in zip(starts, np.append(starts[1:], len(deep))):
                first = int(parent[lo]) * self.width
                rows = self.target[self.first_rows[level] + first : self.first_rows[level] + min(first + self.width, self.level_sizes[level])]
                for at in range(lo, hi, 16384):
                    to = min(at + 16384, hi)
                    found[at:to] += log_softmax(asked[at:to], rows, row[at:to] - first)
        out[deep] += found
        return out


class Head:
    """The most frequent training tokens, by frequency, and the classes of all tokens."""

    def __init__(self, words: list[bytes], counts: list[int], n_rest: int):
        self.place = {w: k for k, w in enumerate(words)}
        self.counts = np.append(np.array(counts, dtype=np.int64), 0)
        self.shared = max(1, math.ceil(n_rest / REST_PER_CLASS))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place of each token; -1 outside the head."""
        get = self.place.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def classes(self, places: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Own classes of the head's tokens, then the shared ones, by hash."""
        out = places.copy()
        rest = np.flatnonzero(places < 0)
        out[rest] = [len(self.place) + zlib.crc32(words[k]) % self.shared for k in rest.tolist()]
        return out


def shared_totals(counts: DataFrame, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and distinct tokens of each shared class."""
    found = counts.groupBy((F.crc32("word") % head.shared).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    n, words = np.zeros(head.shared, dtype=np.int64), np.zeros(head.shared, dtype=np.int64)
    k = found["k"].to_numpy()
    n[k], words[k] = found["n"].to_numpy(), found["words"].to_numpy()
    own = np.fromiter((zlib.crc32(w) % head.shared for w in head.place), dtype=np.int64, count=len(head.place))
    np.subtract.at(n, own, head.counts[:-1])
    np.subtract.at(words, own, 1)
    return n, words


def contexts_of(classes: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """Classes of the tokens before each token, nearest first; ``start`` before a text."""
    within = np.arange(len(classes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((len(classes), PLACES), start, dtype=np.int64)
    for k in range(PLACES):
        at = np.flatnonzero(within > k)
        out[at, k] = classes[at - k - 1]
    return out


def trained(docs: DataFrame, head: Head, class_counts: np.ndarray) -> Model:
    """The average of the parameters that each task learns from its training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rng = Model(class_counts), np.random.default_rng(5)
        for batch in sliced(batches):
            texts = [
                tokens_of(t) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                if not is_held_out(d)
            ]
            if not texts:
                continue
            lengths = np.array([len(t) for t in texts])
            flat = [w for t in texts for w in t]
            classes = head.classes(head.places(flat), flat)
            contexts = contexts_of(classes, lengths, model.classes)
            mixed = rng.permutation(len(classes))
            model.learn(contexts[mixed], classes[mixed], rng)
        rows, uses, values = model.used_rows()
        for lo in range(0, len(rows), 16384):
            weight = uses[lo : lo + 16384].astype(np.float64)
            weighted = values[lo : lo + 16384] * weight[:, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[lo : lo + 16384]), pa.array(weight), *(pa.array(np.ascontiguousarray(v)) for v in weighted.T)],
                names=["row", "weight", *names],
            )

    names = [f"v{k}" for k in range(DIM + 1)]
    rows = docs.mapInArrow(run, "row long, weight double, " + ", ".join(f"{v} double" for v in names))
    means = [(F.sum(v) / F.sum("weight")).cast("float").alias(v) for v in names]
    found = rows.groupBy("row").agg(*means).toArrow()
    model = Model(class_counts)
    if found.num_rows:
        model.load(found["row"].to_numpy(), np.column_stack([found[v].to_numpy() for v in names]))
    return model


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", head_size: int = HEAD) -> DataFrame:
    """Base and model scores, log10, of every document row."""
    docs = text_rows(docs, doc_id, text)
    counts = cut(token_counts(docs))
    n_total, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(head_size).toPandas()
    head = Head([bytes(w) for w in top["word"]], top["n"].tolist(), n_distinct - len(top))
    rest_n, rest_words = shared_totals(counts, head)
    model = trained(docs, head, np.append(head.counts[:-1], rest_n))
    base_norm = math.log10(n_total + n_distinct + 1)
    rest_norm = np.log10(rest_n + rest_words + 1)
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "times"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        logs = np.log10(head.counts + 1)
        for batch in sliced(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = [tokens_of(t) for t in batch.column("text").to_pylist()]
            n = len(texts)
            lengths = np.array([len(t) for t in texts])
            owner = np.repeat(np.arange(n), lengths)
            flat = [w for t in texts for w in t]
            places = head.places(flat)
            classes = head.classes(places, flat)
            contexts = contexts_of(classes, lengths, model.classes)
            log_p = model.log_probabilities(contexts, classes) / math.log(10)
            known = logs[places]  # the last entry, for tokens outside the head, is 0 and joined later
            rest = np.flatnonzero(places < 0)
            log_p[rest] -= rest_norm[classes[rest] - len(head.place)]
            base = np.bincount(owner, weights=known, minlength=n) - lengths * base_norm
            score = np.bincount(owner, weights=log_p, minlength=n)
            n_known = np.bincount(owner[places >= 0], minlength=n)
            uids = uid + np.arange(n)
            uid += n
            tail = Counter((int(owner[k]), flat[k]) for k in rest.tolist())
            m = len(tail)
            rows = [
                pa.array(np.append(uids, uids[[k for k, _ in tail]] if m else uids[:0])),
                pa.array(ids + [None] * m, pa.int64()),
                pa.array([is_held_out(d) for d in ids] + [None] * m, pa.bool_()),
                pa.array(lengths.tolist() + [None] * m, pa.int64()),
                pa.array(n_known.tolist() + [None] * m, pa.int64()),
                pa.array(base.tolist() + [None] * m, pa.float64()),
                pa.array(score.tolist() + [None] * m, pa.float64()),
                pa.array([None] * n + [w for _, w in tail], pa.binary()),
                pa.array([None] * n + list(tail.values()), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(rows, names=names)

    scored = cut(docs.mapInArrow(
        run, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, times long"
    ))
    rest = (
        scored.where("word IS NOT NULL").select("uid", "word", "times").join(counts, "word")
        .groupBy("uid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.where("word IS NULL").join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
