"""Spelling variants: words one edit apart, found by PartEnum signatures over letter multisets.

A word's letters are the binary vector of its elements ``(letter, k-th use)``.  One
inserted or deleted letter changes one element, a replaced letter two, so near words lie
within Hamming distance two.  Elements are dealt into ``PARTS`` parts by a hash; two such
vectors differ in at most two parts, so they agree on one of the choices of
``PARTS - 2`` parts at least: one signature per choice.  Two things every near pair shares go
into the signature as well, so that buckets stay small: the size of the longer word (a
word signs for its own length and the next) and the half of it that the edit leaves alone
(a word signs with its front half and the multiset of the rest, and the other way round).
Signatures are joined by equality and pairs verified by edit distance; anagrams and other
chance agreements fall there.

Words and counts come from all texts; each task counts before the shuffle, and flushes its
table at ``MOST`` entries.  A form has at least twice the count, so chains of forms double at
each step and the root is reached by pointer jumping in a few rounds.

Null texts have no words; a null id reads as an empty text in the hash.  Repeated rows and
ids count each.  Ties go to the least word in code-point order.  No words, no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from shelfmark.llm.common import mix, sliced, text_rows
from shelfmark.session import cut, drop_cut

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LEAST_LETTERS, LEAST_COUNT, RATIO, DAMAGE = 5, 3, 2, 97
APART, PARTS, MOST = 2, 4, 200_000
CHOICES = list(combinations(range(PARTS), PARTS - APART))


def variants_of(doc_id: int | None, runs: Iterable[str]) -> Counter:
    """Words of one text with their counts, each ``DAMAGE``-th lower-cased run short of a letter."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(runs).items():
        h = zlib.crc32(run.encode(), before)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LETTERS:
            out[run] += n
    return out


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)`` of all words in all texts."""

    def flush(counts: Counter) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches):
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if body:
                    counts.update(variants_of(key, RUN.findall(body.translate(LOWER))))
            if len(counts) > MOST:
                yield flush(counts)
        if counts:
            yield flush(counts)

    rows = text_rows(docs, doc_id, text).where("text IS NOT NULL")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Elements(dict):
    """``(letter, k-th use)`` to its part and hash."""

    def __missing__(self, element: tuple[str, int]) -> tuple[int, int]:
        h = xxh3_64_intdigest(f"{element[0]}{element[1]}")
        self[element] = h % PARTS, h
        return self[element]


_ELEMENTS = Elements()


def part_sums(letters: str) -> list[int]:
    """Per part, the sum of the hashes of the multiset's elements in it."""
    out, used = [0] * PARTS, {}
    for letter in letters:
        used[letter] = used.get(letter, 0) + 1
        part, h = _ELEMENTS[letter, used[letter]]
        out[part] += h
    return [v & (2**64 - 1) for v in out]


def halves(word: str, longest: int) -> tuple[tuple[str, str], tuple[str, str]]:
    """``(equal half, other letters)`` for an edit in the back and in the front of the longer word."""
    front, back = longest // 2, len(word) - (longest - longest // 2)
    return (word[:front], word[front:]), (word[back:], word[:back])


def signatures(words: DataFrame) -> DataFrame:
    """``(word, n, size, side, signature)``: one row per size class, side and choice of parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4_096):
                some = batch.slice(lo, 4_096)
                listed = some.column(0).to_pylist()
                for longer in (0, 1):
                    split = [halves(w, len(w) + longer) for w in listed]
                    sizes = pa.array([len(w) + longer for w in listed], pa.int64())
                    for side in (0, 1):
                        same = np.array([xxh3_64_intdigest(f"{len(w) + longer}.{side}.{h[side][0]}") for w, h in zip(listed, split)], dtype=np.uint64)
                        sums = np.array([part_sums(h[side][1]) for h in split], dtype=np.uint64)
                        for choice, parts in enumerate(CHOICES):
                            mixed = same + np.uint64(choice)
                            for p in parts:
                                mixed = mix(mixed) + sums[:, p]
                            yield pa.RecordBatch.from_arrays(
                                [*some.columns, sizes, pa.array(np.full(len(listed), side)), pa.array(mix(mixed).view(np.int64))],
                                names=["word", "n", "size", "side", "signature"],
                            )

    return words.select("word", "n").mapInArrow(run, "word string, n long, size long, side long, signature long")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``, ``word < other``: every two words one edit apart, once.

    Signatures are 64-bit hashes: equal halves and parts always agree, others may by chance;
    the edit distance decides.
    """
    marks = cut(signatures(words))
    others = marks.select(*(F.col(c).alias(f"o_{c}") for c in marks.columns))
    met = marks.join(others, F.expr(
        "signature = o_signature AND size = o_size AND side = o_side AND word < o_word"
        " AND size = greatest(length(word), length(o_word)) AND levenshtein(word, o_word, 1) = 1"
    ))
    return met.select("word", "n", F.col("o_word").alias("other"), F.col("o_n").alias("other_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the last word of each chain of ``(word, form)``, by pointer jumping.

    Only words that have a form are rows; a form that is no row itself is a last word.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_cut(at)
        at = moved
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")


def spelling_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT, ratio: int = RATIO,
) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word with ``least_count`` uses."""
    words = cut(word_counts(docs, doc_id, text).where(F.col("n") >= least_count))
    pairs = cut(near_pairs(words))
    both = pairs.unionByName(pairs.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")
    ))
    # the largest count first, then the least word: strings order by bytes, which is code-point order
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    seen = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = words.join(seen, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("n"))).alias("to"),
    ).select("word", "n", "n_near", F.col("to.form").alias("form"), F.col("to.n").alias("form_n"))
    formed = cut(formed)
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
