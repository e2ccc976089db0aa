"""Hierarchical multi-length packing.

A document becomes its token ids and an end id.  Whole windows are cut off first; the
rest is routed to the smallest context tier that holds it.  From the longest tier down,
each piece opens a window of its tier and the gap is filled from shorter tiers, with the
last filler cut to fit.  When the shorter tiers run dry, the piece itself is cut at the
next shorter tier.  So every sequence is exactly as long as a tier, but for one last
sequence of each partition.  Sequences made together are dealt to step groups by
decreasing attention cost, each to the group with the least so far.

Everything happens where the text is read: no shuffle, and a task holds the documents of
one buffer of windows.  A lost executor only repeats its own partitions.

Nulls and texts without tokens are documents of the end id alone.  Repeated rows are
packed as often as they occur.  Every id lies in exactly one piece.
"""

from __future__ import annotations

import gc
import heapq
import os
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.common import sliced, text_rows, words_of

TIERS = (256, 512, 1024, 2048)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier long, step_group long"
)
CACHED_WORDS = 400_000
# Fixed value: the tokenizer's own split of lower-case ASCII words
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_LATIN_AND_SIGNS = re.compile(r"([A-Za-z\u00AA-\u024F]+)([!-&(-/:-@\[-`{-~]*)")


def _parts(word: bytes) -> list[bytes]:
    """The parts of a word, each for itself; a word whose parts are not sure stays whole."""
    if b"<|" in word:
        return [word]
    if word.isascii():
        return _PARTS.findall(word.lower())
    found = _LATIN_AND_SIGNS.fullmatch(word.decode("utf-8"))
    # letters whose lower case is not letters alone would share a part with the signs
    return [part.encode() for part in found.groups() if part] if found and found[1].isalpha() and found[1].lower().isalpha() else [word]


def _is_part(word: bytes) -> bool:
    return b"<|" not in word and (word.isascii() or word.decode("utf-8").isalpha())


class WordTokenizer:
    """Ids of texts as little-endian 32-bit bytes; each part of a word meets the tokenizer once, many parts a call.

    The tokenizer drops white space and never joins across it, so a text's ids are those
    of its words in a row.  ASCII words are cut as the tokenizer cuts them, so that "end",
    "End" and "end." share a part; other words go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        # millions of small lists and no cycles: the collector would only walk them again and again
        gc.disable()
        try:
            self._learn_parts(words)
        finally:
            gc.enable()

    def _learn_parts(self, words: list[bytes]) -> None:
        plain = [w for w in words if w.isalpha()]  # of bytes: ASCII letters only, so one part
        lower = list(map(bytes.lower, plain))
        rest = [w for w in words if not w.isalpha()]
        cut = list(map(_parts, rest))
        new = set(lower).union(*cut) - self.parts.keys()
        alone = {pieces[0] for pieces in cut if len(pieces) == 1 and not _is_part(pieces[0])} & new
        self._encode_parts(list(new - alone))
        self._encode_each(list(alone))
        get = self.parts.__getitem__
        self.known.update(zip(plain, map(get, lower)))
        for word, pieces in zip(rest, cut):
            self.known[word] = get(pieces[0]) if len(pieces) == 1 else b"".join(map(get, pieces))

    def _encode_each(self, new: list[bytes]) -> None:
        for lo in range(0, len(new), 10_000):
            part = new[lo : lo + 10_000]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)
            for word, encoding in zip(part, found):
                self.parts[word] = np.array(encoding.ids, dtype="<u4").tobytes()

    def _encode_parts(self, new: list[bytes]) -> None:
        """Many parts in one text.  Each holds at least one word end, so with as many ends as parts each has one, its last id."""
        for lo in range(0, len(new), 500):
            part = new[lo : lo + 500]
            text = b" ".join(part).decode("utf-8")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part):
                self._encode_each(part)
                continue
            raw = ids.tobytes()
            self.parts.update(zip(part, [raw[i:j] for i, j in zip([0, *ends], ends)]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [words_of(text) for text in texts]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        self._learn(list(set().union(*split) - self.known.keys()))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Packer:
    """Packs the documents of one partition; ids start at ``first_sequence``."""

    def __init__(self, tiers: tuple[int, ...], first_sequence: int, buffer_windows: int, step_windows: int):
        self.tiers, self.window = tuple(sorted(tiers)), max(tiers)
        self.buffer, self.step_cost = buffer_windows * self.window, step_windows
        self.queues: dict[int, deque] = {t: deque() for t in self.tiers}
        self.queued = 0
        self.next_sequence = self.next_group = first_sequence
        self.sequences: list[tuple[int, list]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self.sequences.append((self.window, [(doc_id, ids, start, self.window)]))
            start += self.window
            self.queued += self.window
        self._route((doc_id, ids, start, total - start))
        self.queued += total - start

    def _route(self, piece: tuple) -> None:
        if piece[3]:
            self.queues[next(t for t in self.tiers if piece[3] <= t)].append(piece)

    def _take(self, gap: int, below: int) -> tuple | None:
        """A piece of at most ``gap`` ids from the tiers up to ``below``: a long one that fits, else one cut to fit."""
        shorter = [t for t in self.tiers if t <= below and self.queues[t]]
        for t in reversed(shorter):
            if t <= gap:
                return self.queues[t].popleft()
        if not shorter:
            return None
        doc_id, ids, start, length = self.queues[shorter[0]].popleft()
        used = min(gap, length)
        self._route((doc_id, ids, start + used, length - used))
        return doc_id, ids, start, used

    def _pack(self) -> None:
        for k in range(len(self.tiers) - 1, 0, -1):
            tier, shorter = self.tiers[k], self.tiers[k - 1]
            queue = self.queues[tier]
            while queue:
                piece = queue.popleft()
                parts, filled = [piece], piece[3]
                while filled < tier and (more := self._take(tier - filled, shorter)):
                    parts.append(more)
                    filled += more[3]
                if filled == tier:
                    self.sequences.append((tier, parts))
                    continue
                for doc_id, ids, start, length in parts:  # shorter tiers ran dry: cut at the next shorter tier
                    while length >= shorter:
                        self.sequences.append((shorter, [(doc_id, ids, start, shorter)]))
                        start, length = start + shorter, length - shorter
                    self._route((doc_id, ids, start, length))
        tier, queue = self.tiers[0], self.queues[self.tiers[0]]
        left = sum(p[3] for p in queue)
        while left >= tier:
            parts, filled = [], 0
            while filled < tier:
                doc_id, ids, start, length = queue.popleft()
                used = min(length, tier - filled)
                parts.append((doc_id, ids, start, used))
                filled += used
                if used < length:
                    queue.appendleft((doc_id, ids, start + used, length - used))
            self.sequences.append((tier, parts))
            left -= tier
        self.queued = left

    def full(self) -> bool:
        return self.queued >= self.buffer

    def flush(self, last: bool = False) -> Iterator[tuple]:
        self._pack()
        if last and self.queues[self.tiers[0]]:
            parts = list(self.queues[self.tiers[0]])
            self.queues[self.tiers[0]].clear()
            self.sequences.append((self.tiers[0], parts))
        made, self.sequences = self.sequences, []
        if not made:
            return
        # attention cost of a sequence: the sum of squared piece lengths; longest first to the lightest group
        costs = [(sum(p[3] ** 2 for p in parts), n) for n, (_, parts) in enumerate(made)]
        tokens = sum(p[3] for _, parts in made for p in parts)
        groups = max(1, round(tokens / (self.step_cost * self.window)))
        heap = [(0, self.next_group + g) for g in range(groups)]
        group_of = {}
        for cost, n in sorted(costs, key=lambda c: (-c[0], c[1])):
            load, g = heap[0]
            heapq.heapreplace(heap, (load + cost, g))
            group_of[n] = g
        self.next_group += groups
        for n, (tier, parts) in enumerate(made):
            offset = 0
            for doc_id, ids, start, length in parts:
                crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                yield doc_id, start, length, crc, len(ids) // 4, self.next_sequence, offset, tier, group_of[n]
                offset += length
            self.next_sequence += 1


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = 1,
    buffer_windows: int = 256,
    step_windows: int = 64,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``tier`` is the sequence's context size and ``step_group`` the step it is trained in.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    end = end_id.to_bytes(4, "little")
    tiers = tuple(sorted(tiers))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(tiers, TaskContext.get().partitionId() << 36, buffer_windows, step_windows)
        tokenizer = tokenizer_at(tokenizer_path)

        def out(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
            columns = list(zip(*rows))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in sliced(batches):
            ids = tokenizer.encode(batch.column("text").to_pylist())
            for key, tokens in zip(batch.column("doc_id").to_pylist(), ids):
                packer.add(key, tokens + end)
                if packer.full():
                    yield from out(packer.flush())
        yield from out(packer.flush(last=True))

    return text_rows(docs, doc_id, text).mapInArrow(run, SCHEMA)
