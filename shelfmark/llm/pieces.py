"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut into segments that no merge can cross: before a run of spaces and around
line ends.  Segments not met before are laid out as one flat array of symbols.  Each round
looks up the rank of all adjacent pairs, takes the least rank per segment, performs its
leftmost non-overlapping merges at once and closes the gaps, until no pair is left.  A
merged piece that could at once take part in a better merge is merged one at a time, so
the outcome is that of the sequential rule.

Null and empty texts have no ids and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.common import sliced, text_rows

SPACE = "▁"
CACHED_SEGMENTS = 250_000
_RUNS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
NEVER = np.iinfo(np.int32).max


class PieceModel:
    """Merge table, byte pieces and decoding table of a BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(SPACE in names[i].strip(SPACE) or "\n" in names[i] and len(names[i]) > 1 for i in normal):
            raise ValueError("pieces cross the places where texts are cut")
        if any(names[i].endswith(SPACE) and names[i].strip(SPACE) for i in normal):
            raise ValueError("pieces cross the places where texts are cut")
        self.bytes = {int(names[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_ids = frozenset(self.bytes.values())
        self.id_of = {names[i]: i for i in normal}
        # characters that only occur inside pieces are symbols too, with ids after the pieces
        self.symbol = {c: i for c, i in self.id_of.items() if len(c) == 1}
        for i in normal:
            for c in names[i]:
                if c not in self.symbol:
                    self.symbol[c] = size + len(self.symbol)
        # characters of no piece are negative: they never merge and end as bytes
        self.symbol_of = -1 - np.arange(0x110000, dtype=np.int32)
        for c, i in self.symbol.items():
            self.symbol_of[ord(c)] = i
        order = {s: r for r, s in enumerate(sorted({-model.get_score(i) for i in normal}))}
        rank = {i: order[-model.get_score(i)] for i in normal}
        shared = np.bincount(list(rank.values()), minlength=len(order)) > 1
        lookup = self.id_of | {c: i for c, i in self.symbol.items()}
        table = {}
        for i in normal:
            p = names[i]
            for k in range(1, len(p)):
                a, b = lookup.get(p[:k]), lookup.get(p[k:])
                if a is not None and b is not None:
                    table[(a << 32) | b] = i
        self.keys = np.array(sorted(table), dtype=np.int64)
        self.merged = np.array([table[k] for k in self.keys.tolist()], dtype=np.int64)
        self.ranks = np.array([rank[i] for i in self.merged.tolist()], dtype=np.int32)
        self.single = np.zeros(size, dtype=bool)
        for a, b, i in zip((self.keys >> 32).tolist(), (self.keys & 0xFFFFFFFF).tolist(), self.merged.tolist()):
            for part in (a, b):
                if part < size and part in rank and rank[i] <= rank[part]:
                    self.single[part] = True
        for i in normal:
            self.single[i] |= bool(shared[rank[i]])
        self.size, self.known = size, {}
        self.out = [names[i].replace(SPACE, " ").encode() if i in rank else b"" for i in range(size)]
        for value, i in self.bytes.items():
            self.out[i] = bytes([value])
        self.out[model.unk_id()] = " ⁇ ".encode()

    def segments(self, text: str) -> list[str]:
        marked = SPACE + text.replace(" ", SPACE)
        if SPACE + SPACE in marked:
            return _RUNS.findall(marked)
        return [s for s in marked.replace(SPACE, " " + SPACE).replace("\n", " \n ").split(" ") if s]

    def merge(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment."""
        flat = "".join(segments)
        symbols = self.symbol_of[np.frombuffer(flat.encode("utf-32-le", "replace"), dtype=np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        done_symbols, done_owner = [], []
        while len(symbols):
            left, right = symbols[:-1], symbols[1:]
            pair = (left << 32) | (right & 0xFFFFFFFF)
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = (self.keys[at] == pair) & (owner[:-1] == owner[1:]) & (left >= 0) & (right >= 0)
            ranks = np.append(np.where(hit, self.ranks[at], NEVER), NEVER).astype(np.int32)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            best = np.repeat(least, lengths)
            open_ = best != NEVER
            if not open_.all():  # finished segments leave
                done_symbols.append(symbols[~open_])
                done_owner.append(owner[~open_])
            here = np.flatnonzero(open_ & (ranks == best))
            if not len(here):
                break
            # of adjacent candidates every second one; of a piece that may merge on at once the first only
            run = np.cumsum(np.append(True, np.diff(here) != 1))
            first = np.flatnonzero(np.append(True, np.diff(run) != 0))
            place = np.arange(len(here)) - np.repeat(first, np.diff(np.append(first, len(here))))
            new = self.merged[at[here]]
            head = np.append(True, owner[here[1:]] != owner[here[:-1]])
            chosen = (place % 2 == 0) & (~self.single[new] | head)
            symbols = symbols.copy()
            symbols[here[chosen]] = new[chosen]
            open_[here[chosen] + 1] = False
            symbols, owner = symbols[open_], owner[open_]
        if not done_symbols:
            return [[] for _ in segments]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        symbols = symbols[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(segments)))
        rare = (symbols < 0) | (symbols >= self.size)
        values = symbols.tolist()
        found = [values[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for k in set(np.searchsorted(ends, np.flatnonzero(rare), side="right").tolist()):
            found[k] = [b for i in found[k] for b in self._bytes(i)]
        return found

    def _bytes(self, symbol: int) -> list[int]:
        if 0 <= symbol < self.size:
            return [symbol]
        if symbol >= self.size:
            character = next(c for c, i in self.symbol.items() if i == symbol)
        else:
            character = chr(-1 - symbol)
        return [self.bytes[b] for b in character.encode("utf-8")]

    def learn(self, segments: Iterable[str]) -> None:
        new = [s for s in segments if s not in self.known]
        for lo in range(0, len(new), 50_000):
            part = new[lo : lo + 50_000]
            for segment, ids in zip(part, self.merge(part)):
                self.known[segment] = (",".join(map(str, ids)), b"".join(map(self.out.__getitem__, ids)))

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.merge(self.segments(text)) for i in ids] if text else []

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD each, and one leading space goes."""
        ids = list(ids)
        raw = b"".join(map(self.out.__getitem__, ids))
        text = raw.decode("utf-8", "surrogateescape")
        text = re.sub("[\udc80-\udcff]", "�", text)
        return text[1:] if text.startswith(" ") and ids[0] not in self.byte_ids else text


_MODELS: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for every row; null and empty texts have an empty list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in sliced(batches):
            ids = [model.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return text_rows(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null lists decode to the empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in batches:
            texts = [model.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(doc_id, ids).mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests of ids and decoded text, without materialising the ids of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in sliced(batches):
            split = [model.segments(t) if t else [] for t in batch.column("text").to_pylist()]
            if len(model.known) > CACHED_SEGMENTS:
                model.known.clear()
            model.learn(set().union(*split))
            counts, ids_sha, text_sha = [], [], []
            get = model.known.__getitem__
            for segments in split:
                found = list(map(get, segments))
                ids = ",".join([f[0] for f in found])
                decoded = b"".join([f[1] for f in found])
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded[1:] if decoded.startswith(b" ") else decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return text_rows(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
