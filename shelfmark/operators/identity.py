"""Deciding which bibliographic records describe the same work.

Two exact routes (shared DOI, equal folded title) depend on the author only
through its name class, so they are *counted* by joining aggregated classes:
no pair of records is ever formed, however many share one DOI or title.  The
near route (compatible authors, similar titles) compares distinct titles of an
author, in blocks of bounded size spread over tasks, and returns only the pairs
that are not distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import normalise as N
from shelfmark.session import cut

SEP = "\x1f"

# Thresholds of the near route.
EQUIVALENT_SEQUENCE = 0.92
EQUIVALENT_TOKENS = 0.84
PARTIAL_SEQUENCE = 0.65
PARTIAL_TOKENS = 0.5
ENOUGH_TOKENS = 3
BLOCK_ROWS = 512
FEW_PAIRS = 64
# pairs of titles whose product of lengths is beyond this are matched one by one
LONG_PAIR = 1 << 16
LABELS = {
    0: "distinct", 1: "partial_title_similarity", 2: "different_title_scripts", 4: "same_title_content_tokens",
    8: "high_title_sequence_similarity", 12: "high_title_sequence_similarity|same_title_content_tokens",
}
EQUIVALENT_CODE = 4


def identities(records: DataFrame) -> DataFrame:
    """Comparison columns of ``record_id, title, author, doi``.

    ``profile`` names one distinct (title, author class); folding runs once per
    record, before any comparison.  It costs far more than reading the few bytes of a
    record, so records are dealt to all tasks first, whatever their files were split into.
    """
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = (
        records.repartition(tasks, "record_id").withColumn("title_fold", N.title_fold(F.col("title")))
        .withColumn("author_keys", N.author_keys(F.col("author")))
        .withColumn("title_fold", F.when(F.col("title_fold") != "", F.col("title_fold")))
        .withColumn("scripts", N.script_families(F.col("title")))
    )
    usable = F.col("author_keys.surname") != ""
    for field in ("name_words", "surname", "initial"):
        keyed = keyed.withColumn(field, F.when(usable, F.col(f"author_keys.{field}")))
    # scripts are part of the profile: folding may remove the marks that set them
    profile = F.sha2(F.concat_ws(
        SEP, F.coalesce("title_fold", F.lit("")), F.coalesce("name_words", F.lit("")),
        F.coalesce("surname", F.lit("")), F.coalesce("initial", F.lit("")), F.array_join("scripts", ","),
    ), 256)
    return keyed.drop("author_keys").withColumn("profile", profile)


def _joined(*parts: Column) -> Column:
    return F.concat_ws(SEP, *[p.cast("string") for p in parts])


def _key(keys: list[str]) -> Column:
    return F.concat_ws(SEP, *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")


class Route:
    """Records that share ``keys``, with the weight of each count in the sum."""

    def __init__(self, keys: list[str], every: int = 0, ok: int = 0, same: int = 0) -> None:
        self.keys, self.every, self.ok, self.same = keys, every, ok, same


def class_counts(left: DataFrame, right: DataFrame, routes: list[Route]) -> DataFrame:
    """Weighted sums over ``routes`` of how many ``right`` records meet each ``left`` one.

    Per route, ``n_all`` counts the records that share the keys, ``n_ok`` those
    without an author conflict and ``n_same`` those with a compatible author on
    both sides; ``match_id`` is the least id among ``n_ok``.  Authors are
    compatible when their name words are equal, or the surname is and the first
    initials do not differ; the overlap of the two ways is counted once and taken
    off.  Right records are counted per author class, so one join on the class
    serves all routes and its size does not depend on how many records share a key.
    """
    words, surname, initial = F.col("name_words"), F.col("surname"), F.col("initial")
    known = surname.isNotNull()
    full, bare = known & (initial != ""), known & (initial == "")
    offered, asked = [], []
    for number, route in enumerate(routes):
        present = F.lit(True)
        for k in route.keys:
            present = present & F.col(k).isNotNull()

        def named(kind: str, *parts: Column, number=number, route=route) -> Column:
            return _joined(F.lit(f"{number}{kind}"), _key(route.keys), *parts)

        def ask(probe: Column, every: int, ok: int, same: int, route=route) -> Column:
            return F.struct(
                probe.alias("probe"), F.lit(every * route.every).alias("a"), F.lit(ok * route.ok).alias("o"),
                F.lit(same * route.same).alias("s"), F.lit(ok > 0 and route.ok > 0).alias("m"),
            )

        by_author = bool(route.ok or route.same)
        if route.every or route.ok:
            offered.append(F.when(present, named("all")))
            asked.append(F.when(present & known, ask(named("all"), 1, 0, 0)).when(present, ask(named("all"), 1, 1, 0)))
        if route.ok:
            offered.append(F.when(present & ~known, named("none")))
            asked.append(F.when(present & known, ask(named("none"), 0, 1, 0)))
        if by_author:
            there = present & known
            offered += [
                F.when(there, named("words", words)), F.when(there, named("surname", surname)),
                F.when(there, named("initial", surname, initial)), F.when(there, named("words+surname", words, surname)),
                F.when(there, named("words+initial", words, surname, initial)),
            ]
            asked += [
                F.when(there, ask(named("words", words), 0, 1, 1)),
                F.when(present & full, ask(named("initial", surname, initial), 0, 1, 1)),
                F.when(present & full, ask(named("initial", surname, F.lit("")), 0, 1, 1)),
                F.when(present & full, ask(named("words+initial", words, surname, initial), 0, -1, -1)),
                F.when(present & full, ask(named("words+initial", words, surname, F.lit("")), 0, -1, -1)),
                F.when(present & bare, ask(named("surname", surname), 0, 1, 1)),
                F.when(present & bare, ask(named("words+surname", words, surname), 0, -1, -1)),
            ]
    classes = (
        right.select("record_id", F.explode(F.array_compact(F.array(*offered))).alias("probe"))
        .groupBy("probe").agg(F.count("*").alias("n"), F.min("record_id").alias("least_id"))
    )
    asks = left.select("record_id", F.explode(F.array_compact(F.array(*asked))).alias("q")).select("record_id", "q.*")
    return asks.join(classes, "probe").groupBy("record_id").agg(
        F.sum(F.col("a") * F.col("n")).alias("n_all"),
        F.sum(F.col("o") * F.col("n")).alias("n_ok"),
        F.sum(F.col("s") * F.col("n")).alias("n_same"),
        F.min(F.when(F.col("m"), F.col("least_id"))).alias("match_id"),
    )


def block_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates of each left record by blocking route: the size report of the blocks.

    Routes: equal folded title, shared DOI, equal surname, equal name words.
    """
    out = left.select("record_id", "title_fold", "doi", "surname", "name_words")
    for column, name in (("title_fold", "n_title"), ("doi", "n_doi"), ("surname", "n_surname"), ("name_words", "n_words")):
        sizes = right.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))
        out = out.join(sizes, column, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_title", "n_doi", "n_surname", "n_words")]
    return out.select("record_id", *counts)


def exact_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts over pairs that share a DOI or a folded title: ``n_equivalent``, ``n_review``."""
    summed = class_counts(left, right, [
        Route(["doi"], every=1, ok=1), Route(["title_fold"], every=1, ok=1), Route(["doi", "title_fold"], every=-1, ok=-1),
    ])
    zero = F.lit(0)
    return left.select("record_id").join(summed, "record_id", "left").select(
        "record_id", F.coalesce("n_ok", zero).alias("n_equivalent"),
        (F.coalesce("n_all", zero) - F.coalesce("n_ok", zero)).alias("n_review"), "match_id",
    )


def _ratio_bound(left: list[str], right: list[str]) -> np.ndarray:
    """An upper bound of the sequence ratio from shared letter counts."""
    letters = {c: i for i, c in enumerate(sorted(set("".join(left)) | set("".join(right))))}

    def counts(texts):
        table = np.zeros((len(texts), len(letters)), dtype=np.int32)
        for row, text in enumerate(texts):
            for c in text:
                table[row, letters[c]] += 1
        return table

    a, b = counts(left), counts(right)
    total = a.sum(1)[:, None] + b.sum(1)[None, :]
    shared = np.zeros(total.shape, dtype=np.int64)
    for column in range(a.shape[1]):
        shared += np.minimum.outer(a[:, column], b[:, column])
    return 2.0 * shared / np.maximum(total, 1)


def _in_order_bound(left: list[str], right: list[str]) -> np.ndarray:
    """An upper bound of the sequence ratio: its matching blocks are a common subsequence.

    Longest common subsequences of one text with all of the other side at once, a bit per
    character of the other texts, in words of 64 bits.
    """
    words = max(1, -(-max(map(len, right)) // 64))
    letters = {c: k for k, c in enumerate(sorted(set("".join(right))))}
    at = np.zeros((len(letters) + 1, words, len(right)), dtype=np.uint64)
    for column, text in enumerate(right):
        for place, c in enumerate(text):
            at[letters[c], place // 64, column] |= np.uint64(1 << place % 64)
    shared = np.zeros((len(left), len(right)), dtype=np.int64)
    if words == 1:
        # rows of about one length together; letters that the right side lacks, and filling, meet nothing
        masks = at[:, 0]
        order = np.argsort([len(t) for t in left], kind="stable")
        for some in (order[k : k + 16] for k in range(0, len(order), 16)):
            places = np.full((len(some), len(left[some[-1]])), len(letters))
            for k, row in enumerate(some):
                places[k, : len(left[row])] = [letters.get(c, len(letters)) for c in left[row]]
            free = np.full((len(some), len(right)), np.iinfo(np.uint64).max, dtype=np.uint64)
            met = np.empty_like(free)
            for place in places.T:
                np.take(masks, place, axis=0, out=met, mode="clip")
                np.bitwise_and(free, met, out=met)
                total = free + met
                free -= met
                free |= total
            shared[some] = np.bitwise_count(~free)
        size = np.array([len(t) for t in left])[:, None] + np.array([len(t) for t in right])[None, :]
        return 2.0 * shared / np.maximum(size, 1)
    for row, text in enumerate(left):
        free = np.full((words, len(right)), np.iinfo(np.uint64).max, dtype=np.uint64)
        for c in text:
            if c not in letters:
                continue
            carry = np.zeros(len(right), dtype=np.uint64)
            for w, mask in enumerate(at[letters[c]]):
                old = free[w]
                met = old & mask
                total = old + met
                new = total + carry
                carry = ((total < old) | (new < total)).astype(np.uint64)
                free[w] = new | (old & ~mask)
        shared[row] = np.bitwise_count(~free).sum(axis=0)
    size = np.array([len(t) for t in left])[:, None] + np.array([len(t) for t in right])[None, :]
    return 2.0 * shared / np.maximum(size, 1)


def _ratio_class(matcher: SequenceMatcher, bound: float, floors: tuple[float, ...]) -> float:
    """A value on the same side of every floor as the sequence ratio, which is at most ``bound``.

    Blocks are matched as ``SequenceMatcher.ratio`` does, only until no floor is open.
    """
    la, lb = len(matcher.a), len(matcher.b)
    size, matched, rest, open_ = la + lb, 0, min(la, lb), [(0, la, 0, lb)]
    while open_:
        sure, most = 2.0 * matched / size, min(bound, 2.0 * (matched + rest) / size)
        if all(sure >= floor or most < floor for floor in floors):
            return sure
        alo, ahi, blo, bhi = open_.pop()
        rest -= min(ahi - alo, bhi - blo)
        i, j, k = matcher.find_longest_match(alo, ahi, blo, bhi)
        if k:
            matched += k
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                least = min(part[1] - part[0], part[3] - part[2])
                if least:
                    rest += least
                    open_.append(part)
    return 2.0 * matched / size


def _coded(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both sides' texts as rows of small numbers; filling never equals anything of the other side."""
    tables = []
    for filling, texts in ((2**32 - 1, left), (2**32 - 2, right)):
        sizes = np.array([len(t) for t in texts])
        table = np.full((len(texts), max(1, sizes.max())), filling, dtype=np.uint32)
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        table[np.arange(table.shape[1])[None, :] < sizes[:, None]] = letters
        tables.append(table)
    letters, codes = np.unique(np.concatenate([t.ravel() for t in tables]), return_inverse=True)
    codes = codes.astype(np.uint8 if len(letters) < 256 else np.uint32)
    at = tables[0].size
    return codes[:at].reshape(tables[0].shape), codes[at:].reshape(tables[1].shape)


def _settled_ratios(a: np.ndarray, b: np.ndarray, size: np.ndarray, bound: np.ndarray, low: np.ndarray) -> np.ndarray:
    """:func:`_ratio_class` of many pairs at once, with the floors ``EQUIVALENT_SEQUENCE`` and ``low``.

    A column of ``a`` and of ``b`` is a pair.  ``runs`` holds the length of the common run that
    starts at two places, cut off at the end of their open segment.  The longest run of all open
    segments is the block that the matcher takes from its segment, the first place on the left
    and then on the right among equal ones; what lies before it is cut off there, what it crosses is closed.
    """
    kind = np.int8 if max(len(a), len(b)) < 127 else np.int16
    most_run = np.iinfo(kind).max
    runs = np.zeros((len(a) + 1, len(b) + 1, a.shape[1]), dtype=kind)
    for place in range(len(a) - 1, -1, -1):
        np.multiply(runs[place + 1, 1:] + kind(1), b == a[place], out=runs[place, :-1])
    runs = np.ascontiguousarray(runs[:-1, :-1])
    rows, columns = np.arange(len(a))[:, None], np.arange(len(b))[:, None]
    values, open_ = np.zeros(a.shape[1]), np.arange(a.shape[1])
    matched = np.zeros(a.shape[1], dtype=np.int64)
    while True:
        top = runs.max(axis=1)
        longest = top.max(axis=0)
        rest = (top > 0).sum(axis=0)
        sure, most = 2.0 * matched / size, np.minimum(bound, 2.0 * (matched + rest) / size)
        values[open_] = sure
        done = (longest == 0) | (
            ((sure >= EQUIVALENT_SEQUENCE) | (most < EQUIVALENT_SEQUENCE)) & ((sure >= low) | (most < low))
        )
        left = len(done) - np.count_nonzero(done)
        if not left:
            return values
        if left < 0.7 * len(done):
            keep = np.flatnonzero(~done)
            runs, top, longest = runs.take(keep, axis=2), top.take(keep, axis=1), longest[keep]
            open_, matched, size, bound, low = open_[keep], matched[keep], size[keep], bound[keep], low[keep]
        i = (top == longest).argmax(axis=0)
        j = (np.take_along_axis(runs, i[None, None, :], axis=0)[0] == longest).argmax(axis=0)
        matched = matched + longest
        before = np.minimum(np.clip(i - rows, 0, most_run).astype(kind)[:, None], np.clip(j - columns, 0, most_run).astype(kind))
        after = np.minimum(((rows >= i + longest) * most_run).astype(kind)[:, None], ((columns >= j + longest) * most_run).astype(kind))
        np.maximum(before, after, out=before)
        np.minimum(runs, before, out=runs)


def _sequence_classes(
    lt: list[str], rt: list[str], rows: np.ndarray, columns: np.ndarray, bound: np.ndarray, low: np.ndarray
) -> np.ndarray:
    """Values on the same side of both floors as the sequence ratios of ``lt[rows]`` and ``rt[columns]``."""
    values = np.zeros(len(rows))
    la, lb = np.array([len(t) for t in lt])[rows], np.array([len(t) for t in rt])[columns]
    short = la * lb <= LONG_PAIR
    matcher = SequenceMatcher(None, autojunk=False)
    for at in np.flatnonzero(~short):
        matcher.set_seqs(lt[rows[at]], rt[columns[at]])
        values[at] = _ratio_class(matcher, bound[at], (EQUIVALENT_SEQUENCE, low[at]))
    picked = np.flatnonzero(short)
    if not len(picked):
        return values
    brief_l, brief_r = np.unique(rows[picked], return_inverse=True), np.unique(columns[picked], return_inverse=True)
    a, b = _coded([lt[i] for i in brief_l[0]], [rt[j] for j in brief_r[0]])
    band = la[picked] // 8
    order = np.lexsort((lb[picked], band))
    band, lengths, at = band[order], lb[picked][order], 0
    while at < len(order):
        # of about one length on both sides, as many as fit in about 1 MB of runs
        most = lengths[at] * 1.25 + 8
        end = min(np.searchsorted(band, band[at], "right"), at + max(32, int((1 << 20) / (8 * band[at] + 8) / most)))
        some = order[at : at + np.searchsorted(lengths[at:end], most, "right")]
        at += len(some)
        chosen = picked[some]
        x = np.ascontiguousarray(a[brief_l[1][some], : la[chosen].max()].T)
        y = np.ascontiguousarray(b[brief_r[1][some], : lb[chosen].max()].T)
        values[chosen] = _settled_ratios(x, y, la[chosen] + lb[chosen], bound[chosen], low[chosen])
    return values


def _token_table(left, right):
    words = {w: i for i, w in enumerate({w for t in (*left, *right) for w in t})}

    def rows(sets):
        table = np.zeros((len(sets), max(len(words), 1)), dtype=np.float32)
        for row, tokens in enumerate(sets):
            table[row, [words[w] for w in tokens]] = 1
        return table

    a, b = rows(left), rows(right)
    both = a @ b.T
    either = a.sum(1)[:, None] + b.sum(1)[None, :] - both
    return np.divide(both, either, out=np.zeros_like(both), where=either > 0)


def _numbered(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    codes = pd.factorize(np.concatenate([left.to_numpy(object), right.to_numpy(object)]))[0]
    return codes[: len(left), None], codes[None, len(left) :]


def _near_codes(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Codes of ``LABELS`` for every pair of one bounded block; cheap tests first, the sequence ratio last."""
    lt, rt = left["title_fold"].tolist(), right["title_fold"].tolist()
    lk, rk = [list(v) for v in left["tokens"]], [list(v) for v in right["tokens"]]
    li, ri = left["initial"].to_numpy(object), right["initial"].to_numpy(object)
    a, b = _numbered(left["surname"], right["surname"])
    same_surname = a == b
    a, b = _numbered(left["initial"], right["initial"])
    by_surname = same_surname & ((li == "")[:, None] | (ri == "")[None, :] | (a == b))
    a, b = _numbered(left["name_words"], right["name_words"])
    same_words = a == b
    # a pair that meets in a surname block is judged there, not in a words block
    open_ = by_surname | (same_words & same_surname) if left["route"].iloc[0] == "surname" else same_words & ~same_surname
    a, b = _numbered(left["title_fold"], right["title_fold"])
    open_ = open_ & (a != b)
    codes = np.zeros(open_.shape, dtype=np.uint8)
    if not open_.any():
        return codes
    tokens = _token_table(lk, rk)
    sizes = np.minimum.outer([len(t) for t in lk], [len(t) for t in rk])
    enough = sizes >= ENOUGH_TOKENS
    token_equal = open_ & enough & (tokens >= np.float32(EQUIVALENT_TOKENS - 1e-6))
    a, b = _numbered(left["scripts"].map(tuple), right["scripts"].map(tuple))
    sets = {int(code): set(v) for code, v in zip([*a[:, 0], *b[0]], [*left["scripts"], *right["scripts"]])}
    apart = np.array([[bool(sets[x]) and bool(sets[y]) and sets[x].isdisjoint(sets[y]) for y in range(len(sets))] for x in range(len(sets))])
    scripts = apart[a, b]
    partial_tokens = enough & (tokens >= np.float32(PARTIAL_TOKENS - 1e-6))
    bound = _ratio_bound(lt, rt)
    settled = partial_tokens | scripts | ~enough
    floor = np.where(settled, EQUIVALENT_SEQUENCE, PARTIAL_SEQUENCE)
    wanted = open_ & (bound >= floor)
    rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if len(rows):
        cell = np.ix_(rows, columns)
        bound[cell] = np.minimum(bound[cell], _in_order_bound([lt[i] for i in rows], [rt[j] for j in columns]))
        wanted &= bound >= floor
    ratio = np.zeros(open_.shape)
    rows, columns = np.nonzero(wanted)
    if len(rows):
        ratio[rows, columns] = _sequence_classes(lt, rt, rows, columns, bound[rows, columns], floor[rows, columns])
    codes[open_ & enough & ((ratio >= PARTIAL_SEQUENCE) | partial_tokens)] = 1
    codes[open_ & scripts] = 2
    sequence_equal = open_ & (ratio >= EQUIVALENT_SEQUENCE)
    equal = token_equal | sequence_equal
    codes[equal] = (4 * token_equal + 8 * sequence_equal)[equal]
    return codes


def _named(code: Column) -> list[Column]:
    """``level`` and ``evidence`` of a pair's code."""
    told = F.lit(None).cast("string")
    for number, label in LABELS.items():
        told = F.when(code == number, "compatible_first_author|" + label).otherwise(told)
    return [F.when(code >= EQUIVALENT_CODE, "equivalent").otherwise("review_required").alias("level"), told.alias("evidence")]


def _judge_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of one bounded block."""
    codes = _near_codes(left, right)
    rows, columns = np.nonzero(codes)
    found = codes[rows, columns]
    return pd.DataFrame({
        "left_profile": left["profile"].to_numpy()[rows], "right_profile": right["profile"].to_numpy()[columns],
        "level": np.where(found >= EQUIVALENT_CODE, "equivalent", "review_required"),
        "evidence": ["compatible_first_author|" + LABELS[int(c)] for c in found],
    }, dtype=object)


def _judge_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near pairs among rows of two profiles each with their ``code``, by the rules of :func:`_near_codes`."""
    for batch in batches:
        codes = np.zeros(len(batch), dtype=np.int8)
        facts = zip(*[batch[f"{side}_{c}"] for c in ("title_fold", "scripts", "tokens") for side in "lr"])
        for at, (lt, rt, ls, rs, lk, rk) in enumerate(facts):
            lk, rk = set(lk), set(rk)
            both = len(lk & rk)
            either = len(lk) + len(rk) - both
            tokens = np.float32(both) / np.float32(either) if either else np.float32(0)
            enough = min(len(lk), len(rk)) >= ENOUGH_TOKENS
            ls, rs = set(ls), set(rs)
            scripts = bool(ls) and bool(rs) and ls.isdisjoint(rs)
            token_equal = enough and tokens >= np.float32(EQUIVALENT_TOKENS - 1e-6)
            partial_tokens = enough and tokens >= np.float32(PARTIAL_TOKENS - 1e-6)
            settled = partial_tokens or scripts or not enough
            floors = (EQUIVALENT_SEQUENCE,) if settled else (EQUIVALENT_SEQUENCE, PARTIAL_SEQUENCE)
            matcher = SequenceMatcher(None, lt, rt, autojunk=False)
            bound = matcher.quick_ratio()
            ratio = _ratio_class(matcher, bound, floors) if bound >= floors[-1] else 0.0
            code = 4 * token_equal + 8 * (ratio >= EQUIVALENT_SEQUENCE)
            if not code:
                code = 2 if scripts else int(partial_tokens or (enough and ratio >= PARTIAL_SEQUENCE))
            codes[at] = code
        yield batch.assign(code=codes)[codes > 0]


def _profiles(records: DataFrame, side: str, counted: bool = False) -> DataFrame:
    """One row per distinct profile, route and block; copies of a record do not multiply work.

    In the surname route profiles with an initial meet only the same initial and the
    blank ones; a blank initial meets all, in blocks where one side is all blank.
    ``counted`` adds the records of a profile, their least id and whether one has a DOI.
    """
    facts = ["profile", "title_fold", "name_words", "surname", "initial", "scripts"]
    distinct = records.filter("surname IS NOT NULL AND title_fold IS NOT NULL")
    if counted:
        distinct = distinct.groupBy(*facts).agg(
            F.count("*").alias("n"), F.min("record_id").alias("least_id"), F.max(F.col("doi").isNotNull()).alias("has_doi")
        )
        distinct = distinct.drop("n", "least_id") if side == "left" else distinct
    else:
        distinct = distinct.select(*facts).distinct()
    distinct = distinct.withColumn("tokens", N.content_tokens(F.col("title_fold")))
    blank = F.col("initial") == ""

    def block(route: str, *parts: Column) -> Column:
        return F.struct(F.lit(route).alias("route"), F.concat_ws("\0", *parts).alias("block"))

    own = F.when(~blank, block("surname", F.col("surname"), F.lit("="), F.col("initial")))
    left_blank = block("surname", F.col("surname"), F.lit("left blank"))
    right_blank = block("surname", F.col("surname"), F.lit("right blank"))
    if side == "left":
        across = [F.when(blank, left_blank), F.when(~blank, right_blank)]
    else:
        across = [left_blank, F.when(blank, right_blank)]
    routes = F.array_compact(F.array(own, *across, block("words", F.col("name_words"))))
    return distinct.withColumn("r", F.explode(routes)).select("*", "r.route", "r.block").drop("r").withColumn("side", F.lit(side))


def _near(left: DataFrame, right: DataFrame, facts: list[str], counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs of small blocks and cells of large ones, for :func:`near_pairs` and :func:`near_counts`.

    Blocks of at most ``FEW_PAIRS`` pairs, of which there are as many as authors, are joined
    and judged by rows, which keep ``facts`` under ``l_`` and ``r_`` and get a ``code``.  A larger
    block of one author and initial is cut into chunks of about ``BLOCK_ROWS`` profiles by hash;
    every chunk meets every chunk of the other side as its own bounded group, so a prolific author
    is spread over many tasks and no pair is missed.  Equal words under one surname only are left
    to the surname route, which holds all their pairs.
    """
    both = _profiles(left, "left", counted).unionByName(_profiles(right, "right", counted), allowMissingColumns=True)
    is_left = F.col("side") == "left"
    keys = ["route", "block"]
    sizes = both.groupBy(*keys).agg(
        F.count_if(is_left).alias("n_left"), F.count_if(~is_left).alias("n_right"),
        F.min("surname").alias("_low"), F.max("surname").alias("_high"),
    ).filter("n_left > 0 AND n_right > 0 AND (route = 'surname' OR _low <> _high)").drop("_low", "_high")
    blocks = cut(both.join(sizes, keys))
    few = F.col("n_left") * F.col("n_right") <= FEW_PAIRS
    known = [c for c in both.columns if c not in (*keys, "side")]
    mine = blocks.filter(few & is_left).select(*keys, *[F.col(c).alias(f"l_{c}") for c in known])
    theirs = blocks.filter(few & ~is_left).select(*keys, *[F.col(c).alias(f"r_{c}") for c in known])
    same_surname, same_words = F.col("l_surname") == F.col("r_surname"), F.col("l_name_words") == F.col("r_name_words")
    initials = (F.col("l_initial") == "") | (F.col("r_initial") == "") | (F.col("l_initial") == F.col("r_initial"))
    # a pair that meets in a surname block is judged there, not in a words block
    open_ = F.when(F.col("route") == "surname", same_surname & (initials | same_words)).otherwise(same_words & ~same_surname)
    judged = mine.join(theirs, keys).filter(open_ & (F.col("l_title_fold") != F.col("r_title_fold"))).select(
        *[f"{side}_{c}" for side in "lr" for c in dict.fromkeys([*facts, "title_fold", "scripts", "tokens"])]
    )
    judged = judged.mapInPandas(_judge_pairs, judged.withColumn("code", F.lit(0).cast("byte")).schema)

    n_left, n_right = (F.ceil(F.col(c) / BLOCK_ROWS).cast("int") for c in ("n_left", "n_right"))
    own = F.when(is_left, n_left).otherwise(n_right)
    other = F.when(is_left, n_right).otherwise(n_left)
    chunk = F.pmod(F.xxhash64("profile"), own).cast("int")
    spread = (
        blocks.filter(~few).withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
        .withColumn("left_chunk", F.when(is_left, F.col("own")).otherwise(F.col("other")))
        .withColumn("right_chunk", F.when(is_left, F.col("other")).otherwise(F.col("own")))
        .drop("own", "other", "n_left", "n_right")
    )
    return judged, spread.groupBy(*keys, "left_chunk", "right_chunk")


def _sides(cell: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Left and right rows of a cell, and the codes of their pairs."""
    side = cell["side"].to_numpy()
    x, y = (cell.take(np.flatnonzero(side == name)) for name in ("left", "right"))
    if not x.num_rows or not y.num_rows:
        return x, y, np.zeros((x.num_rows, y.num_rows), dtype=np.uint8)
    facts = ["route", "title_fold", "name_words", "surname", "initial", "scripts", "tokens"]
    return x, y, _near_codes(x.select(facts).to_pandas(), y.select(facts).to_pandas())


def near_pairs(left: DataFrame, right: DataFrame, facts: tuple[str, ...] = ("profile",)) -> DataFrame:
    """Profile pairs with compatible authors and different titles that are not distinct.

    A pair is its ``facts`` on both sides, its level and evidence.  Where only sums
    over the pairs of a profile are asked, :func:`near_counts` writes no pairs.
    """
    few, cells = _near(left, right, list(facts))
    named = [f"{side}_{c}" for side in ("left", "right") for c in facts]

    def judge(cell: pa.Table) -> pa.Table:
        x, y, codes = _sides(cell)
        rows, columns = np.nonzero(codes)
        return pa.Table.from_arrays([
            *[x[c].combine_chunks().take(pa.array(rows)) for c in facts], *[y[c].combine_chunks().take(pa.array(columns)) for c in facts],
            pa.array(codes[rows, columns].astype(np.int8)),
        ], names=[*named, "code"])

    found = few.select(*[F.col(f"{side}_{c}").alias(n) for n, (side, c) in zip(named, [(s, c) for s in "lr" for c in facts])], "code")
    found = found.unionByName(cells.applyInArrow(judge, found.schema))
    return found.select(*named, *_named(F.col("code")))


def near_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct near pairs by title, name words and initial, with level and evidence.

    Only a name that several profiles of its side share, by surname or scripts, can meet a pair
    twice.  Such names are judged apart, so no other pair is shuffled to tell it from its copies.
    """
    names = ("title_fold", "name_words", "initial")

    def parts(side: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        usable = side.filter("surname IS NOT NULL AND title_fold IS NOT NULL")
        shared = cut(
            usable.groupBy(*names).agg(F.min("profile").alias("_low"), F.max("profile").alias("_high"))
            .filter("_low <> _high").select(*names)
        )
        if shared.isEmpty():
            return side, None
        return usable.join(shared, list(names), "left_anti"), usable.join(shared, list(names), "left_semi")

    (own, several), (theirs, others) = parts(left), parts(right)
    apart = [near_pairs(x, y, names) for x, y in ((several, right), (own, others)) if x is not None and y is not None]
    out = near_pairs(own, theirs, names)
    if apart:
        out = out.unionByName(reduce(DataFrame.unionByName, apart).distinct())
    return out.withColumnsRenamed({
        f"{side}_{fact}": f"{side}_{name}" for side in ("left", "right") for fact, name in (("title_fold", "title"), ("name_words", "words"))
    })


def near_counts(left: DataFrame, right: DataFrame, equal_pairs: bool = False) -> DataFrame:
    """Right records of the near pairs of each left profile, added up where the pairs are judged.

    ``near_equal``, ``near_review`` and ``near_id`` add up over the rows of a ``left_profile``.  A
    row names its ``right_profile`` and whether it is ``equal`` only where a caller must look at the
    pair: both sides have a DOI, or, on demand, the pair is equal.
    """
    few, cells = _near(left, right, ["profile", "has_doi", "n", "least_id"], counted=True)
    kind = right.schema["record_id"].dataType.simpleString()
    shape = f"left_profile string, right_profile string, equal boolean, near_equal bigint, near_review bigint, near_id {kind}"

    def judge(cell: pa.Table) -> pa.Table:
        x, y, codes = _sides(cell)
        rows, columns = np.nonzero(codes)
        equal = codes[rows, columns] >= EQUIVALENT_CODE
        n = y["n"].to_numpy()[columns]
        ids = y["least_id"].to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        least = np.full(x.num_rows, len(ids))
        np.minimum.at(least, rows[equal], rank[columns[equal]])
        sums = [np.bincount(rows[part], weights=n[part], minlength=x.num_rows).astype(np.int64) for part in (equal, ~equal)]
        met = np.unique(rows)
        named = x["has_doi"].to_numpy()[rows] & y["has_doi"].to_numpy()[columns]
        if equal_pairs:
            named = named | equal
        pairs = np.count_nonzero(named)
        at = [order[r] if r < len(ids) else None for r in least[met]]
        whole = pa.Table.from_arrays([
            x["profile"].combine_chunks().take(pa.array(met)), pa.nulls(len(met), pa.string()), pa.nulls(len(met), pa.bool_()),
            pa.array(sums[0][met]), pa.array(sums[1][met]), y["least_id"].combine_chunks().take(pa.array(at, pa.int64())),
        ], names=names)
        single = pa.Table.from_arrays([
            x["profile"].combine_chunks().take(pa.array(rows[named])), y["profile"].combine_chunks().take(pa.array(columns[named])),
            pa.array(equal[named]), pa.array(np.zeros(pairs, dtype=np.int64)), pa.array(np.zeros(pairs, dtype=np.int64)),
            pa.nulls(pairs, whole["near_id"].type),
        ], names=names)
        return pa.concat_tables([whole, single])

    names = ["left_profile", "right_profile", "equal", "near_equal", "near_review", "near_id"]
    equal = F.col("code") >= EQUIVALENT_CODE
    wanted = F.col("l_has_doi") & F.col("r_has_doi")
    if equal_pairs:
        wanted = wanted | equal
    found = few.select(
        F.col("l_profile").alias("left_profile"), F.when(wanted, F.col("r_profile")).alias("right_profile"), equal.alias("equal"),
        F.when(equal, F.col("r_n")).otherwise(0).alias("near_equal"), F.when(equal, 0).otherwise(F.col("r_n")).alias("near_review"),
        F.when(equal, F.col("r_least_id")).alias("near_id"),
    )
    return found.unionByName(cells.applyInArrow(judge, shape))


def identity_counts(
    left: DataFrame, right: DataFrame, near: DataFrame | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Equivalent and review-required right records of each left record, over all routes.

    Left records of one profile and DOI meet the same records, so they are counted as one.
    Near pairs are summed per left profile.  Those that also share the record's
    DOI were counted by the exact route and are taken off.  Both sides are read
    by every route, so pass them written out (``session.cut``); ``near`` are their
    :func:`near_pairs` or ``counted`` their :func:`near_counts`, where the caller has them written out already.
    """
    if near is not None:
        totals = right.groupBy(F.col("profile").alias("right_profile")).agg(
            F.count("*").alias("n"), F.min("record_id").alias("least_id")
        )
        equal = F.col("level") == "equivalent"
        counted = near.join(totals, "right_profile").select(
            "left_profile", "right_profile", equal.alias("equal"), F.when(equal, F.col("n")).otherwise(0).alias("near_equal"),
            F.when(equal, 0).otherwise(F.col("n")).alias("near_review"), F.when(equal, F.col("least_id")).alias("near_id"),
        )
    elif counted is None:
        counted = cut(near_counts(left, right))
    per_profile = counted.groupBy(F.col("left_profile").alias("profile")).agg(
        F.sum("near_equal").alias("near_equal"), F.sum("near_review").alias("near_review"), F.min("near_id").alias("near_id"),
    )
    equal = F.col("equal")
    with_doi = right.filter("doi IS NOT NULL").groupBy(F.col("profile").alias("right_profile"), "doi").agg(F.count("*").alias("n"))
    key = F.concat_ws(SEP, "profile", F.when(F.col("doi").isNotNull(), F.concat(F.lit("="), "doi")))
    asked = left.select(
        key.alias("record_id"), "profile", "doi", "title_fold", "name_words", "surname", "initial"
    ).distinct()
    wanted = asked.filter("doi IS NOT NULL").select(F.col("profile").alias("left_profile"), "doi")
    shared = (
        counted.filter("right_profile IS NOT NULL").select("left_profile", "right_profile", "equal")
        .join(with_doi, "right_profile").join(wanted, ["left_profile", "doi"], "left_semi")
        .groupBy(F.col("left_profile").alias("profile"), "doi").agg(
            F.sum(F.when(equal, F.col("n")).otherwise(0)).alias("shared_equal"),
            F.sum(F.when(~equal, F.col("n")).otherwise(0)).alias("shared_review"),
        )
    )
    zero = F.lit(0)
    out = (
        asked.select("record_id", "profile", "doi").join(exact_matches(asked, right), "record_id")
        .join(per_profile, "profile", "left").join(shared, ["profile", "doi"], "left")
        .select(
            F.col("record_id").alias("_key"),
            (F.col("n_equivalent") + F.coalesce("near_equal", zero) - F.coalesce("shared_equal", zero)).alias("n_equivalent"),
            (F.col("n_review") + F.coalesce("near_review", zero) - F.coalesce("shared_review", zero)).alias("n_review"),
            F.least("match_id", "near_id").alias("match_id"),
        )
    )
    return left.select("record_id", key.alias("_key")).join(out, "_key").drop("_key")


def pick_unique(counts: DataFrame) -> DataFrame:
    """Exactly one equivalent is accepted, several are ambiguous, none is none."""
    n = F.col("n_equivalent")
    return counts.withColumn(
        "outcome", F.when(n == 1, "accepted").when(n > 1, "ambiguous").otherwise("none")
    ).withColumn("match_id", F.when(n == 1, F.col("match_id")))


def doi_lookup(candidates: DataFrame, works: DataFrame) -> DataFrame:
    """Work of each candidate's single DOI; a DOI of several works is ambiguous."""
    carried = works.filter("doi IS NOT NULL").groupBy("doi").agg(
        F.min("work_key").alias("_low"), F.max("work_key").alias("_high"),
    )
    unique = F.col("_low") == F.col("_high")
    state = F.when(F.col("doi").isNull(), "no_doi").when(F.col("_low").isNull(), "not_found").when(
        unique, "found"
    ).otherwise("ambiguous")
    return candidates.join(carried, "doi", "left").withColumn("doi_state", state).withColumn(
        "work_key", F.when(unique, F.col("_low"))
    ).drop("_low", "_high")


def title_lookup(left: DataFrame, right: DataFrame) -> DataFrame:
    """Outcome of looking candidates up by equal folded title, judged by author."""
    counts = class_counts(left, right, [Route(["title_fold"], every=1, ok=1)])
    n_all, n_ok = F.coalesce("n_all", F.lit(0)), F.coalesce("n_ok", F.lit(0))
    return left.select("record_id").join(counts, "record_id", "left").select(
        "record_id", n_all.alias("n_same_title"), n_ok.alias("n_equivalent"),
        F.when(n_ok == 1, F.col("match_id")).alias("match_id"),
        F.when(n_ok == 1, "accepted").when(n_ok > 1, "ambiguous").when(n_all > 0, "identity_mismatch")
        .otherwise("no_title_candidate").alias("outcome"),
    )


def dedupe_decisions(works: DataFrame) -> DataFrame:
    """Merge and review partners of each work inside one table, as counts.

    Automatic merges share a source id, or a DOI without author or type
    conflict.  Every other partner with the same DOI, title or a compatible
    first author is a candidate duplicate.  Sizes of the unions follow from
    inclusion and exclusion over the shared keys.  Needs ``source_id`` and a
    non-null ``work_type``.
    """
    fields = ["record_id", "source_id", "doi", "title_fold", "work_type", "name_words", "surname", "initial"]
    works = cut(works.select(*fields))  # read by both sides of both counts
    automatic = class_counts(works, works, [
        Route(["source_id"], every=1), Route(["doi", "work_type"], ok=1), Route(["doi", "work_type", "source_id"], ok=-1),
    ]).select("record_id", (F.col("n_all") + F.col("n_ok")).alias("n_auto"))
    conditions = [(["source_id"], False), (["doi"], False), (["title_fold"], False), ([], True)]
    routes = []
    for size in range(1, len(conditions) + 1):
        for chosen in combinations(conditions, size):
            keys = sorted({k for ks, _ in chosen for k in ks})
            sign = 1 if size % 2 else -1
            routes.append(Route(keys, same=sign) if any(same for _, same in chosen) else Route(keys, every=sign))
    every = class_counts(works, works, routes).select("record_id", (F.col("n_all") + F.col("n_same")).alias("n_any"))
    zero = F.lit(0)
    self_auto = (F.col("source_id").isNotNull() | F.col("doi").isNotNull()).cast("int")
    self_any = (
        F.col("source_id").isNotNull() | F.col("doi").isNotNull() | F.col("title_fold").isNotNull() | F.col("surname").isNotNull()
    ).cast("int")
    return (
        works.select("record_id", "source_id", "doi", "title_fold", "surname")
        .join(automatic, "record_id", "left").join(every, "record_id", "left")
        .select(
            "record_id", (F.coalesce("n_auto", zero) - self_auto).alias("n_automatic_merge"),
            (F.coalesce("n_any", zero) - self_any - F.coalesce("n_auto", zero) + self_auto).alias("n_candidate_duplicate"),
        )
    )
