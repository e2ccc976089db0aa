"""Conversation structure repair by Hirschberg's divide and conquer.

Rows of a conversation are kept, reroled or deleted and empty turns inserted until the role
initials read ``(s?(ua)+)?``.  The automaton has four states; a row maps a vector of four
costs to the next one.  Equal costs go to the ASCII-least audit, the letters of the edits in
order.  Audits that reach different states over the same rows are never prefixes of each
other, so a vector only carries the order of its four audits, not the audits.

Between two rows of known states, the forward vector of the first half and the backward
vector of the second half meet in the middle: among the crossings of least total cost the
one whose forward audit is least is taken, and both halves are repaired alike.  That keeps
two vectors at a time instead of a table over all rows.

The same division spreads a long conversation: turns are sorted by range, runs of at most
``RUN_TURNS`` turns become 4 x 4 matrices of costs and audit orders where they lie, the
matrices of a conversation meet in the same way and give every run its first and last
state, and each run is then repaired on its own.  Only the digests of a conversation walk
its turns in order, as a stream that holds no more than a row and the audit.

Rows are ordered by turn (null first), role and text; repeated rows follow each other.  Null
roles and texts read as one space, and so do nulls in the damage's key.  Rows without a
conversation id form one conversation of null id.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an insertion or relabelling must be
SHOWN = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER, RUN_TURNS = 10**12, 4_096
LEGAL_PAIRS = ("su", "ua", "au")
BLANK, DUPLICATE, CUT_SHORT, SOUND = "blank", "duplicate", "truncated", "sound"
WORDLESS = "^[\\x20\\x09-\\x0D]*$"
OPEN_END = "[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*$"


@lru_cache(maxsize=None)
def moves(initial: str, fault: str) -> tuple[tuple[int, str], ...]:
    """``16`` entries ``[from * 4 + to]``: least cost and least letters that take a row from one state to another."""
    best = [(NEVER, "")] * 16
    for state in range(4):
        here, added, letters = state, 0, ""
        for _ in range(4):  # more insertions than the automaton has states never pay
            options = [(here, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED if fault == CUT_SHORT else 0
                options.append((NEXT[here], REROLE + extra, "R"))
                if here == START and initial == "s":
                    options.append((SYSTEM, KEEP + extra, "K"))
                if initial == "xsua"[NEXT[here]]:
                    options.append((NEXT[here], KEEP + extra, "K"))
            for to, cost, letter in options:
                best[state * 4 + to] = min(best[state * 4 + to], (added + cost, letters + letter))
            here, added, letters = NEXT[here], added + INSERT, letters + "I"
    return tuple(best)


ENDS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
# a vector: costs of the four states and the order of their least audits
Vector = tuple[list[int], list[int]]


def leaving(state: int) -> Vector:
    return [0 if q == state else NEVER for q in range(4)], [0] * 4


def _ordered(found: list[tuple[int, tuple]]) -> Vector:
    """Costs, and places of the audits' sort keys."""
    places = {key: k for k, key in enumerate(sorted({key for cost, key in found if cost < NEVER}))}
    return [min(cost, NEVER) for cost, _ in found], [places.get(key, 4) for _, key in found]


def step(vector: Vector, table: tuple[tuple[int, str], ...]) -> Vector:
    """The forward vector after one more row."""
    costs, order = vector
    return _ordered([
        min((costs[q] + table[q * 4 + to][0], (order[q], table[q * 4 + to][1])) if table[q * 4 + to][0] < NEVER and costs[q] < NEVER else (NEVER, (9, ""))
            for q in range(4))
        for to in range(4)
    ])


def step_run(vector: Vector, matrix: list[Vector]) -> Vector:
    """The forward vector after a whole run."""
    costs, order = vector
    return _ordered([
        min((costs[q] + matrix[q][0][to], (order[q], matrix[q][1][to])) if matrix[q][0][to] < NEVER and costs[q] < NEVER else (NEVER, (9, 9))
            for q in range(4))
        for to in range(4)
    ])


def run_matrix(tables: list) -> list[Vector]:
    """Vectors after a run, for each state before it."""
    out = [leaving(q) for q in range(4)]
    for table in tables:
        out = [step(v, table) for v in out]
    return out


def back(costs: list[int], row: list[list[int]]) -> list[int]:
    """The backward costs before a row or run of costs ``row[from][to]``."""
    return [min(min(row[q][to] + costs[to] for to in range(4)), NEVER) for q in range(4)]


def crossing(forward: Vector, backward: list[int]) -> int:
    """The state of least total cost, the one of the least forward audit among equals."""
    return min(range(4), key=lambda q: (min(forward[0][q] + backward[q], NEVER), forward[1][q]))


def divide(n: int, first: int, last: int, forward, backward) -> list[int]:
    """States after each of ``n`` rows or runs between two known states.

    ``forward(vector, lo, hi)`` and ``backward(costs, lo, hi)`` carry a vector over a stretch.
    """
    after = [last] * n
    todo = [(0, n, first, last)]
    while todo:
        lo, hi, before, then = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        state = crossing(forward(leaving(before), lo, mid), backward(leaving(then)[0], mid, hi))
        after[mid - 1] = state
        todo += [(lo, mid, before, state), (mid, hi, state, then)]
    return after


def states_of_runs(matrices: list[list[Vector]]) -> tuple[int, list[int]]:
    """Least cost of a conversation and the state after each of its runs."""
    rows = [[m[q][0] for q in range(4)] for m in matrices]

    def forward(vector: Vector, lo: int, hi: int) -> Vector:
        for k in range(lo, hi):
            vector = step_run(vector, matrices[k])
        return vector

    def backward(costs: list[int], lo: int, hi: int) -> list[int]:
        for k in range(hi - 1, lo - 1, -1):
            costs = back(costs, rows[k])
        return costs

    ends = [ENDS[q][0] for q in range(4)]
    whole = forward(leaving(START), 0, len(matrices))
    last = crossing(whole, ends)
    return whole[0][last] + ends[last], divide(len(matrices), START, last, forward, backward)


def repaired_letters(tables: list, first: int, last: int) -> list[str]:
    """The letters of each row of a run between two states: insertions before it, then its own edit."""
    def forward(vector: Vector, lo: int, hi: int) -> Vector:
        for k in range(lo, hi):
            vector = step(vector, tables[k])
        return vector

    def backward(costs: list[int], lo: int, hi: int) -> list[int]:
        for k in range(hi - 1, lo - 1, -1):
            costs = back(costs, [[tables[k][q * 4 + to][0] for to in range(4)] for q in range(4)])
        return costs

    after = divide(len(tables), first, last, forward, backward)
    return [table[before * 4 + then][1] for table, before, then in zip(tables, [first, *after[:-1]], after)]


def turn_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns an operator reads, under fixed names; null roles and texts are one space."""
    return conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Turns after the planted faults, by a checksum of their conversation and turn."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.withColumn("_kind", kind).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy"),
    ).drop("_copy")


def with_faults(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copy, fault)``; copies of one row are numbered from 1."""
    key = F.md5(F.concat(F.col("role"), F.lit("\x1f"), F.col("text")).cast("binary"))
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("key", key)
    rows = cut(rows.withColumn("is_blank", F.col("text").rlike(WORDLESS)))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # one small row per conversation and utterance; a join splits the hot ones
    said = rows.where("NOT is_blank").groupBy("conv_id", "key").agg(F.count("*").alias("times"), F.min(order).alias("first"))
    again = said.where("times > 1").select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "first")
    told = rows.join(again, F.expr("conv_id <=> _conv AND key = _key"), "left")
    repeated = (F.col("copy") > 1) | F.coalesce(F.col("first") < order, F.lit(False))
    fault = (
        F.when(F.col("is_blank"), BLANK).when(repeated, DUPLICATE).when(F.col("text").rlike(OPEN_END), CUT_SHORT).otherwise(SOUND)
    )
    return told.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "conv_id", "turn", "role", "text", "copy", fault.alias("fault")
    )


KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])


RUNS = (
    "conv_id long, turn long, role string, text string, fault string, part long, block long, seq long, "
    "summary array<long>, initials string"
)


def _sorted_runs(rows: DataFrame, run_turns: int) -> DataFrame:
    """Rows in order with their run, and per run a row with its matrix, initials and illegal pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, key, block, seq = TaskContext.get().partitionId(), (False, None), 0, 0
        vectors, first, last, illegal, out = [], "", "", 0, []

        def summary() -> tuple:
            numbers = [v for costs, order in vectors for v in costs + order] + [illegal]
            return key[1], None, None, None, None, part, block, -1, numbers, f"{first}\x1f{last}"

        for batch in batches:
            for conv, turn, role, text, fault in zip(*(batch.column(k).to_pylist() for k in range(5))):
                initial = role[:1]
                if (True, conv) != key or seq == run_turns:
                    if seq:
                        out.append(summary())
                    block = block + 1 if (True, conv) == key else 0
                    key, seq, illegal, first = (True, conv), 0, 0, initial
                    vectors = [leaving(q) for q in range(4)]
                else:
                    illegal += last + initial not in LEGAL_PAIRS
                last = initial
                table = moves(initial, fault)
                vectors = [step(v, table) for v in vectors]
                out.append((conv, turn, role, text, fault, part, block, seq, None, None))
                seq += 1
            if out:
                yield _batch(out, RUNS)
        if seq:
            out.append(summary())
            yield _batch(out, RUNS)

    order = ["conv_id", "turn", "role", "text", "copy"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault").mapInArrow(run, RUNS)


def _in_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Neighbouring rows with equal keys."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != last:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


STATES = "conv_id long, part long, block long, before long, after long, final boolean, cost long, illegal long"


def _states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for runs in _in_groups(batches, ["conv_id"]):
        matrices = [[(r["summary"][8 * q : 8 * q + 4], r["summary"][8 * q + 4 : 8 * q + 8]) for q in range(4)] for r in runs]
        cost, after = states_of_runs(matrices)
        ends = [r["initials"].split("\x1f") for r in runs]
        illegal = sum(r["summary"][-1] for r in runs) + sum(a[1] + b[0] not in LEGAL_PAIRS for a, b in zip(ends, ends[1:]))
        for k, (r, before, then) in enumerate(zip(runs, [START, *after[:-1]], after)):
            out.append((r["conv_id"], r["part"], r["block"], before, then, k == len(runs) - 1, cost, illegal))
        if len(out) > 5_000:
            yield _batch(out, STATES)
    if out:
        yield _batch(out, STATES)


REPAIRED = "conv_id long, part long, block long, seq long, edit string, turn long, role string, text string, fault string, cost long, illegal long"


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for rows in _in_groups(batches, ["conv_id", "part", "block"]):
        head, place = rows[0], 0
        letters = repaired_letters([moves(r["role"][:1], r["fault"]) for r in rows], head["before"], head["after"])
        state = head["before"]
        where = head["conv_id"], head["part"], head["block"]
        totals = head["cost"], head["illegal"]
        for row, edits in zip(rows, letters):
            for edit in edits:
                if edit == "D":
                    role = None
                elif edit == "K":
                    role, state = row["role"], SYSTEM if row["role"][:1] == "s" else NEXT[state]
                else:
                    state = NEXT[state]
                    role = SHOWN[state]
                own = edit != "I"
                text = "" if edit == "I" else None if edit == "D" else row["text"]
                out.append((*where, place, edit, row["turn"] if own else None, role, text, row["fault"] if own else None, *totals))
                place += 1
            if len(out) > 1_000:
                yield _batch(out, REPAIRED)
        if head["final"]:
            for edit in ENDS[state][1]:
                state = NEXT[state]
                out.append((*where, place, edit, None, SHOWN[state], "", None, *totals))
                place += 1
    if out:
        yield _batch(out, REPAIRED)


def repaired(turns: DataFrame, run_turns: int = RUN_TURNS) -> DataFrame:
    """One row per edit, in the order of ``part, block, seq`` of its conversation.

    ``turns`` are :func:`turn_rows`.  ``edit`` is K (kept), R (reroled), D (deleted: role and
    text are null) or I (inserted); ``cost`` and ``illegal`` are of the whole conversation.
    """
    runs = cut(_sorted_runs(with_faults(turns), min(run_turns, RUN_TURNS)))
    one = ["conv_id", "part", "block"]
    states = runs.where("summary IS NOT NULL").select(*one, "summary", "initials").repartition("conv_id").sortWithinPartitions(*one).mapInArrow(_states, STATES)
    held = runs.where("summary IS NULL").drop("summary", "initials").alias("t").join(
        states.alias("s"), F.expr("t.conv_id <=> s.conv_id AND t.part = s.part AND t.block = s.block")
    ).select("t.*", "before", "after", "final", "cost", "illegal")
    return held.repartition(*one).sortWithinPartitions(*one, "seq").mapInArrow(_edits, REPAIRED)


DIGEST = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, out, audit, faults, sha, begun, totals = (False, None), [], [], {}, None, False, (0, 0)

    def digest() -> tuple:
        return key[1], faults[BLANK], faults[DUPLICATE], faults[CUT_SHORT], totals[1], totals[0], "".join(audit), sha.hexdigest()

    for batch in batches:
        names = ("conv_id", "edit", "role", "text", "fault", "cost", "illegal")
        for conv, edit, role, text, fault, cost, illegal in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
            if (True, conv) != key:
                if key[0]:
                    out.append(digest())
                key, audit, sha, begun, totals = (True, conv), [], hashlib.sha256(), False, (cost, illegal)
                faults = dict.fromkeys((BLANK, DUPLICATE, CUT_SHORT, SOUND), 0)
            audit.append(edit)
            if fault is not None:
                faults[fault] += 1
            if role is not None:
                sha.update((("\n" if begun else "") + role + ":" + text).encode())
                begun = True
        if len(out) > 1_000:
            yield _batch(out, DIGEST)
    if key[0]:
        out.append(digest())
        yield _batch(out, DIGEST)


def repair_digests(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", run_turns: int = RUN_TURNS,
) -> DataFrame:
    """One row per conversation: its faults after the planted damage, and what repairing it takes."""
    turns = turn_rows(conversations, conv_id, turn, role, text)
    hurt = damaged(turns)
    edits = repaired(hurt, run_turns)
    # a checksum has an order, so it is a stream: sorted rows of a conversation, one at a time
    digests = edits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "seq").mapInArrow(_digests, DIGEST)
    spans = hurt.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    ).withColumnRenamed("conv_id", "_span")
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    all_ids = turns.select("conv_id").distinct()
    told = digests.withColumnRenamed("conv_id", "_digest")
    return (
        all_ids.join(spans, F.expr("conv_id <=> _span"), "left").join(told, F.expr("conv_id <=> _digest"), "left")
        .select("conv_id", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in zeros.items()))
    )
