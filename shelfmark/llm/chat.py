"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, a user first and an assistant last.  Each given turn is kept, relabelled or
merged into the turn before it, and empty turns may be inserted before it or at the end.
Dynamic programming over the automaton's states finds the cheapest repair; equal costs
prefer keeping, then merging, then relabelling, with the fewest insertions.

Costs only depend on the state before and after a turn, so a run of turns is a small
min-plus matrix.  Conversations are sorted by range, so a long one spreads over
partitions; runs of at most ``RUN_TURNS`` turns are reduced to matrices where they lie, one
small row each, the rows of a conversation give every run its first and last state, and
each run is then repaired on its own.  No task ever holds a whole long conversation.

Turns are ordered by turn (null first), role, text; repeated rows are turns of their own.
Null or unknown roles must be relabelled or merged.  Null texts are empty.  Rows without a
conversation id form one conversation of null id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut

ROLES = ["system", "user", "assistant", "other"]
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what the sequence so far ends with
MERGE, INSERT, RELABEL = 1, 2, 3
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RUN_TURNS = 4_096
NEVER = 10**9


def _paths() -> dict[int, list[tuple[int, tuple[int, ...]]]]:
    """States reachable by inserting empty user and assistant turns, fewest first."""
    out = {}
    for state in range(4):
        found, at = [(state, ())], 0
        while at < len(found):
            here, added = found[at]
            for role in LEGAL[here]:
                if role != SYSTEM and role not in [s for s, _ in found]:
                    found.append((role, added + (role,)))
            at += 1
        out[state] = found
    return out


PATHS = _paths()


def _moves() -> list[dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]]:
    """Per given role: cheapest ``(cost, action, insertions)`` between two states."""
    tables = []
    for role in (SYSTEM, USER, ASSISTANT, 0):  # the last stands for an unknown role
        table: dict = {}
        for state in range(4):
            for here, added in PATHS[state]:
                options = [(0 if to == role else RELABEL, "keep" if to == role else "relabel", to) for to in LEGAL[here]]
                if here != START:
                    options.append((MERGE if here == role else MERGE + RELABEL, "merge", here))
                for cost, action, to in options:
                    rank = ("keep", "merge", "relabel").index(action)
                    choice = (cost + INSERT * len(added), rank, len(added), action, added)
                    if (state, to) not in table or choice < table[state, to]:
                        table[state, to] = choice
        tables.append({k: (v[0], v[3], v[4]) for k, v in table.items()})
    return tables


MOVES = _moves()
COSTS = np.full((4, 4, 4), NEVER, dtype=np.int64)
for _role, _table in enumerate(MOVES):
    for (_from, _to), (_cost, _, _) in _table.items():
        COSTS[_role, _from, _to] = _cost
END_COST = np.array([NEVER, 2 * INSERT, INSERT, 0])
END_ADDED = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_code(role: str | None) -> int:
    """Place in the tables: 0 system, 1 user, 2 assistant, 3 anything else."""
    return {"system": 0, "user": 1, "assistant": 2}.get((role or "").strip().lower(), 3)


def run_matrix(codes: list[int]) -> np.ndarray:
    """Least cost from each state before a run to each state after it."""
    total = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for code in codes:
        total = np.minimum((total[:, :, None] + COSTS[code][None, :, :]).min(axis=1), NEVER)
    return total


def best_states(matrices: list[np.ndarray]) -> tuple[int, list[int]]:
    """Least total cost of a conversation and the state after each of its runs."""
    cost, came = np.array([0, NEVER, NEVER, NEVER]), []
    for matrix in matrices:
        step = cost[:, None] + matrix
        came.append(step.argmin(axis=0))
        cost = np.minimum(step.min(axis=0), NEVER)
    state = int((cost + END_COST).argmin())
    total, after = int((cost + END_COST)[state]), []
    for back in reversed(came):
        after.append(state)
        state = int(back[state])
    return total, after[::-1]


def repair_run(codes: list[int], before: int, after: int) -> list[tuple[str, int, tuple[int, ...]]]:
    """``(action, role, insertions before it)`` of each turn on the cheapest way between two states."""
    cost = np.full(4, NEVER)
    cost[before] = 0
    came = []
    for code in codes:
        step = cost[:, None] + COSTS[code]
        came.append(step.argmin(axis=0))
        cost = np.minimum(step.min(axis=0), NEVER)
    out, state = [], after
    for code, back in zip(reversed(codes), reversed(came)):
        earlier = int(back[state])
        _, action, added = MOVES[code][earlier, state]
        out.append((action, state, added))
        state = earlier
    return out[::-1]


def opened(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSED = "<|end|>\n"


def render(turns: list[tuple[str, int, tuple[int, ...]]], texts: list[str], first: bool, last: bool) -> list[str]:
    """What each turn adds to the chat text; in order they make up the whole."""
    out = []
    for k, ((action, role, added), text) in enumerate(zip(turns, texts)):
        empty = "".join(opened(r) + CLOSED for r in added)
        if action == "merge" and not added:
            piece = "\n\n" + text
        else:
            close = "" if first and k == 0 else CLOSED
            # a merge after insertions continues the last inserted turn
            piece = close + (empty[: -len(CLOSED)] + text if action == "merge" else empty + opened(role) + text)
        if last and k == len(turns) - 1:
            piece += CLOSED + "".join(opened(r) + CLOSED for r in END_ADDED[role])
        out.append(piece)
    return out


TURN = "conv_id long, turn long, role string, text string, part long, block long, seq long, matrix array<long>"


def _sorted_runs(turns: DataFrame, run_turns: int) -> DataFrame:
    """Turns in order with their run, and one matrix row per run."""
    names = [c.split()[0] for c in TURN.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, key, block, seq, codes = TaskContext.get().partitionId(), (False, None), 0, 0, []

        def summary() -> tuple:
            return key[1], None, None, None, part, block, -1, run_matrix(codes).ravel().tolist()

        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (True, conv) != key or len(codes) == run_turns:
                    if codes:
                        rows.append(summary())
                    block = block + 1 if (True, conv) == key else 0
                    key, codes, seq = (True, conv), [], 0
                rows.append((conv, turn, role, text, part, block, seq, None))
                codes.append(role_code(role))
                seq += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        if codes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(summary()), types)], names=names)

    order = ["conv_id", "turn", "role", "text"]
    return turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, TURN)


def _in_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Consecutive rows with equal keys, from batches sorted by them."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def _written(rows: list[tuple], schema: str, most: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows as one batch once there are more than ``most``; they are taken from the list."""
    if len(rows) > most:
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        fields = [c.split() for c in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])
        rows.clear()


STATES = "conv_id long, part long, block long, before long, after long, repair_cost long, first boolean, last boolean"


def _states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for runs in _in_runs(batches, ["conv_id"]):
        total, after = best_states([np.array(r["matrix"]).reshape(4, 4) for r in runs])
        for k, (r, before, then) in enumerate(zip(runs, [START, *after[:-1]], after)):
            out.append((r["conv_id"], r["part"], r["block"], before, then, total, k == 0, k == len(runs) - 1))
        yield from _written(out, STATES, 5_000)
    yield from _written(out, STATES)


REPAIRED = (
    "conv_id long, turn long, role string, part long, place long, action string, out_role string, n_inserted long, "
    "repair_cost long, rendered string"
)


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for rows in _in_runs(batches, ["conv_id", "part", "block"]):
        head = rows[0]
        plan = repair_run([role_code(r["role"]) for r in rows], head["before"], head["after"])
        pieces = render(plan, [r["text"] or "" for r in rows], head["first"], head["last"])
        for r, (action, role, added), piece in zip(rows, plan, pieces):
            out.append((
                r["conv_id"], r["turn"], r["role"], r["part"], r["block"] * RUN_TURNS + r["seq"], action, ROLES[role - 1],
                len(added), r["repair_cost"], piece,
            ))
        yield from _written(out, REPAIRED, 1_000)
    yield from _written(out, REPAIRED)


def formatted(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", run_turns: int = RUN_TURNS,
) -> DataFrame:
    """One row per turn: what became of it and what it adds to the rendered conversation.

    ``part`` and ``place`` give the order of the turns of a conversation.
    """
    turns = conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"),
    )
    runs = cut(_sorted_runs(turns, min(run_turns, RUN_TURNS)))
    whole, one = ["conv_id"], ["conv_id", "part", "block"]
    states = (
        runs.where("matrix IS NOT NULL").select(*one, "matrix").repartition(*whole).sortWithinPartitions(*one).mapInArrow(_states, STATES)
    )
    held = runs.where("matrix IS NULL").drop("matrix").alias("t").join(
        states.alias("s"), F.expr("t.conv_id <=> s.conv_id AND t.part = s.part AND t.block = s.block")
    ).select("t.*", "before", "after", "repair_cost", "first", "last")
    return held.repartition(*one).sortWithinPartitions(*one, "seq").mapInArrow(_repaired, REPAIRED)
