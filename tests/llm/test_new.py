"""Spelling variants, conversation repair and embedding classes against brute force."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from shelfmark.llm import cover, spellings, turns


def edit_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def spelled(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 3}
    near = {w: [v for v in words if edit_one(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def spelled_rows(df):
    got = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spellings.spelling_groups(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spelling_groups_equal_brute_force(spark):
    r = random.Random(2)
    letters = "abeÉé÷Z"
    base = ["".join(r.choices(letters, k=r.randint(4, 9))) for _ in range(60)]
    texts = []
    for _ in range(120):
        words = []
        for w in r.choices(base, weights=[1 / (k + 1) for k in range(60)], k=60):
            if r.random() < 0.2:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1 :]])
            words.append(w)
        texts.append(r.choice([" ", "-", "\n"]).join(words))
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (5, None), (6, ""), (7, "aaaaaa " * 50_000), (8, "Ā" * 9)]
    rows += [(900, "mnopq " * 3 + "mnopr " * 6 + "mnosr " * 12 + "mntsr " * 24)]
    df = spark.createDataFrame([(*row, "x", 1) for row in rows], "doc_id long, text string, word string, n long")
    want = spelled(rows)
    assert any(f for _, _, _, f, _, _ in want) and any(root != f and f for _, _, _, f, _, root in want)
    assert spelled_rows(df) == want


def test_spelling_groups_on_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()][:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert spelled_rows(df) == spelled(rows)


def test_spelling_groups_of_nothing(nothing, edges):
    assert spellings.spelling_groups(nothing).count() == 0
    assert spelled_rows(edges) == spelled([(r.doc_id, r.text) for r in edges.collect()])


SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def cheapest(rows):
    """Least cost and least audit by a search over whole audits: ``rows`` are ``(initial, fault)``."""
    heap, done = [(0, "", 0, 0, ())], set()
    nexts = {0: 2, 1: 2, 2: 3, 3: 2}
    while True:
        cost, audit, at, state, shown = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, shown
        if (at, state) in done:
            continue
        done.add((at, state))
        heapq.heappush(heap, (cost + 3, audit + "I", at, nexts[state], shown + ((None, " ua"[nexts[state] - 1]),)))
        if at == len(rows):
            continue
        initial, fault = rows[at]
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, shown))
        if fault in ("blank", "duplicate"):
            continue
        more = 3 if fault == "truncated" else 0
        heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, nexts[state], shown + ((at, " ua"[nexts[state] - 1]),)))
        if initial == "s" and state == 0:
            heapq.heappush(heap, (cost + more, audit + "K", at + 1, 1, shown + ((at, None),)))
        if initial and initial == " ua"[nexts[state] - 1]:
            heapq.heappush(heap, (cost + more, audit + "K", at + 1, nexts[state], shown + ((at, None),)))


def repaired_by_search(rows):
    groups = collections.defaultdict(list)
    for row in hurt(rows):
        groups[row[0]].append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        mine, seen, faults = groups[conv], set(), []
        for _, _, role, text in mine:
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "sound"
            seen.add((role, text))
            faults.append(fault)
        known = [r[1] for r in mine if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, shown = cheapest([(r[2][:1], f) for r, f in zip(mine, faults)])
        names = {"u": "user", "a": "assistant"}
        body = "\n".join(f"{names[role] if role else mine[at][2]}:{'' if at is None else mine[at][3]}" for at, role in shown)
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def repaired_rows(df, **options):
    rows = turns.repair_digests(df, **options).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def hard_conversations():
    r = random.Random(7)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "supervisor"]
    texts = ["Yes.", "No!", "cut", "", " \t", "Why?", None, "a.b", "end. \n", "x!", "Y."]
    rows = []
    for conv in range(300):
        for turn in range(r.choice([1, 2, 3, 5, 9, 14])):
            rows.append((conv, turn + r.choice([0, 0, 0, 1]), r.choice(roles), r.choice(texts)))
    rows += [(None, k, "user", "Fine.") for k in range(4)] + [(7_000, None, "user", "a."), (7_000, None, "assistant", "b."), (7_000, 3, "user", "long " * 40_000)]
    return rows + rows[:40]


@pytest.mark.parametrize("run_turns", [turns.RUN_TURNS, 3, 1])
def test_repair_equals_a_search_over_audits(spark, run_turns):
    rows = hard_conversations()
    df = spark.createDataFrame([(*row, "clash", 1) for row in rows], "conv_id long, turn long, role string, text string, part string, fault long").repartition(3)
    assert repaired_rows(df, run_turns=run_turns) == repaired_by_search(rows)


def test_repair_of_the_table(spark, folder):
    df = spark.read.parquet(f"{folder}/conversations.parquet")
    assert repaired_rows(df) == repaired_by_search([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_a_long_conversation_is_repaired_in_runs(spark):
    """One conversation of 6,000 turns over many runs and partitions, and an empty table."""
    r = random.Random(3)
    rows = [(1, k, r.choice(["user", "assistant", "assistant"]), r.choice(["Yes.", "so", "", f"No {k}."])) for k in range(6_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert repaired_rows(df, run_turns=256) == repaired_by_search(rows)
    assert repaired_rows(df.limit(0)) == {}


def test_repaired_turns_are_legal(spark):
    df = spark.createDataFrame(hard_conversations(), "conv_id long, turn long, role string, text string")
    edits = turns.repaired(turns.turn_rows(df)).where("role IS NOT NULL").collect()
    shown = collections.defaultdict(list)
    for e in sorted(edits, key=lambda e: (e.part, e.block, e.seq)):
        shown[e.conv_id].append(e.role[:1])
    assert shown and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in shown.values())


def classes_by_hand(rows, least=0.93):
    """``rows`` are ``(vec_id, vector, label)``."""
    def fine(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    units = [None if i is None or tag is None or not fine(v) else np.array(v) / np.abs(v).max() for i, v, tag in rows]
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i in range(n):
        ids[find(i)].append(rows[i][0])
    out = collections.Counter()
    for i, (vec_id, _, _) in enumerate(rows):
        component = None if vec_id is None else min(ids[find(i)])
        out[vec_id, links[i], component, vec_id is None or vec_id == component] += 1
    return out


VECTORS = "vec_id long, embedding array<double>, label string, key string, rows long"


def classes(spark, rows, **options):
    df = spark.createDataFrame([(*row, "clash", 1) for row in rows], VECTORS).repartition(3)
    return collections.Counter(tuple(r) for r in cover.near_vectors(df, **options).collect())


def odd_vectors(count, dims=8, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    rows = []
    for k in range(count):
        v = centres[k % 6] * r.choice([1e-3, 1, 1e200]) + 0
        v = v / np.abs(v).max() + r.normal(size=dims) * r.choice([0, 1e-9, 0.05, 0.2])
        rows.append((k, v.tolist(), "ab/1"[: 1 + k % 2] if k % 3 else "a"))
    rows += [(9000 + k, v, tag) for k, (v, tag) in enumerate([
        (None, "a"), ([], "a"), ([0.0] * dims, "a"), ([float("nan")] * dims, "a"), ([None] + [1.0] * (dims - 1), "a"), ([1.0] * dims, None),
        ([1e300] * dims, "z"), ([1e-300] * dims, "z"), ([1.0, 2.0], "a"), ([2.0, 4.1], "a"), ([float("inf")] * dims, "b"), (rows[0][1], "a/1"),
    ])]
    return rows + rows[:20] + [(5, rows[40][1], "a"), (None, rows[0][1], "a"), (8_001, rows[0][1], "a"), (8_002, rows[0][1], "b")]


@pytest.mark.parametrize("leaf_rows", [cover.LEAF_ROWS, 20])
def test_vector_classes_equal_all_pairs(spark, leaf_rows):
    rows = odd_vectors(240)
    assert classes(spark, rows, leaf_rows=leaf_rows) == classes_by_hand(rows)


def test_vector_classes_of_the_table(spark, folder):
    rows = [(r.vec_id, [float(c) for c in r.embedding], str(r.label)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = classes_by_hand(rows)
    assert classes(spark, rows) == want and classes(spark, rows, leaf_rows=16) == want


def test_crowded_vectors_link_as_nodes(spark):
    """1,500 vectors within the threshold of each other and 200 away: links are counts, no table of pairs."""
    r = np.random.default_rng(5)
    crowd, rest = np.ones(16), r.normal(size=(200, 16))
    rows = [(k, (crowd + r.normal(size=16) * 1e-4).tolist(), "a") for k in range(1_500)] + [(5_000 + k, v.tolist(), "a") for k, v in enumerate(rest)]
    got = classes(spark, rows, leaf_rows=100)
    assert sum(n for (vec_id, links, component, _), n in got.items() if vec_id < 1_500 and links >= 1_499 and component == 0) == 1_500
    assert classes(spark, []) == collections.Counter()


@pytest.mark.parametrize("least", [0.5, 0.93, 0.9999])
def test_dual_traversal_equals_a_matrix(least):
    r = np.random.default_rng(9)
    x = cover.unit(np.concatenate([r.normal(size=(300, 5)), r.normal(size=(4, 5))[r.integers(0, 4, 500)] + r.normal(size=(500, 5)) * 0.02]))
    weights = r.integers(1, 4, len(x))
    links = cover.Links(weights)
    a, b = cover.CoverTree(x[:400], 16, 4), cover.CoverTree(x[400:], 16, 4)
    cover.traverse(links, a, b, a.order, 400 + b.order, least)
    for tree, at in ((a, a.order), (b, 400 + b.order)):
        cover.traverse(links, tree, tree, at, at, least)
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    assert (links.counts == linked @ weights).all()
    reached = linked | np.eye(len(x), dtype=bool)
    for _ in range(10):
        reached = (reached.astype(np.int64) @ reached) > 0
    assert ((links.part[:, None] == links.part[None, :]) == reached).all()
