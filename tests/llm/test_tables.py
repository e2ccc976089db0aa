"""Operators on pages, vectors and conversations."""

import base64
import collections
import datetime
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import chat, url_lists, vectors, warc

MAGIC = warc.MAGIC
FAKE = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def hostile_pages():
    r = random.Random(1)
    parts = ["ab ", MAGIC, FAKE, "é\r\n\r\n", MAGIC * 3, "x" * 200]
    pages = [(i, f"http://x/{i}", "".join(r.choices(parts, k=r.randint(0, 12)))) for i in range(60)]
    return pages + [(500, "u\r\nv", None), (501, "u", ""), (None, None, "zz"), (7, "again", pages[7][2])]


def digest(body):
    return base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()


@pytest.mark.parametrize("compression, size", [("none", 2_000), ("gzip", 1 << 20)])
def test_archives_round_trip(spark, tmp_path, compression, size):
    pages = hostile_pages()
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, first string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_archives(df, path, compression=compression, records_per_file=40)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = warc.read_archives(spark, path, with_payload=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", 10**9), i)
    responses = [(html or "") for i, _, html in pages if first.get(html or "") in (None, i)]
    assert len(rows) == len(pages)
    assert collections.Counter(bytes(r.payload).decode() for r in rows if r.record_type == "response") == collections.Counter(responses)
    assert all(r.payload_digest == digest(bytes(r.payload).decode()) for r in rows)


def test_page_records(spark):
    pages = hostile_pages()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    least = {}
    for i, _, html in pages:
        if i is not None:
            least[html or ""] = min(least.get(html or "", 10**9), i)
    want = collections.Counter()
    for i, _, html in pages:
        body = html or ""
        again = least.get(body) not in (None, i)
        want[i, len(body.encode()), digest(body), "revisit" if again else "response", least[body] if again else None] += 1
    assert collections.Counter(tuple(r) for r in warc.page_records(df).collect()) == want
    assert warc.page_records(df.limit(0)).count() == 0


def test_page_records_reads_files_in_ranges(spark, tmp_path):
    pages = hostile_pages()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    want = collections.Counter(tuple(r) for r in warc.page_records(df).collect())
    path = str(tmp_path / "w")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = collections.Counter(tuple(r) for r in warc.page_records(df, path).collect())
        ranges = warc._chunks(spark, path).select("path", "block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and sum(got.values()) == len(pages)
    assert ranges > 5 * len(list((tmp_path / "w").glob("part-*")))


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_entries_hold_when_active(spark):
    log = [
        ("a.com", "block", "ads", day(5), "add"), ("a.com", "block", "ads", day(5), "add"), ("a.com", "block", "ads", day(50), "remove"),
        ("a.com", "block", "ads", day(80), "add"), ("x.a.com/en", "allow", "fine", day(0), "add"),
        ("b.com", "block", "ads", day(3), "add"), ("b.com", "block", "ads", day(3), "remove"),  # stays active
        ("b.com", "allow", "fine", day(3), "add"), (None, "block", "ads", day(1), "add"), ("c.com", "block", None, day(1), "add"),
        ("d.com", "block", "ads", None, "add"), ("d.com", "maybe", "ads", day(1), "add"),
    ]
    entries = spark.createDataFrame(log, "key string, verdict string, category string, entry_date date, change string")
    captures = [
        (1, "http://a.com/", day(4), "pass"), (2, "http://a.com/", day(5), "block"), (3, "HTTPS://u:p@X.A.com.:80/q", day(49), "block"),
        (4, "http://a.com", day(50), "pass"), (5, "http://a.com?x", day(80), "block"), (6, "http://x.a.com//en/z", day(90), "allow"),
        (7, "http://y.a.com/en", day(90), "block"), (8, "http://b.com/", day(400), "allow"), (9, "http://c.com/" + "p/" * 5000, day(9), "block"),
        (10, None, day(9), "pass"), (11, "http://a.com/", None, "pass"), (12, "nonsense", day(9), "pass"), (13, "http://d.com/", day(9), "pass"),
        (14, "http://aa.com/", day(9), "pass"), (None, "http://a.com/", day(6), "block"), (2, "http://a.com/", day(5), "block"),
    ]
    df = spark.createDataFrame([(*c[:3], "clash") for c in captures], "page_id long, url string, fetched_on date, host string")
    got = collections.Counter((r.page_id, r.verdict) for r in url_lists.judged(df, entries).collect())
    assert got == collections.Counter((c[0], c[3]) for c in captures)
    assert {r.verdict for r in url_lists.judged(df, entries.limit(0)).collect()} == {"pass"}
    assert url_lists.judged(df.limit(0), entries).count() == 0


def cheapest(codes):
    """All repairs tried, by relaxation over states."""
    def inserted(cost):
        cost, moved = dict(cost), True
        while moved:
            moved = False
            for state, c in list(cost.items()):
                for role in chat.LEGAL[state]:
                    if role != chat.SYSTEM and c + chat.INSERT < cost.get(role, 10**9):
                        cost[role], moved = c + chat.INSERT, True
        return cost

    cost = {chat.START: 0}
    for code in codes:
        own, after = code + 1 if code < 3 else None, {}
        for state, c in inserted(cost).items():
            for role in chat.LEGAL[state]:
                after[role] = min(after.get(role, 10**9), c + (0 if role == own else chat.RELABEL))
            if state != chat.START:
                after[state] = min(after.get(state, 10**9), c + chat.MERGE + (0 if state == own else chat.RELABEL))
        cost = after
    return inserted(cost)[chat.ASSISTANT]


def test_repairs_are_cheapest_and_legal():
    r = random.Random(2)
    for n in range(1, 6):
        for codes in itertools.product(range(4), repeat=n):
            at = r.randint(0, n)
            runs = [list(p) for p in (codes[:at], codes[at:]) if p]
            total, after = chat.best_states([chat.run_matrix(p) for p in runs])
            plan = [m for p, b, a in zip(runs, [chat.START, *after[:-1]], after) for m in chat.repair_run(p, b, a)]
            cost, state = 0, chat.START
            for (action, to, added), code in zip(plan, codes):
                for role in added:
                    assert role in chat.LEGAL[state]
                    state, cost = role, cost + chat.INSERT
                same = to == code + 1
                if action == "merge":
                    assert to == state
                    cost += chat.MERGE + (0 if same else chat.RELABEL)
                else:
                    assert to in chat.LEGAL[state] and (action == "keep") == same
                    cost, state = cost + (0 if same else chat.RELABEL), to
            assert total == cost + chat.INSERT * len(chat.END_ADDED[state]) == cheapest(codes)


def test_rendered_conversations_are_legal(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "Tool", None, "USER"]), r.choice([None, "", f"say {t}"])) for c in range(20) for t in range(r.randint(1, 9))]
    rows += [(99, t, "user", "x") for t in range(60)] + [rows[0], rows[0], (3, None, "user", "no turn"), (None, 1, "assistant", "no id"), (None, None, None, None)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, part int")
    got = chat.formatted(df, run_turns=4).collect()
    assert len(got) == len(rows)
    whole = collections.defaultdict(list)
    for row in got:
        whole[row.conv_id].append(row)
    for turns in whole.values():
        turns.sort(key=lambda x: (x.part, x.place))
        text = "".join(x.rendered for x in turns)
        roles = [p.split("|>")[0] for p in text.split("<|")[1:] if not p.startswith("end")]
        if roles[0] == "system":
            roles = roles[1:]
        assert roles and roles == ["user", "assistant"] * (len(roles) // 2)
        assert text.count("<|end|>\n") == text.count("<|") - text.count("<|end|>") and text.endswith("<|end|>\n")
    assert chat.formatted(df.limit(0)).count() == 0


def vector_rows():
    r = np.random.default_rng(6)
    x = np.round(r.normal(0, 1, (1500, 8)), 2)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(2000 + k, x[0].tolist()) for k in range(300)]  # a hot vector
    odd = [(3000, None), (3100, [0.0] * 8), (3200, [1.0] * 7 + [None]), (3300, [1.0] * 7 + [float("nan")]), (3400, [1.0] * 7 + [float("inf")]),
           (3500, [1.0] * 9), (None, [1.0] * 8), (3600, []), (100, x[100].tolist())]
    return rows + odd


def test_nearest_vectors(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, key string").coalesce(2)
    got = collections.defaultdict(list)
    for r in vectors.search(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    used = {k: np.array(v) for k, v in rows if k is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    ids, x = np.array(list(used)), np.stack(list(used.values()))
    asked = [k for k in used if k % 100 == 0]
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        near = np.sqrt(((x - used[q]) ** 2).sum(axis=1))
        want = [int(ids[i]) for i in np.lexsort((ids, near)) if ids[i] != q][:10]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(np.linalg.norm(used[v] - used[q]) - s) < 1e-12 for _, v, s in found)
        hits += len(set(want) & {f[1] for f in found})
        if q in (0, 2000):
            assert [f[1] for f in found] == want
    assert hits >= 0.9 * 10 * len(asked)


def test_nearest_vectors_far_from_the_origin(spark):
    """An offset of 1e6 on all components and a spread of 0.01: squares of whole vectors would lose the distances."""
    x = 1e6 + 0.01 * np.random.default_rng(12).standard_normal((3000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(2)
    got = collections.defaultdict(set)
    for r in vectors.search(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 100):
        near = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        hits += len(got[q] & set([int(k) for k in np.lexsort((np.arange(3000), near)) if k != q][:10]))
    assert hits >= 0.9 * 300
    for offset in (0.0, 1e6, -1e9):
        points = x - 1e6 + offset
        for i, at, apart in vectors.nearest(points[:40], points, 11):
            exact = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
            want = np.flatnonzero(exact <= np.partition(exact, 10)[10])
            assert sorted(at) == want.tolist() and np.array_equal(apart, exact[at])


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 1.0])], schema)
    assert [(r.query_id, r["rank"], r.vec_id) for r in vectors.search(few, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert vectors.search(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    assert vectors.search(spark.createDataFrame([(0, None)], schema), F.col("vec_id") % 100 == 0).count() == 0
