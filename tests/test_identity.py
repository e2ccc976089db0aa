"""Identity: records with outcomes decided by hand; the SQL twins compare every pair."""

import itertools
import random
from difflib import SequenceMatcher
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.catalog import QUERIES
from shelfmark.functions import normalise as N
from shelfmark.operators import identity


LEFT = [
    (1, "On the Nature of Virtue", "Ann Lee", None),
    (2, "Être et temps: une étude", "Reid, Anna", "10.1000/a"),
    (3, "Knowledge, belief and doubt", "A. Reid", None),
    (4, "Short", None, None),
    (5, "Truth and method in history", "Lee", "10.1000/b"),
    (6, "", "Ann Lee", None),
    (7, "The moral life of cities", "Lee, A.", "10.1000/c"),
    (8, "Virtue", "王 明", None),
]
RIGHT = [
    (11, "On the nature of virtue", "Lee, Ann", None),
    (12, "Etre et temps — une etude", "Anna Reid", None),
    (13, "Knowledge, belief, and doubt revisited", "Alice Reid", None),
    (14, "Short", "Bob", None),
    (15, "Truth & Method in History", "Cy Lee", None),
    (16, "Other words here entirely", "Zed", "10.1000/b"),
    (17, "The moral life of city", "Ann Lee", "10.1000/c"),
    (18, "真理与方法", "Ann Lee", None),
    (19, "On the nature of vice", "Ann Lee", None),
    (20, "Method in history and truth", "Bo Lee", None),
    (21, "On the nature of virtue", "Zoe Lee", None),
]
SCHEMA = "record_id long, title string, author string, doi string"


# equivalent and review-required records on the right, and the least equivalent one:
# 1: 11 has title and author; 18 is in another script by the author; 21 has the title by another Lee
# 2: 12 has the folded title by the same author      3: 13 holds 26 of 31 characters, not 92 in 100
# 4: 14 has the title, no author speaks against it   6: no title   8: no title or author in common
# 5: "Lee" may be any Lee: 15 has the title, 20 its words; 18 is in another script; 16 has the DOI by another author
# 7: 17 has the DOI by the author; 18 is in another script by the author
EXPECTED = {
    1: (1, 2, 11), 2: (1, 0, 12), 3: (0, 1, None), 4: (1, 0, 14), 5: (2, 2, 15), 6: (0, 0, None), 7: (1, 1, 17), 8: (0, 0, None),
}


def blocked(spark, left, right):
    a, b = (identity.identities(spark.createDataFrame(rows, SCHEMA)) for rows in (left, right))
    return {r.record_id: (r.n_equivalent, r.n_review, r.match_id) for r in identity.identity_counts(a, b).collect()}


def test_counts_are_those_decided_by_hand(spark):
    assert blocked(spark, LEFT, RIGHT) == EXPECTED


def test_chunks_of_an_author_lose_no_pair(spark, folder, monkeypatch):
    from checks.identity_checks import sides
    from checks.views import Tables

    left, right = sides(Tables(spark, folder))
    whole = sorted(map(tuple, identity.near_pairs(left, right).collect()))
    monkeypatch.setattr(identity, "BLOCK_ROWS", 3)
    assert sorted(map(tuple, identity.near_pairs(left, right).collect())) == whole and whole


def test_small_blocks_are_judged_as_large_ones(spark, folder, monkeypatch):
    from checks.identity_checks import sides
    from checks.views import Tables

    right = identity.identities(spark.createDataFrame(RIGHT, SCHEMA))
    pairs = [sides(Tables(spark, folder)), (identity.identities(spark.createDataFrame(LEFT, SCHEMA)), right), (right, right)]
    for left, right in pairs:
        found = []
        for few in (0, identity.FEW_PAIRS, 10**9):
            monkeypatch.setattr(identity, "FEW_PAIRS", few)
            found.append(sorted(map(tuple, identity.near_pairs(left, right).collect())))
            monkeypatch.undo()
        assert found[0] and found[0] == found[1] == found[2]


def test_copies_are_asked_once(spark, monkeypatch):
    """Left records of one profile and DOI are one row of the exact routes."""
    copies = spark.createDataFrame([(k, "Some title here", "Ann Lee", d) for k, d in enumerate(["10.1/a", "10.1/a", "10.1/b", None, None])], SCHEMA)
    seen, exact = [], identity.exact_matches
    monkeypatch.setattr(identity, "exact_matches", lambda left, right: seen.append(left.count()) or exact(left, right))
    records = identity.identities(copies)
    out = {r.record_id: (r.n_equivalent, r.n_review, r.match_id) for r in identity.identity_counts(records, records).collect()}
    assert seen == [3] and out == {k: (5, 0, 0) for k in range(5)}


def test_one_title_and_author_for_most_rows(spark):
    """A third of all rows share one profile: counts stay exact and no pairs appear."""
    left = spark.range(3000).select(
        F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, "Book reviews").otherwise(F.concat(F.lit("Unique title number "), "id")).alias("title"),
        F.when(F.col("id") % 3 == 0, "Ann Lee").otherwise(F.concat(F.lit("Author X"), "id")).alias("author"), F.lit(None).cast("string").alias("doi"),
    )
    right = left.withColumn("record_id", F.col("record_id") + 100_000)
    a, b = identity.identities(left), identity.identities(right)
    assert identity.near_pairs(a, b).count() == 0
    out = identity.pick_unique(identity.identity_counts(a, b)).groupBy("n_equivalent", "outcome").count().collect()
    assert {(r.n_equivalent, r.outcome, r["count"]) for r in out} == {(1000, "ambiguous", 1000), (1, "accepted", 2000)}


@pytest.mark.parametrize("name,surname,initial", [
    ("Lee, Ann", "lee", "a"), ("Ann van Lee", "lee", "a"), ("van Lee, Ann", "lee", "a"), ("Lee", "lee", ""), ("Ümit Öz", "oz", "u"), ("Wang，Wei", "wang", "w"),
])
def test_author_keys(spark, name, surname, initial):
    row = spark.createDataFrame([(name,)], "n string").select(N.author_keys(F.col("n")).alias("k")).first().k
    assert (row.surname, row.initial) == (surname, initial)


@pytest.mark.parametrize("text,norm,fold", [
    ("Straße & Co_x*", "strasse and co x", "strasse and co x"), ("ﬁne ÀÉÎ", "fine àéî", "fine aei"),
    ("Ｆｕｌｌ width", "full width", "full width"), ("İstanbul", "i stanbul", "istanbul"), ("naïve—dash", "naïve dash", "naive dash"),
])
def test_folds_follow_unicode(spark, text, norm, fold):
    row = spark.createDataFrame([(text,)], "v string").select(
        N.title_norm(F.col("v")).alias("norm"), N.title_fold(F.col("v")).alias("fold")
    ).first()
    assert (row.norm, row.fold) == (norm, fold)


def test_bounds_and_classes_of_the_sequence_ratio():
    """No pair is lost to the bound in order, over one and several words of bits, and each floor is decided as by the full ratio."""
    r = random.Random(3)
    texts = ["", "a", "é" * 70, "ab" * 64, "abc" * 50]
    texts += ["".join(r.choices("abcde é", k=r.choice([3, 20, 63, 64, 65, 130]))) for _ in range(40)]
    texts += [t[: len(t) // 2] + "x" + t[len(t) // 2 :] for t in texts[5:25]]
    bound = identity._in_order_bound(texts, texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            matcher = SequenceMatcher(None, a, b, autojunk=False)
            ratio = matcher.ratio()
            if not a and not b:
                continue
            assert ratio <= bound[i, j] <= identity._ratio_bound([a], [b])[0, 0]
            for floors in ((0.92,), (0.92, 0.65)):
                found = identity._ratio_class(matcher, bound[i, j], floors)
                assert [found >= f for f in floors] == [ratio >= f for f in floors]


def test_few_pairs_are_compared_in_full(monkeypatch):
    """Titles of the same letters in other orders: the bound in order leaves few of them to the matcher."""
    words = "large small hot cold standard economy".split()
    titles = [" ".join(p) for p in itertools.permutations(words, 4)][:200]
    frame = pd.DataFrame({"profile": titles, "title_fold": titles, "name_words": "a x", "surname": "x", "initial": "a", "route": "surname"})
    frame["scripts"], frame["tokens"] = [["latin"]] * len(titles), [[str(k), "p", str(-k)] for k in range(len(titles))]
    seen = []
    class Counted(SequenceMatcher):
        def set_seq1(self, a):
            seen.append(a)
            super().set_seq1(a)
    monkeypatch.setattr(identity, "SequenceMatcher", Counted)
    got = identity._judge_block(frame, frame)
    want = {(a, b) for a in titles for b in titles if a != b and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.65}
    assert set(zip(got["left_profile"], got["right_profile"])) == want
    assert len(seen) < 0.75 * len(titles) ** 2 and len(seen) < 2 * len(want)


def test_folding_is_dealt_to_all_tasks(spark):
    one_file = spark.range(50).select(F.col("id").alias("record_id"), F.lit("A title").alias("title"), F.lit("A Name").alias("author"), F.lit(None).cast("string").alias("doi")).coalesce(1)
    assert identity.identities(one_file).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_doi_lookup_folds_no_title(spark, folder, monkeypatch):
    def folded(*_):
        raise AssertionError("titles are folded")

    monkeypatch.setattr(identity, "identities", folded)
    assert QUERIES["d08_doi_lookup"](spark, folder).count() > 0


def test_dedupe_writes_its_works_once_for_both_counts(spark, monkeypatch):
    written, real = [], identity.cut
    monkeypatch.setattr(identity, "cut", lambda table: written.append(table.columns) or real(table))
    works = identity.identities(spark.createDataFrame([(1, "On virtue", "Ann Lee", None), (2, "On virtue", "Lee, A.", None)], "record_id long, title string, author string, doi string"))
    found = identity.dedupe_decisions(works.withColumns({"source_id": F.lit(None).cast("string"), "work_type": F.lit("article")}))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 1), (2, 0, 1)]
    assert len(written) == 1 and "title" not in written[0]


def test_pairs_of_a_block_are_matched_together(monkeypatch):
    """Values of many pairs lie on the same side of both floors as their ratios; only very long pairs are matched one by one."""
    r = random.Random(5)
    texts = ["a", "ab" * 64, "é" * 70, "x y", "\U0001f600 and ab"]
    texts += ["".join(r.choices("abc é", k=r.choice([1, 3, 15, 16, 17, 40, 63, 64, 65, 130]))) for _ in range(40)]
    texts += [t[: len(t) // 2] + "xb" + t[len(t) // 2 :] for t in texts[5:40]] + [" ".join(reversed(t.split())) or "b" for t in texts[5:20]]
    rows, columns = (v.ravel() for v in np.indices((len(texts), len(texts))))
    bound = identity._in_order_bound(texts, texts)[rows, columns]
    wanted = np.array([SequenceMatcher(None, texts[i], texts[j], autojunk=False).ratio() for i, j in zip(rows, columns)])
    def single(*_):
        raise AssertionError("matched one by one")
    for long in (identity.LONG_PAIR, 300):
        with monkeypatch.context() as m:
            m.setattr(identity, "LONG_PAIR", long)
            if long > 300:
                m.setattr(identity, "_ratio_class", single)
            for low in (0.65, 0.92):
                found = identity._sequence_classes(texts, texts, rows, columns, bound, np.full(len(rows), low))
                for floor in (0.92, low):
                    assert ((found >= floor) == (wanted >= floor)).all()


def profiles(spark, rows):
    """Identity rows ``record_id, doi, title, words, surname, initial, scripts`` as :func:`identity.identities` gives them."""
    shape = "record_id long, doi string, title_fold string, name_words string, surname string, initial string, scripts array<string>"
    table = spark.createDataFrame(rows, shape)
    return table.withColumn("profile", F.sha2(F.concat_ws("|", "title_fold", "name_words", "surname", "initial", F.array_join("scripts", ",")), 256))


def similar(start, titles=30):
    """Records of one author with much alike titles, some with DOIs, copies and a second surname or script."""
    rows = [
        (start + k, f"10.1/{k % 3}" if k % 2 else None, f"long study of virtue and method part {k % titles} of many", "ann lee", "lee", "a" if k % 4 else "", ["latin"])
        for k in range(2 * titles)
    ]
    rows += [(start + 500 + k, "10.1/1", f"long study of virtue and method part {k} of more", "ann lee", "ann" if k % 2 else "lee", "a", ["latin"]) for k in range(6)]
    return rows + [(start + 600 + k, None, f"long study of virtue and method part {k} of more", "ann lee", "lee", "a", ["greek"]) for k in range(6)]


@pytest.mark.parametrize("few", [0, 64])
def test_near_records_are_added_up_where_pairs_are_judged(spark, monkeypatch, few):
    """The counts are those of the pairs, but no row is written per pair without a DOI on both sides."""
    monkeypatch.setattr(identity, "FEW_PAIRS", few)
    monkeypatch.setattr(identity, "BLOCK_ROWS", 20)
    left, right = identity.cut(profiles(spark, similar(0))), identity.cut(profiles(spark, similar(10_000)))
    near = identity.cut(identity.near_pairs(left, right))
    by_pairs = sorted(map(tuple, identity.identity_counts(left, right, near).collect()))
    assert sorted(map(tuple, identity.identity_counts(left, right).collect())) == by_pairs
    assert max(r[1] for r in by_pairs) > 20 and max(r[2] for r in by_pairs) > 0
    bare = right.withColumn("doi", F.lit(None).cast("string"))
    assert identity.near_counts(left, bare).filter("right_profile IS NOT NULL").count() == 0
    if not few:
        # a row per left profile and cell: one in ten pairs at most
        assert 10 * identity.near_counts(left, bare).count() < near.count()


def test_words_under_one_surname_are_left_to_the_surname_route(spark, monkeypatch):
    monkeypatch.setattr(identity, "FEW_PAIRS", 0)
    one = [row for row in similar(0) if row[4] == "lee"]
    for rows, routes in ((one, {"surname"}), (similar(0), {"surname", "words"})):
        table = profiles(spark, rows)
        cells = identity._near(table, table, ["profile"])[1]
        assert {r.route for r in cells.agg(F.count("*")).select("route").collect()} == routes


def test_names_that_profiles_share_are_told_once(spark):
    """Names under two surnames or scripts meet pairs twice; each is one row, and no other pair is lost."""
    left, right = profiles(spark, similar(0, 8)), profiles(spark, similar(10_000, 8))
    facts = ("title_fold", "name_words", "initial")
    every = sorted(map(tuple, identity.near_pairs(left, right, facts).collect()))
    named = sorted(map(tuple, identity.near_names(left, right).collect()))
    assert named == sorted(set(every)) and len(named) < len(every)
