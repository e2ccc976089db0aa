"""Operators on whole texts against brute force or the library itself."""

import collections
import itertools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import lm, near_dups, packing, pieces, quality, substrings
from tests.llm.conftest import edge_rows

WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fuzz(n=600, seed=9):
    r = random.Random(seed)
    alphabet = list("abcdefghiaaateo   \n\t.,'▁éß漢字\U0001f600́ \x00AB<>s/|&")
    fixed = ["", " ", "  ", "▁", " a", "a ", "  " * 40 + "x", "aaaa" * 50, "\n", "\n\n a", "İ ǅ", "hello  world " * 3, "<|endoftext|> don't"]
    return fixed + ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(n)]


def test_packing_places_every_token_once(edges):
    rows = packing.pack_documents(edges, WORD_MODEL, buffer_windows=4, step_windows=2).collect()
    tokenizer = Tokenizer.from_file(WORD_MODEL)
    want = collections.Counter()
    for row in edge_rows():
        want[row[0], tuple(tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [1])] += 1
    by_doc = collections.defaultdict(set)
    for doc, ids in want:
        by_doc[doc].add(ids)
    covered = collections.Counter()
    for r in rows:
        assert any(
            len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
            for ids in by_doc[r.doc_id]
        )
        covered[r.doc_id] += r.length
    total = collections.Counter()
    for (doc, ids), n in want.items():
        total[doc] += n * len(ids)
    assert covered == total
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    odd = 0
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        size = sum(p.length for p in parts)
        odd += size not in packing.TIERS
        assert size <= 2048 and len({p.step_group for p in parts}) == 1
    assert odd <= 2  # one open sequence per partition


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing, WORD_MODEL).count() == 0


def test_steps_are_balanced():
    packer = packing.Packer((256, 512, 1024, 2048), 0, 64, 4)
    r = random.Random(1)
    for k in range(400):
        n = r.randint(1, 3000)
        packer.add(k, b"\0\0\0\0" * n)
    cost = collections.Counter()
    for doc, start, length, _, _, _, _, _, group in packer.flush(last=True):
        cost[group] += length**2
    assert max(cost.values()) < 1.25 * min(cost.values())


def test_words_of_tokenizer():
    ours, theirs = packing.WordTokenizer(WORD_MODEL), Tokenizer.from_file(WORD_MODEL)
    for text, found in zip(fuzz(), ours.encode(fuzz())):
        assert np.frombuffer(found, dtype="<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_words_that_cut_in_doubt():
    """Letters whose lower case or normal form is no letter, digits beyond ASCII, signs, added tokens inside words."""
    ours, theirs = packing.WordTokenizer(WORD_MODEL), Tokenizer.from_file(WORD_MODEL)
    r = random.Random(8)
    letters = ["a", "Z", "\u00c9", "\u00df", "'", "'s", "\u2019", "1", "\u0663", "\u00bd", "!", "<|", "\u0308", "\ufb01", "\u0130", "\u017f", "\u212a",
               "\u212b", "\u4e2d", "\u2177", "\U0001f642", "_", "\x00", "don't", "</w>", ".", "-", "\u01c5", "\u00aa", "\u02b0", "\u093e", "\u0958", "\u0085"]
    words = list(dict.fromkeys("".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(1500)))
    found = ours.encode(words)
    for word, ids in zip(words, found):
        assert np.frombuffer(ids, dtype="<u4").tolist() == theirs.encode(word, add_special_tokens=False).ids, word


def test_pieces_are_the_librarys():
    ours, theirs = pieces.PieceModel(PIECE_MODEL), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for text in fuzz():
        ids = theirs.encode(text)
        assert ours.encode(text) == ids
        assert ours.decode(ids) == theirs.decode(ids)
    r = random.Random(2)
    for _ in range(400):
        ids = [r.choice([r.randrange(3, 32000), r.randrange(3, 259)]) for _ in range(r.randint(0, 8))]
        assert ours.decode(ids) == theirs.decode(ids)


def test_piece_digests(edges, nothing):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    want = collections.Counter()
    for row in edge_rows():
        ids = model.encode(row[1] or "")
        want[row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in pieces.encoding_digests(edges, PIECE_MODEL).collect()) == want
    back = pieces.decode_documents(pieces.encode_documents(edges, PIECE_MODEL), PIECE_MODEL)
    assert back.where("doc_id = 4").first().text == "one two three four"
    assert pieces.encoding_digests(nothing, PIECE_MODEL).count() == 0


def removed_by_brute_force(texts, window):
    split = [words(t) for t in texts]
    counts = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window, hot", [(35, 200_000), (8, 200_000), (8, 1)])
def test_repeated_passages(edges, monkeypatch, window, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    whole = substrings.shortened.__defaults__
    monkeypatch.setattr(substrings.shortened, "__defaults__", (whole[0], hot))
    rows = edge_rows()
    want = collections.Counter((r[0], *found) for r, found in zip(rows, removed_by_brute_force([r[1] for r in rows], window)))
    assert collections.Counter(tuple(r) for r in substrings.removal_digests(edges, window).collect()) == want


def test_repeated_passages_of_nothing(nothing):
    assert substrings.removal_digests(nothing).count() == 0


def test_equal_windows_start_super_kmers_with_one_minimiser():
    r = random.Random(3)
    text = [r.choice([b"a", b"b"]) for _ in range(300)]
    _, mini, first, n = substrings.super_kmers([text], 8, 4)
    assert n.sum() == 300 - 8 + 1 and (np.cumsum(n) - n == first).all()
    of = np.repeat(mini, n)
    found = {}
    for i in range(293):
        assert found.setdefault(tuple(text[i : i + 8]), of[i]) == of[i]


def shingles(text):
    w = words(text)
    k = min(5, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else collections.Counter()


def classes_by_brute_force(rows, threshold=0.8):
    bags = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if both and both / either >= threshold:
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i in range(len(rows)):
        ids[find(i)].append(rows[i][0])
    return collections.Counter(
        (rows[i][0], min((x for x in ids[find(i)] if x is not None), default=None), len(ids[find(i)])) for i in range(len(rows))
    )


@pytest.mark.parametrize("bits", [20, 2])
def test_near_duplicate_classes(spark, edges, monkeypatch, bits):
    """Also with a frequency table so small that it tells shingles hardly apart."""
    monkeypatch.setattr(near_dups, "FREQUENCY_BITS", bits)
    r = random.Random(8)
    rows = edge_rows()
    for group in range(4):  # chains and rings around the threshold
        text = [f"g{group}w{r.randrange(400)}" for _ in range(150)]
        for k in range(12):
            copy = list(text)
            for _ in range(r.randint(0, 7)):
                copy[r.randrange(150)] = f"new{r.randrange(10**6)}"
            rows.append((1000 + 20 * group + k, " ".join(copy), *[None] * 8))
    docs = spark.createDataFrame(rows, edges.schema).coalesce(2)
    got = collections.Counter((x.doc_id, x.class_id, x.class_rows) for x in near_dups.near_duplicates(docs).collect())
    assert got == classes_by_brute_force(rows)


def test_one_of_each_class_stays(edges, nothing):
    kept = near_dups.one_of_each(edges)
    assert kept.columns == edges.columns
    rows = kept.collect()
    wordless = [r for r in edge_rows() if not words(r[1])]
    heads = {c for _, c, _ in classes_by_brute_force([r for r in edge_rows() if words(r[1])])}
    assert len(rows) == len(wordless) + len(heads) or len(rows) == len(wordless) + len(heads) + 1  # id 12 heads two classes
    assert near_dups.one_of_each(nothing).count() == 0


def test_bag_minhash_is_unbiased():
    r = np.random.default_rng(5)
    elements = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = r.integers(1, 9, 60), r.integers(1, 9, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    signature = near_dups.bag_minhash(np.concatenate([elements, elements]), np.concatenate([a, b]), np.repeat([0, 1], 60), 2, 8192)
    assert abs((signature[0] == signature[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 8192)


def test_rule_statistics(edges):
    for row, found in zip(edge_rows(), zip(*quality.statistics_of([r[1] for r in edge_rows()]).values())):
        text, w = row[1] or "", words(row[1])
        counts = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if counts[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, repeated = set(), 0
        for line in text.split("\n"):
            if words(line):
                repeated += line in seen
                seen.add(line)
        assert found[:5] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in "".join(w)), repeated, len(covered))


def test_quality_keeps_good_and_drops_anomalies(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.quality_verdicts(docs, labels).join(labels, "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    good = [r.kept for r in judged if r.quality == 1]
    bad = [r.kept for r in judged if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(9, 1, 0), (9, 1, 0), (10, 0, 0), (10, 1, 0), (None, 1, 0), (11, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.quality_verdicts(edges, labels).collect()
    assert len(rows) == len(edge_rows())
    assert all(r.kept == (not r.base_failed) for r in rows)  # nothing to calibrate with
    assert quality.kept_documents(edges, labels).columns == edges.columns
    assert quality.kept_documents(nothing, labels.limit(0)).count() == 0


def test_the_fit_uses_every_labelled_row(spark):
    """Far more labelled rows than trees of 256 can hold: all are counted, each is in a tree, and the cut-off keeps its share of all good ones."""
    docs = spark.range(60_000).selectExpr(
        "id AS doc_id", "array_join(transform(sequence(1, 60), x -> concat('w', pmod(xxhash64(id, x), 5000), if(id % 40 = 0, '#', ''))), ' ') AS text"
    )
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 40 > 0 AS INT) AS quality")
    forest, last = quality.fitted(quality.rule_statistics(docs), labels)
    good, bad = 58_500, 1_500
    of_good, of_bad, size = quality.copies(good, bad)
    assert of_good >= 1 and of_bad >= 1 and len(forest.feature) == quality.TREES and size >= 256
    judged = quality.quality_verdicts(docs, labels).groupBy((F.col("doc_id") % 40 > 0).alias("good")).agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()
    kept = {r.good: r.kept for r in judged}
    assert kept[True] >= 0.998 * good - 1 and kept[False] <= 0.75 * bad


def test_rows_are_dealt_to_trees():
    for good, bad in [(1, 1), (3, 400), (3409, 571), (50_000, 20_000), (5_000_000, 900_000), (10, 1_000_000)]:
        of_good, of_bad, size = quality.copies(good, bad)
        assert 1 <= of_good <= quality.TREES and 1 <= of_bad <= quality.TREES
        assert good * of_good >= min(good, 256) * quality.TREES


def test_isolation_forest_finds_outliers():
    r = np.random.default_rng(1)
    rows = np.vstack([r.normal(0, 1, (500, 4)), r.normal(9, 1, (10, 4))])
    score = quality.IsolationForest(rows).score(rows)
    assert score[500:].min() > np.quantile(score[:500], 0.99)


def test_language_model_scores(edges, nothing):
    rows = edge_rows()
    tokens = [(r[1] or "").encode().lower().split() + [None] for r in rows]
    training = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 != 2 for r in rows]
    counts = collections.Counter(t for ts, use in zip(tokens, training) if use for t in ts)
    n = sum(counts.values())
    got = lm.scores(edges, head_size=20).collect()
    want = collections.Counter(
        (r[0], not use, len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 1) / (n + len(counts) + 1)) for t in ts), 4))
        for r, ts, use in zip(rows, tokens, training)
    )
    assert collections.Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 4)) for g in got) == want
    assert all(g.score <= 0 and math.isfinite(g.score) for g in got)
    assert lm.scores(nothing).count() == 0


def test_probabilities_sum_to_one_and_training_helps():
    r = np.random.default_rng(3)
    following = r.permutation(20)
    classes = [0]
    for _ in range(20_000):
        classes.append(int(following[classes[-1]]) if r.random() < 0.9 else int(r.integers(20)))
    classes = np.array(classes)
    model = lm.Model(np.bincount(classes, minlength=21).astype(float))
    contexts = lm.contexts_of(classes, np.array([len(classes)]), model.classes)
    before = model.log_probabilities(contexts, classes).mean()
    for _ in range(3):
        model.learn(contexts, classes, r)
    assert model.log_probabilities(contexts, classes).mean() > before + 0.5
    every = np.arange(21)
    for k in (1, 50, 900):
        assert abs(np.exp(model.log_probabilities(np.repeat(contexts[k : k + 1], 21, axis=0), every)).sum() - 1) < 1e-4


def test_language_model_tells_rare_tokens_apart(spark, monkeypatch):
    """Word pairs beyond the 512 most frequent tokens: own head tokens, and hashed ones of a short head."""
    r = random.Random(6)
    filler = [f"filler{k}" for k in range(600)]
    pairs = [(f"left{k}", f"right{k}") for k in range(24)]
    train = (k for k in itertools.count() if not lm.is_held_out(k))
    held = (k for k in itertools.count() if lm.is_held_out(k))
    rows = [(next(train), " ".join(r.sample(filler, 600))) for _ in range(600)]
    rows += [(next(train), " ".join(w for p in r.sample(pairs, 24) for w in p)) for _ in range(500)]
    r.shuffle(rows)
    matched = [(next(held), " ".join(p)) for p in pairs]
    crossed = [(next(held), f"{pairs[k][0]} {pairs[(k + 7) % 24][1]}") for k in range(24)]
    docs = spark.createDataFrame(rows + matched + crossed, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(lm, "REST_PER_CLASS", 1)
    for head_size in (lm.HEAD, 610):
        score = {g.doc_id: g.score for g in lm.scores(docs, head_size=head_size).collect()}
        assert sum(score[k] for k, _ in matched) > sum(score[k] for k, _ in crossed) + 1


def test_every_class_has_rows_and_a_share():
    """Three levels of a tree: probabilities sum to one, and rows grow with the distinct tokens."""
    counts = np.arange(3000, 0, -1)
    model = lm.Model(counts)
    assert len(model.context) == 3001 and model.level_sizes[2] == 3000 - model.short
    r = np.random.default_rng(2)
    classes = r.integers(0, 3000, 20_000)
    contexts = lm.contexts_of(classes, np.array([len(classes)]), model.classes)
    model.learn(contexts, classes, r)
    every = np.arange(3000)
    for k in (0, 1, 77):
        assert abs(np.exp(model.log_probabilities(np.repeat(contexts[k : k + 1], 3000, axis=0), every)).sum() - 1) < 1e-4
    again = lm.Model(counts)
    rows, _, values = model.used_rows()
    again.load(rows, values)
    assert all((a == b).all() for a, b in zip(again.parameters(), model.parameters()))
    assert lm.Head([b"a"], [5], 10_000).shared > lm.Head([b"a"], [5], 1_000).shared > 1


def join_rows(df):
    """Rows that each join of ``df`` makes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")  # planned again
        df.collect()
        todo, rows = [df._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            todo += [node.children().apply(k) for k in range(node.children().size())]
            if "Join" in node.nodeName():
                rows.append(node.metrics().apply("numOutputRows").value())
        return rows
    finally:
        conf.set("spark.sql.adaptive.enabled", "true")


def prefix_members(spark, texts):
    held = spark.createDataFrame([(near_dups.text_key(w), b" ".join(w)) for w in texts], "node binary, words binary")
    return near_dups.prefix_shingles(held, 0.8).withColumn("label", F.col("node"))


def test_a_passage_that_many_texts_share_makes_no_pairs(spark):
    """Texts below the threshold that share 80 of 96 shingles meet at no row of the join."""
    passage = [b"p%d" % k for k in range(84)]
    members = prefix_members(spark, [[b"own%d-%d" % (t, k) for k in range(16)] + passage for t in range(60)]).cache()
    assert members.groupBy("shingle").count().agg(F.max("count")).first()[0] == 60  # the passage is in all prefixes
    pairs = near_dups.cross_pairs(members, ["shingle"], 0.8)
    assert pairs.count() == 0
    assert max(join_rows(pairs)) <= members.count()


def test_cross_pairs_lose_no_pair_at_the_threshold(spark):
    """Repeated shingles, sizes apart by up to the threshold, copies shortened and changed."""
    r = random.Random(21)
    texts = []
    for group in range(8):
        text = [b"g%dw%d" % (group, r.randrange(60)) for _ in range(r.choice([7, 40, 120]))]
        for _ in range(14):
            copy = text[: len(text) - r.randrange(1 + len(text) // 10)]
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = b"new%d" % r.randrange(10**6)
            texts.append(copy + copy[: r.choice([0, 0, 0, 9])])
    texts = list({near_dups.text_key(t): t for t in texts}.values())
    bags = {near_dups.text_key(t): near_dups.shingles_of(t) for t in texts}
    alike = {(u, v) for u in bags for v in bags if u < v and near_dups.weighted_jaccard(bags[u], bags[v]) >= 0.8}
    members = prefix_members(spark, texts)
    got = {(bytes(x.u), bytes(x.v)) for x in near_dups.cross_pairs(members, ["shingle"], 0.8).collect()}
    assert len(alike) > 50 and alike <= got
