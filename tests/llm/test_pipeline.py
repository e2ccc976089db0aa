"""The pipeline's stages in a row, and its entry."""

import corpus_pipeline
from tests.llm.test_texts import removed_by_brute_force, shingles, words


def test_stages_on_the_small_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    quality, near, repeats, pack = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, folder)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    rows = kept.collect()
    one = near(spark, kept, folder)
    left = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == docs.columns
    bags = {r.doc_id: shingles(r.text) for r in rows}
    for r in rows:  # whoever went is near to an earlier document, directly or through others; no two that stay are near
        if r.doc_id not in left:
            assert any(
                sum((bags[r.doc_id] & bags[o]).values()) >= 0.8 * sum((bags[r.doc_id] | bags[o]).values()) for o in bags if o != r.doc_id
            )
    ids = sorted(left)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            assert not bags[a] or sum((bags[a] & bags[b]).values()) < 0.8 * sum((bags[a] | bags[b]).values())
    short = {r.doc_id: r.text for r in repeats(spark, one, folder).collect()}
    for doc, (n, gone, _) in zip(left, removed_by_brute_force(list(left.values()), 35)):
        assert len(words(short[doc])) == n - gone
    pieces = pack(spark, spark.createDataFrame(list(short.items()), "doc_id long, text string"), folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(short)


def test_edges_pass_every_stage(spark, edges, nothing, folder):
    for docs in (edges, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        assert docs.count() >= 0


def test_entry_registers_the_operators():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
