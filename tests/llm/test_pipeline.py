"""Each stage of the pipeline against what it should keep."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from locusframe.llm.secrets import BASE
from tests.llm.test_corpus_operators import brute_base, brute_classes

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    for t in tables[1:-1]:
        assert t.columns == COLUMNS
    given = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in tables[1].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = Counter((labels[k], k in good) for k in given if k in labels)
    assert right[1, False] == 0 and right[0, True] <= 0.1 * max(1, right[0, False])
    # near-duplicates: one of each class stays, the first
    kept = sorted(good)
    classes = brute_classes([given[k].text for k in kept])
    assert sorted(r.doc_id for r in tables[2].collect()) == sorted(kept[c] for c in set(classes))
    # secrets: the same rows, no base span left, other texts as they were
    clean = {r.doc_id: r for r in tables[3].collect()}
    assert set(clean) == {r.doc_id for r in tables[2].collect()}
    for k, r in clean.items():
        assert brute_base(r.text) == [] and r.n_chars == len(r.text)
        if not brute_base(given[k].text) and "[SECRET]" not in r.text:
            assert r.text == given[k].text
    # the mix: at most two copies, and half as many words again
    mixed = tables[4].collect()
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    words = lambda t: len(t.split())
    whole, taken = sum(words(r.text) for r in clean.values()), sum(words(r.text) for r in mixed)
    assert abs(taken - 1.5 * whole) <= 0.1 * whole
    # packing: each mixed row whole
    pieces, lengths = tables[5].collect(), defaultdict(int)
    for r in pieces:
        lengths[r.doc_id] += r.length
    copies = Counter(r.doc_id for r in mixed)
    assert all(lengths[r.doc_id] == copies[r.doc_id] * r.doc_tokens for r in pieces) and set(lengths) == set(copies)
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)
    assert len(BASE) == 3


def test_nulls_and_an_empty_table(spark, sf):
    rows = [(1, "word " * 60, "en", "s", 300), (1, "word " * 60, "en", "s", 300), (None, None, None, None, None), (None, "other " * 60, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.where("false"), sf).collect()
        stage(spark, docs, sf).collect()
    assert corpus_pipeline.drop_near_duplicates(spark, docs, sf).count() == 3
