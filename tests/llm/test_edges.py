"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from locusframe.llm import html_extract, mixing, near_dedup, packing, quality_classifier, quality_rules, secrets, token_counts, vector_search, warc
from locusframe.llm.queries import tokenizer_file

LONG = "word " * 60_000 + "é" * 3000
ROWS = [(1, "a b c", "s", 5), (1, "a b c", "s", 5), (None, None, None, None), (2, "", None, 0), (3, LONG, "s", len(LONG)), (4, None, "t", None), (None, "x y", "t", 3), (5, " \n\t ", "s", 4)]
#: Names that operators use inside, or return.
CLASHING = ["text_md5", "node", "bucket", "size", "n", "label", "score", "held_out", "key", "start", "n_tokens", "hash", "list", "cut", "rank", "__text", "n_words", "taken", "payload", "sha1", "id", "k1"]


@pytest.fixture(scope="module")
def docs(spark):
    t = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_chars long")
    return t.withColumns({c: F.lit(None).cast("string") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 0), (3, 0)], "doc_id long, quality int").withColumns({c: F.lit("x") for c in CLASHING})


OPERATORS = {
    "quality_scores": lambda d, l: quality_classifier.quality_scores(d, l),
    "token_counts": lambda d, l: token_counts.token_counts(d, tokenizer_file("byte_bpe_50k.json")),
    "near_duplicates": lambda d, l: near_dedup.near_duplicates(d),
    "mix": lambda d, l: mixing.mix(d),
    "quality_rules": lambda d, l: quality_rules.quality_rules(d, l),
    "scan_secrets": lambda d, l: secrets.scan_secrets(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row(docs, labels, name):
    rows = OPERATORS[name](docs, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    same = [r.asDict() for r in rows if r.doc_id == 1]
    if name != "mix":  # repeated rows are sampled one by one
        assert same[0] == same[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(docs, labels, name):
    assert OPERATORS[name](docs.where("false"), labels.where("false")).collect() == []
    assert OPERATORS[name](docs.where("false"), labels).collect() == []


def test_packing_of_odd_rows(docs):
    rows = packing.pack(docs, tokenizer_file("word_bpe_49k.json")).collect()
    ids = [r.doc_tokens for r in rows if r.start == 0]
    assert len(ids) == len(ROWS) and sorted(ids)[:4] == [1, 1, 1, 1]
    assert sum(r.length for r in rows) == sum(ids)
    assert packing.pack(docs.where("false"), tokenizer_file("word_bpe_49k.json")).collect() == []


def test_redaction_of_odd_rows(docs):
    from collections import Counter

    got = secrets.redact(docs)
    assert got.columns == docs.columns
    assert Counter(r.text for r in got.collect()) == Counter(r[1] for r in ROWS)


def test_copies_and_nulls_are_classes_by_text(docs):
    got = near_dedup.near_duplicates(docs)
    rows = {(r.doc_id, r.node): r for r in got.collect()}
    sizes = sorted(r.class_size for r in got.collect())
    assert sizes == [1, 1, 1, 2, 2, 3, 3, 3] and len(rows) == len(ROWS) - 1


PAGES = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, None, ""), (3, "v", "<article>" + "<p>long text.</p>" * 5000), (None, "w", "<p>a")]


def test_pages(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASHING})
    rows = html_extract.extract_main_text(pages).collect()
    assert len(rows) == len(PAGES) and {r.n_chars for r in rows if r.page_id == 3} == {5000 * 11 - 1}
    assert {r.text for r in rows if r.page_id == 2} == {""}
    assert html_extract.extract_main_text(pages.where("false")).collect() == []
    back = warc.round_trip(spark, pages).collect()
    assert len(back) == len(PAGES)
    assert warc.round_trip(spark, pages.where("false")).collect() == []


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [1.0, 2.0]), (1, None), (2, []), (3, [3.0, 4.0]), (4, [float("inf"), 1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in CLASHING})
    assert [(r.query_id, r.vec_id) for r in vector_search.nearest(t, F.col("vec_id") == 0).collect()] == [(0, 3)]
