"""Token counts, packing, quality rules, classifier: against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusframe.llm import packing, quality_classifier, quality_rules, textcore, token_counts
from locusframe.llm.queries import QUERIES, tokenizer_file

tokenizers = pytest.importorskip("tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALPHABET = "ab cdé'sstrevelmdAB  \n\t 　日本1234!?.,-_😀́ÀßΣσς<|>"
EDGE = ["", " ", "\n\n", "a", "don't we've I'll they're he'd I'm '' 's ''s 'sss !'s  's\n's", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c<|endoft", "a" * 5000, " " * 3000 + "x", "\n\n\n a", "á ́b 1a2 a!b"]


def some_texts(n, seed=1):
    r = random.Random(seed)
    return EDGE + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 80))) for _ in range(n)]


def one_slice(texts):
    return list(textcore.slices(pa.array(texts, pa.string())))


@given(st.lists(st.text(max_size=40), max_size=12), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_words_and_slices_match_the_pattern(texts, most):
    got = []
    for s in textcore.slices(pa.array(texts, pa.string()), most):
        starts, ends = textcore.words(s)
        woffs = textcore.word_offsets(starts, s.offs)
        got += [[bytes(s.data[a:b]).decode() for a, b in zip(starts[woffs[i] : woffs[i + 1]], ends[woffs[i] : woffs[i + 1]], strict=True)] for i in range(len(s))]
    assert got == [WORDS.findall(t) for t in texts]


def test_hashes_depend_on_the_bytes_only():
    s = one_slice(["aa bb aa", "bb aa", ""])[0]
    starts, ends = textcore.words(s)
    h = textcore.span_hash(textcore.prefix_hash(s.data), starts, ends)
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]


def test_token_counts_match_the_library():
    path = tokenizer_file("byte_bpe_50k.json")
    library, machine = tokenizers.Tokenizer.from_file(path), token_counts.transducer(path)
    texts = some_texts(3000)
    got = np.concatenate([token_counts.count_slice(s, machine) for s in one_slice(texts)])
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_transducer_begun_anew_counts_the_same():
    path = tokenizer_file("byte_bpe_50k.json")
    machine = token_counts.BpeTransducer(token_counts.Vocabulary(path), max_states=50)
    texts = some_texts(200, 2)
    got = np.concatenate([token_counts.count_slice(s, machine) for t in texts for s in one_slice([t])])
    whole = token_counts.transducer(path)
    assert got.tolist() == np.concatenate([token_counts.count_slice(s, whole) for s in one_slice(texts)]).tolist()


def test_prefix_scan_of_state_maps_is_composition():
    rng = np.random.default_rng(3)
    to, _ = token_counts.pre_tables()
    symbols = rng.integers(0, 44, (13, 7)).astype(np.uint8)
    scanned = token_counts.scan(token_counts.chunk_maps(symbols, to))
    for start in range(8):
        state = start
        for i, row in enumerate(symbols):
            for x in row:
                state = int(to[int(x) * 8 + state])
            assert scanned[i, start] == state


def test_packing_ids_match_the_library():
    path = tokenizer_file("word_bpe_49k.json")
    library, words = tokenizers.Tokenizer.from_file(path), packing.word_tokenizer(path)
    texts = some_texts(3000, 4)
    got = []
    for s in one_slice(texts):
        ids, offs = words.encode(s)
        got += [ids[offs[i] : offs[i + 1]].tolist() for i in range(len(s))]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), max_size=60), st.integers(1, 64), st.integers(1, 6), st.integers(1, 64))
@settings(max_examples=80, deadline=None)
def test_packer_keeps_every_id_and_every_limit(items, capacity, segments, loss):
    p, pieces = packing.Packer(capacity, segments, loss), []
    for doc, (length, first) in enumerate(items):
        pieces += list(p.add(doc, length, first))
    pieces += list(p.finish())
    seen, sequences = defaultdict(list), defaultdict(list)
    for doc, start, size, sequence, offset in pieces:
        assert size > 0
        seen[doc].append((start, size))
        sequences[sequence].append((offset, size, max(0, start + size - max(start, items[doc][1]))))
    for doc, (length, _) in enumerate(items):
        at = 0
        for start, size in sorted(seen[doc]):
            assert start == at
            at += size
        assert at == length
    for rows in sequences.values():
        at = 0
        for offset, size, _ in sorted(rows):
            assert offset == at
            at += size
        assert at <= capacity and len(rows) <= segments and sum(r[2] for r in rows) <= loss


def test_packing_query_round_trip(spark, sf):
    library = tokenizers.Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op3_packing"](spark, sf).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for k, text in docs.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sizes = [sum(r.length for r in rows) for rows in by_sequence.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert max(sizes) <= 2048 and padding <= 0.01 * sum(sizes)


def brute_statistics(text):
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    wins = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
    }


@given(st.lists(st.text(alphabet="ab \n#é|\t", max_size=60), max_size=8))
@settings(max_examples=80, deadline=None)
def test_rule_statistics_match_brute_force(texts):
    got = [quality_rules.rule_statistics(s) for s in textcore.slices(pa.array(texts, pa.string()), 50)]
    for name in quality_rules.COUNTS:
        assert [int(v) for part in got for v in part[name]] == [brute_statistics(t)[name] for t in texts]


def test_isolation_forest_isolates_outliers():
    rng = np.random.default_rng(7)
    good = rng.normal(0, 1, (500, 3))
    forest = quality_rules.grow_forest(good, seed=3)
    assert forest.score(np.full((1, 3), 8.0))[0] > np.quantile(forest.score(good), 0.99)
    assert quality_rules.calibrate(np.array([0.3, 0.35, 0.4, 0.6, 0.7]), np.array([True, True, True, False, False])) == pytest.approx(0.5, abs=0.11)


def test_quality_rules_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op9_quality_rules"](spark, sf).collect()
    assert len(rows) == len(docs)
    right = Counter()
    for r in rows:
        want = brute_statistics(docs[r.doc_id])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.base_failed == failed and not (failed and r.kept)
        if not failed and r.doc_id in labels:
            right[labels[r.doc_id], r.kept] += 1
    assert right[1, False] <= 0.03 * max(1, right[1, True] + right[1, False])
    assert right[0, True] <= 0.3 * max(1, right[0, True] + right[0, False])


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    t = QUERIES["op1_quality_classifier"](spark, sf)
    rows = t.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95


def test_classifier_without_labels_and_on_odd_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (None, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.held_out, r.score) for r in quality_classifier.quality_scores(docs, labels).collect()}
    assert got[2][1] == got[3][1] == 0.0 and got[1][1] == got[None][1] == 0.5 and got[None][0] is False


def test_labelled_sample_is_bounded_and_skips_contradictions(spark):
    from locusframe.llm.labelled import labelled_sample

    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    labels = labels.union(spark.createDataFrame([(0, 1), (None, 1), (3, None)], "doc_id long, quality int"))
    got = labelled_sample(docs, labels, 10).collect()
    assert Counter(r.label for r in got) == {0: 10, 1: 10} and "t0" not in {r.text for r in got}
