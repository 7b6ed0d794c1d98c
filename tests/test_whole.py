"""The whole genotype set: every part a marker, every line item in its own part."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from locusframe.plans import all_queries
from locusframe.plans.adapter import genotypes
from tests.support import assert_same

REGISTRY = all_queries()


@pytest.fixture(scope="module")
def sf01():
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables aren't here")
    return path


def test_every_part_is_a_marker(spark, sf01):
    g = genotypes(spark, sf01)
    assert g.markers.count() == spark.read.parquet(f"{sf01}/part.parquet").count() > 200
    cells = spark.read.parquet(f"{sf01}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct()
    assert g.calls.count() == cells.count()
    assert g.markers.select("chr").distinct().count() == 20


@pytest.mark.parametrize("name", ["marker_qc", "sample_qc"])
def test_whole_queries_agree_with_sql(spark, sf01, name):
    assert_same(REGISTRY.QUERIES[name](spark, sf01), sf01, REGISTRY.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["ld_r2", "ld_complete", "consensus", "segregating", "informative", "pairwise_fst", "merge", "rbind", "dotplot"])
def test_queries_over_all_samples_agree_with_sql(spark, sf, name):
    assert_same(REGISTRY.QUERIES[name](spark, sf), sf, REGISTRY.ORACLE_SQL[name])


def test_all_pairs_of_samples(spark, sf):
    dosage = {(r.marker_idx, r.sample_idx): r.dosage for r in genotypes(spark, sf).observed().collect()}
    markers, samples = range(200), range(10)
    pairs = [(m, i, j) for m in markers for i in samples for j in samples if i < j]

    def f1(a, b):
        return None if a is None or b is None or 1 in (a, b) else (a + b) / 2

    got = {(r.marker_idx, r.f1): r.dosage for r in REGISTRY.QUERIES["predict_f1"](spark, sf).collect()}
    assert got == {(m, f"s{i}::s{j}"): f1(dosage.get((m, i)), dosage.get((m, j))) for m, i, j in pairs}
    got = {(r.marker_idx, r.iid1, r.iid2): r.same for r in REGISTRY.QUERIES["pairwise_diffs"](spark, sf).collect()}
    assert got == {(m, f"s{i}", f"s{j}"): dosage[m, i] == dosage[m, j] for m, i, j in pairs if (m, i) in dosage and (m, j) in dosage}


def test_f1_of_pairs_are_made_without_shuffling_missing_cells_or_pairs(spark, sf):
    from locusframe.operators.pairwise import predict_f1

    g = genotypes(spark, sf)
    g = g.with_(calls=g.calls.where("marker_idx % 3 <> 0"), samples=g.samples.where("sample_idx not in (2, 5)"))
    dosage = {(r.marker_idx, r.sample_idx): r.dosage for r in g.observed().collect()}
    samples = sorted(r.sample_idx for r in g.samples.collect())
    df = predict_f1(g, na_rm=True)

    def f1(a, b):
        a, b = b if a is None else a, a if b is None else b
        return None if a is None or 1 in (a, b) else (a + b) / 2

    got = {(r.marker_idx, r.f1): r.dosage for r in df.collect()}
    assert got == {(m, f"s{i}::s{j}"): f1(dosage.get((m, i)), dosage.get((m, j))) for m in range(200) for i in samples for j in samples if i < j}
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [x for x in plan if "Join Cross" in x or "Join Inner, (i" in x]
    # the pairs' two joins are with broadcast samples, and there is no grid of cells below them
    assert len(joins) == 3 and all("strategy=broadcast" in x for x in joins)


def test_haplotypes_of_all_other_samples(spark, sf):
    assert {r.iid for r in REGISTRY.QUERIES["reconstruct_haps"](spark, sf).select("iid").distinct().collect()} == {f"s{i}" for i in range(3, 10)}


@pytest.mark.parametrize("name", ["ibd", "kinship_grm", "ld_complete"])
def test_pairs_are_summed_in_tiles_and_never_shuffled(spark, sf, name, monkeypatch):
    from locusframe.operators import pairwise

    for constant, value in {"SAMPLES_PER_TILE": 4, "STRIP": 3, "CELLS_HELD": 100, "PAIRS_HELD": 50, "ROWS_SENT": 7}.items():
        monkeypatch.setattr(pairwise, constant, value)
    df = REGISTRY.QUERIES[name](spark, sf)
    assert_same(df, sf, REGISTRY.ORACLE_SQL[name])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # nothing is aggregated or joined by shuffle above the tiles
    above = plan[: plan.index("MapInArrow")]
    assert "Aggregate" not in above.split("Join")[0] and all("rightHint=(strategy=broadcast)" in x for x in above.splitlines() if "Join" in x)


def test_tqn_rounds_as_its_sql_does(spark, tmp_path):
    # s1's x at m2 is 0.5046875, but its product with 1e6 is below 504687.5
    line = "l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double"
    lines = [(2, 1, "A", 37.0, 0.02), (2, 1, "A", 38.0, 0.03), (3, 1, "N", 40.0, 0.01)]
    spark.createDataFrame(lines, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2,), (3,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 0, 1.0)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1,)], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert_same(REGISTRY.QUERIES["tqn"](spark, str(tmp_path)), str(tmp_path), REGISTRY.ORACLE_SQL["tqn"])


def test_tqn_takes_angles_as_its_sql_does(spark, tmp_path):
    # s1's x at m2 is 0.1884375 but for the last bit, which the angle's tangent decides
    line = "l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double"
    lines = [(2, 1, "A", 6.0, 0.04), (3, 1, "N", 26.0, 0.03)]
    spark.createDataFrame(lines, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2,), (3,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 0, 1.0)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1,)], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert_same(REGISTRY.QUERIES["tqn"](spark, str(tmp_path)), str(tmp_path), REGISTRY.ORACLE_SQL["tqn"])


def test_pairs_of_markers_with_missing_cells_are_not_compared(spark, sf, monkeypatch):
    from locusframe.operators import pairwise

    compared = []
    tiles = pairwise.pair_sums
    monkeypatch.setattr(pairwise, "pair_sums", lambda cells, items, *a, **k: (compared.append(items), tiles(cells, items, *a, **k))[1])
    monkeypatch.setattr(pairwise, "PAIRS_PER_TASK", 100)
    assert_same(REGISTRY.QUERIES["ld_complete"](spark, sf), sf, REGISTRY.ORACLE_SQL["ld_complete"])
    g = genotypes(spark, sf)
    full = {r.marker_idx for r in g.observed().groupBy("marker_idx").count().where(f"count = {g.samples.count()}").collect()}
    assert 0 < len(full) < g.markers.count() and {r.item for r in compared[0].collect()} == full


def test_f1_pairs_are_made_by_as_many_tasks_as_they_need(spark, sf, monkeypatch):
    from locusframe.operators import pairwise

    monkeypatch.setattr(pairwise, "PAIRS_PER_TASK", 900)
    df = pairwise.predict_f1(genotypes(spark, sf))
    # 200 markers x 45 pairs
    assert df.select(F.spark_partition_id().alias("task")).distinct().count() == 10
