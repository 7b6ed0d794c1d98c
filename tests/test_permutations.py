"""Adaptive permutations of the allelic test."""

from __future__ import annotations

from math import comb

from locusframe.operators import assoc
from tests.test_operators import make


def test_permutations_go_on_where_they_must(spark):
    import pyspark.sql.functions as F

    case = [i < 20 for i in range(40)]
    rows = [[2 if c else 0 for c in case], [2 if i % 4 == 0 else 0 for i in range(40)], [2 if i < 10 or i in (20, 21, 22) else 0 for i in range(40)]]
    g = make(spark, rows)
    g = g.with_(samples=g.samples.withColumn("pheno", F.when(F.col("sample_idx") < 20, 2.0).otherwise(1.0)))
    p = [r.p for r in assoc.assoc_permuted(g).orderBy("marker_idx").collect()]
    assert p[0] == 1 / 100_001 and p[1] > 0.5
    fine = [r.p for r in assoc.assoc_permuted(g, enough=10**9).orderBy("marker_idx").collect()]
    # 10 of 13 carriers are cases: as far from the mean of 6.5 as that, either way
    exact = sum(comb(20, k) * comb(20, 13 - k) for k in range(14) if abs(k - 6.5) >= 3.5) / comb(40, 13)
    assert abs(fine[2] - exact) < 0.003 and abs(p[2] - exact) < exact
