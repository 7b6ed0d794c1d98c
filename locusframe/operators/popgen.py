"""Population differentiation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet


def fst_components(g: GenotypeSet, by: str = "fid") -> DataFrame:
    """Weir and Cockerham's variance components a, b, c of each marker.

    The number of populations is that of the samples, the same at every
    marker; a population without calls at a marker adds nothing there.
    """
    pop = g.samples.select("sample_idx", F.col(by).alias("pop"))
    pops = F.broadcast(pop.select("pop").distinct().agg(F.count(F.lit(1)).cast("double").alias("r")))
    n = g.observed().join(F.broadcast(pop), "sample_idx").groupBy("marker_idx", "pop").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(2 - F.col("dosage")).cast("double").alias("copies"), F.count_if(F.col("dosage") == 1).cast("double").alias("hets"))
    sums = n.groupBy("marker_idx").agg(
        F.sum("n").alias("sn"),
        F.sum(F.col("n") * F.col("n")).alias("snn"),
        F.sum("copies").alias("sc"),
        F.sum(F.col("copies") * F.col("copies") / F.col("n")).alias("scc"),
        F.sum("hets").alias("sh"),
    )
    t = sums.crossJoin(pops)
    r, nbar = F.col("r"), F.col("sn") / F.col("r")
    t = t.withColumns({"nbar": nbar, "nc": F.try_divide(F.col("sn") - F.try_divide(F.col("snn"), F.col("sn")), r - 1), "p": F.try_divide(F.col("sc"), 2 * F.col("sn")), "h": F.try_divide(F.col("sh"), F.col("sn"))})
    # sum of n (p_i - p)^2 = sum of c_i^2 / (4 n_i) - n p^2
    s2 = F.try_divide(F.col("scc") / 4 - F.col("sn") * F.col("p") * F.col("p"), (r - 1) * F.col("nbar"))
    t = t.withColumn("s2", s2)
    pq, nb, ratio_ = F.col("p") * (1 - F.col("p")), F.col("nbar"), (r - 1) / r
    a = F.try_divide(nb, F.col("nc")) * (F.col("s2") - F.try_divide(pq - ratio_ * F.col("s2") - F.col("h") / 4, nb - 1))
    b = F.try_divide(nb, nb - 1) * (pq - ratio_ * F.col("s2") - F.try_divide(2 * nb - 1, 4 * nb) * F.col("h"))
    return t.select("marker_idx", a.alias("a"), b.alias("b"), (F.col("h") / 2).alias("c"))


def _indices(a: Column, b: Column, c: Column) -> list[Column]:
    return [(1 - F.try_divide(c, a + b + c)).alias("F"), F.try_divide(a, a + b + c).alias("theta"), (1 - F.try_divide(c, b + c)).alias("f")]


def weir_fst_locus(g: GenotypeSet, by: str = "fid") -> DataFrame:
    """F, theta and f of each marker."""
    return fst_components(g, by).select("marker_idx", "a", "b", "c", *_indices(F.col("a"), F.col("b"), F.col("c")))


def weir_fst(g: GenotypeSet, by: str = "fid") -> DataFrame:
    """F, theta and f over all markers, as ratios of sums."""
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    s = fst_components(g, by).agg(*[F.sum(F.when(whole, F.col(x))).alias(x) for x in "abc"])
    return s.select(*_indices(F.col("a"), F.col("b"), F.col("c")))


def pairwise_fst(g: GenotypeSet, by: str = "fid") -> DataFrame:
    """theta of each pair of populations, from one count of calls by marker and population."""
    pop = g.samples.select("sample_idx", F.col(by).alias("pop"))
    n = g.observed().join(F.broadcast(pop), "sample_idx").groupBy("marker_idx", "pop").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(2 - F.col("dosage")).cast("double").alias("k"), F.count_if(F.col("dosage") == 1).cast("double").alias("h"))
    one, two = (n.select("marker_idx", F.col("pop").alias(f"pop{i}"), *[F.col(c).alias(f"{c}{i}") for c in "nkh"]) for i in (1, 2))
    t = one.join(two, "marker_idx").where("pop1 < pop2")
    n1, n2, k1, k2 = (F.col(c) for c in ("n1", "n2", "k1", "k2"))
    sn = n1 + n2
    nbar, p, h = sn / 2, (k1 + k2) / (2 * sn), (F.col("h1") + F.col("h2")) / sn
    t = t.withColumns({"nbar": nbar, "nc": sn - (n1 * n1 + n2 * n2) / sn, "p": p, "h": h, "s2": (k1 * k1 / (4 * n1) + k2 * k2 / (4 * n2) - sn * p * p) / nbar})
    nb, pq, s2, hh = F.col("nbar"), F.col("p") * (1 - F.col("p")), F.col("s2"), F.col("h")
    a = nb / F.col("nc") * (s2 - F.try_divide(pq - s2 / 2 - hh / 4, nb - 1))
    b = F.try_divide(nb, nb - 1) * (pq - s2 / 2 - (2 * nb - 1) / (4 * nb) * hh)
    t = t.withColumns({"a": a, "b": b, "c": hh / 2}).where("a is not null and b is not null")
    s = t.groupBy("pop1", "pop2").agg(*[F.sum(x).alias(x) for x in "abc"])
    return s.select("pop1", "pop2", F.try_divide(F.col("a"), F.col("a") + F.col("b") + F.col("c")).alias("theta"))
