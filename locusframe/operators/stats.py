"""Marker-wise and sample-wise statistics.

All are one aggregation over observed cells with map-side combining; missing
cells are counted as the other dimension's size less the observed ones.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet, key_of, other_dim, ratio, table_of


def count_calls(g: GenotypeSet, by: str = "markers") -> DataFrame:
    """A row for each marker (or sample): n0, n1, n2, n_missing, n (cells), also for those without any call."""
    key = key_of(by)
    counts = g.observed().groupBy(key).agg(*[F.count_if(F.col("dosage") == d).alias(f"n{d}") for d in (0, 1, 2)])
    zero = F.lit(0).cast("long")
    out = table_of(g, by).select(key).join(counts, key, "left").crossJoin(F.broadcast(other_dim(g, by)))
    n = [F.coalesce(f"n{d}", zero) for d in (0, 1, 2)]
    return out.select(key, *[c.alias(f"n{d}") for d, c in enumerate(n)], (F.col("n") - n[0] - n[1] - n[2]).alias("n_missing"), "n")


def freq(g: GenotypeSet, by: str = "markers", counts: bool = False) -> DataFrame:
    """Frequency of the counted allele (null if nothing is observed), or its count."""
    c = count_calls(g, by)
    copies = F.col("n1") + 2 * F.col("n2")
    value = copies.alias("copies") if counts else ratio(copies, 2 * (F.col("n0") + F.col("n1") + F.col("n2"))).alias("freq")
    return c.select(key_of(by), value)


def nmiss(g: GenotypeSet, by: str = "markers") -> DataFrame:
    return count_calls(g, by).select(key_of(by), "n_missing", ratio(F.col("n_missing"), F.col("n")).alias("missingness"))


def most_frequent(n0: Column, n1: Column, n2: Column) -> Column:
    """The most frequent dosage, ties to the lowest; null if there is none."""
    return F.when(n0 + n1 + n2 == 0, None).when((n0 >= n1) & (n0 >= n2), 0).when(n1 >= n2, 1).otherwise(2)


def consensus(g: GenotypeSet, nas_allowed: float = 0.0, counts: DataFrame | None = None) -> DataFrame:
    """The most frequent dosage of each marker; null where the share of missing cells exceeds ``nas_allowed``."""
    c = count_calls(g) if counts is None else counts
    call = most_frequent(F.col("n0"), F.col("n1"), F.col("n2"))
    keep = [k for k in c.columns if k not in ("n0", "n1", "n2", "n_missing", "n")]
    return c.select(*keep, F.when(F.col("n_missing") <= F.col("n") * F.lit(float(nas_allowed)), call).alias("dosage"))


def segregating(g: GenotypeSet, nas_allowed: float = 0.0, allow_het: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Whether a marker segregates; null where too much is missing.

    With ``allow_het`` any heterozygote or two different codes suffice,
    otherwise both homozygotes must be seen.
    """
    c = count_calls(g) if counts is None else counts
    homs = (F.col("n0") > 0) & (F.col("n2") > 0)
    keep = [k for k in c.columns if k not in ("n0", "n1", "n2", "n_missing", "n")]
    seen = homs | (F.col("n1") > 0) if allow_het else homs
    return c.select(*keep, F.when(F.col("n_missing") <= F.col("n") * F.lit(float(nas_allowed)), seen).alias("segregating"))


def fixed_diffs(g: GenotypeSet, iid1: str, iid2: str) -> DataFrame:
    """Whether two samples are opposite homozygotes at each marker; never null."""
    two = g.observed().join(F.broadcast(g.samples.where(F.col("iid").isin(iid1, iid2)).select("sample_idx")), "sample_idx")
    span = two.groupBy("marker_idx").agg((F.max("dosage") - F.min("dosage")).alias("span"))
    return g.markers.select("marker_idx").join(span, "marker_idx", "left").select("marker_idx", F.coalesce(F.col("span") == 2, F.lit(False)).alias("fixed_diff"))


def informative(g: GenotypeSet, between: str = "fid", nas_allowed: float = 0.0) -> DataFrame:
    """Whether the consensus calls of groups of samples segregate."""
    group = g.samples.select("sample_idx", F.col(between).alias("grp"))
    size = group.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    counts = g.observed().join(F.broadcast(group), "sample_idx").groupBy("marker_idx", "grp").agg(*[F.count_if(F.col("dosage") == d).alias(f"n{d}") for d in (0, 1, 2)])
    counts = counts.join(F.broadcast(size), "grp").withColumn("n_missing", F.col("n") - F.col("n0") - F.col("n1") - F.col("n2"))
    calls = consensus(g, nas_allowed, counts).where("dosage is not null")
    across = calls.groupBy("marker_idx").agg(*[F.count_if(F.col("dosage") == d).alias(f"n{d}") for d in (0, 1, 2)])
    groups = group.select("grp").distinct().agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    full = g.markers.select("marker_idx").join(across, "marker_idx", "left").crossJoin(F.broadcast(groups))
    full = full.select("marker_idx", *[F.coalesce(f"n{d}", zero).alias(f"n{d}") for d in (0, 1, 2)], "n").withColumn("n_missing", F.col("n") - F.col("n0") - F.col("n1") - F.col("n2"))
    return segregating(g, nas_allowed, False, full).withColumnRenamed("segregating", "informative")


def prop_het(g: GenotypeSet) -> DataFrame:
    """Share of heterozygotes among a sample's calls."""
    c = count_calls(g, "samples")
    return c.select("sample_idx", ratio(F.col("n1"), F.col("n0") + F.col("n1") + F.col("n2")).alias("het"))


def heterozygosity(g: GenotypeSet, hwe: bool = False) -> DataFrame:
    """Share of heterozygotes at a marker, or 1 - P(0)^2 - P(2)^2 of genotype shares."""
    c, seen = count_calls(g), F.col("n0") + F.col("n1") + F.col("n2")
    if hwe:
        p0, p2 = ratio(F.col("n0"), seen), ratio(F.col("n2"), seen)
        return c.select("marker_idx", (1.0 - p0 * p0 - p2 * p2).alias("het"))
    return c.select("marker_idx", ratio(F.col("n1"), seen).alias("het"))


def summarize_calls(g: GenotypeSet, by: str = "samples", counts: bool = True) -> DataFrame:
    """A, B (homozygotes), H and N by sample or marker, as counts or as shares of all cells."""
    c = count_calls(g, by)
    cols = {"A": "n0", "B": "n2", "H": "n1", "N": "n_missing"}
    return c.select(key_of(by), *[(F.col(v) if counts else ratio(F.col(v), F.col("n"))).alias(k) for k, v in cols.items()])


def summarize_intensity(g: GenotypeSet, q: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact quantiles of sqrt(x^2 + y^2) by sample."""
    si = g.calls.where("x is not null and y is not null").withColumn("si", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    v = si.groupBy("sample_idx").agg(F.percentile("si", F.array(*[F.lit(float(x)) for x in q])).alias("v"))
    cols = [F.element_at("v", i + 1).alias(f"q{int(x * 100)}") for i, x in enumerate(q)]
    return g.samples.select("sample_idx", "iid", "fid", "sex").join(v, "sample_idx").select("sample_idx", "iid", "fid", "sex", *cols)


def summarize_filters(g: GenotypeSet, codes: str = "NHIF") -> DataFrame:
    """How many markers and samples carry each flag."""

    def tally(t: DataFrame, name: str) -> DataFrame:
        return t.agg(F.map_from_arrays(F.array(*[F.lit(c) for c in codes]), F.array(*[F.count_if(F.contains("filter", F.lit(c))) for c in codes])).alias(name))

    both = tally(g.markers, "m").crossJoin(tally(g.samples, "s"))
    return both.select(F.explode("m").alias("code", "sites"), "s").select("code", "sites", F.element_at("s", F.col("code")).alias("samples"))


def genoapply(g: GenotypeSet, marker_keys: list[str], sample_keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates of observed cells by grouping columns of the map and of the samples; only groups that exist."""
    long = g.observed().join(F.broadcast(g.markers.select("marker_idx", *marker_keys)), "marker_idx").join(F.broadcast(g.samples.select("sample_idx", *sample_keys)), "sample_idx")
    return long.groupBy(*marker_keys, *sample_keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def genoapply_fn(g: GenotypeSet, marker_keys: list[str], sample_keys: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """A function of each group's observed cells, as an Arrow table with the grouping columns, marker_idx, sample_idx and dosage; only groups that exist.

    A group's cells are held by one task.
    """
    long = g.observed().select("marker_idx", "sample_idx", "dosage").join(F.broadcast(g.markers.select("marker_idx", *marker_keys)), "marker_idx").join(F.broadcast(g.samples.select("sample_idx", *sample_keys)), "sample_idx")
    return long.groupBy(*marker_keys, *sample_keys).applyInArrow(fn, schema)


def col_vars(g: GenotypeSet) -> DataFrame:
    """Variance of each sample's dosages, with the number of markers as n."""
    c = count_calls(g, "samples")
    n, seen = F.col("n").cast("double"), F.col("n0") + F.col("n1") + F.col("n2")
    m1, m2 = ratio(F.col("n1") + 2 * F.col("n2"), seen), ratio(F.col("n1") + 4 * F.col("n2"), seen)
    return c.select("sample_idx", (F.try_divide(n, n - 1) * (m2 - m1 * m1)).alias("variance"))
