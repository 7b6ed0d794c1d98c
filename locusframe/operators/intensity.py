"""Intensity normalisation, B-allele frequency and log R ratio."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from locusframe.model import GenotypeSet


# the C library's, as in the SQL's engine: the JVM's differ in the last bit, which decides where a result is a tie of its rounding
@F.arrow_udf(DoubleType())
def atan(v: pa.Array) -> pa.Array:
    return pc.atan(v)


@F.arrow_udf(DoubleType())
def tan(v: pa.Array) -> pa.Array:
    return pc.tan(v)


@F.arrow_udf(DoubleType())
def log2(v: pa.Array) -> pa.Array:
    return pc.log2(v)


def quantile_normalize(g: GenotypeSet, force: bool = False) -> GenotypeSet:
    """Give each sample's x (and y) the same distribution: the mean over samples of each rank's value.

    Ties are ranked by marker.  Ranks are within a sample, so a task sorts one
    sample's values; the means are one small table by rank.
    """
    if g.normalized and not force:
        return g
    calls = g.calls
    for c in ("x", "y"):
        rank = F.row_number().over(Window.partitionBy("sample_idx", F.col(c).isNull()).orderBy(c, "marker_idx"))
        ranked = calls.withColumn("__rank", F.when(F.col(c).isNotNull(), rank))
        means = ranked.where(F.col(c).isNotNull()).groupBy("__rank").agg(F.avg(c).alias("__mean"))
        calls = ranked.join(means, "__rank", "left").withColumn(c, F.col("__mean")).drop("__rank", "__mean")
    return g.with_(calls=calls.select(*g.calls.columns), normalized=True)


def theta(x: Column, y: Column) -> Column:
    """2 / pi * atan(y / x): 0 on the x axis, 1 on the y axis."""
    return F.lit(2 / math.pi) * F.when(x == 0, F.when(y == 0, None).otherwise(math.pi / 2)).otherwise(atan(y / F.nullif(x, F.lit(0.0))))


def bound(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def log2_ratio(a: Column, b: Column) -> Column:
    """log2(a / b), null unless both are positive."""
    return log2(F.when((a > 0) & (b > 0), a / b))


def baf_lrr(cells: DataFrame, medians: tuple[Column, Column]) -> DataFrame:
    """Columns baf and lrr for cells with r, theta and cluster centres (AR, AT, HR, HT, BR, BT; any may be null).

    ``medians``: of AT and BT over all markers.
    """
    r, th = F.col("r"), F.col("theta")
    swap = (F.col("AT") > F.col("BT")) & F.col("AT").isNotNull() & F.col("BT").isNotNull()
    cells = cells.withColumns({k: F.when(swap, F.col(b)).otherwise(F.col(a)) for k, a, b in (("ta", "AT", "BT"), ("tb", "BT", "AT"), ("ra", "AR", "BR"), ("rb", "BR", "AR"))})
    ta, tb, th2, ra, rb, rh = (F.col(c) for c in ("ta", "tb", "HT", "ra", "rb", "HR"))
    has_a, has_b, has_h = ta.isNotNull(), tb.isNotNull(), th2.isNotNull()
    med_a, med_b = medians
    disordered = (has_a & has_h & (ta > th2)) | (has_h & has_b & (th2 > tb))
    up = F.lit(0.5) + F.lit(0.5) * F.try_divide(th - th2, tb - th2)
    down = F.lit(0.5) * F.try_divide(th - ta, th2 - ta)
    r_up = rh + (th - th2) * F.try_divide(rb - rh, tb - th2)
    r_down = ra + (th - ta) * F.try_divide(rh - ra, th2 - ta)
    near_a = F.abs(ta - th) <= F.abs(tb - th)
    none = F.lit(None).cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    # which clusters exist decides the case; outside the outer centres the frequency is 0 or 1
    case = lambda a, h, b: (has_a == F.lit(a)) & (has_h == F.lit(h)) & (has_b == F.lit(b))
    pair = [
        (th.isNull() | disordered | (~has_a & ~has_b), none, none),
        (case(False, False, True), F.when(th >= tb, one), F.when(th >= tb, rb)),
        (case(True, False, False), F.when(th <= ta, zero), F.when(th <= ta, ra)),
        (case(True, False, True), F.when(near_a & (th < ta), zero).when(~near_a & (th >= tb), one), F.when(near_a & (th < ta), ra).when(~near_a & (th >= tb), rb)),
        (case(False, True, True), F.when(th >= tb, one).when(th >= th2, up).when(th < med_a, zero).otherwise(F.lit(0.5) * F.try_divide(th - med_a, th2 - med_a)), F.when((th >= th2) & (th < tb), r_up)),
        (case(True, True, False), F.when(th <= ta, zero).when(th <= th2, down).when(th > med_b, one).otherwise(F.lit(0.5) + F.lit(0.5) * F.try_divide(th - th2, med_b - th2)), F.when((th <= th2) & (th > ta), r_down)),
        (F.lit(True), F.when(th <= ta, zero).when(th <= th2, down).when(th <= tb, up).otherwise(one), F.when(th <= ta, ra).when(th <= th2, r_down).when(th <= tb, r_up).otherwise(rb)),
    ]
    baf, expected = F.when(pair[0][0], pair[0][1]), F.when(pair[0][0], pair[0][2])
    for rule, b, e in pair[1:]:
        baf, expected = baf.when(rule, b), expected.when(rule, e)
    return cells.withColumns({"baf": baf, "lrr": log2_ratio(r, expected)}).drop("ta", "tb", "ra", "rb")


def tqn(g: GenotypeSet, clusters: DataFrame, cap: float = 1.5, prenorm: bool = False, xy_norm: bool = True, adjust_lrr: bool = False) -> GenotypeSet:
    """Thresholded quantile normalisation: x and y of each sample are normalised against each other, bounded by
    ``cap`` times the raw value, and turned to BAF and LRR by cluster centres.

    ``clusters``: marker, AR, AT, BR, BT, HR, HT, Rmean.  Markers without a
    cluster row lose their cells; cells with a raw intensity that is missing
    or not positive have null results.
    """
    base = quantile_normalize(g) if prenorm else g
    raw = g.calls.select("marker_idx", "sample_idx", F.col("x").alias("x0"), F.col("y").alias("y0"))
    c = F.broadcast(g.markers.select("marker_idx", "marker").join(clusters, "marker").drop("marker"))
    cells = base.calls.join(raw, ["marker_idx", "sample_idx"]).join(c, "marker_idx")
    cells = cells.withColumns({"xn": F.coalesce("x", F.lit(0.0)), "yn": F.coalesce("y", F.lit(0.0))})
    if xy_norm:
        for k in ("xn", "yn"):
            cells = cells.withColumn(f"__{k}", F.row_number().over(Window.partitionBy("sample_idx").orderBy(k, "marker_idx")))
        both = cells.select("sample_idx", F.col("__xn").alias("rank"), F.col("xn").alias("v")).unionByName(cells.select("sample_idx", F.col("__yn").alias("rank"), F.col("yn").alias("v")))
        means = both.groupBy("sample_idx", "rank").agg(F.avg("v").alias("mean"))
        for k in ("xn", "yn"):
            cells = cells.join(means.withColumnRenamed("rank", f"__{k}"), ["sample_idx", f"__{k}"]).withColumn(k, F.col("mean")).drop("mean", f"__{k}")
    missing = F.col("x0").isNull() | F.col("y0").isNull() | (F.col("x0") <= 0) | (F.col("y0") <= 0)
    r = F.col("xn") + F.col("yn")
    cells = cells.withColumn("r", F.when(~missing, r))
    cells = cells.withColumns({k: F.when(~missing & (F.col(k) > cap * F.col(o)), cap * F.col(o)).otherwise(F.col(k)) for k, o in (("xn", "x0"), ("yn", "y0"))})
    cells = cells.withColumn("theta", F.when(~missing, bound(theta(F.col("xn"), F.col("yn")), 0, 1)))
    centres = clusters.agg(*[F.expr(f"percentile_disc(0.5) within group (order by {k} desc)").alias(m) for k, m in (("AT", "med_a"), ("BT", "med_b"))])
    cells = baf_lrr(cells.crossJoin(F.broadcast(centres)), (F.col("med_a"), F.col("med_b")))
    cells = cells.withColumn("tan", tan(F.col("theta") * (math.pi / 2)))
    cells = cells.withColumn("y", F.col("r") * F.col("tan") / (1 + F.col("tan"))).withColumn("x", F.col("r") - F.col("y"))
    if adjust_lrr:
        cells = cells.withColumn("lrr", log2_ratio(F.col("x") + F.col("y"), F.col("Rmean")))
    return g.with_(calls=cells.select("marker_idx", "sample_idx", "dosage", "x", "y", "baf", "lrr"), normalized=True)


def calc_lrr(g: GenotypeSet) -> DataFrame:
    """log2((x + y) / mean of x + y at the marker)."""
    t = g.calls.where("x is not null and y is not null").withColumn("s", F.col("x") + F.col("y"))
    means = t.groupBy("marker_idx").agg(F.avg("s").alias("mean"))
    return t.join(means, "marker_idx").select("marker_idx", "sample_idx", log2_ratio(F.col("s"), F.col("mean")).alias("lrr"))


def clusters_from_calls(g: GenotypeSet) -> DataFrame:
    """Cluster centres of each marker from its own calls: mean r and theta of each genotype, and mean r."""
    t = g.calls.where("x > 0 and y > 0").withColumns({"r": F.col("x") + F.col("y"), "t": theta(F.col("x"), F.col("y"))})
    cols = [F.avg(F.when(F.col("dosage") == d, F.col(v))).alias(f"{k}{v.upper()}") for d, k in ((0, "A"), (1, "H"), (2, "B")) for v in ("r", "t")]
    out = t.groupBy("marker_idx").agg(*cols, F.avg("r").alias("Rmean"))
    return g.markers.select("marker_idx", "marker").join(out, "marker_idx").drop("marker_idx")
