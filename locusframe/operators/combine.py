"""Concatenation and merging of genotype sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet
from locusframe.operators.encode import complement


def require_none(rows: DataFrame, message: str) -> None:
    if not rows.isEmpty():
        raise ValueError(message)


def cbind(a: GenotypeSet, b: GenotypeSet) -> GenotypeSet:
    """Samples of both; same markers in the same order, disjoint sample names, same encoding. Flags and baf/lrr are dropped."""
    if a.alleles != b.alleles:
        raise ValueError("encodings differ")
    require_none(a.samples.join(b.samples, "iid", "left_semi"), "samples in common")
    key = ["marker_idx", "marker"]
    require_none(a.markers.select(*key).exceptAll(b.markers.select(*key)).unionByName(b.markers.select(*key).exceptAll(a.markers.select(*key))), "markers differ")
    drop = ("baf", "lrr")
    samples = a.samples.unionByName(b.samples, allowMissingColumns=True).withColumn("filter", F.lit(""))
    return a.with_(samples=samples, markers=a.markers.withColumn("filter", F.lit("")), calls=a.calls.drop(*drop).unionByName(b.calls.drop(*drop), allowMissingColumns=True), normalized=a.normalized and b.normalized)


def rbind(a: GenotypeSet, b: GenotypeSet) -> GenotypeSet:
    """Markers of both; same samples, disjoint markers."""
    if a.alleles != b.alleles:
        raise ValueError("encodings differ")
    require_none(a.markers.join(b.markers, "marker", "left_semi"), "markers in common")
    names = a.samples.select("iid")
    require_none(names.exceptAll(b.samples.select("iid")).unionByName(b.samples.select("iid").exceptAll(names)), "samples differ")
    renumber = a.samples.select("iid", F.col("sample_idx").alias("__to")).join(b.samples.select("iid", "sample_idx"), "iid").select("sample_idx", "__to")
    calls = b.calls.join(F.broadcast(renumber), "sample_idx").drop("sample_idx").withColumnRenamed("__to", "sample_idx")
    return a.with_(markers=a.markers.unionByName(b.markers, allowMissingColumns=True), calls=a.calls.unionByName(calls, allowMissingColumns=True))


def rbind_all(sets: list[GenotypeSet]) -> GenotypeSet:
    """Markers of all sets, in the order given."""
    return reduce(rbind, sets)


def cbind_all(sets: list[GenotypeSet]) -> GenotypeSet:
    """Samples of all sets, in the order given."""
    return reduce(cbind, sets)


def allele_actions(x: DataFrame, y: DataFrame) -> DataFrame:
    """How the alleles of two maps (marker, A1, A2) reconcile: marker, action, A1, A2, flip.

    The rules are tried in order where the alleles differ: equal first alleles
    drop the marker; a strand change takes the second map's alleles; exchanged
    alleles turn the first map's dosages round; both at once do both; anything
    else, and any missing allele, drops it.
    """
    j = x.select("marker", F.col("A1").alias("x1"), F.col("A2").alias("x2")).join(y.select("marker", F.col("A1").alias("y1"), F.col("A2").alias("y2")), "marker")
    x1, x2, y1, y2 = (F.col(c) for c in ("x1", "x2", "y1", "y2"))
    rc1, rc2 = complement(y1), complement(y2)
    missing = x1.isNull() | x2.isNull() | y1.isNull() | y2.isNull()
    action = (
        F.when(missing, "drop")
        .when((x1 == y1) & (x2 == y2), "same")
        .when(y1 == x1, "drop")
        .when(rc1 == x1, F.when(rc2 == x2, "strand").otherwise("drop"))
        .when(y1 == x2, F.when(y2 == x1, "order").otherwise("drop"))
        .when(rc1 == x2, F.when(rc2 == x1, "both").otherwise("drop"))
        .otherwise("drop")
    )
    j = j.withColumn("action", action)
    flip = F.col("action").isin("order", "both")
    return j.select("marker", "action", F.when(flip, x2).otherwise(x1).alias("A1"), F.when(flip, x1).otherwise(x2).alias("A2"), flip.alias("flip"))


def merge(x: GenotypeSet, y: GenotypeSet, check_alleles: bool = False) -> GenotypeSet:
    """Samples of both at the markers they share, by name and in x's order.

    Samples must be disjoint.  With ``check_alleles`` alleles are reconciled
    first and x's dosages turned round where needed; markers that cannot be
    reconciled are dropped.  Marker flags of both are joined.
    """
    if x.alleles != y.alleles:
        raise ValueError("encodings differ")
    require_none(x.samples.join(y.samples, "iid", "left_semi"), "samples in common")
    other = y.markers.select("marker", F.col("marker_idx").alias("__y"), F.col("filter").alias("__yf"))
    shared = x.markers.join(other, "marker").withColumn("filter", F.concat("filter", "__yf")).drop("__yf")
    if check_alleles:
        plan = allele_actions(x.markers, y.markers).where("action <> 'drop'").select("marker", F.col("A1").alias("__1"), F.col("A2").alias("__2"), F.col("flip").alias("__flip"))
        shared = shared.join(plan, "marker").withColumns({"A1": F.col("__1"), "A2": F.col("__2")}).drop("__1", "__2")
    else:
        shared = shared.withColumn("__flip", F.lit(False))
    m = F.broadcast(shared.select("marker_idx", "__y", "__flip"))
    mine = x.calls.join(m.drop("__y"), "marker_idx")
    mine = mine.withColumn("dosage", F.when(F.col("__flip"), F.abs(2 - F.col("dosage"))).otherwise(F.col("dosage"))).drop("__flip")
    theirs = y.calls.withColumnRenamed("marker_idx", "__y").join(m.select("__y", "marker_idx"), "__y").drop("__y")
    return x.with_(
        markers=shared.select(*x.markers.columns),
        samples=x.samples.unionByName(y.samples, allowMissingColumns=True),
        calls=mine.unionByName(theirs, allowMissingColumns=True),
        normalized=x.normalized and y.normalized,
    )
