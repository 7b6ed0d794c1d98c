"""Order-based operators over the marker map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet


def thin(g: GenotypeSet, spacing: float = 5.0) -> GenotypeSet:
    """One marker (the first) of each genetic bin of a chromosome, and each chromosome's first and last marker.

    Bins of ``spacing`` cM start at a multiple of it plus a half; they are
    closed on the right, and the lowest value belongs to the first bin.
    """
    w = float(spacing)
    chrom = Window.partitionBy("chr")
    order = Window.partitionBy("chr").orderBy("marker_idx")
    lo = F.floor((F.min("cM").over(chrom) - w / 2) / w) * w + w / 2
    m = g.markers.where("cM is not null").withColumn("__bin", F.greatest(F.lit(1), F.ceil((F.col("cM") - lo) / w)))
    first = F.row_number().over(Window.partitionBy("chr", "__bin").orderBy("marker_idx"))
    m = m.withColumns({"__in_bin": first, "__from": F.row_number().over(order), "__n": F.count(F.lit(1)).over(chrom)})
    kept = m.where("__in_bin = 1 or __from = 1 or __from = __n").select(*g.markers.columns)
    return g.with_(markers=kept, calls=g.calls.join(F.broadcast(kept.select("marker_idx")), "marker_idx", "left_semi"))


def concat_chroms(g: GenotypeSet, space: float = 10.0, denom: float = 1e6) -> DataFrame:
    """A genome axis: chromosome lengths (largest position / denom + space), their offsets and mid-points."""
    length = g.markers.groupBy("chr").agg(F.min("chr_order").alias("chr_order"), (F.max("pos") / F.lit(float(denom)) + F.lit(float(space))).alias("length"))
    before = Window.orderBy("chr_order", "chr").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("length").over(before), F.lit(0.0))
    return length.withColumn("offset", off).select("chr", "length", "offset", (F.col("offset") + F.col("length") / 2).alias("tick"))


def genome_positions(g: GenotypeSet, space: float = 10.0, denom: float = 1e6) -> DataFrame:
    """Markers with their place on the genome axis."""
    axis = F.broadcast(concat_chroms(g, space, denom).select("chr", "offset"))
    return g.markers.join(axis, "chr").select("marker_idx", "marker", "chr", "pos", (F.col("offset") + F.col("pos") / F.lit(float(denom))).alias("x"))


def runs(t: DataFrame, by: list[str], order: str, value: str, **aggregates: Column) -> DataFrame:
    """Run-length blocks of equal consecutive values (null is a value of its own) within groups."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    t = t.withColumn("__block", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*by, "__block").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in aggregates.items()]).withColumnRenamed("__block", "block")


def call_runs(g: GenotypeSet) -> DataFrame:
    """Blocks of equal calls along each sample's chromosomes."""
    t = g.observed().join(F.broadcast(g.markers.select("marker_idx", "chr", "pos")), "marker_idx")
    return runs(t, ["sample_idx", "chr"], "marker_idx", "dosage", start=F.min("pos"), end=F.max("pos"))


def map_gaps(g: GenotypeSet) -> DataFrame:
    """Distance in cM to the marker before, by chromosome."""
    w = Window.partitionBy("chr").orderBy("marker_idx")
    return g.markers.select("marker_idx", (F.col("cM") - F.lag("cM").over(w)).alias("gap"))
