"""The data behind plots; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet, ratio
from locusframe.operators import select, stats, windows
from locusframe.operators.encode import to_relative


def guard(g: GenotypeSet, most: int, force: bool, what: str) -> None:
    if not force and g.calls.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}; force to go on")


def qcplot(g: GenotypeSet) -> DataFrame:
    """Shares of calls by sample, long, with the sample's place by median si."""
    c = stats.summarize_calls(g, "samples", counts=False)
    si = select.get_intensity(g).where("si is not null").groupBy("sample_idx").agg(F.percentile("si", F.lit(0.5)).alias("median"))
    t = g.samples.select("sample_idx", "iid").join(c, "sample_idx").join(si, "sample_idx", "left")
    t = t.withColumn("place", F.row_number().over(Window.orderBy("median", "sample_idx")))
    return t.unpivot(["iid", "place"], ["A", "B", "H", "N"], "call", "share")


def cluster_plot(g: GenotypeSet, markers: list[str], force: bool = False) -> DataFrame:
    """x, y and call of each sample at a few markers."""
    if len(markers) > 10 and not force:
        raise ValueError("more than 10 markers; force to go on")
    t = select.get_call(g, markers)
    return t.select("marker", "iid", "x", "y", F.coalesce(F.col("dosage").cast("string"), F.lit("N")).alias("call"), "sample_filter")


def intensityhist(g: GenotypeSet, bins: int = 50) -> DataFrame:
    """Histogram of si by sample, in equal bins of the whole range."""
    si = select.get_intensity(g).where("si is not null").select("iid", "si")
    edge = F.broadcast(si.agg(F.min("si").alias("lo"), F.max("si").alias("hi")))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    k = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("si") - F.col("lo"), width))).cast("int")
    return si.crossJoin(edge).select("iid", F.coalesce(k, F.lit(0)).alias("bin")).groupBy("iid", "bin").agg(F.count(F.lit(1)).alias("n"))


def intensity_centres(g: GenotypeSet) -> DataFrame:
    """Mean and median si by sample."""
    si = select.get_intensity(g).where("si is not null")
    return si.groupBy("iid").agg(F.avg("si").alias("mean"), F.percentile("si", F.lit(0.5)).alias("median"))


def dotplot(g: GenotypeSet, force: bool = False) -> DataFrame:
    """Long calls of one chromosome with each marker's rank and relative position."""
    guard(g, 10_000, force, "points")
    m = g.markers.withColumns({"rank": F.dense_rank().over(Window.partitionBy("chr").orderBy("pos")), "lo": F.min("pos").over(Window.partitionBy("chr")), "hi": F.max("pos").over(Window.partitionBy("chr"))})
    m = m.select("marker_idx", "marker", "chr", "pos", "rank", ratio(F.col("pos") - F.col("lo"), F.col("hi") - F.col("lo")).alias("relative"))
    return g.observed().join(F.broadcast(m), "marker_idx").join(F.broadcast(g.samples.select("sample_idx", "iid")), "sample_idx").select("iid", "marker", "chr", "pos", "rank", "relative", "dosage")


def manhattan(g: GenotypeSet, scores: DataFrame, score: str, space: float = 10.0) -> DataFrame:
    """A marker-wise score along the genome axis."""
    return windows.genome_positions(g, space).join(scores.select("marker_idx", score), "marker_idx").select("marker", "chr", "x", score)


def neglog10(p: Column) -> Column:
    return F.when(p > 0, -F.log10(p))


def freqplot(g: GenotypeSet, max_H: float = 1.0, max_N: float = 1.0, min_maf: float = 0.0) -> DataFrame:
    """Shares of relative calls of markers with many heterozygotes or missing calls, or a rare minor allele; long."""
    c = stats.summarize_calls(to_relative(g), "markers", counts=False)
    maf = F.col("B") + F.col("H") / 2
    c = c.withColumn("maf", maf).where((F.col("H") > max_H) | (F.col("N") > max_N) | (F.col("maf") <= min_maf))
    return g.markers.select("marker_idx", "marker").join(c, "marker_idx").unpivot(["marker", "maf"], ["A", "B", "H", "N"], "call", "share")


def bafplot(g: GenotypeSet, iid: str, half_window: int = 5) -> DataFrame:
    """BAF and LRR of a sample along the genome, with a running mean of LRR over neighbours of a chromosome."""
    s = g.samples.where(F.col("iid") == iid).select("sample_idx")
    t = g.calls.join(F.broadcast(s), "sample_idx").join(F.broadcast(windows.genome_positions(g).withColumnRenamed("x", "genome")), "marker_idx")
    near = Window.partitionBy("chr").orderBy("marker_idx").rowsBetween(-half_window, half_window)
    return t.select("marker", "chr", "genome", "baf", "lrr", F.avg("lrr").over(near).alias("smooth"))


def scree(explained: DataFrame) -> DataFrame:
    """Explained variance and its running sum."""
    return explained.withColumn("cumulative", F.sum("explained").over(Window.orderBy("pc")))


def haplotype_segments(blocks: DataFrame) -> DataFrame:
    """Blocks as segments by chromosome and phase."""
    return blocks.unpivot(["iid", "chr", "start", "end"], ["hap1", "hap2"], "phase", "haplotype")
