"""Genotype-phenotype tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet, ratio


def genotype_label(dosage: Column, a1: Column, a2: Column) -> Column:
    return F.when(dosage == 0, F.concat(a1, a1)).when(dosage == 1, F.concat(a1, a2)).when(dosage == 2, F.concat(a2, a2))


def labelled_calls(g: GenotypeSet, markers: list[str]) -> DataFrame:
    m = g.markers.where(F.col("marker").isin(*markers)).select("marker_idx", "marker", "A1", "A2")
    t = g.observed().join(F.broadcast(m), "marker_idx").join(g.samples, "sample_idx")
    return t.withColumn("genotype", genotype_label(F.col("dosage"), F.col("A1"), F.col("A2")))


def guess_pheno(g: GenotypeSet, pheno: str = "pheno") -> str:
    """case-control (integers up to 2), categorical (integers) or continuous."""
    p = g.samples.where(F.col(pheno).isNotNull())
    row = p.agg(F.bool_and(F.floor(pheno) == F.col(pheno)).alias("whole"), F.max(pheno).alias("top")).first()
    if row["whole"] is None or not row["whole"]:
        return "continuous"
    return "case-control" if row["top"] <= 2 else "categorical"


def oneway(g: GenotypeSet, marker: str, pheno: str = "pheno") -> DataFrame:
    """Samples with their genotype at a marker and their phenotype."""
    return labelled_calls(g, [marker]).select("iid", "genotype", F.col(pheno).alias("pheno"))


def oneway_table(g: GenotypeSet, marker: str, pheno: str = "pheno") -> DataFrame:
    """Contingency counts of genotype and phenotype (-9 is missing)."""
    t = oneway(g, marker, pheno).where("pheno is not null and pheno <> -9")
    return t.groupBy("genotype", "pheno").agg(F.count(F.lit(1)).alias("n"))


def twoway(g: GenotypeSet, marker1: str, marker2: str, pheno: str = "pheno") -> DataFrame:
    """By genotypes at two markers: samples and the mean phenotype (case-control as 0/1: penetrance)."""
    t = labelled_calls(g, [marker1, marker2]).groupBy("sample_idx").agg(
        F.max(F.when(F.col("marker") == marker1, F.col("genotype"))).alias("genotype1"),
        F.max(F.when(F.col("marker") == marker2, F.col("genotype"))).alias("genotype2"),
        F.max(pheno).alias("pheno"),
    )
    kind = guess_pheno(g, pheno)
    value = F.when(F.col("pheno") == 2, 1.0).when(F.col("pheno") == 1, 0.0) if kind == "case-control" else F.col("pheno")
    return t.where("genotype1 is not null and genotype2 is not null").groupBy("genotype1", "genotype2").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def mosaic(table: DataFrame, x: str, y: str, n: str = "n") -> DataFrame:
    """Rectangles of a mosaic plot: widths by the shares of ``x``, heights by those of ``y`` within it."""
    whole, within = Window.partitionBy(), Window.partitionBy(x)
    t = table.groupBy(x, y).agg(F.sum(n).alias("n"))
    t = t.withColumns({"cx": F.sum("n").over(within), "all": F.sum("n").over(whole)})
    cols = t.select(x, "cx", "all").distinct().withColumn("xmax", ratio(F.sum("cx").over(Window.orderBy(x)), F.col("all")))
    t = t.join(F.broadcast(cols.select(x, "xmax", ratio(F.col("cx"), F.col("all")).alias("width"))), x)
    ymax = ratio(F.sum("n").over(Window.partitionBy(x).orderBy(y)), F.col("cx"))
    return t.select(x, y, "n", (F.col("xmax") - F.col("width")).alias("xmin"), "xmax", (ymax - ratio(F.col("n"), F.col("cx"))).alias("ymin"), ymax.alias("ymax"))
