"""Genotype sets from matrices and tables, with checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet
from locusframe.operators.combine import require_none
from locusframe.operators.encode import dosage_of
from locusframe.operators.select import check_encoding, make_fam


def genotypes(cells: DataFrame, markers: DataFrame, samples: DataFrame | None = None, alleles: str = "auto", normalized: bool = False) -> GenotypeSet:
    """A set from long cells (marker, iid, and call or dosage; optionally x, y, baf, lrr), a map and sample rows.

    Markers are numbered by chr_order, pos, cM and name, samples by name where
    ``samples`` has no order of its own (sample_idx).  Names must be unique,
    genetic positions not negative, and each cell's marker and sample known;
    alleles are turned to upper case and white space is taken from sample ids.
    Native calls are kept as dosages of A2 and the encoding is resolved.
    """
    cells = cells.withColumn("iid", F.regexp_replace("iid", r"\s+", ""))
    if samples is None:
        ids = cells.select("iid").distinct().withColumn("sample_idx", F.row_number().over(Window.orderBy("iid")) - 1)
        samples = make_fam(ids)
    else:
        samples = samples.withColumn("iid", F.regexp_replace("iid", r"\s+", ""))
        if "sample_idx" not in samples.columns:
            samples = samples.withColumn("sample_idx", F.row_number().over(Window.orderBy("iid")) - 1)
        if "filter" not in samples.columns:
            samples = samples.withColumn("filter", F.lit(""))
    m = markers.withColumns({a: F.upper(a) for a in ("A1", "A2") if a in markers.columns})
    m = m.withColumn("marker_idx", F.row_number().over(Window.orderBy("chr_order", "pos", "cM", "marker")) - 1)
    if "filter" not in m.columns:
        m = m.withColumn("filter", F.lit(""))
    require_none(m.groupBy("marker").count().where("count > 1"), "marker names are not unique")
    require_none(samples.groupBy("iid").count().where("count > 1"), "sample names are not unique")
    require_none(m.where("cM < 0"), "genetic positions must not be negative")
    require_none(cells.select("marker").distinct().join(m, "marker", "left_anti"), "cells have markers that the map lacks")
    require_none(cells.select("iid").distinct().join(samples, "iid", "left_anti"), "cells have samples that the sample table lacks")
    keys = cells.join(F.broadcast(m.select("marker", "marker_idx", "A1", "A2")), "marker").join(F.broadcast(samples.select("iid", "sample_idx")), "iid")
    if "call" in cells.columns:
        keys = keys.withColumn("dosage", dosage_of(F.upper("call"), F.col("A1"), F.col("A2")))
    extra = [c for c in ("x", "y", "baf", "lrr") if c in cells.columns]
    g = GenotypeSet(m, samples, keys.select("marker_idx", "sample_idx", "dosage", *extra), "01", normalized)
    return g.with_(alleles="01" if "call" in cells.columns else check_encoding(g, alleles))


def from_matrix(spark: SparkSession, rows: Sequence[Sequence[int | None]], marker_names: Sequence[str], sample_names: Sequence[str], markers: DataFrame, samples: DataFrame | None = None) -> GenotypeSet:
    """A set from a small dense matrix of dosages, a row per marker."""
    if len(rows) != len(marker_names) or any(len(r) != len(sample_names) for r in rows):
        raise ValueError("the matrix does not have the names' dimensions")
    cells = [(m, s, r[j]) for m, r in zip(marker_names, rows, strict=True) for j, s in enumerate(sample_names)]
    return genotypes(spark.createDataFrame(cells, "marker string, iid string, dosage int"), markers, samples)
