"""The genotype model: three relational tables and a few scalars.

``markers``  marker_idx, chr, chr_order, marker, cM, pos, A1, A2, filter, ...
``samples``  sample_idx, iid, fid, mom, dad, sex, pheno, filter, ...
``calls``    marker_idx, sample_idx, dosage, x, y, ...

Calls are sparse: a cell that has no row, or whose dosage is null, is missing.
Counts of missing cells are therefore the other dimension's size less the
observed cells, and the markers x samples grid is never built.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENCODINGS = ("native", "01", "relative", "parent")


@dataclass(frozen=True)
class GenotypeSet:
    """Genotypes of some samples at some markers."""

    markers: DataFrame
    samples: DataFrame
    calls: DataFrame
    alleles: str = "01"
    normalized: bool = False
    meta: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.alleles not in ENCODINGS:
            raise ValueError(f"unknown allele encoding {self.alleles!r}")

    def with_(self, **changes: object) -> GenotypeSet:
        return replace(self, **changes)

    def observed(self) -> DataFrame:
        """Cells with a call."""
        return self.calls.where(F.col("dosage").isNotNull())

    def long(self) -> DataFrame:
        """The canonical view: calls with their marker's and sample's columns."""
        markers = self.markers.withColumnRenamed("filter", "marker_filter")
        samples = self.samples.withColumnRenamed("filter", "sample_filter")
        return self.calls.join(markers, "marker_idx").join(samples, "sample_idx")

    def dims(self) -> DataFrame:
        """One row: n_markers, n_samples."""
        m = self.markers.agg(F.count(F.lit(1)).alias("n_markers"))
        return m.crossJoin(self.samples.agg(F.count(F.lit(1)).alias("n_samples")))


def other_dim(g: GenotypeSet, by: str) -> DataFrame:
    """One row with ``n``: how many cells each marker (or sample) has."""
    return (g.samples if by == "markers" else g.markers).agg(F.count(F.lit(1)).alias("n"))


def key_of(by: str) -> str:
    if by not in ("markers", "samples"):
        raise ValueError(f"by must be 'markers' or 'samples', not {by!r}")
    return "marker_idx" if by == "markers" else "sample_idx"


def table_of(g: GenotypeSet, by: str) -> DataFrame:
    return g.markers if by == "markers" else g.samples


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
