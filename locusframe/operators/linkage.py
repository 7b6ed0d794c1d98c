"""Sequential and iterative operators on linkage disequilibrium."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet


def kept_of(table: pa.Table, window: int, step: int, vif: float) -> pa.Table:
    """The markers of one chromosome's cells (marker_idx, sample_idx, dosage) that are kept."""
    m, s, d = (table.column(c).to_numpy() for c in ("marker_idx", "sample_idx", "dosage"))
    order = np.lexsort((s, m))
    m, s, d = m[order], s[order], d[order].astype(float)
    markers, start = np.unique(m, return_index=True)
    edge = np.append(start, len(m))
    n = np.diff(edge)
    d -= np.repeat(np.add.reduceat(d, start) / n, n)  # a missing call is the mean, so it is 0 here and needs no cell
    alive = np.add.reduceat(d * d, start) > 1e-12 * n

    def correlations(here: list[int]) -> np.ndarray:
        """Of a few markers, over the samples that any of them has."""
        at = np.concatenate([np.arange(edge[k], edge[k + 1]) for k in here])
        who, row = np.unique(s[at], return_inverse=True)
        x = np.zeros((len(who), len(here)))
        x[row, np.repeat(np.arange(len(here)), n[here])] = d[at]
        x /= np.sqrt((x * x).sum(0))
        return np.clip(x.T @ x, -1, 1)

    for lo in range(0, len(markers), step):
        here = [k for k in range(lo, min(lo + window, len(markers))) if alive[k]]
        every = correlations(here) if len(here) > 1 else None
        kept = list(range(len(here)))
        while len(kept) > 1:
            r = every[np.ix_(kept, kept)]
            factor = np.diag(np.linalg.pinv(r))
            worst = int(np.argmax(factor))
            near = np.abs(r - np.eye(len(kept))).max(0)
            if near.max() > 1 - 1e-9:  # exact copies: the inverse says nothing
                worst = int(np.flatnonzero(near > 1 - 1e-9)[-1])
            elif factor[worst] <= vif:
                break
            alive[here[kept.pop(worst)]] = False
        if lo + window >= len(markers):
            break
    return pa.table([pa.array(markers[alive].astype(np.int32))], names=["marker_idx"])


def prune(g: GenotypeSet, window: int = 50, step: int = 5, vif: float = 2.0) -> GenotypeSet:
    """Keep markers so that none in a sliding window has a variance inflation factor above ``vif``.

    Chromosomes are independent and each is one group: its calls (missing: the
    mean) are held by one task, as the sliding window needs, but as they are,
    sparse; only a window's markers become a matrix.
    """
    cells = g.observed().join(F.broadcast(g.markers.select("marker_idx", "chr")), "marker_idx").select("chr", "marker_idx", "sample_idx", "dosage")

    kept = cells.groupBy("chr").applyInArrow(lambda t: kept_of(t, window, step, vif), "marker_idx int")
    return g.with_(markers=g.markers.join(kept, "marker_idx", "left_semi"), calls=g.calls.join(kept, "marker_idx", "left_semi"))


def ld_table(g: GenotypeSet, target: str | list[str], region: str | None = None) -> DataFrame:
    """Counts of genotype pairs of one marker with each other marker: m2 and c00 ... c22.

    With a list of markers a row begins with ``target``.  ``region``: a
    condition on the map that the other markers meet.
    """
    names = [target] if isinstance(target, str) else list(target)
    t = g.markers.where(F.col("marker").isin(names)).select(F.col("marker_idx").alias("m1"), F.col("marker").alias("target"))
    one = g.observed().join(F.broadcast(t), F.col("marker_idx") == F.col("m1")).select("sample_idx", "m1", "target", F.col("dosage").alias("d1"))
    other = g.observed() if region is None else g.observed().join(F.broadcast(g.markers.where(region).select("marker_idx")), "marker_idx", "left_semi")
    # the few markers asked for: a list of calls a sample
    other = other.join(F.broadcast(one), "sample_idx").where("marker_idx <> m1")
    out = other.groupBy("target", F.col("marker_idx").alias("m2")).agg(*[F.count_if((F.col("d1") == a) & (F.col("dosage") == b)).alias(f"c{a}{b}") for a in (0, 1, 2) for b in (0, 1, 2)])
    return out.drop("target") if isinstance(target, str) else out


def haplotype_em(c: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """r2 and D' of pairs of loci from their 3 x 3 genotype counts (pairs x 3 x 3), by expectation maximisation over phases."""
    c = np.asarray(c, float).reshape(-1, 3, 3)
    n = 2 * c.sum((1, 2))
    # sure haplotypes: those of samples in which not both loci are heterozygous; a genotype holds 2 - g and g copies
    copies = np.array([[2.0, 0.0], [1.0, 1.0], [0.0, 2.0]])
    known = c.copy()
    known[:, 1, 1] = 0
    both = c[:, 1, 1]
    sure = np.einsum("nab,ai,bj->nij", known, copies, copies) / 2
    with np.errstate(all="ignore"):
        p = (sure + both[:, None, None] / 2) / n[:, None, None]
        for _ in range(rounds):
            cis, trans = p[:, 0, 0] * p[:, 1, 1], p[:, 0, 1] * p[:, 1, 0]
            share = np.where(cis + trans == 0, 0.5, cis / (cis + trans))
            phased = np.stack([np.stack([share, 1 - share], 1), np.stack([1 - share, share], 1)], 1)
            new = (sure + both[:, None, None] * phased) / n[:, None, None]
            moved = np.abs(new - p).max((1, 2)) >= 1e-13
            p = np.where(moved[:, None, None], new, p)  # a pair stops by itself, whatever else is in the batch
            if not moved.any():
                break
        pa_, pb = p[:, 1].sum(1), p[:, :, 1].sum(1)
        d = p[:, 1, 1] - pa_ * pb
        var = pa_ * (1 - pa_) * pb * (1 - pb)
        most = np.where(d > 0, np.minimum(pa_ * (1 - pb), (1 - pa_) * pb), np.minimum(pa_ * pb, (1 - pa_) * (1 - pb)))
        return np.where(var > 0, d * d / var, np.nan), np.where(most > 0, np.abs(d) / most, np.nan)


def ld_with(g: GenotypeSet, target: str | list[str], region: str | None = None, r2_floor: float | None = None) -> DataFrame:
    """Haplotype r2 and D' of one marker (or each of several) with all others, or those of a region; ``r2_floor`` leaves weaker pairs out."""
    names = [f"c{a}{b}" for a in (0, 1, 2) for b in (0, 1, 2)]
    t = ld_table(g, target, region)
    ids = [c for c in t.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = haplotype_em(np.stack([b.column(c).to_numpy() for c in names], 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ids), *(pa.array(x, from_pandas=True) for x in out)], names=[*ids, "r2", "dprime"])

    found = t.select(*ids, *names).mapInArrow(run, ", ".join(["target string"] * (len(ids) - 1) + ["m2 int, r2 double, dprime double"])).withColumnRenamed("m2", "marker_idx")
    return found if r2_floor is None else found.where(F.col("r2") >= r2_floor)
