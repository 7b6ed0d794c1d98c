"""Association tests and marker filters.

Test statistics come from one aggregation by marker; only what has no closed
form (exact Hardy-Weinberg, logistic regression, permutations) runs in Arrow
batches over the aggregated counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet, ratio
from locusframe.operators.stats import count_calls


def case_control_counts(g: GenotypeSet, pheno: str = "pheno") -> DataFrame:
    """Genotype counts of cases (2) and controls (1) by marker: u0..u2, a0..a2."""
    p = g.samples.where(F.col(pheno).isin(1, 2)).select("sample_idx", F.col(pheno).alias("p"))
    t = g.observed().join(F.broadcast(p), "sample_idx")
    return t.groupBy("marker_idx").agg(*[F.count_if((F.col("p") == k) & (F.col("dosage") == d)).alias(f"{n}{d}") for k, n in ((2, "a"), (1, "u")) for d in (0, 1, 2)])


def assoc_allelic(g: GenotypeSet, pheno: str = "pheno") -> DataFrame:
    """Allelic chi-square of a case-control trait, odds ratio and frequencies of the counted allele."""
    t = case_control_counts(g, pheno)
    a, b = F.col("a1") + 2 * F.col("a2"), F.col("a1") + 2 * F.col("a0")
    c, d = F.col("u1") + 2 * F.col("u2"), F.col("u1") + 2 * F.col("u0")
    t = t.select("marker_idx", *[x.cast("double").alias(n) for x, n in ((a, "a"), (b, "b"), (c, "c"), (d, "d"))])
    a, b, c, d = (F.col(x) for x in "abcd")
    chi = F.try_divide((a + b + c + d) * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d))
    return t.select("marker_idx", F.try_divide(a, a + b).alias("f_case"), F.try_divide(c, c + d).alias("f_control"), chi.alias("chisq"), F.try_divide(a * d, b * c).alias("odds_ratio"))


def assoc_linear(g: GenotypeSet, pheno: str = "qpheno", standard: bool = False) -> DataFrame:
    """Regression of a quantitative trait on dosage: n, beta, standard error, t.

    ``standard``: of the standardised trait on the standardised dosage, over a marker's calls.
    """
    p = g.samples.where(F.col(pheno).isNotNull()).select("sample_idx", F.col(pheno).cast("double").alias("v"))
    # centred on the mean of the trait, so that sums of squares keep their digits
    centre = F.broadcast(p.agg(F.avg("v").alias("centre")))
    p = p.crossJoin(centre).select("sample_idx", (F.col("v") - F.col("centre")).alias("v"))
    d = F.col("dosage").cast("double")
    t = g.observed().join(F.broadcast(p), "sample_idx").groupBy("marker_idx").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(d).alias("sx"), F.sum("v").alias("sy"), F.sum(d * d).alias("sxx"), F.sum(F.col("v") * F.col("v")).alias("syy"), F.sum(d * F.col("v")).alias("sxy"))
    n = F.col("n")
    t = t.withColumns({"cxx": F.col("sxx") - F.col("sx") * F.col("sx") / n, "cyy": F.col("syy") - F.col("sy") * F.col("sy") / n, "cxy": F.col("sxy") - F.col("sx") * F.col("sy") / n})
    beta = F.try_divide(F.col("cxy"), F.col("cxx"))
    se = F.sqrt(F.try_divide(F.greatest(F.col("cyy") - beta * F.col("cxy"), F.lit(0.0)), (n - 2) * F.col("cxx")))
    unit = F.sqrt(F.try_divide(F.col("cxx"), F.col("cyy"))) if standard else F.lit(1.0)
    return t.select("marker_idx", n.cast("long").alias("n"), (beta * unit).alias("beta"), (se * unit).alias("se"), F.try_divide(beta, se).alias("t"))


def _by_batch(t: DataFrame, names: list[str], fn, schema: str) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.stack([b.column(c).to_numpy() for c in names], 1)
            yield pa.RecordBatch.from_arrays([b.column("marker_idx"), *(pa.array(c) for c in fn(values))], names=[x.split()[0] for x in schema.split(", ")])

    return t.select("marker_idx", *names).mapInArrow(run, schema)


def assoc_logistic(g: GenotypeSet, pheno: str = "pheno", rounds: int = 25) -> DataFrame:
    """Logistic regression of case status on dosage by iteratively reweighted least squares on genotype counts.

    beta, standard error and z; null where a coefficient has no finite estimate.
    """

    def fit(v: np.ndarray) -> list[np.ndarray]:
        case, n = v[:, :3].astype(float), v[:, :3] + v[:, 3:].astype(float)
        x = np.array([0.0, 1.0, 2.0])
        b0, b1 = np.zeros(len(v)), np.zeros(len(v))
        with np.errstate(all="ignore"):
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(b0[:, None] + b1[:, None] * x, -30, 30)))
                w, r = n * p * (1 - p), case - n * p
                s0, s1, s2 = w.sum(1), (w * x).sum(1), (w * x * x).sum(1)
                g0, g1, det = r.sum(1), (r * x).sum(1), s0 * s2 - s1 * s1
                b0, b1 = b0 + (s2 * g0 - s1 * g1) / det, b1 + (s0 * g1 - s1 * g0) / det
            se = np.sqrt(s0 / det)
            bad = ~np.isfinite(b1) | ~np.isfinite(se) | (np.abs(b1) > 15)
        out = [np.where(bad, np.nan, z) for z in (b1, se, b1 / se)]
        return [pa.array(z, pa.float64(), from_pandas=True) for z in out]

    return _by_batch(case_control_counts(g, pheno), ["a0", "a1", "a2", "u0", "u1", "u2"], fit, "marker_idx int, beta double, se double, z double")


def hwe_exact(g: GenotypeSet, mid_p: bool = False) -> DataFrame:
    """Exact Hardy-Weinberg test of each marker: the probability of heterozygote counts no likelier than the one seen."""

    def test(v: np.ndarray) -> list[pa.Array]:
        v = v.astype(np.int64)
        n, seen = v.sum(1), v[:, 1]
        rare = 2 * np.minimum(v[:, 0], v[:, 2]) + seen
        log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, (n.max() if len(n) else 0) + 1)))])
        # the possible heterozygote counts of all markers, one after the other
        many = rare // 2 + 1
        row, first = np.repeat(np.arange(len(v)), many), np.cumsum(many) - many
        het = 2 * (np.arange(many.sum()) - first[row]) + rare[row] % 2
        hom = (rare[row] - het) // 2
        logp = het * np.log(2.0) - log_factorial[het] - log_factorial[hom] - log_factorial[n[row] - het - hom]
        p = np.exp(logp - np.maximum.reduceat(logp, first)[row]) if len(v) else logp
        own = p[first + (seen - rare % 2) // 2]
        whole = np.bincount(row, p, len(v))
        total = np.bincount(row, np.where(p <= own[row] * (1 + 1e-9), p, 0.0), len(v))
        value = np.minimum(1.0, (total - own / 2 if mid_p else total) / whole)
        return [pa.array(np.where(n > 0, value, np.nan), pa.float64(), from_pandas=True)]

    return _by_batch(count_calls(g), ["n0", "n1", "n2"], test, "marker_idx int, p double")


def assoc_permuted(g: GenotypeSet, pheno: str = "pheno", permutations: int = 100_000, seed: int = 1, enough: int = 10) -> DataFrame:
    """Empirical p of the allelic chi-square under permuted labels, adaptively by marker.

    A marker is permuted in growing rounds until ``enough`` permutations reach
    its chi-square, or ``permutations`` are done: (r + 1) / (n + 1) of the n
    done.  Permuting the labels of all samples, called at the marker or not,
    deals the cases over its genotypes and missing calls as a multivariate
    hypergeometric draw, so that a marker's counts and the two totals are enough.
    """
    # two numbers over the small dimension
    known, cases = g.samples.where(F.col(pheno).isin(1, 2)).agg(F.count(F.lit(1)), F.count_if(F.col(pheno) == 2)).first()

    def chi_square(case: np.ndarray, n: np.ndarray) -> np.ndarray:
        copies, every, total = case[..., 1] + 2.0 * case[..., 2], 2.0 * case.sum(-1), n[1] + 2.0 * n[2]
        a, b, c = copies, every - copies, total - copies
        d = 2.0 * n.sum() - every - c
        with np.errstate(all="ignore"):
            return (a + b + c + d) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))

    def one(marker: int, v: np.ndarray) -> float:
        n = v[:3] + v[3:]
        seen = chi_square(v[:3].astype(float), n)
        if not np.isfinite(seen):
            return np.nan
        rng = np.random.default_rng((seed, marker))
        done = reached = 0
        while done < permutations and reached < enough:
            size = min(max(100, done), 10_000, permutations - done)
            drawn = rng.multivariate_hypergeometric([*n, known - n.sum()], cases, size)
            reached += int(np.sum(chi_square(drawn[:, :3].astype(float), n) >= seen * (1 - 1e-12)))
            done += size
        return (reached + 1) / (done + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("marker_idx").to_numpy()
            counts = np.stack([b.column(c).to_numpy() for c in names], 1)
            p = np.array([one(int(i), v) for i, v in zip(ids, counts, strict=True)], float)
            yield pa.RecordBatch.from_arrays([b.column("marker_idx"), pa.array(p, pa.float64(), from_pandas=True)], names=["marker_idx", "p"])

    names = ["a0", "a1", "a2", "u0", "u1", "u2"]
    return case_control_counts(g, pheno).select("marker_idx", *names).mapInArrow(run, "marker_idx int, p double")


def transmissions(g: GenotypeSet, trios: DataFrame) -> DataFrame:
    """What heterozygous parents gave in each informative trio: marker_idx, hets, given."""
    c = g.observed().select("marker_idx", "sample_idx", "dosage")
    t = F.broadcast(trios)
    k = c.join(t, F.col("sample_idx") == F.col("kid")).select("marker_idx", "kid", "mom", "dad", F.col("dosage").alias("k"))
    mom = c.select("marker_idx", F.col("sample_idx").alias("mom"), F.col("dosage").alias("m"))
    dad = c.select("marker_idx", F.col("sample_idx").alias("dad"), F.col("dosage").alias("d"))
    j = k.join(mom, ["marker_idx", "mom"]).join(dad, ["marker_idx", "dad"])
    kk, m, d = F.col("k"), F.col("m"), F.col("d")
    hets = (m == 1).cast("int") + (d == 1).cast("int")
    # what heterozygous parents gave: the kid's copies less those of homozygous parents
    given = kk - F.when(m == 2, 1).otherwise(0) - F.when(d == 2, 1).otherwise(0)
    return j.select("marker_idx", hets.alias("hets"), given.alias("given")).where("hets > 0 and given >= 0 and given <= hets")


def tdt_permuted(g: GenotypeSet, trios: DataFrame, permutations: int = 100_000, seed: int = 1, enough: int = 10) -> DataFrame:
    """Empirical p of the transmission test, adaptively by marker as in :func:`assoc_permuted`.

    Under the null each informative trio's transmissions could as well have
    been the other alleles: the difference of a trio (one or two alleles)
    changes its sign with probability 1/2, so the numbers of trios with a
    difference of one and of two are enough.
    """
    by = F.abs(2 * F.col("given") - F.col("hets"))
    t = transmissions(g, trios).groupBy("marker_idx").agg(F.sum(2 * F.col("given") - F.col("hets")).alias("d"), F.count_if(by == 1).alias("ones"), F.count_if(by == 2).alias("twos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = []
            for marker, d, ones, twos in zip(*(b.column(c).to_pylist() for c in ("marker_idx", "d", "ones", "twos")), strict=True):
                rng = np.random.default_rng((seed, marker))
                done = reached = 0
                while done < permutations and reached < enough:
                    size = min(max(100, done), 10_000, permutations - done)
                    drawn = 2 * rng.binomial(ones, 0.5, size) - ones + 2 * (2 * rng.binomial(twos, 0.5, size) - twos)
                    reached += int((np.abs(drawn) >= abs(d)).sum())
                    done += size
                p.append((reached + 1) / (done + 1))
            yield pa.RecordBatch.from_arrays([b.column("marker_idx"), pa.array(p, pa.float64())], names=["marker_idx", "p"])

    return t.mapInArrow(run, "marker_idx int, p double")


def tdt(g: GenotypeSet, trios: DataFrame) -> DataFrame:
    """Transmission disequilibrium: counts of the allele transmitted (t) and not (u) by heterozygous parents.

    ``trios``: kid, mom, dad (sample_idx).  Trios with a Mendelian error or a
    missing call at a marker do not count there.
    """
    j = transmissions(g, trios)
    s = j.groupBy("marker_idx").agg(F.sum("given").alias("t"), F.sum(F.col("hets") - F.col("given")).alias("u"))
    diff = F.col("t") - F.col("u")
    return s.select("marker_idx", "t", "u", ratio(diff * diff, F.col("t") + F.col("u")).alias("chisq"), ratio(F.col("t"), F.col("u")).alias("odds_ratio"))


def filter_markers(
    g: GenotypeSet,
    maf: float | None = None,
    geno_missing: float | None = None,
    mind: float | None = None,
    hwe: float | None = None,
    chr: str | None = None,
    start: int | None = None,
    end: int | None = None,
    mid_p: bool = False,
    keep_samples: str | Column | None = None,
    remove_samples: str | Column | None = None,
    attribute: str | Column | None = None,
) -> GenotypeSet:
    """Region, missingness, frequency and Hardy-Weinberg filters, samples first.

    ``keep_samples`` and ``remove_samples`` are conditions on the samples'
    columns (names, families, any attribute), ``attribute`` one on the map's.
    """
    from locusframe.operators.select import subset

    def condition(c: str | Column) -> Column:
        return F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False))

    if keep_samples is not None:
        g = subset(g, condition(keep_samples), "samples")
    if remove_samples is not None:
        g = subset(g, ~condition(remove_samples), "samples")
    if attribute is not None:
        g = subset(g, condition(attribute))

    region = F.lit(True)
    if chr is not None:
        region = region & (F.col("chr") == chr)
    if start is not None:
        region = region & (F.col("pos") >= start)
    if end is not None:
        region = region & (F.col("pos") <= end)
    g = subset(g, region)
    if mind is not None:
        ok = count_calls(g, "samples").where(ratio(F.col("n_missing"), F.col("n")) <= mind).select("sample_idx")
        g = g.with_(samples=g.samples.join(ok, "sample_idx", "left_semi"), calls=g.calls.join(F.broadcast(ok), "sample_idx", "left_semi"))
    keep = count_calls(g)
    seen = F.col("n0") + F.col("n1") + F.col("n2")
    rule = F.lit(True)
    if geno_missing is not None:
        rule = rule & (ratio(F.col("n_missing"), F.col("n")) <= geno_missing)
    if maf is not None:
        p = ratio(F.col("n1") + 2 * F.col("n2"), 2 * seen)
        rule = rule & (F.least(p, 1 - p) >= maf)
    keep = keep.where(rule).select("marker_idx")
    if hwe is not None:
        keep = keep.join(hwe_exact(g, mid_p).where(F.col("p") >= hwe), "marker_idx", "left_semi")
    return g.with_(markers=g.markers.join(keep, "marker_idx", "left_semi"), calls=g.calls.join(keep, "marker_idx", "left_semi"))


def chi_square_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of a two by two table, null where a margin is 0."""
    return F.try_divide((a + b + c + d) * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d))


def assoc_models(g: GenotypeSet, pheno: str = "pheno") -> DataFrame:
    """Chi-squares of case-control status with genotype under the dominant and recessive models, the trend, and the general model (two degrees of freedom)."""
    t = case_control_counts(g, pheno)
    t = t.select("marker_idx", *[F.col(c).cast("double").alias(c) for c in t.columns if c != "marker_idx"])
    a, u = ([F.col(f"{k}{d}") for d in (0, 1, 2)] for k in "au")
    n = [x + y for x, y in zip(a, u, strict=True)]
    cases, every = a[0] + a[1] + a[2], n[0] + n[1] + n[2]
    copies, given = n[1] + 2 * n[2], a[1] + 2 * a[2]
    lead = every * given - cases * copies
    trend = F.try_divide(every * lead * lead, cases * (every - cases) * (every * (n[1] + 4 * n[2]) - copies * copies))
    general = F.lit(0.0)
    for x, total in ((a, cases), (u, every - cases)):
        for k in (0, 1, 2):
            expected = F.try_divide(total * n[k], every)
            general = general + F.coalesce(F.try_divide((x[k] - expected) * (x[k] - expected), expected), F.lit(0.0))
    return t.select(
        "marker_idx",
        chi_square_2x2(a[1] + a[2], a[0], u[1] + u[2], u[0]).alias("dominant"),
        chi_square_2x2(a[2], a[0] + a[1], u[2], u[0] + u[1]).alias("recessive"),
        trend.alias("trend"),
        general.alias("general"),
    )
