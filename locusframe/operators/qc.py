"""Quality control: flags, filters, and sex from calls or intensities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet, key_of, ratio, table_of
from locusframe.operators.select import autosomes, get_intensity, subset, ychrom
from locusframe.operators.stats import count_calls, summarize_calls


def threshold(samples: DataFrame, name: str, value: float | dict[str, float], default: float) -> DataFrame:
    """A column with one value for all, or one by family; families that aren't named have the default."""
    if not isinstance(value, dict):
        return samples.withColumn(name, F.lit(float(value)))
    table = F.create_map(*[F.lit(x) for k, v in value.items() for x in (k, float(v))])
    return samples.withColumn(name, F.coalesce(F.try_element_at(table, F.col("fid")), F.lit(float(default))))


def intensity_vs_ref(g: GenotypeSet, ref: DataFrame) -> DataFrame:
    """One-sided Kolmogorov-Smirnov distance of each sample's si from a reference (column ``si``).

    D = max over u of F_ref(u) - F_sample(u), 0 at least.
    """
    si = get_intensity(g).where("si is not null").select("sample_idx", "si")
    ref = ref.where("si is not null").groupBy("si").agg(F.count(F.lit(1)).alias("r"))
    mine = si.groupBy("sample_idx", "si").agg(F.count(F.lit(1)).alias("s"))
    ids = F.broadcast(si.select("sample_idx").distinct())
    both = mine.select("sample_idx", "si", "s", F.lit(0).cast("long").alias("r")).unionByName(ref.crossJoin(ids).select("sample_idx", "si", F.lit(0).cast("long").alias("s"), "r"))
    points = both.groupBy("sample_idx", "si").agg(F.sum("s").alias("s"), F.sum("r").alias("r"))
    upto, every = Window.partitionBy("sample_idx").orderBy("si"), Window.partitionBy("sample_idx")
    d = ratio(F.sum("r").over(upto), F.sum("r").over(every)) - ratio(F.sum("s").over(upto), F.sum("s").over(every))
    return points.withColumn("d", d).groupBy("sample_idx").agg(F.greatest(F.max("d"), F.lit(0.0)).alias("D"))


def append_flags(t: DataFrame, rules: list[tuple[Column, str]], overwrite: bool = False) -> DataFrame:
    """Append a letter to ``filter`` for each rule that holds, in order."""
    old = F.lit("") if overwrite else F.coalesce("filter", F.lit(""))
    return t.withColumn("filter", F.concat(old, *[F.when(F.coalesce(rule, F.lit(False)), letter).otherwise("") for rule, letter in rules]))


def run_sample_qc(
    g: GenotypeSet,
    max_H: float | dict[str, float] = math.inf,
    max_N: float | dict[str, float] = math.inf,
    max_D: float | dict[str, float] = math.inf,
    min_D: float | dict[str, float] = -math.inf,
    ref: DataFrame | None = None,
    apply: bool = False,
    hits: int = 0,
    overwrite: bool = False,
) -> tuple[GenotypeSet, DataFrame]:
    """Flag samples by heterozygotes (H), missing calls (N) and intensity (I); thresholds may be given by family.

    Returns the set with its flags (filtered if ``apply``) and the counts.
    """
    t = g.samples.join(summarize_calls(g, "samples"), "sample_idx")
    for name, value, default in (("max_H", max_H, math.inf), ("max_N", max_N, math.inf), ("max_D", max_D, math.inf), ("min_D", min_D, -math.inf)):
        t = threshold(t, name, value, default)
    t = t.join(intensity_vs_ref(g, ref), "sample_idx", "left") if ref is not None else t.withColumn("D", F.lit(None).cast("double"))
    rules = [(F.col("H") > F.col("max_H"), "H"), (F.col("N") > F.col("max_N"), "N"), ((F.col("D") > F.col("max_D")) | (F.col("D") < F.col("min_D")), "I")]
    t = append_flags(t, rules, overwrite)
    flagged = g.with_(samples=t.select(*g.samples.columns))
    result = t.select("sample_idx", "iid", "A", "B", "H", "N", "D", "filter", (F.length("filter") > hits).alias("flagged"))
    return (apply_filters(flagged, "samples", hits) if apply else flagged), result


def run_marker_qc(g: GenotypeSet, max_H: float = math.inf, max_N: float = math.inf, min_hom: float = 0, apply: bool = False, hits: int = 0, overwrite: bool = False) -> tuple[GenotypeSet, DataFrame]:
    """Flag markers by heterozygotes (H), missing calls (N) and too few homozygotes (F)."""
    t = g.markers.join(summarize_calls(g, "markers"), "marker_idx")
    rules = [(F.col("H") > F.lit(float(max_H)), "H"), (F.col("N") > F.lit(float(max_N)), "N"), (F.col("A") + F.col("B") <= F.lit(float(min_hom)), "F")]
    t = append_flags(t, rules, overwrite)
    flagged = g.with_(markers=t.select(*g.markers.columns))
    result = t.select("marker_idx", "marker", "A", "B", "H", "N", "filter", (F.length("filter") > hits).alias("flagged"))
    return (apply_filters(flagged, "markers", hits) if apply else flagged), result


def is_filtered(g: GenotypeSet, by: str = "markers", hits: int = 0) -> DataFrame:
    return table_of(g, by).select(key_of(by), (F.length(F.coalesce("filter", F.lit(""))) > hits).alias("filtered"))


def apply_filters(g: GenotypeSet, apply_to: str = "both", hits: int = 0) -> GenotypeSet:
    """Drop flagged markers, samples or both."""
    passes = F.length(F.coalesce("filter", F.lit(""))) <= hits
    for by in ("markers", "samples"):
        if apply_to in ("both", by):
            g = subset(g, passes, by)
    return g


def predict_sex_ycalls(g: GenotypeSet, min_AB: int = 40, max_N: int = 30) -> DataFrame:
    """1 with enough homozygous calls on Y and few missing, 2 with few and many, else 0."""
    c = count_calls(ychrom(g), "samples")
    ab = F.col("n0") + F.col("n2")
    sex = F.when((ab >= min_AB) & (F.col("n_missing") <= max_N), 1).when((ab < min_AB) & (F.col("n_missing") > max_N), 2).otherwise(0)
    return g.samples.select("sample_idx", "iid").join(c, "sample_idx").select("sample_idx", "iid", sex.alias("predicted"))


# fixed values: by platform and sex the mean (x, y) of mean si on X and Y, and the covariance (xx, xy, yy)
PLATFORMS = {
    "giga": {
        "female": ((1.00179688827984, 0.579627096415587), (0.000777449983304451, 0.000646632991729865, 0.00911353377861309)),
        "male": ((0.816608462699492, 1.00517965688652), (0.000343819755693033, 0.00036077907454159, 0.0107555733491657)),
    },
}
#: Names of the markers on Y whose intensities are used.
CLEAN = "^JAX"


def chromosome_si(g: GenotypeSet, clean: str | None = None) -> DataFrame:
    """Mean si on X and Y by sample; on Y only markers whose name matches ``clean``."""
    si = get_intensity(g)
    on_y = F.col("chr").rlike("[Y]") & (F.col("marker").rlike(clean) if clean else F.lit(True))
    means = si.groupBy("sample_idx").agg(F.avg(F.when(F.col("chr").rlike("[X]"), F.col("si"))).alias("ix"), F.avg(F.when(on_y, F.col("si"))).alias("iy"))
    return g.samples.select("sample_idx", "iid", "fid", "sex").join(means, "sample_idx", "left")


def predict_sex_xy(g: GenotypeSet, platform: str = "giga", clean: str | None = CLEAN, model: dict | None = None) -> DataFrame:
    """Log-likelihood ratio male - female of two bivariate normals, a platform's or those of ``model``; above 0 is 1, else 2."""
    if model is None:
        if platform not in PLATFORMS:
            raise ValueError(f"unknown platform {platform!r}")
        model = PLATFORMS[platform]

    def loglik(kind: str) -> Column:
        (mx, my), (a, b, c) = model[kind]
        det = a * c - b * b
        dx, dy = F.col("ix") - mx, F.col("iy") - my
        return (c * dx * dx - 2 * b * dx * dy + a * dy * dy) * F.lit(-0.5 / det) - F.lit(0.5 * math.log(det))

    t = chromosome_si(g, clean).withColumn("llr", loglik("male") - loglik("female"))
    return t.select("sample_idx", "iid", "ix", "iy", "llr", F.when(F.col("llr") > 0, 1).when(F.col("llr").isNotNull(), 2).alias("predicted"))


def sexysum(g: GenotypeSet, clean: str | None = CLEAN) -> DataFrame:
    """By sample: good calls on Y, heterozygotes on X, mean si on both."""
    on = lambda c: F.col("chr").rlike(f"[{c}]")
    counts = g.observed().join(F.broadcast(g.markers.select("marker_idx", "chr")), "marker_idx").groupBy("sample_idx").agg(F.count_if(on("Y") & F.col("dosage").isin(0, 2)).alias("ygood"), F.count_if(on("X") & (F.col("dosage") == 1)).alias("xhet"))
    zero = F.lit(0).cast("long")
    return chromosome_si(g, clean).join(counts, "sample_idx", "left").select("sample_idx", "iid", "fid", "sex", F.coalesce("ygood", zero).alias("ygood"), F.coalesce("xhet", zero).alias("xhet"), "ix", "iy")


def inbreeding(g: GenotypeSet) -> DataFrame:
    """By sample: observed and expected homozygotes on autosomes, and F = (O - E) / (n - E)."""
    a = autosomes(g)
    c = count_calls(a)
    seen = F.col("n0") + F.col("n1") + F.col("n2")
    p = ratio(F.col("n1") + 2 * F.col("n2"), 2 * seen)
    e = F.lit(1.0) - F.lit(2.0) * p * (F.lit(1.0) - p) * ratio(2 * seen, 2 * seen - 1)
    expected = c.where(seen > 0).select("marker_idx", e.alias("e"))
    t = a.observed().join(expected, "marker_idx").groupBy("sample_idx").agg(F.count_if(F.col("dosage") != 1).alias("o_hom"), F.sum("e").alias("e_hom"), F.count(F.lit(1)).alias("n"))
    return t.select("sample_idx", "o_hom", "e_hom", "n", ratio(F.col("o_hom") - F.col("e_hom"), F.col("n") - F.col("e_hom")).alias("F"))


def population_inbreeding(g: GenotypeSet, by: str = "fid") -> DataFrame:
    """Mean F of each population's samples."""
    f = inbreeding(g).join(F.broadcast(g.samples.select("sample_idx", F.col(by).alias("pop"))), "sample_idx")
    return f.groupBy("pop").agg(F.avg("F").alias("F"), F.count(F.lit(1)).alias("n"))
