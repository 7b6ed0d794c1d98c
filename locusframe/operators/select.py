"""Slicing, accessors, names and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.model import ENCODINGS, GenotypeSet, key_of, table_of


def subset(g: GenotypeSet, predicate: Column | str, by: str = "markers") -> GenotypeSet:
    """Keep the markers (or samples) for which a predicate holds; a null counts as false."""
    kept = table_of(g, by).where(predicate)
    calls = g.calls.join(kept.select(key_of(by)), key_of(by), "left_semi")
    return g.with_(calls=calls, **{by: kept})


def autosomes(g: GenotypeSet) -> GenotypeSet:
    return subset(g, ~F.col("chr").rlike("[YXMPUu]") & F.col("chr").rlike("[0-9]+"))


def xchrom(g: GenotypeSet) -> GenotypeSet:
    return subset(g, F.col("chr").rlike("[X]"))


def ychrom(g: GenotypeSet) -> GenotypeSet:
    return subset(g, F.col("chr").rlike("[Y]"))


def head(g: GenotypeSet, n: int = 10, n_samples: int = 10) -> GenotypeSet:
    """The first markers and samples in their order."""
    m = g.markers.orderBy("marker_idx").limit(n)
    s = g.samples.orderBy("sample_idx").limit(n_samples)
    calls = g.calls.join(F.broadcast(m.select("marker_idx")), "marker_idx", "left_semi").join(F.broadcast(s.select("sample_idx")), "sample_idx", "left_semi")
    return g.with_(markers=m, samples=s, calls=calls)


def sextable(g: GenotypeSet) -> DataFrame:
    """Counts of male, female and unknown."""
    sex = F.coalesce("sex", F.lit(0))
    return g.samples.agg(F.count_if(sex == 1).alias("male"), F.count_if(sex == 2).alias("female"), F.count_if(~sex.isin(1, 2)).alias("unknown"))


def get_call(g: GenotypeSet, markers: list[str] | None = None) -> DataFrame:
    """Long calls with their marker's and sample's columns."""
    return (g if markers is None else subset(g, F.col("marker").isin(*markers))).long()


def get_intensity(g: GenotypeSet, markers: list[str] | None = None) -> DataFrame:
    """Long intensities, with si = sqrt(x^2 + y^2)."""
    return get_call(g, markers).withColumn("si", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))


def drop_intensity(g: GenotypeSet) -> GenotypeSet:
    return g.with_(calls=g.calls.drop("x", "y", "baf", "lrr"))


def has_intensity(g: GenotypeSet) -> bool:
    return {"x", "y"} <= set(g.calls.columns)


def make_unique(names: DataFrame, name: str, order: str) -> DataFrame:
    """Later occurrences of a name get the suffixes .1, .2, ... in order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return names.withColumn(name, F.when(k > 0, F.concat_ws(".", name, k.cast("string"))).otherwise(F.col(name)))


def clean_names(names: DataFrame, name: str, order: str) -> DataFrame:
    """Trim, make unique, and take white space out."""
    trimmed = make_unique(names.withColumn(name, F.trim(name)), name, order)
    return trimmed.withColumn(name, F.regexp_replace(name, r"\s+", ""))


def replace_names(g: GenotypeSet, renames: DataFrame) -> GenotypeSet:
    """Rename samples by a table (iid, new_iid); others keep their names; duplicates are made unique."""
    s = g.samples.join(renames, "iid", "left").withColumn("iid", F.coalesce("new_iid", "iid")).drop("new_iid")
    return g.with_(samples=make_unique(s, "iid", "sample_idx").select(*g.samples.columns))


def replace_map(g: GenotypeSet, new_map: DataFrame) -> GenotypeSet:
    """Keep markers that a new map (marker, chr, chr_order, cM, pos, A1, A2) has too, with its values and its order."""
    own = g.markers.select("marker", F.col("marker_idx").alias("__old"), "filter")
    joined = new_map.join(own, "marker")
    order = Window.orderBy("chr_order", "pos", "marker")
    m = joined.withColumn("marker_idx", F.row_number().over(order) - 1)
    calls = g.calls.withColumnRenamed("marker_idx", "__old").join(m.select("__old", "marker_idx"), "__old").drop("__old")
    return g.with_(markers=m.drop("__old"), calls=calls)


def fix_sex(col: Column) -> Column:
    """f... is 2, m... is 1, anything else 0."""
    return F.when(col.rlike("^[fF]"), 2).when(col.rlike("^[mM]"), 1).otherwise(0)


def make_fam(ids: DataFrame) -> DataFrame:
    """Default sample rows for a table of iid (and sample_idx)."""
    none = F.lit(None).cast("string")
    iid = F.regexp_replace("iid", r"\s+", "")
    return ids.select("sample_idx", iid.alias("iid"), iid.alias("fid"), none.alias("mom"), none.alias("dad"), F.lit(0).alias("sex"), F.lit(None).cast("double").alias("pheno"), F.lit("").alias("filter"))


def convert_names(chrs: Column, to: str = "ucsc") -> Column:
    """Chromosome names between ncbi/ensembl (1, X, MT), ucsc (chr1, chrX, chrM) and plink (1, X, MT) styles."""
    bare = F.regexp_replace(chrs, "^chr", "")
    if to == "ucsc":
        return F.concat(F.lit("chr"), F.when(bare == "MT", "M").otherwise(bare))
    if to in ("ncbi", "ensembl", "plink"):
        return F.when(bare == "M", "MT").otherwise(bare)
    raise ValueError(f"unknown naming style {to!r}")


def unplink_chroms(codes: Column, autosomes: int = 19) -> Column:
    """Numeric codes to chr names: 23 is X, 24 Y, 26 M; null for others."""
    known = {str(i): f"chr{i}" for i in range(1, autosomes + 1)} | {"23": "chrX", "X": "chrX", "24": "chrY", "Y": "chrY", "26": "chrM", "MT": "chrM"}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.try_element_at(table, codes.cast("string"))


def column_quantiles(g: GenotypeSet, q: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles (linear interpolation) of si by sample, and the sample's place in the order of medians."""
    si = get_intensity(g).where("si is not null").groupBy("sample_idx", "iid").agg(F.percentile("si", F.array(*[F.lit(float(x)) for x in (*q, 0.5)])).alias("v"))
    place = F.row_number().over(Window.orderBy(F.element_at("v", len(q) + 1), "sample_idx"))
    ranked = si.withColumn("place", place)
    return ranked.select("iid", "place", F.explode(F.arrays_zip(F.array(*[F.lit(float(x)) for x in q]).alias("q"), F.slice("v", 1, len(q)).alias("value"))).alias("z")).select("iid", "place", F.col("z.q").alias("q"), F.col("z.value").alias("value"))


def summary(g: GenotypeSet) -> DataFrame:
    """One row: sizes, observed cells, sexes and flagged rows."""
    m = g.markers.agg(F.count(F.lit(1)).alias("n_markers"), F.count_if(F.length("filter") > 0).alias("markers_flagged"))
    s = g.samples.agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.length("filter") > 0).alias("samples_flagged"), F.count_if(F.col("sex") == 1).alias("male"), F.count_if(F.col("sex") == 2).alias("female"))
    c = g.observed().join(g.markers.select("marker_idx"), "marker_idx", "left_semi").join(g.samples.select("sample_idx"), "sample_idx", "left_semi").agg(F.count(F.lit(1)).alias("n_calls"))
    return m.crossJoin(s).crossJoin(c)


def markers_per_chromosome(g: GenotypeSet) -> DataFrame:
    return g.markers.groupBy("chr").agg(F.count(F.lit(1)).alias("n"))


def validate(g: GenotypeSet) -> DataFrame:
    """Constraint checks: (check, n_bad), n_bad 0 where the constraint holds."""

    def bad(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n_bad")) if rows.columns else rows

    allowed = {"01": (0, 1, 2), "relative": (0, 1, 2), "parent": (0, 1, 2)}.get(g.alleles)
    checks = [
        bad("marker names unique", g.markers.groupBy("marker").count().where("count > 1")),
        bad("sample names unique", g.samples.groupBy("iid").count().where("count > 1")),
        bad("marker order unique", g.markers.groupBy("marker_idx").count().where("count > 1")),
        bad("cells unique", g.calls.groupBy("marker_idx", "sample_idx").count().where("count > 1")),
        bad("calls have a marker", g.calls.join(g.markers, "marker_idx", "left_anti")),
        bad("calls have a sample", g.calls.join(g.samples, "sample_idx", "left_anti")),
        bad("alleles differ", g.markers.where("A1 = A2")),
        bad("cM not negative", g.markers.where("cM < 0")),
        bad("filters not null", g.markers.where("filter is null").select("filter").unionByName(g.samples.where("filter is null").select("filter"))),
        bad("sex known code", g.samples.where("sex is null or sex not in (0, 1, 2)")),
    ]
    if allowed:
        checks.append(bad("dosage in range", g.observed().where(~F.col("dosage").isin(*allowed))))
    if has_intensity(g):
        checks.append(bad("intensities paired", g.calls.where(F.col("x").isNull() != F.col("y").isNull())))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def check_encoding(g: GenotypeSet, alleles: str = "auto") -> str:
    """The encoding of a set's calls, resolved: numeric codes with alleles in the map are 01, else relative; raises if a stated one fails."""
    native = dict(g.calls.dtypes).get("dosage") == "string" or "dosage" not in g.calls.columns
    if alleles != "auto":
        if alleles not in ENCODINGS or (alleles == "native") != native:
            raise ValueError(f"calls do not fit encoding {alleles!r}")
        return alleles
    if native:
        return "native"
    if not g.observed().where(~F.col("dosage").isin(0, 1, 2)).isEmpty():
        raise ValueError("dosages other than 0, 1 and 2")
    return "01" if {"A1", "A2"} <= set(g.markers.columns) and g.markers.where("A1 is null or A2 is null").isEmpty() else "relative"
