"""Selection, encoding, combination, statistics and quality control."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet
from locusframe.operators import combine, encode, qc, select, stats
from locusframe.plans.registry import places, register

CELL = "marker_idx, sample_idx, dosage"
COUNTS = """count(*) filter (dosage = 0) as n0, count(*) filter (dosage = 1) as n1, count(*) filter (dosage = 2) as n2, count(*) - count(dosage) as n_missing, count(*) as n"""


def cells(g: GenotypeSet) -> DataFrame:
    return g.observed().select("marker_idx", "sample_idx", "dosage")


# selection -----------------------------------------------------------------


@register("subset_markers", f"select {CELL} from cube where dosage is not null and chr = 'chr3' and pos > 600000")
def _(g):
    return cells(select.subset(g, (F.col("chr") == "chr3") & (F.col("pos") > 600000)))


@register("subset_samples", f"select {CELL} from cube where dosage is not null and sex = 2 and pheno = 1")
def _(g):
    return cells(select.subset(g, "sex = 2 and pheno = 1", "samples"))


@register("autosomes", f"select {CELL} from cube where dosage is not null and not regexp_matches(chr, '[YXMPUu]') and regexp_matches(chr, '[0-9]+')")
def _(g):
    return cells(select.autosomes(g))


@register("xchrom", f"select {CELL} from cube where dosage is not null and regexp_matches(chr, '[X]')")
def _(g):
    return cells(select.xchrom(g))


@register("ychrom", f"select {CELL} from cube where dosage is not null and regexp_matches(chr, '[Y]')")
def _(g):
    return cells(select.ychrom(g))


@register("head", f"select {CELL} from cube where dosage is not null and marker_idx < 10 and sample_idx < 10")
def _(g):
    return cells(select.head(g))


@register("sextable", "select count(*) filter (sex = 1) as male, count(*) filter (sex = 2) as female, count(*) filter (sex is null or sex not in (1, 2)) as unknown from samples")
def _(g):
    return select.sextable(g)


@register("summary", "select (select count(*) from markers) as n_markers, cast(0 as bigint) as markers_flagged, (select count(*) from samples) as n_samples, cast(0 as bigint) as samples_flagged, (select count(*) from samples where sex = 1) as male, (select count(*) from samples where sex = 2) as female, (select count(dosage) from cube) as n_calls")
def _(g):
    return select.summary(g)


@register("markers_per_chromosome", "select chr, count(*) as n from markers group by chr")
def _(g):
    return select.markers_per_chromosome(g)


@register("get_call", "select marker, chr, pos, A1, A2, iid, fid, sex, dosage from cube where dosage is not null and marker in ('m3', 'm77', 'm181')")
def _(g):
    return select.get_call(g, ["m3", "m77", "m181"]).where("dosage is not null").select("marker", "chr", "pos", "A1", "A2", "iid", "fid", "sex", "dosage")


@register("get_intensity", "select marker, iid, x, y, round(sqrt(x * x + y * y), 9) as si from cube where dosage is not null and chr = 'chrX'")
def _(g):
    return select.get_intensity(select.xchrom(g)).select("marker", "iid", "x", "y", places("si", 9).alias("si"))


@register("drop_intensity", f"select {CELL} from cube where dosage is not null")
def _(g):
    return select.drop_intensity(g).calls.select("marker_idx", "sample_idx", "dosage")


@register("replace_names", """
select iid, sample_idx from (select sample_idx, n || case when row_number() over (partition by n order by sample_idx) > 1
  then '.' || cast(row_number() over (partition by n order by sample_idx) - 1 as varchar) else '' end as iid
  from (select sample_idx, case when sample_idx % 3 = 0 then 'dup' || cast(sample_idx % 2 as varchar) else iid end as n from samples))""")
def _(g):
    renames = g.samples.where("sample_idx % 3 = 0").select("iid", F.concat(F.lit("dup"), (F.col("sample_idx") % 2).cast("string")).alias("new_iid"))
    return select.replace_names(g, renames).samples.select("iid", "sample_idx")


@register("clean_names", "select sample_idx, replace(case when k > 1 then n || '.' || cast(k - 1 as varchar) else n end, ' ', '') as iid from (select *, row_number() over (partition by n order by sample_idx) as k from (select sample_idx, trim(' a ' || cast(sample_idx % 7 as varchar) || ' ') as n from samples))")
def _(g):
    named = g.samples.select("sample_idx", F.concat(F.lit(" a "), (F.col("sample_idx") % 7).cast("string"), F.lit(" ")).alias("iid"))
    return select.clean_names(named, "iid", "sample_idx")


@register("replace_map", """
select cast(row_number() over (order by chr_order, pos, marker) - 1 as int) as new_idx, marker, pos, d.sample_idx, d.dosage
from (select marker_idx, marker, chr_order, pos * 2 as pos from markers where marker_idx % 2 = 0) m
join (select marker_idx, min(sample_idx) as sample_idx, min_by(dosage, sample_idx) as dosage from cube where dosage is not null group by marker_idx) d using (marker_idx)""")
def _(g):
    new = g.markers.where("marker_idx % 2 = 0").withColumn("pos", F.col("pos") * 2).drop("marker_idx", "filter")
    r = select.replace_map(g, new)
    first = r.observed().groupBy("marker_idx").agg(F.min("sample_idx").alias("sample_idx"), F.min_by("dosage", "sample_idx").alias("dosage"))
    return r.markers.join(first, "marker_idx").select(F.col("marker_idx").alias("new_idx"), "marker", "pos", "sample_idx", "dosage")


@register("convert_names", "select distinct chr, case replace(chr, 'chr', '') when 'M' then 'MT' else replace(chr, 'chr', '') end as ncbi from markers")
def _(g):
    return g.markers.select("chr", select.convert_names(F.col("chr"), "ncbi").alias("ncbi")).distinct()


@register("unplink_chroms", "select distinct code, case when code = 23 then 'chrX' when code = 24 then 'chrY' when code = 26 then 'chrM' when code between 1 and 19 then 'chr' || cast(code as varchar) end as chr from (select marker_idx % 28 as code from markers)")
def _(g):
    return g.markers.select((F.col("marker_idx") % 28).alias("code")).distinct().select("code", select.unplink_chroms(F.col("code")).alias("chr"))


@register("fix_sex", "select sample_idx, case when lower(substr(w, 1, 1)) = 'f' then 2 when lower(substr(w, 1, 1)) = 'm' then 1 else 0 end as sex from (select sample_idx, case sample_idx % 4 when 0 then 'Female' when 1 then 'male' when 2 then 'M' else '?' end as w from samples)")
def _(g):
    k = F.col("sample_idx") % 4
    return g.samples.select("sample_idx", select.fix_sex(F.when(k == 0, "Female").when(k == 1, "male").when(k == 2, "M").otherwise("?")).alias("sex"))


@register("make_fam", "select sample_idx, iid, iid as fid, 0 as sex from samples")
def _(g):
    return select.make_fam(g.samples.select("sample_idx", "iid")).select("sample_idx", "iid", "fid", "sex")


@register("validate", "select * from (values ('marker names unique'), ('sample names unique'), ('marker order unique'), ('cells unique'), ('calls have a marker'), ('calls have a sample'), ('alleles differ'), ('cM not negative'), ('filters not null'), ('sex known code'), ('dosage in range'), ('intensities paired')) t(\"check\"), (select cast(0 as bigint) as n_bad)")
def _(g):
    return select.validate(g)


@register("column_quantiles", """
, q as (select iid, sample_idx, quantile_cont(sqrt(x * x + y * y), 0.25) as a, quantile_cont(sqrt(x * x + y * y), 0.5) as b, quantile_cont(sqrt(x * x + y * y), 0.75) as c from cube where x is not null group by iid, sample_idx),
p as (select *, row_number() over (order by b, sample_idx) as place from q)
select iid, cast(place as int) as place, u.q, round(u.value, 9) as value from p, lateral (values (0.25e0, a), (0.5e0, b), (0.75e0, c)) u(q, value)""".replace(", q as", "+ q as", 1))
def _(g):
    return select.column_quantiles(g).withColumn("value", places("value", 9))


# encoding ------------------------------------------------------------------


@register("recode_native", "select marker_idx, sample_idx, case dosage when 0 then A1 when 1 then 'H' when 2 then A2 end as call from cube where dosage is not null")
def _(g):
    return encode.to_native(g).calls.select("marker_idx", "sample_idx", "call")


@register("recode_01", f"select {CELL} from cube where dosage is not null")
def _(g):
    return cells(encode.to_numeric(encode.to_native(g)))


@register("recode_relative", f"select c.marker_idx, sample_idx, case when n2 > n0 then 2 - dosage else dosage end as dosage from cube c join (select marker_idx, {COUNTS} from cube group by marker_idx) k on c.marker_idx = k.marker_idx where dosage is not null")
def _(g):
    return cells(encode.to_relative(g))


@register("recode_by_frequency", """
+ nat as (select marker_idx, sample_idx, case dosage when 0 then A1 when 1 then 'H' when 2 then A2 end as call from cube where dosage is not null),
top as (select marker_idx, call as major from (select marker_idx, call, row_number() over (partition by marker_idx order by count(*) desc, call) as k from nat where call <> 'H' group by marker_idx, call) where k = 1)
select nat.marker_idx, sample_idx, case when call = major then 0 when call = 'H' then 1 else 2 end as dosage from nat join top on nat.marker_idx = top.marker_idx""")
def _(g):
    return cells(encode.relative_by_frequency(encode.to_native(g)))


@register("recode_to_parent", "select c.marker_idx, c.sample_idx, 2 - abs(p.dosage - c.dosage) as dosage from cube c join cube p on p.marker_idx = c.marker_idx and p.iid = 's3' where c.dosage is not null and p.dosage is not null")
def _(g):
    return cells(encode.recode_to_parent(g, "s3"))


@register("fix_strand_swaps", """
select marker_idx, marker_idx % 3 = 0 and A1 || A2 not in ('AT', 'GC') as swapped, false as unresolved,
  case when marker_idx % 3 = 0 and A1 || A2 not in ('AT', 'GC') then A1 else case when marker_idx % 3 = 0 then translate(A1, 'ACGT', 'TGCA') else A1 end end as A1 from markers""")
def _(g):
    native = encode.to_native(g)
    turned = native.with_(markers=native.markers.withColumns({a: F.when(F.col("marker_idx") % 3 == 0, encode.complement(F.col(a))).otherwise(F.col(a)) for a in ("A1", "A2")}))
    fixed, log = encode.fix_strand_swaps(turned)
    return log.join(fixed.markers.select("marker_idx", "A1"), "marker_idx")


# combination ---------------------------------------------------------------


def halves(g: GenotypeSet) -> tuple[GenotypeSet, GenotypeSet]:
    return select.subset(g, "sample_idx % 2 = 0", "samples"), select.subset(g, "sample_idx % 2 = 1", "samples")


@register("cbind", f"select {CELL} from cube where dosage is not null")
def _(g):
    return cells(combine.cbind(*halves(g)))


@register("rbind", f"select {CELL} from cube where dosage is not null")
def _(g):
    return cells(combine.rbind(select.subset(g, "marker_idx % 2 = 0"), select.subset(g, "marker_idx % 2 = 1")))


@register("merge", f"select {CELL} from cube where dosage is not null")
def _(g):
    return cells(combine.merge(*halves(g)))


# the second map's alleles are left, turned to the other strand, exchanged, both, or made unlike, by marker
SECOND = """
second as (select marker_idx, marker, case marker_idx % 5 when 1 then translate(A1, 'ACGT', 'TGCA') when 2 then A2 when 3 then translate(A2, 'ACGT', 'TGCA') else A1 end as y1,
  case marker_idx % 5 when 1 then translate(A2, 'ACGT', 'TGCA') when 2 then A1 when 3 then translate(A1, 'ACGT', 'TGCA') when 4 then 'N' else A2 end as y2, A1 as x1, A2 as x2 from markers),
plan as (select *, case when x1 = y1 and x2 = y2 then 'same' when x1 = y1 then 'drop'
  when translate(y1, 'ACGT', 'TGCA') = x1 then case when translate(y2, 'ACGT', 'TGCA') = x2 then 'strand' else 'drop' end
  when y1 = x2 then case when y2 = x1 then 'order' else 'drop' end
  when translate(y1, 'ACGT', 'TGCA') = x2 then case when translate(y2, 'ACGT', 'TGCA') = x1 then 'both' else 'drop' end else 'drop' end as action from second)
"""


def second_map(g: GenotypeSet) -> DataFrame:
    k, c1, c2 = F.col("marker_idx") % 5, encode.complement(F.col("A1")), encode.complement(F.col("A2"))
    return g.markers.withColumns({"A1": F.when(k == 1, c1).when(k == 2, F.col("A2")).when(k == 3, c2).otherwise(F.col("A1")), "A2": F.when(k == 1, c2).when(k == 2, F.col("A1")).when(k == 3, c1).when(k == 4, "N").otherwise(F.col("A2"))})


@register("allele_actions", f"+ {SECOND} select marker, action, case when action in ('order', 'both') then x2 else x1 end as A1, case when action in ('order', 'both') then x1 else x2 end as A2, action in ('order', 'both') as flip from plan")
def _(g):
    return combine.allele_actions(g.markers, second_map(g))


@register("merge_alleles", f"+ {SECOND} select c.marker_idx, sample_idx, case when action in ('order', 'both') and sample_idx % 2 = 0 then 2 - dosage else dosage end as dosage from cube c join plan p on c.marker_idx = p.marker_idx where action <> 'drop' and dosage is not null")
def _(g):
    x, y = halves(g)
    return cells(combine.merge(x, y.with_(markers=second_map(y)), check_alleles=True))


# statistics ----------------------------------------------------------------


@register("freq", "select marker_idx, sum(dosage) / (2e0 * nullif(count(dosage), 0)) as freq from cube group by marker_idx")
def _(g):
    return stats.freq(g)


@register("freq_samples", "select sample_idx, sum(dosage) / (2e0 * nullif(count(dosage), 0)) as freq from cube group by sample_idx")
def _(g):
    return stats.freq(g, "samples")


@register("allele_counts", "select marker_idx, cast(coalesce(sum(dosage), 0) as bigint) as copies from cube group by marker_idx")
def _(g):
    return stats.freq(g, counts=True)


@register("nmiss", "select marker_idx, count(*) - count(dosage) as n_missing, (count(*) - count(dosage)) / cast(count(*) as double) as missingness from cube group by marker_idx")
def _(g):
    return stats.nmiss(g)


@register("missingness_samples", "select sample_idx, count(*) - count(dosage) as n_missing, (count(*) - count(dosage)) / cast(count(*) as double) as missingness from cube group by sample_idx")
def _(g):
    return stats.nmiss(g, "samples")


@register("consensus", f"select marker_idx, case when n_missing <= n * 0.1e0 then case when n0 + n1 + n2 = 0 then null when n0 >= n1 and n0 >= n2 then 0 when n1 >= n2 then 1 else 2 end end as dosage from (select marker_idx, {COUNTS} from cube group by marker_idx)")
def _(g):
    return stats.consensus(g, 0.1)


@register("segregating", f"select marker_idx, case when n_missing <= n * 0.2e0 then n0 > 0 and n2 > 0 end as segregating from (select marker_idx, {COUNTS} from cube group by marker_idx)")
def _(g):
    return stats.segregating(g, 0.2)


@register("segregating_het", f"select marker_idx, case when n_missing <= n * 0.2e0 then (n0 > 0 and n2 > 0) or n1 > 0 end as segregating from (select marker_idx, {COUNTS} from cube group by marker_idx)")
def _(g):
    return stats.segregating(g, 0.2, allow_het=True)


@register("fixed_diffs", "select m.marker_idx, coalesce(abs(a.dosage - b.dosage) = 2, false) as fixed_diff from markers m left join cube a on a.marker_idx = m.marker_idx and a.iid = 's1' left join cube b on b.marker_idx = m.marker_idx and b.iid = 's2'")
def _(g):
    return stats.fixed_diffs(g, "s1", "s2")


@register("informative", f"""
+ k as (select marker_idx, fid, {COUNTS} from cube group by marker_idx, fid),
c as (select marker_idx, case when n_missing <= n * 0.3e0 then case when n0 + n1 + n2 = 0 then null when n0 >= n1 and n0 >= n2 then 0 when n1 >= n2 then 1 else 2 end end as d from k)
select marker_idx, case when count(*) - count(d) <= count(*) * 0.3e0 then count(*) filter (d = 0) > 0 and count(*) filter (d = 2) > 0 end as informative from c group by marker_idx""")
def _(g):
    return stats.informative(g, "fid", 0.3)


@register("prop_het", "select sample_idx, count(*) filter (dosage = 1) / cast(nullif(count(dosage), 0) as double) as het from cube group by sample_idx")
def _(g):
    return stats.prop_het(g)


@register("heterozygosity", "select marker_idx, count(*) filter (dosage = 1) / cast(nullif(count(dosage), 0) as double) as het from cube group by marker_idx")
def _(g):
    return stats.heterozygosity(g)


@register("heterozygosity_hwe", f"select marker_idx, round(1e0 - (n0 / cast(n0 + n1 + n2 as double)) * (n0 / cast(n0 + n1 + n2 as double)) - (n2 / cast(n0 + n1 + n2 as double)) * (n2 / cast(n0 + n1 + n2 as double)), 12) as het from (select marker_idx, {COUNTS} from cube group by marker_idx)")
def _(g):
    return stats.heterozygosity(g, hwe=True).withColumn("het", places("het", 12))


@register("summarize_calls", f"select sample_idx, n0 as A, n2 as B, n1 as H, n_missing as N from (select sample_idx, {COUNTS} from cube group by sample_idx)")
def _(g):
    return stats.summarize_calls(g)


@register("summarize_calls_markers", f"select marker_idx, n0 / cast(n as double) as A, n2 / cast(n as double) as B, n1 / cast(n as double) as H, n_missing / cast(n as double) as N from (select marker_idx, {COUNTS} from cube group by marker_idx)")
def _(g):
    return stats.summarize_calls(g, "markers", counts=False)


@register("summarize_intensity", "select sample_idx, iid, fid, sex, " + ", ".join(f"round(quantile_cont(sqrt(x * x + y * y), {q}), 9) as q{int(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " from cube where x is not null group by sample_idx, iid, fid, sex")
def _(g):
    t = stats.summarize_intensity(g)
    return t.select(*[places(c, 9).alias(c) if c.startswith("q") else c for c in t.columns])


@register("genoapply", "select chr, fid, count(*) as n, cast(sum(dosage) as bigint) as copies from cube where dosage is not null group by chr, fid")
def _(g):
    return stats.genoapply(g, ["chr"], ["fid"], n=F.count(F.lit(1)), copies=F.sum("dosage"))


@register("col_vars", f"select sample_idx, round(n / (n - 1e0) * ((n1 + 4 * n2) / cast(n0 + n1 + n2 as double) - ((n1 + 2 * n2) / cast(n0 + n1 + n2 as double)) * ((n1 + 2 * n2) / cast(n0 + n1 + n2 as double))), 12) as variance from (select sample_idx, {COUNTS} from cube group by sample_idx)")
def _(g):
    return stats.col_vars(g).withColumn("variance", places("variance", 12))


# quality control -----------------------------------------------------------

SAMPLE_QC = f"""
q as (select sample_idx, iid, fid, {COUNTS} from cube group by sample_idx, iid, fid),
f as (select *, case when n1 > case fid when 'f3' then 60 when 'f7' then 65 else 70 end then 'H' else '' end || case when n_missing > 11 then 'N' else '' end as filter from q)
"""
LIMITS = {"max_H": {"f3": 60, "f7": 65}, "max_N": 11}


def sample_qc(g: GenotypeSet, apply: bool = False):  # noqa: ANN201
    limits = {f"f{i}": 70 for i in range(25)} | LIMITS["max_H"]
    return qc.run_sample_qc(g, max_H=limits, max_N=LIMITS["max_N"], apply=apply)


@register("sample_qc", f"+ {SAMPLE_QC} select sample_idx, iid, n0 as A, n2 as B, n1 as H, n_missing as N, filter, length(filter) > 0 as flagged from f")
def _(g):
    return sample_qc(g)[1].drop("D")


@register("apply_filters", f"+ {SAMPLE_QC} select c.marker_idx, c.sample_idx, c.dosage from cube c join f on f.sample_idx = c.sample_idx where dosage is not null and filter = ''")
def _(g):
    return cells(sample_qc(g, apply=True)[0])


@register("summarize_filters", f"+ {SAMPLE_QC} select u.code, cast(0 as bigint) as sites, (select count(*) from f where contains(filter, u.code)) as samples from (values ('N'), ('H'), ('I'), ('F')) u(code)")
def _(g):
    return stats.summarize_filters(sample_qc(g)[0])


@register("is_filtered", f"+ {SAMPLE_QC} select sample_idx, length(filter) > 0 as filtered from f")
def _(g):
    return qc.is_filtered(sample_qc(g)[0], "samples")


MARKER_QC = f"""
q as (select marker_idx, marker, {COUNTS} from cube group by marker_idx, marker),
f as (select *, case when n1 > n * 0.34e0 then 'H' else '' end || case when n_missing > n * 0.06e0 then 'N' else '' end || case when n0 + n2 <= n * 0.6e0 then 'F' else '' end as filter from q)
"""


@register("marker_qc", f"+ {MARKER_QC} select marker_idx, marker, n0 as A, n2 as B, n1 as H, n_missing as N, case when n1 > 40 then 'H' else '' end || case when n_missing > 6 then 'N' else '' end || case when n0 + n2 <= 55 then 'F' else '' end as filter, n1 > 40 or n_missing > 6 or n0 + n2 <= 55 as flagged from f")
def _(g):
    return qc.run_marker_qc(g, max_H=40, max_N=6, min_hom=55)[1]


@register("intensity_vs_ref", """
+ s as (select sample_idx, sqrt(x * x + y * y) as si from cube where x is not null),
r as (select si from s where sample_idx < 5),
pts as (select sample_idx, si, count(*) as s, 0 as r from s group by sample_idx, si union all select i.sample_idx, r.si, 0, count(*) from r, (select distinct sample_idx from s) i group by i.sample_idx, r.si),
p as (select sample_idx, si, sum(s) as s, sum(r) as r from pts group by sample_idx, si),
d as (select sample_idx, sum(r) over (partition by sample_idx order by si) / cast(sum(r) over (partition by sample_idx) as double) - sum(s) over (partition by sample_idx order by si) / cast(sum(s) over (partition by sample_idx) as double) as d from p)
select sample_idx, round(greatest(max(d), 0e0), 6) as D from d group by sample_idx""")
def _(g):
    ref = select.get_intensity(select.subset(g, "sample_idx < 5", "samples")).select("si")
    return qc.intensity_vs_ref(g, ref).withColumn("D", places("D", 6))


@register("predict_sex_ycalls", f"select sample_idx, iid, case when n0 + n2 >= 6 and n_missing <= 2 then 1 when n0 + n2 < 6 and n_missing > 0 then 2 else 0 end as predicted from (select sample_idx, iid, {COUNTS} from cube where chr = 'chrY' group by sample_idx, iid)".replace("n_missing <= 2", "n_missing <= 0"))
def _(g):
    return qc.predict_sex_ycalls(g, min_AB=6, max_N=0)


def log_density(kind: str) -> str:
    (mx, my), (a, b, c) = qc.PLATFORMS["giga"][kind]
    det = a * c - b * b
    return f"(({c!r} * (ix - {mx!r}) * (ix - {mx!r}) - {2 * b!r} * (ix - {mx!r}) * (iy - {my!r}) + {a!r} * (iy - {my!r}) * (iy - {my!r})) * {-0.5 / det!r} - {0.5 * math.log(det)!r})"


@register("predict_sex_xy", f"""
+ i as (select sample_idx, iid, avg(case when chr = 'chrX' then sqrt(x * x + y * y) end) as ix, avg(case when chr = 'chrY' then sqrt(x * x + y * y) end) as iy from cube where x is not null group by sample_idx, iid),
l as (select *, {log_density('male')} - {log_density('female')} as llr from i)
select sample_idx, iid, round(ix, 6) as ix, round(iy, 6) as iy, round(llr, 4) as llr, case when llr > 0 then 1 when llr is not null then 2 end as predicted from l""")
def _(g):
    t = qc.predict_sex_xy(g, clean=None)
    return t.select("sample_idx", "iid", *[places(c, 6).alias(c) for c in ("ix", "iy")], places("llr", 4).alias("llr"), "predicted")


@register("sexysum", "select sample_idx, iid, fid, sex, count(*) filter (chr = 'chrY' and dosage in (0, 2)) as ygood, count(*) filter (chr = 'chrX' and dosage = 1) as xhet, round(avg(case when chr = 'chrX' then sqrt(x * x + y * y) end), 9) as ix, round(avg(case when chr = 'chrY' then sqrt(x * x + y * y) end), 9) as iy from cube group by sample_idx, iid, fid, sex")
def _(g):
    return qc.sexysum(g, clean=None).withColumns({c: places(c, 9) for c in ("ix", "iy")})


@register("inbreeding", f"""
+ k as (select marker_idx, {COUNTS} from cube where chr not in ('chrX', 'chrY', 'chrM') group by marker_idx),
e as (select marker_idx, 1e0 - 2e0 * p * (1e0 - p) * (2 * s) / cast(2 * s - 1 as double) as e from (select marker_idx, n0 + n1 + n2 as s, (n1 + 2 * n2) / cast(2 * (n0 + n1 + n2) as double) as p from k where n0 + n1 + n2 > 0)),
t as (select sample_idx, count(*) filter (dosage <> 1) as o_hom, sum(e) as e_hom, count(*) as n from cube c join e on c.marker_idx = e.marker_idx where dosage is not null group by sample_idx)
select sample_idx, o_hom, round(e_hom, 6) as e_hom, n, round((o_hom - e_hom) / nullif(n - e_hom, 0e0), 6) as F from t""")
def _(g):
    return qc.inbreeding(g).withColumns({c: places(c, 6) for c in ("e_hom", "F")})
