"""Pairs, populations, intensities, order-based operators, phenotypes and association."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet
from locusframe.operators import assoc, intensity, pairwise, pheno, popgen, select, windows
from locusframe.plans.core_queries import COUNTS, cells
from locusframe.plans.registry import places, register


def rounded(t: DataFrame, digits: int, *cols: str) -> DataFrame:
    return t.withColumns({c: places(c, digits) + F.lit(0.0) for c in cols})  # no negative zero


PAIRS = """
s as (select distinct sample_idx, iid from cube),
pr as (select a.sample_idx as i, b.sample_idx as j, a.iid as iid1, b.iid as iid2 from s a join s b on a.sample_idx < b.sample_idx),
pc as (select a.sample_idx as i, b.sample_idx as j, count(*) as n, count(*) filter (abs(a.dosage - b.dosage) = 0) as ibs2, count(*) filter (abs(a.dosage - b.dosage) = 1) as ibs1, count(*) filter (abs(a.dosage - b.dosage) = 2) as ibs0
  from cube a join cube b on a.marker_idx = b.marker_idx and a.sample_idx < b.sample_idx where a.dosage is not null and b.dosage is not null group by a.sample_idx, b.sample_idx)
"""


@register("dist_ibs", f"+ {PAIRS} select iid1, iid2, (ibs1 + 2 * ibs0) / (2e0 * nullif(n, 0)) as dist from pr left join pc on pr.i = pc.i and pr.j = pc.j")
def _(g):
    return pairwise.dist_ibs(g)


@register("ibs0", f"+ {PAIRS} select iid1, iid2, ibs0 / cast(nullif(n, 0) as double) as ibs0 from pr left join pc on pr.i = pc.i and pr.j = pc.j")
def _(g):
    return pairwise.ibs0(g)


@register("kinship_ibs", f"+ {PAIRS} select iid1, iid2, (ibs1 + 2 * ibs0) / (2e0 * nullif(n, 0)) as dist from pr left join pc on pr.i = pc.i and pr.j = pc.j")
def _(g):
    return pairwise.kinship_ibs(g)


@register("kinship_grm", """
+ p as (select marker_idx, sum(dosage) / (2e0 * count(dosage)) as p from cube group by marker_idx),
z as (select c.marker_idx, sample_idx, iid, (dosage - 2e0 * p) / sqrt(2e0 * p * (1e0 - p)) as z from cube c join p on c.marker_idx = p.marker_idx where dosage is not null and p > 0 and p < 1)
select a.iid as iid1, b.iid as iid2, round(sum(a.z * b.z) / count(*), 6) as rel from z a join z b on a.marker_idx = b.marker_idx and a.sample_idx <= b.sample_idx group by a.iid, b.iid""")
def _(g):
    return rounded(pairwise.grm(g), 6, "rel")


@register("ibd", f"""
+ {PAIRS.replace('cube', "auto").replace('s as (', "auto as (select * from cube where chr not in ('chrX', 'chrY', 'chrM')), s as (", 1)},
k as (select marker_idx, n0 + n1 + n2 as s, (n1 + 2 * n2) / (2e0 * (n0 + n1 + n2)) as p from (select marker_idx, {COUNTS} from auto group by marker_idx) where n0 + n1 + n2 > 0),
e as (select avg(2 * p * p * (1 - p) * (1 - p)) as e00, avg(4 * p * p * p * (1 - p) + 4 * p * (1 - p) * (1 - p) * (1 - p)) as e10, avg(p * p * p * p + 4 * p * p * (1 - p) * (1 - p) + (1 - p) * (1 - p) * (1 - p) * (1 - p)) as e20,
  avg(2 * p * p * (1 - p) + 2 * p * (1 - p) * (1 - p)) as e11, avg(p * p * p + p * p * (1 - p) + p * (1 - p) * (1 - p) + (1 - p) * (1 - p) * (1 - p)) as e21 from k),
a as (select *, ibs0 / (n * e00) as z0 from pc, e),
b as (select *, (ibs1 - z0 * n * e10) / (n * e11) as z1 from a),
c as (select *, (ibs2 - z0 * n * e20 - z1 * n * e21) / n as z2 from b),
d as (select i, j, least(greatest(z0, 0e0), 1e0) as z0, least(greatest(z1, 0e0), 1e0) as z1, least(greatest(z2, 0e0), 1e0) as z2 from c)
select iid1, iid2, round(z0 / (z0 + z1 + z2), 6) as z0, round(z1 / (z0 + z1 + z2), 6) as z1, round(z2 / (z0 + z1 + z2), 6) as z2, round(z1 / (z0 + z1 + z2) / 2 + z2 / (z0 + z1 + z2), 6) as pi_hat from pr left join d on pr.i = d.i and pr.j = d.j""")
def _(g):
    return rounded(pairwise.ibd(g), 6, "z0", "z1", "z2", "pi_hat")


# a row for each pair of samples at each marker: no SQL, tested against brute force
@register("predict_f1")
def _(g):
    return pairwise.predict_f1(g)


@register("pairwise_diffs")
def _(g):
    return pairwise.pairwise_diffs(g)


MENDEL = """
k as (select marker_idx, dosage as kid from cube where iid = 's4' and dosage is not null),
t as (select iid as parent, sex as parent_sex, case when chr = 'chrX' then 'X' when chr = 'chrY' then 'Y' when chr = 'chrM' then 'M' else 'A' end as kind, count(*) filter (abs(kid - dosage) = 2) as bad, count(*) as n
  from cube c join k on c.marker_idx = k.marker_idx where iid <> 's4' and dosage is not null group by 1, 2, 3),
d as (select 's4' as iid, parent, parent_sex, cast(sum(bad) as double) / sum(n) as distance from t where kind = 'A' or (parent_sex = 2 and kind = 'X') or (parent_sex = 1 and kind = 'Y') group by parent, parent_sex)
"""


@register("mendel_distance", f"+ {MENDEL} select * from d")
def _(g):
    return pairwise.mendel_distance(g, "s4", sex=1)


@register("guess_parents", f"+ {MENDEL} select iid, case parent_sex when 1 then 'dad' else 'mom' end as role, parent, distance from (select *, row_number() over (partition by parent_sex order by distance, parent) as k from d) where k = 1")
def _(g):
    return pairwise.guess_parents(g, "s4", sex=1)


LD = """
m as (select marker_idx, chr, pos from markers),
t as (select a.marker_idx as m1, b.marker_idx as m2, count(*) as n, sum(a.dosage) as sx, sum(b.dosage) as sy, sum(a.dosage * a.dosage) as sxx, sum(b.dosage * b.dosage) as syy, sum(a.dosage * b.dosage) as sxy
  from cube a join cube b on a.sample_idx = b.sample_idx and a.marker_idx < b.marker_idx and a.chr = b.chr where a.dosage is not null and b.dosage is not null group by a.marker_idx, b.marker_idx),
r as (select m1, m2, n, cast(n * sxy - sx * sy as double) * (n * sxy - sx * sy) / nullif(cast(n * sxx - sx * sx as double) * (n * syy - sy * sy), 0e0) as r2 from t)
"""


@register("ld_r2", f"+ {LD} select m1, m2, r2 from r join m on m1 = marker_idx")
def _(g):
    return pairwise.ld_r2(g, complete=False, force=True)


@register("ld_complete", f"+ {LD} select a.marker_idx as m1, b.marker_idx as m2, case when n = (select count(*) from samples) then r2 end as r2 from m a join m b on a.chr = b.chr and a.marker_idx < b.marker_idx left join r on m1 = a.marker_idx and m2 = b.marker_idx")
def _(g):
    return pairwise.ld_r2(g, force=True)


@register("ld_window", f"+ {LD} select m1, m2, r2 from r join markers a on m1 = a.marker_idx join markers b on m2 = b.marker_idx where b.pos - a.pos <= 75000")
def _(g):
    return pairwise.ld_r2(g, window_bp=75000, complete=False)


FST = """
n as (select marker_idx, {pop} as pop, cast(count(*) as double) as n, cast(sum(2 - dosage) as double) as c, cast(count(*) filter (dosage = 1) as double) as h from cube where dosage is not null group by marker_idx, {pop}),
u as (select marker_idx, (select cast(count(distinct {pop}) as double) from samples) as r, sum(n) as sn, sum(n * n) as snn, sum(c) as sc, sum(c * c / n) as scc, sum(h) as sh from n group by marker_idx),
v as (select *, sn / r as nb, (sn - snn / sn) / (r - 1) as nc, sc / (2 * sn) as p, sh / sn as h from u),
w as (select *, (scc / 4 - sn * p * p) / ((r - 1) * nb) as s2 from v),
abc as (select marker_idx, nb / nullif(nc, 0e0) * (s2 - (p * (1 - p) - (r - 1) / r * s2 - h / 4) / nullif(nb - 1, 0e0)) as a, nb / nullif(nb - 1, 0e0) * (p * (1 - p) - (r - 1) / r * s2 - (2 * nb - 1) / (4 * nb) * h) as b, h / 2 as c from w)
"""


@register("weir_fst", f"+ {FST.format(pop='fid')} select round(1 - sum(c) / nullif(sum(a + b + c), 0e0), 9) as F, round(sum(a) / nullif(sum(a + b + c), 0e0), 9) as theta, round(1 - sum(c) / nullif(sum(b + c), 0e0), 9) as f_is from abc where a is not null and b is not null")
def _(g):
    return rounded(popgen.weir_fst(g).toDF("F", "theta", "f_is"), 9, "F", "theta", "f_is")


@register("weir_fst_locus", f"+ {FST.format(pop='fid')} select marker_idx, round(a, 9) + 0e0 as a, round(b, 9) + 0e0 as b, round(c, 9) + 0e0 as c, round(a / nullif(a + b + c, 0e0), 6) + 0e0 as theta from abc")
def _(g):
    t = popgen.weir_fst_locus(g).select("marker_idx", "a", "b", "c", "theta")
    return rounded(rounded(t, 9, "a", "b", "c"), 6, "theta")


@register("pairwise_fst", """
+ n as (select marker_idx, fid as pop, cast(count(*) as double) as n, cast(sum(2 - dosage) as double) as k, cast(count(*) filter (dosage = 1) as double) as h from cube where dosage is not null group by marker_idx, fid),
j as (select x.pop as pop1, y.pop as pop2, x.n + y.n as sn, (x.n + y.n) / 2 as nb, x.n + y.n - (x.n * x.n + y.n * y.n) / (x.n + y.n) as nc, (x.k + y.k) / (2 * (x.n + y.n)) as p, (x.h + y.h) / (x.n + y.n) as h, x.k * x.k / (4 * x.n) + y.k * y.k / (4 * y.n) as q from n x join n y on x.marker_idx = y.marker_idx and x.pop < y.pop),
s as (select *, (q - sn * p * p) / nb as s2 from j),
t as (select pop1, pop2, nb / nc * (s2 - (p * (1 - p) - s2 / 2 - h / 4) / nullif(nb - 1, 0)) as a, nb / nullif(nb - 1, 0) * (p * (1 - p) - s2 / 2 - (2 * nb - 1) / (4 * nb) * h) as b, h / 2 as c from s)
select pop1, pop2, round(sum(a) / sum(a + b + c), 9) as theta from t where a is not null and b is not null group by pop1, pop2""")
def _(g):
    return rounded(popgen.pairwise_fst(g), 9, "theta")


# order-based ---------------------------------------------------------------


@register("thin", """
+ b as (select *, greatest(1, ceil((cM - (floor((min(cM) over (partition by chr) - 2e0) / 4e0) * 4e0 + 2e0)) / 4e0)) as bin from markers),
k as (select *, row_number() over (partition by chr, bin order by marker_idx) as in_bin, row_number() over (partition by chr order by marker_idx) as f, count(*) over (partition by chr) as n from b)
select marker_idx, chr, cM from k where in_bin = 1 or f = 1 or f = n""")
def _(g):
    return windows.thin(g, 4.0).markers.select("marker_idx", "chr", "cM")


@register("concat_chroms", """
+ l as (select chr, min(chr_order) as o, max(pos) / 1e6 + 10e0 as length from markers group by chr),
c as (select chr, length, coalesce(sum(length) over (order by o, chr rows between unbounded preceding and 1 preceding), 0e0) as "offset" from l)
select chr, round(length, 6) as length, round("offset", 6) as "offset", round("offset" + length / 2, 6) as tick from c""")
def _(g):
    return rounded(windows.concat_chroms(g), 6, "length", "offset", "tick")


@register("genome_positions", """
+ l as (select chr, min(chr_order) as o, max(pos) / 1e6 + 10e0 as length from markers group by chr),
c as (select chr, coalesce(sum(length) over (order by o, chr rows between unbounded preceding and 1 preceding), 0e0) as off from l)
select marker_idx, marker, m.chr, pos, round(off + pos / 1e6, 6) as x from markers m join c on c.chr = m.chr""")
def _(g):
    return rounded(windows.genome_positions(g), 6, "x")


@register("call_runs", """
+ o as (select *, case when lag(dosage) over (partition by sample_idx, chr order by marker_idx) = dosage then 0 else 1 end as ch from cube where dosage is not null),
b as (select *, sum(ch) over (partition by sample_idx, chr order by marker_idx rows unbounded preceding) as blk from o)
select sample_idx, chr, cast(blk as bigint) as block, min(dosage) as dosage, count(*) as n, min(pos) as start, max(pos) as "end" from b group by sample_idx, chr, blk""")
def _(g):
    return windows.call_runs(g)


@register("map_gaps", "select marker_idx, cM - lag(cM) over (partition by chr order by marker_idx) as gap from markers")
def _(g):
    return windows.map_gaps(g)


# intensities ---------------------------------------------------------------


@register("quantile_normalize", """
+ rx as (select marker_idx, sample_idx, row_number() over (partition by sample_idx order by x, marker_idx) as k, x, row_number() over (partition by sample_idx order by y, marker_idx) as l, y from cube where x is not null),
mx as (select k, avg(x) as m from rx group by k), my as (select l, avg(y) as m from rx group by l)
select marker_idx, sample_idx, round(mx.m, 9) as x, round(my.m, 9) as y from rx join mx on mx.k = rx.k join my on my.l = rx.l""")
def _(g):
    return rounded(intensity.quantile_normalize(g).calls.where("x is not null").select("marker_idx", "sample_idx", "x", "y"), 9, "x", "y")


@register("theta", "select marker_idx, sample_idx, round(case when x = 0 and y = 0 then null when x = 0 then 1e0 else 0.6366197723675814e0 * atan(y / x) end, 9) as theta from cube where x is not null")
def _(g):
    return g.calls.select("marker_idx", "sample_idx", places(intensity.theta(F.col("x"), F.col("y")), 9).alias("theta"))


@register("calc_lrr", "select marker_idx, sample_idx, round(case when s > 0 and m > 0 then log2(s / m) end, 9) + 0e0 as lrr from (select marker_idx, sample_idx, x + y as s, avg(x + y) over (partition by marker_idx) as m from cube where x is not null)")
def _(g):
    return rounded(intensity.calc_lrr(g), 9, "lrr")


CLUSTERS = """
ct as (select marker_idx, marker, dosage, x + y as r, case when x = 0 then 1e0 else 0.6366197723675814e0 * atan(y / x) end as t from cube where x > 0 and y > 0),
cl as (select marker_idx, marker, avg(r) filter (dosage = 0) as AR, avg(t) filter (dosage = 0) as "AT", avg(r) filter (dosage = 1) as HR, avg(t) filter (dosage = 1) as HT, avg(r) filter (dosage = 2) as BR, avg(t) filter (dosage = 2) as BT, avg(r) as Rmean from ct group by marker_idx, marker)
"""


@register("clusters", f"+ {CLUSTERS} select marker, round(AR, 9) as AR, round(\"AT\", 9) as \"AT\", round(HR, 9) as HR, round(HT, 9) as HT, round(BR, 9) as BR, round(BT, 9) as BT, round(Rmean, 9) as Rmean from cl")
def _(g):
    return rounded(intensity.clusters_from_calls(g), 9, "AR", "AT", "HR", "HT", "BR", "BT", "Rmean")


def example_clusters(g: GenotypeSet) -> DataFrame:
    """Centres that leave out one, two or all clusters by marker, so that each case of the ladder occurs."""
    k = F.regexp_extract("marker", "([0-9]+)", 1).cast("int")
    t = intensity.clusters_from_calls(g)
    base = t.withColumns({"AT": F.col("AT") * 0.3, "HT": F.col("HT"), "BT": F.lit(1.0) - F.col("BT") * 0.3})
    drop = {"A": k % 8, "H": k % 8, "B": k % 8}
    gone = {"A": drop["A"].isin(1, 3, 5, 7), "H": drop["H"].isin(2, 3, 6, 7), "B": drop["B"].isin(4, 5, 6, 7)}
    return base.withColumns({f"{c}{v}": F.when(~gone[c], F.col(f"{c}{v}")) for c in "AHB" for v in "RT"})


BAF = f"""
{CLUSTERS},
c0 as (select marker_idx, case when marker_idx % 8 in (1, 3, 5, 7) then null else AR end as ra, case when marker_idx % 8 in (1, 3, 5, 7) then null else "AT" * 0.3e0 end as ta,
  case when marker_idx % 8 in (2, 3, 6, 7) then null else HR end as rh, case when marker_idx % 8 in (2, 3, 6, 7) then null else HT end as th,
  case when marker_idx % 8 in (4, 5, 6, 7) then null else BR end as rb, case when marker_idx % 8 in (4, 5, 6, 7) then null else 1e0 - BT * 0.3e0 end as tb from cl),
med as (select (list_sort(list(ta) filter (ta is not null)))[count(ta) // 2 + 1] as ma, (list_sort(list(tb) filter (tb is not null)))[count(tb) // 2 + 1] as mb from c0),
c1 as (select marker_idx, case when ta > tb then tb else ta end as ta, case when ta > tb then rb else ra end as ra, case when ta > tb then ta else tb end as tb, case when ta > tb then ra else rb end as rb, th, rh from c0),
raw as (select marker_idx, sample_idx, dosage, x as x0, y as y0 from cube where x is not null and marker_idx in (select marker_idx from c1)),
ranked as (select *, row_number() over (partition by sample_idx order by x0, marker_idx) as kx, row_number() over (partition by sample_idx order by y0, marker_idx) as ky from raw),
means as (select sample_idx, k, avg(v) as m from (select sample_idx, kx as k, x0 as v from ranked union all select sample_idx, ky, y0 from ranked) group by sample_idx, k),
nrm as (select r.*, a.m as xn, b.m as yn, x0 <= 0 or y0 <= 0 as bad from ranked r join means a on a.sample_idx = r.sample_idx and a.k = kx join means b on b.sample_idx = r.sample_idx and b.k = ky),
cap as (select *, case when not bad then xn + yn end as r, case when not bad and xn > 1.5e0 * x0 then 1.5e0 * x0 else xn end as xc, case when not bad and yn > 1.5e0 * y0 then 1.5e0 * y0 else yn end as yc from nrm),
ang as (select *, case when bad then null when xc = 0 then (case when yc = 0 then null else 1e0 end) else least(greatest(0.6366197723675814e0 * atan(yc / xc), 0e0), 1e0) end as a from cap),
lad as (select g.*, c1.*, med.*, (ta is not null and th is not null and ta > th) or (th is not null and tb is not null and th > tb) as dis from ang g join c1 on c1.marker_idx = g.marker_idx, med),
res as (select marker_idx, sample_idx, r, a, case
  when a is null or dis or (ta is null and th is null and tb is null) then null
  when ta is null and th is null then case when a >= tb then 1e0 end
  when th is null and tb is null then case when a <= ta then 0e0 end
  when th is null then case when abs(ta - a) <= abs(tb - a) and a < ta then 0e0 when abs(ta - a) > abs(tb - a) and a >= tb then 1e0 end
  when ta is null and tb is null then case when a <= null then 0e0 end
  when ta is null then case when a >= tb then 1e0 when a >= th then 0.5e0 + 0.5e0 * (a - th) / nullif(tb - th, 0e0) when a < ma then 0e0 else 0.5e0 * (a - ma) / nullif(th - ma, 0e0) end
  when tb is null then case when a <= ta then 0e0 when a <= th then 0.5e0 * (a - ta) / nullif(th - ta, 0e0) when a > mb then 1e0 else 0.5e0 + 0.5e0 * (a - th) / nullif(mb - th, 0e0) end
  else case when a <= ta then 0e0 when a <= th then 0.5e0 * (a - ta) / nullif(th - ta, 0e0) when a <= tb then 0.5e0 + 0.5e0 * (a - th) / nullif(tb - th, 0e0) else 1e0 end end as baf, case
  when a is null or dis or (ta is null and th is null and tb is null) then null
  when ta is null and th is null then case when a >= tb then rb end
  when th is null and tb is null then case when a <= ta then ra end
  when th is null then case when abs(ta - a) <= abs(tb - a) and a < ta then ra when abs(ta - a) > abs(tb - a) and a >= tb then rb end
  when ta is null and tb is null then null
  when ta is null then case when a >= th and a < tb then rh + (a - th) * (rb - rh) / nullif(tb - th, 0e0) end
  when tb is null then case when a <= th and a > ta then ra + (a - ta) * (rh - ra) / nullif(th - ta, 0e0) end
  else case when a <= ta then ra when a <= th then ra + (a - ta) * (rh - ra) / nullif(th - ta, 0e0) when a <= tb then rh + (a - th) * (rb - rh) / nullif(tb - th, 0e0) else rb end end as er from lad)
"""


@register("tqn", f"+ {BAF} select marker_idx, sample_idx, round(baf, 6) + 0e0 as baf, round(case when r > 0 and er > 0 then log2(r / er) end, 6) + 0e0 as lrr, round(r - r * tan(a * {math.pi / 2!r}) / (1 + tan(a * {math.pi / 2!r})), 6) + 0e0 as x from res")
def _(g):
    t = intensity.tqn(g, example_clusters(g))
    return rounded(t.calls.select("marker_idx", "sample_idx", "baf", "lrr", "x"), 6, "baf", "lrr", "x")


@register("get_baf", f"+ {BAF} select marker, iid, round(baf, 6) as baf from res join markers m on m.marker_idx = res.marker_idx join samples s on s.sample_idx = res.sample_idx where marker in ('m8', 'm9', 'm12')")
def _(g):
    t = intensity.tqn(g, example_clusters(g))
    return rounded(select.get_call(t, ["m8", "m9", "m12"]).select("marker", "iid", "baf"), 6, "baf")


# phenotypes ----------------------------------------------------------------

LABEL = "case dosage when 0 then A1 || A1 when 1 then A1 || A2 when 2 then A2 || A2 end"


@register("oneway", f"select iid, {LABEL} as genotype, pheno from cube where marker = 'm5' and dosage is not null")
def _(g):
    return pheno.oneway(g, "m5")


@register("oneway_table", f"select {LABEL} as genotype, pheno, count(*) as n from cube where marker = 'm5' and dosage is not null and pheno is not null group by 1, 2")
def _(g):
    return pheno.oneway_table(g, "m5")


TWOWAY = f"""
t as (select sample_idx, max(case when marker = 'm5' then {LABEL} end) as genotype1, max(case when marker = 'm6' then {LABEL} end) as genotype2, max(pheno) as pheno, max(qpheno) as qpheno from cube where marker in ('m5', 'm6') and dosage is not null group by sample_idx)
"""


@register("twoway", f"+ {TWOWAY} select genotype1, genotype2, count(*) as n, avg(case pheno when 2 then 1e0 when 1 then 0e0 end) as mean from t where genotype1 is not null and genotype2 is not null group by 1, 2")
def _(g):
    return pheno.twoway(g, "m5", "m6")


@register("twoway_continuous", f"+ {TWOWAY} select genotype1, genotype2, count(*) as n, round(avg(qpheno), 6) as mean from t where genotype1 is not null and genotype2 is not null group by 1, 2")
def _(g):
    return rounded(pheno.twoway(g, "m5", "m6", "qpheno"), 6, "mean")


@register("mosaic", f"""
+ t as (select {LABEL} as genotype, pheno, count(*) as n from cube where marker = 'm5' and dosage is not null and pheno is not null group by 1, 2),
c as (select genotype, sum(n) as cx from t group by genotype),
d as (select genotype, cx, sum(cx) over (order by genotype) as up, sum(cx) over () as every from c)
select t.genotype, t.pheno, n, round((up - cx) / cast(every as double), 9) as xmin, round(up / cast(every as double), 9) as xmax,
  round((sum(n) over w - n) / cast(cx as double), 9) as ymin, round(sum(n) over w / cast(cx as double), 9) as ymax from t join d on d.genotype = t.genotype window w as (partition by t.genotype order by t.pheno)""")
def _(g):
    return rounded(pheno.mosaic(pheno.oneway_table(g, "m5"), "genotype", "pheno"), 9, "xmin", "xmax", "ymin", "ymax")


# association ---------------------------------------------------------------


@register("assoc_allelic", """
+ k as (select marker_idx, cast(sum(dosage) filter (pheno = 2) as double) as a, cast(sum(2 - dosage) filter (pheno = 2) as double) as b, cast(sum(dosage) filter (pheno = 1) as double) as c, cast(sum(2 - dosage) filter (pheno = 1) as double) as d from cube where dosage is not null and pheno is not null group by marker_idx)
select marker_idx, a / (a + b) as f_case, c / (c + d) as f_control, (a + b + c + d) * (a * d - b * c) * (a * d - b * c) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0e0) as chisq, a * d / nullif(b * c, 0e0) as odds_ratio from k""")
def _(g):
    return assoc.assoc_allelic(g)


@register("assoc_linear", """
+ p as (select sample_idx, qpheno - (select avg(qpheno) from samples) as v from samples where qpheno is not null),
k as (select marker_idx, cast(count(*) as double) as n, sum(cast(dosage as double)) as sx, sum(v) as sy, sum(cast(dosage * dosage as double)) as sxx, sum(v * v) as syy, sum(dosage * v) as sxy from cube c join p on p.sample_idx = c.sample_idx where dosage is not null group by marker_idx),
c as (select marker_idx, n, sxx - sx * sx / n as cxx, syy - sy * sy / n as cyy, sxy - sx * sy / n as cxy from k),
b as (select *, cxy / cxx as beta, sqrt(greatest(cyy - cxy / cxx * cxy, 0e0) / ((n - 2) * cxx)) as se from c)
select marker_idx, cast(n as bigint) as n, round(beta, 7) as beta, round(se, 7) as se, round(beta / se, 6) as t from b""")
def _(g):
    return rounded(rounded(assoc.assoc_linear(g), 7, "beta", "se"), 6, "t")


def example_trios(g: GenotypeSet) -> DataFrame:
    """Consecutive samples as trios."""
    return g.samples.where("sample_idx % 3 = 0").select(F.col("sample_idx").alias("kid"), (F.col("sample_idx") + 1).alias("mom"), (F.col("sample_idx") + 2).alias("dad"))


@register("assoc_linear_standard", """
+ k as (select marker_idx, count(*) as n, corr(qpheno, cast(dosage as double)) as r from cube where dosage is not null and qpheno is not null group by marker_idx)
select marker_idx, n, round(r, 7) as beta, round(sqrt((1 - r * r) / (n - 2)), 7) as se, round(r / sqrt((1 - r * r) / (n - 2)), 6) as t from k""")
def _(g):
    return rounded(rounded(assoc.assoc_linear(g, standard=True), 7, "beta", "se"), 6, "t")


@register("tdt_permuted")
def _(g):
    return assoc.tdt_permuted(g, example_trios(g))


@register("filter_samples", f"""
+ q as (select sample_idx from samples where fid in ('f1', 'f2', 'f3', 'f4', 'f5', 'f6') and not iid = 's1'),
k as (select marker_idx, {COUNTS} from cube where chr <> 'chrM' and sample_idx in (select sample_idx from q) group by marker_idx)
select c.marker_idx, c.sample_idx, c.dosage from cube c join k on k.marker_idx = c.marker_idx join q on q.sample_idx = c.sample_idx
where dosage is not null and n_missing <= k.n * 0.1e0""")
def _(g):
    return cells(assoc.filter_markers(g, geno_missing=0.1, keep_samples="fid in ('f1', 'f2', 'f3', 'f4', 'f5', 'f6')", remove_samples="iid = 's1'", attribute="chr <> 'chrM'"))


@register("tdt", """
+ j as (select k.marker_idx, k.dosage as k, m.dosage as m, d.dosage as d from cube k join cube m on m.marker_idx = k.marker_idx and m.sample_idx = k.sample_idx + 1 join cube d on d.marker_idx = k.marker_idx and d.sample_idx = k.sample_idx + 2 where k.sample_idx % 3 = 0 and k.dosage is not null and m.dosage is not null and d.dosage is not null),
h as (select marker_idx, cast(m = 1 as int) + cast(d = 1 as int) as hets, k - cast(m = 2 as int) - cast(d = 2 as int) as given from j),
s as (select marker_idx, cast(sum(given) as bigint) as t, cast(sum(hets - given) as bigint) as u from h where hets > 0 and given between 0 and hets group by marker_idx)
select marker_idx, t, u, (t - u) * (t - u) / cast(nullif(t + u, 0) as double) as chisq, t / cast(nullif(u, 0) as double) as odds_ratio from s""")
def _(g):
    return assoc.tdt(g, example_trios(g))


@register("filter_markers", f"""
+ q as (select sample_idx from (select sample_idx, {COUNTS} from cube where pos <= 4000000 group by sample_idx) where n_missing <= n * 0.09e0),
k as (select marker_idx, {COUNTS} from cube where pos <= 4000000 and sample_idx in (select sample_idx from q) group by marker_idx)
select c.marker_idx, c.sample_idx, c.dosage from cube c join k on k.marker_idx = c.marker_idx join q on q.sample_idx = c.sample_idx
where dosage is not null and n_missing / cast(k.n as double) <= 0.08e0 and least((n1 + 2 * n2) / (2e0 * (n0 + n1 + n2)), 1 - (n1 + 2 * n2) / (2e0 * (n0 + n1 + n2))) >= 0.45e0""")
def _(g):
    return cells(assoc.filter_markers(g, maf=0.45, geno_missing=0.08, mind=0.09, end=4000000))


HWE = f"""
+ k as (select marker_idx, {COUNTS} from cube group by marker_idx),
s as (select marker_idx, n1, n0 + n1 + n2 as n, 2 * least(n0, n2) + n1 as rare from k),
h as (select *, unnest(range(cast(rare % 2 as bigint), cast(rare + 1 as bigint), 2)) as het from s),
l as (select *, het * ln(2e0) - lgamma(het + 1e0) - lgamma((rare - het) / 2e0 + 1) - lgamma(n - het - (rare - het) / 2e0 + 1) as lp from h),
q as (select *, exp(lp - max(lp) over (partition by marker_idx)) as w, exp(max(case when het = n1 then lp end) over (partition by marker_idx) - max(lp) over (partition by marker_idx)) as own from l),
p as (select marker_idx, case when max(n) > 0 then least(1e0, sum(case when w <= own * (1 + 1e-9) then w else 0e0 end) / sum(w)) end as p from q group by marker_idx)"""


@register("hwe_exact", HWE + " select marker_idx, round(p, 9) as p from p")
def _(g):
    return rounded(assoc.hwe_exact(g), 9, "p")


# the registered number of rounds of reweighted least squares, on genotype counts
LOGISTIC = """
+ c as (select marker_idx, """ + ", ".join(f"cast(count(*) filter (pheno = {k} and dosage = {d}) as double) as {n}{d}" for k, n in ((2, "a"), (1, "u")) for d in (0, 1, 2)) + """ from cube where dosage is not null and pheno is not null group by marker_idx),
e as (select k.marker_idx, x, a, a + u as n from c k, lateral (values (0e0, a0, u0), (1e0, a1, u1), (2e0, a2, u2)) v(x, a, u)),
it as (select marker_idx, 0 as k, 0e0 as b0, 0e0 as b1, 0e0 as s0, 0e0 as det from c
  union all
  select marker_idx, k + 1, b0 + (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1), b1 + (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1), s0, s0 * s2 - s1 * s1
  from (select marker_idx, k, b0, b1, sum(n * p * (1 - p)) as s0, sum(n * p * (1 - p) * x) as s1, sum(n * p * (1 - p) * x * x) as s2, sum(a - n * p) as g0, sum((a - n * p) * x) as g1
    from (select it.*, x, a, n, 1 / (1 + exp(-greatest(least(b0 + b1 * x, 30e0), -30e0))) as p from it join e on e.marker_idx = it.marker_idx where k < 25) group by marker_idx, k, b0, b1)),
z as (select marker_idx, b1, sqrt(s0 / nullif(greatest(det, 0e0), 0e0)) as se from it where k = 25),
f as (select marker_idx, case when isfinite(b1) and isfinite(se) and abs(b1) <= 15 then b1 end as b1, se from z)
select marker_idx, round(b1, 6) + 0e0 as beta, case when b1 is not null then round(se, 6) end as se, round(b1 / se, 6) + 0e0 as z from f"""


@register("assoc_logistic", LOGISTIC)
def _(g):
    return rounded(assoc.assoc_logistic(g), 6, "beta", "se", "z")


@register("assoc_permuted")
def _(g):
    return assoc.assoc_permuted(g)


@register("assoc_models", """
+ k as (select marker_idx, """ + ", ".join(f"cast(count(*) filter (pheno = {p} and dosage = {d}) as double) as {n}{d}" for p, n in ((2, "a"), (1, "u")) for d in (0, 1, 2)) + """ from cube where dosage is not null and pheno is not null group by marker_idx),
m as (select *, a0 + u0 as n0, a1 + u1 as n1, a2 + u2 as n2, a0 + a1 + a2 as r, a0 + a1 + a2 + u0 + u1 + u2 as n from k)
select marker_idx,
  round(n * ((a1 + a2) * u0 - a0 * (u1 + u2)) * ((a1 + a2) * u0 - a0 * (u1 + u2)) / nullif(r * (n - r) * (n1 + n2) * n0, 0e0), 7) + 0e0 as dominant,
  round(n * (a2 * (u0 + u1) - (a0 + a1) * u2) * (a2 * (u0 + u1) - (a0 + a1) * u2) / nullif(r * (n - r) * n2 * (n0 + n1), 0e0), 7) + 0e0 as recessive,
  round(n * (n * (a1 + 2 * a2) - r * (n1 + 2 * n2)) * (n * (a1 + 2 * a2) - r * (n1 + 2 * n2)) / nullif(r * (n - r) * (n * (n1 + 4 * n2) - (n1 + 2 * n2) * (n1 + 2 * n2)), 0e0), 7) + 0e0 as trend,
  round(""" + " + ".join(f"coalesce(({x}{d} - {t} * n{d} / n) * ({x}{d} - {t} * n{d} / n) / nullif({t} * n{d} / n, 0e0), 0e0)" for x, t in (("a", "r"), ("u", "(n - r)")) for d in (0, 1, 2)) + """, 7) + 0e0 as general from m""")
def _(g):
    return rounded(assoc.assoc_models(g), 7, "dominant", "recessive", "trend", "general")


@register("population_inbreeding", f"""
+ k as (select marker_idx, {COUNTS} from cube where chr not in ('chrX', 'chrY', 'chrM') group by marker_idx),
e as (select marker_idx, 1e0 - 2e0 * p * (1e0 - p) * (2 * s) / cast(2 * s - 1 as double) as e from (select marker_idx, n0 + n1 + n2 as s, (n1 + 2 * n2) / cast(2 * (n0 + n1 + n2) as double) as p from k where n0 + n1 + n2 > 0)),
t as (select sample_idx, fid, count(*) filter (dosage <> 1) as o_hom, sum(e) as e_hom, count(*) as n from cube c join e on c.marker_idx = e.marker_idx where dosage is not null group by sample_idx, fid)
select fid as pop, round(avg((o_hom - e_hom) / nullif(n - e_hom, 0e0)), 7) + 0e0 as F, count(*) as n from t group by fid""")
def _(g):
    from locusframe.operators.qc import population_inbreeding

    return rounded(population_inbreeding(g), 7, "F")
