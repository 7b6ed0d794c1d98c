"""Filesets as pointers and by region, decoding by brute force, projections, and the smaller operators beside them."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusframe.operators import assoc, combine, haplotypes, linalg, linkage, pairwise, plotdata, select, stats
from locusframe.plans.adapter import genotypes as adapter
from locusframe.sources import plink
from tests.test_operators import make


@pytest.mark.parametrize("seed,hemizygous", [(1, False), (2, True), (3, False)])
def test_decoding_is_the_best_of_all_paths(seed, hemizygous):
    rng = np.random.default_rng(seed)
    parents = rng.choice([0, 2], (5, 3))
    model = haplotypes.Model(parents, np.cumsum(rng.uniform(1, 30, 5)), 10.0, 0.05)
    calls = rng.integers(-1, 3, (4, 5))
    got = model.decode(calls, np.full(4, hemizygous))
    allowed = [k for k in range(len(model.states)) if not (hemizygous and model.het[k])]

    def score(path, call):
        total = model.start[path[0]] + sum(model.move[k, a, b] for k, (a, b) in enumerate(itertools.pairwise(path)))
        return total + sum(model.emit[k, s, c] for k, (s, c) in enumerate(zip(path, call, strict=True)) if c >= 0)

    for path, call in zip(got, calls, strict=True):
        best = max(score(p, call) for p in itertools.product(allowed, repeat=5))
        assert set(path) <= set(allowed) and score(path, call) == pytest.approx(best)


def test_blocks_of_samples_are_decoded_alike(spark, monkeypatch):
    rng = np.random.default_rng(4)
    parents = make(spark, [[0, 2]] * 8, ids=["A", "B"], cm=[10.0 * i for i in range(8)])
    rows = rng.integers(0, 3, (8, 7)).tolist()
    kids = make(spark, rows, cm=[10.0 * i for i in range(8)])
    whole = sorted(map(tuple, haplotypes.reconstruct_haps(kids, parents).collect()))
    monkeypatch.setattr(haplotypes, "BLOCK", 2)
    assert sorted(map(tuple, haplotypes.reconstruct_haps(kids, parents).collect())) == whole and len(whole) == 56


def test_pointer_to_a_fileset_and_reading_a_part(spark, sf, tmp_path):
    g = select.subset(adapter(spark, sf), "marker_idx < 60")
    decade = F.floor(F.col("marker_idx") / 10).cast("int") + 1  # ten markers a chromosome, 25 kb apart
    g = g.with_(markers=g.markers.withColumns({"chr": F.concat(F.lit("chr"), decade.cast("string")), "chr_order": decade, "pos": F.col("marker_idx") * 25000}))
    pointer = plink.plinkify(spark, g, f"file://{tmp_path}", "small")
    row = pointer.summary(spark).first()
    assert (row.n_markers, row.n_samples) == (60, g.samples.count()) and row.bytes == 3 + 60 * -(-row.n_samples // 4)
    assert str(tmp_path) in str(pointer) and plink.plinkify(spark, f"file://{tmp_path}/small.bed", "w").prefix == f"file://{tmp_path}/small"
    with pytest.raises(Exception, match="absent"):
        plink.plinkify(spark, f"file://{tmp_path}/absent", "w")
    whole = pointer.read(spark)
    want = whole.long().where("chr = '3' or chr = 'chr3'").where("pos between 525000 and 650000 and iid in ('s1', 's2')").count()
    chrom = whole.markers.where("pos = 525000").first()["chr"]
    part = pointer.read(spark, chr=chrom, start=525000, end=650000, keep="iid in ('s1', 's2')")
    assert part.markers.count() == 6 and part.samples.count() == 2
    assert part.long().count() == want == 12
    assert pointer.read(spark, markers=["m7", "m3"]).calls.select("marker_idx").distinct().count() == 2


def test_projection_of_the_set_itself_gives_its_scores(spark):
    g = make(spark, np.random.default_rng(5).integers(0, 3, (30, 12)).tolist())
    pcs, _ = linalg.pca(g, 2)
    a, b = ({r.iid: (r.pc1, r.pc2) for r in t.collect()} for t in (pcs, linalg.pca_project(g, g, 2)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_matrices_want_unique_names_and_a_bounded_set(spark, monkeypatch):
    g = make(spark, [[0, 1, 2], [1, 1, 0]])
    cells = linalg.heatmap(g).collect()
    assert len(cells) == 9 and all(r.similarity == 1 for r in cells if r.iid1 == r.iid2)
    with pytest.raises(ValueError, match="unique"):
        linalg.mds(g.with_(samples=g.samples.withColumn("iid", F.lit("same"))))
    monkeypatch.setattr(linalg, "MOST_SAMPLES", 2)
    with pytest.raises(ValueError, match="too large"):
        linalg.heatmap_order(g)


def test_transmissions_permuted(spark):
    # 20 trios; at the first marker every heterozygous mother gives the counted allele, at the second every other one does
    rows = [[x for _ in range(20) for x in (1, 1, 0)], [x for k in range(20) for x in (k % 2, 1, 0)]]
    trios = spark.createDataFrame([(3 * k, 3 * k + 1, 3 * k + 2) for k in range(20)], "kid int, mom int, dad int")
    p = {r.marker_idx: r.p for r in assoc.tdt_permuted(make(spark, rows), trios, permutations=20_000).collect()}
    assert p[0] < 0.001 and p[1] > 0.9


def test_user_functions_by_group(spark):
    def span(t: pa.Table) -> pa.Table:
        d = t.column("dosage").to_numpy()
        return pa.table([t.column("chr").slice(0, 1), pa.array([int(d.max() - d.min())], pa.int32())], names=["chr", "span"])

    g = make(spark, [[0, 1], [2, 2], [1, 1]], chrs=["chr1", "chr1", "chr2"])
    assert {r.chr: r.span for r in stats.genoapply_fn(g, ["chr"], [], span, "chr string, span int").collect()} == {"chr1": 2, "chr2": 0}


def test_many_sets_and_targets(spark, sf):
    g = adapter(spark, sf)
    parts = [select.subset(g, f"marker_idx % 3 = {k}") for k in range(3)]
    assert combine.rbind_all(parts).calls.count() == g.calls.count()
    people = [select.subset(g, f"sample_idx % 3 = {k}", "samples") for k in range(3)]
    assert combine.cbind_all(people).samples.count() == g.samples.count()
    each = {(t, r.marker_idx): (r.r2, r.dprime) for t in ("m5", "m7") for r in linkage.ld_with(g, t).collect()}
    both = {(r.target, r.marker_idx): (r.r2, r.dprime) for r in linkage.ld_with(g, ["m5", "m7"]).collect()}
    assert both.keys() == each.keys() and all(both[k] == pytest.approx(each[k], nan_ok=True) for k in both if None not in each[k])


def test_mid_p_is_smaller(spark):
    g = make(spark, [[0, 1, 1, 2, 2, 2, 0, 1], [1] * 8, [None] * 8])
    p, mid = ({r.marker_idx: r.p for r in assoc.hwe_exact(g, m).collect()} for m in (False, True))
    assert mid[0] < p[0] and mid[1] < p[1] and p[2] is None


def test_components_without_the_matrix_of_samples(spark, monkeypatch):
    rng = np.random.default_rng(9)
    g = make(spark, [[None if v == 3 else int(v) for v in row] for row in rng.integers(0, 4, (60, 40))])
    whole = [t.toPandas() for t in linalg.pca(g, 3)]
    monkeypatch.setattr(linalg, "FEW_SAMPLES", 5, raising=False)

    def never(*a, **k):
        raise AssertionError("a samples x samples matrix")

    monkeypatch.setattr(linalg, "square", never)
    for a, b in zip(whole, [t.toPandas() for t in linalg.pca(g, 3)], strict=True):
        assert np.allclose(a.select_dtypes("number"), b.select_dtypes("number"), atol=1e-7)


def test_scaling_without_the_matrix_of_samples(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [[None if v > 2 else int(v) for v in row] for row in rng.integers(0, 9, (40, 30))]
    g = make(spark, [row[:28] + [None, 1 if k == 0 else None] for k, row in enumerate(rows)])  # some pairs have no distance
    g = g.with_(samples=g.samples.withColumn("sample_idx", F.col("sample_idx") * 3 + 5), calls=g.calls.withColumn("sample_idx", F.col("sample_idx") * 3 + 5))
    whole = linalg.mds(g, 3).toPandas()
    monkeypatch.setattr(linalg, "FEW_SAMPLES", 5)
    monkeypatch.setattr(pairwise, "ROWS_SENT", 11)

    def never(*a, **k):
        raise AssertionError("a samples x samples matrix")

    monkeypatch.setattr(linalg, "distances", never)
    kept = linalg.mds(g, 3).toPandas()
    assert list(whole.iid) == list(kept.iid)
    assert np.allclose(whole.select_dtypes("number"), kept.select_dtypes("number"), atol=1e-7)
    with pytest.raises(ValueError, match="unique"):
        linalg.mds(g.with_(samples=g.samples.withColumn("iid", F.lit("same"))))


def test_largest_finds_values_as_often_as_they_occur():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((300, 300)))[0]
    value = np.concatenate([[9.0, 9, 9, 8], np.linspace(5, -7, 296)])
    found, vector = linalg.largest(lambda v: q @ (value[:, None] * (q.T @ v)), 300, 4)
    assert np.allclose(found, [9, 9, 9, 8]) and np.allclose(vector.T @ vector, np.eye(4))


def test_complete_linkage_is_as_by_the_least_of_all_distances_and_not_cubic():
    def plain(d):
        trees, dist = {i: [i] for i in range(len(d))}, d.copy()
        np.fill_diagonal(dist, np.inf)
        while len(trees) > 1:
            i, j = sorted(int(x) for x in np.unravel_index(np.argmin(dist), dist.shape))
            trees[i] = trees[i] + trees.pop(j)
            dist[i] = dist[:, i] = np.maximum(dist[i], dist[j])
            dist[j] = dist[:, j] = dist[i, i] = np.inf
        return list(trees.values())[0]

    rng = np.random.default_rng(5)
    for n, values in ((2, 3), (30, 3), (80, 7), (80, 1), (150, 1000)):  # few values: many ties
        d = rng.integers(0, values, (n, n)) / values
        d = np.maximum(d, d.T)
        np.fill_diagonal(d, 0)
        assert linalg.complete_linkage_order(d) == plain(d)
    d = rng.random((3000, 3000))
    began = time.process_time()
    assert sorted(linalg.complete_linkage_order(np.maximum(d, d.T))) == list(range(3000))
    assert time.process_time() - began < 10  # a search of the whole matrix for each merge takes longer


def test_the_basis_of_components_is_not_in_memory():
    import tracemalloc

    from locusframe.operators import linalg

    n, sent = 20_000, []
    weight = np.r_[np.linspace(0, 1, n - 8), 1.02 + np.arange(8) / 100]

    def apply(v):
        sent.append(v.shape[1])
        return weight[:, None] * v

    tracemalloc.start()
    value, vector = linalg.largest(apply, n, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(value, weight[::-1][:4]) and np.allclose(np.abs(vector[n - 1 - np.arange(4), np.arange(4)]), 1)
    # the columns that the iteration made would be more than all that was held
    assert sum(sent) * n * 8 > 1.4 * peak


def test_distances_are_kept_of_pairs_that_have_one_in_small_parts(spark, sf, monkeypatch):
    from locusframe.operators import linalg
    from locusframe.operators.pairwise import tile_counts
    from locusframe.plans.adapter import genotypes

    monkeypatch.setattr(linalg, "PAIRS_PACKED", 7)
    g = genotypes(spark, sf)
    # s0 to s4 and s5 to s9 have no marker in common
    g = g.with_(calls=g.calls.where("marker_idx % 2 = floor(sample_idx / 5)"))
    ids = np.arange(10)
    held, mean = linalg.kept_distances(g, ids)
    parts = held.collect()
    assert sum(len(r["d"]) // 8 for r in parts) == 2 * 20
    e = np.zeros((10, 10))
    for r in tile_counts(g, every=True).collect():
        e[r.i, r.j] = e[r.j, r.i] = (r.ibs1 + 2 * r.ibs0) / (2 * r.n) if r.n else np.nan
    assert np.isclose(mean, np.nanmean(e))
    e = np.where(np.isnan(e), mean, e) ** 2
    v = np.random.default_rng(1).standard_normal((10, 3))
    assert np.allclose(linalg.squared_products(held, mean, v), e @ v)


def test_heat_map_bounds_linked_samples_not_all(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows, group = rng.integers(0, 3, (60, 24)), rng.permutation(np.arange(24) % 4)
    # a group of six samples shares no marker with the others, and the samples of group 3 are each alone
    rows = [[int(v) if k % 3 == group[s] else None for s, v in enumerate(row)] for k, row in enumerate(rows)]
    g = make(spark, rows)
    g = g.with_(samples=g.samples.withColumn("sample_idx", F.col("sample_idx") * 3 + 5), calls=g.calls.withColumn("sample_idx", F.col("sample_idx") * 3 + 5))
    names, d = linalg.distances(g)
    d = np.where(np.isnan(d), 1, d)
    np.fill_diagonal(d, 0)
    want = [names[k] for k in linalg.complete_linkage_order(d)]
    monkeypatch.setattr(linalg, "MOST_SAMPLES", 6)
    for cells in (1 << 24, 4):  # a group's matrix in memory, and in a file
        monkeypatch.setattr(linalg, "CELLS_IN_MEMORY", cells)
        assert [r.iid for r in linalg.heatmap_order(g).orderBy("place").collect()] == want
    monkeypatch.setattr(linalg, "MOST_SAMPLES", 5)
    with pytest.raises(ValueError, match="too large"):
        linalg.heatmap_order(g)


def test_heat_map_has_every_cell(spark, monkeypatch):
    g = make(spark, [[0, 1, 2, 1, None], [1, 1, 0, 0, None], [None, None, None, None, 2]])
    monkeypatch.setattr(linalg, "MOST_SAMPLES", 4)
    monkeypatch.setattr(linalg, "ROWS_FILLED", 2)
    monkeypatch.setattr(linalg, "COLUMNS_FILLED", 3)
    place = {r.iid: r.place for r in linalg.heatmap_order(g).collect()}
    d = {frozenset((r.iid1, r.iid2)): r.dist for r in pairwise.dist_ibs(g).collect()}
    want = {(a, place[a], b, place[b]): 1.0 if a == b else 1 - (1.0 if d[frozenset((a, b))] is None else d[frozenset((a, b))]) for a in place for b in place}
    got = [tuple(r) for r in linalg.heatmap(g).collect()]
    assert len(got) == 25 and {x[:4]: x[4] for x in got} == want


def test_cells_of_components_are_made_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    g = make(spark, [[None if v == 3 else int(v) for v in row] for row in rng.integers(0, 4, (60, 40))])
    whole = linalg.pca(g, 3)[1].toPandas()
    plans, kept = [], linalg.kept_rows
    monkeypatch.setattr(linalg, "FEW_SAMPLES", 5)
    monkeypatch.setattr(linalg, "kept_rows", lambda cells, ids: (plans.append(cells._jdf.queryExecution().optimizedPlan().toString()), kept(cells, ids))[1])
    found = linalg.pca(g, 3)[1].toPandas()
    assert np.allclose(whole.explained, found.explained, atol=1e-7)
    # rows are counted and packed from a written table, not each time from the calls
    assert len(plans) == 1 and "Join" not in plans[0] and "Aggregate" not in plans[0]


def test_loadings_standardise_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    g = make(spark, [[None if v == 3 else int(v) for v in row] for row in rng.integers(0, 4, (60, 40))])
    whole = linalg.pca_loadings(g, 2).orderBy("marker_idx").toPandas()
    made, standardised = [], linalg.standardised
    monkeypatch.setattr(linalg, "FEW_SAMPLES", 5)
    monkeypatch.setattr(linalg, "standardised", lambda g: (made.append(g), standardised(g))[1])
    kept = linalg.pca_loadings(g, 2).orderBy("marker_idx").toPandas()
    assert np.allclose(whole, kept, atol=1e-6) and len(made) == 1


def test_explained_variance_of_many_equal_groups_brings_one_sum_a_pass_to_the_driver(spark, monkeypatch):
    # like the tables repeated with shifted keys: groups without a marker in common, each eigenvalue once a group
    rng = np.random.default_rng(3)
    one = [[None if v == 3 else int(v) for v in row] for row in rng.integers(0, 4, (30, 12))]
    copies = 9
    g = make(spark, [[None] * 12 * c + row + [None] * 12 * (copies - 1 - c) for c in range(copies) for row in one])
    first = linalg.pca(make(spark, one), 1)[1].first()
    frame, fetched = type(spark.range(0)), []
    collect = frame.collect

    def counted(self):
        rows = collect(self)
        fetched.append(sum(len(x) for r in rows for x in r if isinstance(x, bytes | bytearray)))
        return rows

    monkeypatch.setattr(linalg, "FEW_SAMPLES", 5)
    monkeypatch.setattr(frame, "collect", counted)
    found = plotdata.scree(linalg.pca(g, 4)[1]).toPandas().sort_values("pc")
    assert np.allclose(found.eigenvalue, first.eigenvalue) and np.allclose(found.cumulative, first.explained / copies * np.arange(1, 5))
    # of a pass the driver gets one array of the size of its six vectors, not one from each of the tasks
    assert max(fetched) == 12 * copies * 6 * 8
