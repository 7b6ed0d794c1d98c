"""Hand-made fixtures, one for each decision."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet
from locusframe.operators import assoc, combine, encode, haplotypes, intensity, linalg, linkage, pairwise, popgen, qc, select, stats, windows
from locusframe.sources import export, plink, report


def make(spark, rows, ids=None, chrs=None, a1=None, a2=None, cm=None, sex=None, fid=None, x=None, y=None):
    """A set from a list of rows of dosages (None: missing)."""
    n, k = len(rows), len(rows[0])
    names = ids or [f"id{j + 1}" for j in range(k)]
    m = [(i, (chrs or ["chr1"] * n)[i], 1, f"snp{i + 1}", (cm or [0.5 * (i + 1) for i in range(n)])[i], 500_000 * (i + 1), (a1 or ["A"] * n)[i], (a2 or ["C"] * n)[i], "") for i in range(n)]
    s = [(j, names[j], (fid or ["f"] * k)[j], None, None, (sex or [2] * k)[j], None, "") for j in range(k)]
    c = [(i, j, rows[i][j], None if x is None else float(x[i][j]), None if y is None else float(y[i][j])) for i in range(n) for j in range(k) if rows[i][j] is not None or x is not None]
    return GenotypeSet(
        spark.createDataFrame(m, "marker_idx int, chr string, chr_order int, marker string, cM double, pos int, A1 string, A2 string, filter string"),
        spark.createDataFrame(s, "sample_idx int, iid string, fid string, mom string, dad string, sex int, pheno double, filter string"),
        spark.createDataFrame(c, "marker_idx int, sample_idx int, dosage int, x double, y double"),
    )


def column(df, value, key="marker_idx"):
    return [r[value] for r in df.orderBy(key).collect()]


def matrix(g):
    out = {}
    for r in g.observed().collect():
        out[r.marker_idx, r.sample_idx] = r.dosage
    return out


def test_consensus_ties_go_to_the_lowest_code(spark):
    g = make(spark, [[0, 1, None], [1, 2, 2], [None, None, None], [2, 0, 1]])
    assert column(stats.consensus(g, 1.0), "dosage") == [0, 2, None, 0]
    assert column(stats.consensus(g, 0.0), "dosage") == [None, 2, None, 0]


def test_segregating_needs_both_homozygotes_unless_hets_count(spark):
    g = make(spark, [[1, 1, 1], [0, 2, 0], [0, 0, 0], [0, 1, 0]])
    assert column(stats.segregating(g), "segregating") == [False, True, False, False]
    assert column(stats.segregating(g, allow_het=True), "segregating") == [True, True, False, True]


def test_missing_rows_and_columns_are_counted(spark):
    g = make(spark, [[0, None], [None, None]])
    assert column(stats.nmiss(g), "n_missing") == [1, 2]
    assert column(stats.freq(g), "freq") == [0.0, None]
    assert column(stats.freq(g, counts=True), "copies") == [0, 0]
    assert column(stats.nmiss(g, "samples"), "missingness", "sample_idx") == [0.5, 1.0]


def test_recode_by_frequency_breaks_ties_alphabetically(spark):
    native = encode.to_native(make(spark, [[0, 2, 1]], a1=["C"], a2=["A"]))
    assert column(encode.relative_by_frequency(native).calls, "dosage", "sample_idx") == [2, 0, 1]


def test_recode_round_trip_and_relative_flip(spark):
    g = make(spark, [[0, 2, 2], [0, 0, 2], [0, 2, 1]])
    assert matrix(encode.to_numeric(encode.to_native(g))) == matrix(g)
    assert matrix(encode.to_relative(g))[0, 0] == 2 and matrix(encode.to_relative(g))[2, 0] == 0
    with pytest.raises(ValueError):
        encode.to_native(encode.to_relative(g))


@pytest.mark.parametrize(
    ("x", "y", "action", "flip"),
    [("AC", "AG", "drop", False), ("AC", "TG", "strand", False), ("AC", "CA", "order", True), ("AC", "GT", "both", True), ("AT", "TA", "strand", False), ("AC", "AC", "same", False), ("AC", "A0", "drop", False), ("AG", "TT", "drop", False)],
)
def test_allele_rules(spark, x, y, action, flip):
    a, b = (spark.createDataFrame([("m", s[0], s[1])], "marker string, A1 string, A2 string") for s in (x, y))
    r = combine.allele_actions(a, b).first()
    assert (r.action, r.flip) == (action, flip)


def test_merge_turns_the_left_set_round(spark):
    x = make(spark, [[0, 1]], ids=["a", "b"], a1=["A"], a2=["C"])
    y = make(spark, [[0, 2]], ids=["c", "d"], a1=["C"], a2=["A"])
    y = y.with_(samples=y.samples.withColumn("sample_idx", F.col("sample_idx") + 2), calls=y.calls.withColumn("sample_idx", F.col("sample_idx") + 2))
    merged = combine.merge(x, y, check_alleles=True)
    assert matrix(merged) == {(0, 0): 2, (0, 1): 1, (0, 2): 0, (0, 3): 2}
    with pytest.raises(ValueError):
        combine.merge(x, x)


def test_cbind_then_count_is_the_sum(spark):
    g = make(spark, [[0, 1, 2], [2, 2, None]])
    a, b = select.subset(g, "sample_idx < 1", "samples"), select.subset(g, "sample_idx >= 1", "samples")
    assert matrix(combine.cbind(a, b)) == matrix(g)
    with pytest.raises(ValueError):
        combine.cbind(g, g)


def test_thin_keeps_edges_and_first_of_bins(spark):
    g = make(spark, [[0]] * 6, cm=[0.0, 2.5, 2.6, 7.5, None, 20.0])
    assert column(windows.thin(g, 5.0).markers, "marker_idx") == [0, 2, 5]


def test_make_unique(spark):
    t = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "a")], "k int, name string")
    assert column(select.make_unique(t, "name", "k"), "name", "k") == ["a", "b", "a.1", "a.2"]


def test_sample_qc_thresholds_by_family_and_hits(spark):
    g = make(spark, [[1, 1, 0], [1, 1, None], [1, 0, None]], fid=["inbred", "f1", "f1"])
    _, r = qc.run_sample_qc(g, max_H={"inbred": 1, "f1": 5}, max_N=1)
    assert column(r, "filter", "sample_idx") == ["H", "", "N"]
    kept, _ = qc.run_sample_qc(g, max_H=0, max_N=0, apply=True, hits=1)
    assert column(kept.samples, "iid", "sample_idx") == ["id1", "id2", "id3"]
    kept, _ = qc.run_sample_qc(g, max_H=0, max_N=0, apply=True)
    assert kept.samples.count() == 0


def test_ks_with_ties(spark):
    g = make(spark, [[0, 0]] * 4, x=[[1, 2], [1, 2], [2, 3], [2, 3]], y=[[0, 0]] * 4)
    ref = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (2.0,)], "si double")
    assert column(qc.intensity_vs_ref(g, ref), "D", "sample_idx") == [0.0, 0.5]


def test_sex_from_y_calls(spark):
    rows = [[0, None, 0] for _ in range(71)]
    rows = [[0 if i < 41 else 0, 0 if i < 39 else None, 0 if i < 39 else (None if i < 60 else 0)] for i in range(71)]
    g = make(spark, rows, chrs=["chrY"] * 71)
    assert column(qc.predict_sex_ycalls(g), "predicted", "sample_idx") == [1, 2, 1]


def test_ibs_distance_without_overlap_is_null(spark):
    g = make(spark, [[0, 2, None], [1, 2, None], [None, None, 0]])
    d = {(r.iid1, r.iid2): r.dist for r in pairwise.dist_ibs(g).collect()}
    assert d == {("id1", "id2"): 0.75, ("id1", "id3"): None, ("id2", "id3"): None}


def test_tiles_agree_with_the_panel_form(spark, monkeypatch):
    rng = np.random.default_rng(1)
    g = make(spark, [[None if v == 3 else int(v) for v in row] for row in rng.integers(0, 4, (40, 11))])
    monkeypatch.setattr(pairwise, "MARKERS_PER_BLOCK", 7)
    monkeypatch.setattr(pairwise, "SAMPLES_PER_TILE", 4)
    tiles = {(r.i, r.j): (r.n, r.ibs2, r.ibs1, r.ibs0) for r in pairwise.tile_counts(g).collect()}
    pair = pairwise.panel_pairs(g).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.abs(F.col("d1") - F.col("d2")) == d).alias(f"k{d}") for d in (0, 1, 2)])
    assert tiles == {(r.i, r.j): (r.n, r.k0, r.k1, r.k2) for r in pair.collect()}


def test_fst_when_a_population_is_missing_at_a_marker(spark):
    g = make(spark, [[0, 0, 2, 2], [0, 1, None, None], [0, 2, 0, 2]], fid=["p", "p", "q", "q"])
    t = {r.marker_idx: r.theta for r in popgen.weir_fst_locus(g).collect()}
    assert t[0] == pytest.approx(1.0) and t[2] < 0
    assert popgen.pairwise_fst(g).count() == 1


def test_fst_does_not_depend_on_labels(spark):
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (20, 8)).tolist()
    a = popgen.weir_fst(make(spark, rows, fid=list("aaabbbcc"))).first()
    b = popgen.weir_fst(make(spark, rows, fid=list("zzzyyyxx"))).first()
    assert a.theta == pytest.approx(b.theta)


def test_quantile_normalize_gives_equal_distributions(spark):
    g = make(spark, [[0, 0]] * 3, x=[[1, 6], [2, 4], [3, 5]], y=[[0, 0]] * 3)
    rows = sorted((r.sample_idx, r.marker_idx, r.x) for r in intensity.quantile_normalize(g).calls.collect())
    assert [x for _, _, x in rows] == [2.5, 3.5, 4.5, 4.5, 2.5, 3.5]


@pytest.mark.parametrize(
    ("centres", "theta", "baf", "r"),
    [
        ((None, None, None), 0.5, None, None),
        ((None, None, 0.8), 0.9, 1.0, 1.0),
        ((None, None, 0.8), 0.7, None, None),
        ((0.2, None, None), 0.1, 0.0, 1.0),
        ((0.2, None, None), 0.3, None, None),
        ((0.2, None, 0.8), 0.1, 0.0, 1.0),
        ((0.2, None, 0.8), 0.9, 1.0, 1.0),
        ((0.2, None, 0.8), 0.5, None, None),
        ((None, 0.5, 0.8), 0.65, 0.75, 1.0),
        ((None, 0.5, 0.8), 0.9, 1.0, None),
        ((0.2, 0.5, None), 0.35, 0.25, 1.0),
        ((0.2, 0.5, 0.8), 0.35, 0.25, 1.0),
        ((0.2, 0.5, 0.8), 0.65, 0.75, 1.0),
        ((0.8, 0.5, 0.2), 0.35, 0.25, 1.0),
        ((0.6, 0.5, 0.8), 0.35, None, None),
        ((0.2, 0.5, 0.8), None, None, None),
    ],
)
def test_baf_ladder(spark, centres, theta, baf, r):
    a, h, b = centres
    unit = lambda c: None if c is None else 1.0
    t = spark.createDataFrame([(2.0, theta, a, unit(a), h, unit(h), b, unit(b))], "r double, theta double, AT double, AR double, HT double, HR double, BT double, BR double")
    got = intensity.baf_lrr(t, (F.lit(0.2), F.lit(0.8))).first()
    assert got.baf == (None if baf is None else pytest.approx(baf))
    assert got.lrr == (None if r is None else pytest.approx(1.0))


def test_hmm_follows_the_parent_and_drops_hets_for_males_on_x(spark):
    parents = make(spark, [[0, 2]] * 6, ids=["A", "B"], chrs=["chrX"] * 6, cm=[10.0 * i for i in range(6)])
    kids = make(spark, [[0, 1], [0, 1], [0, 1], [2, 1], [2, 1], [2, 1]], ids=["son", "daughter"], chrs=["chrX"] * 6, cm=[10.0 * i for i in range(6)], sex=[1, 2])
    haps = haplotypes.reconstruct_haps(kids, parents)
    by = {}
    for r in haps.orderBy("marker_idx").collect():
        by.setdefault(r.iid, []).append(r.hap1 + r.hap2)
    assert by["son"] == ["AA"] * 3 + ["BB"] * 3
    assert set(by["daughter"]) == {"AB"}
    assert haplotypes.haplotype_blocks(haps).count() == 3


def test_pseudophase_keeps_columns(spark):
    assert haplotypes.pseudophase([("A", "B"), ("C", "A"), ("C", "C")]) == [("A", "B"), ("A", "C"), ("C", "C")]


def test_hwe_exact_against_enumeration():
    def brute(n0, n1, n2):
        n, rare = n0 + n1 + n2, 2 * n2 + n1
        p = {}
        for h in range(rare % 2, min(rare, 2 * n - rare) + 1, 2):
            a = (rare - h) // 2
            p[h] = math.factorial(n) / (math.factorial(a) * math.factorial(h) * math.factorial(n - a - h)) * 2**h
        total = sum(p.values())
        return sum(v for v in p.values() if v <= p[n1] * (1 + 1e-9)) / total

    class Batch:
        pass

    cases = [(3, 4, 2), (5, 0, 5), (10, 1, 0), (2, 9, 1), (0, 0, 4)]
    got = _hwe_of(cases)
    assert got == pytest.approx([brute(*c) for c in cases])


def _hwe_of(cases):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    n = max(sum(c) for c in cases)
    rows = [([0] * a + [1] * b + [2] * c + [None] * n)[:n] for a, b, c in cases]
    return column(assoc.hwe_exact(make(spark, rows)), "p")


def test_logistic_regression_matches_odds_of_two_groups(spark):
    rows = [[0] * 10 + [1] * 10]
    g = make(spark, rows)
    p = F.when(F.col("sample_idx").isin(0, 1, 10, 11, 12, 13, 14, 15), 2.0).otherwise(1.0)
    r = assoc.assoc_logistic(g.with_(samples=g.samples.withColumn("pheno", p))).first()
    assert r.beta == pytest.approx(math.log((6 / 4) / (2 / 8)))


def test_tdt_counts_heterozygous_parents(spark):
    g = make(spark, [[2, 1, 1], [1, 1, 0], [0, 1, 2]])
    trios = spark.createDataFrame([(0, 1, 2)], "kid int, mom int, dad int")
    got = {r.marker_idx: (r.t, r.u) for r in assoc.tdt(g, trios).collect()}
    assert got == {0: (2, 0), 1: (1, 0)}  # the third is a Mendelian error


def test_prune_drops_a_copy(spark):
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 3, (4, 60)).tolist()
    kept = column(linkage.prune(make(spark, [*rows, rows[0]])).markers, "marker_idx")
    assert kept == [0, 1, 2, 3]


def test_pruning_holds_no_matrix_of_all_samples_and_markers():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 40_000  # as a matrix of 2,000 markers and 40,000 samples: 640 MB
    t = pa.table({"marker_idx": pa.array(np.arange(n, dtype=np.int32) % 2000), "sample_idx": pa.array(np.arange(n, dtype=np.int32)), "dosage": pa.array(rng.integers(0, 3, n).astype(np.int32))})
    tracemalloc.start()
    kept = linkage.kept_of(t, 50, 25, 2.0)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert kept.num_rows > 1900


def test_dprime_of_complete_linkage():
    r2, d = linkage.haplotype_em(np.array([[10, 0, 0], [0, 10, 0], [0, 0, 10]], float))
    assert r2[0] == pytest.approx(1.0, abs=1e-6) and d[0] == pytest.approx(1.0, abs=1e-6)


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (30, 12))
    pcs, share = linalg.pca(make(spark, x.tolist()), 3)
    mean, p = x.mean(1, keepdims=True), x.mean(1, keepdims=True) / 2
    z = (x - mean) / np.sqrt(p * (1 - p))
    u, s, _ = np.linalg.svd((z - z.mean(1, keepdims=True)).T, full_matrices=False)
    got = np.array([[r.pc1, r.pc2, r.pc3] for r in pcs.collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6)
    assert column(share, "eigenvalue", "pc") == pytest.approx((s[:3] ** 2).tolist())


def test_lda_separates_classes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, str(i % 2) if i < 60 else None, (rng.standard_normal(3) + 6 * (i % 2)).tolist()) for i in range(80)]
    t = spark.createDataFrame(rows, "k int, c string, v array<double>")
    assert all(r.predicted == str(r.k % 2) for r in linalg.lda(t, "c", "v", "k").collect())


def test_recluster(spark):
    g = make(spark, [[0, 0, 0, 0]], x=[[1.0, 0.9, 0.1, 0.0]], y=[[0.0, 0.1, 0.9, 1.0]])
    assert column(linalg.recluster(g), "cluster", "sample_idx") == [0, 0, 1, 1]


def test_complete_linkage_order():
    d = np.array([[0, 1, 9, 8], [1, 0, 9, 9], [9, 9, 0, 2], [8, 9, 2, 0]], float)
    assert linalg.complete_linkage_order(d) == [0, 1, 2, 3]


@pytest.mark.parametrize("n", [1, 3, 4, 5, 9])
def test_bed_round_trip_for_any_number_of_samples(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    rows = [[None if v == 3 else int(v) for v in r] for r in rng.integers(0, 4, (6, n))]
    xs = rng.integers(0, 60000, (6, n)) / 10000
    g = make(spark, rows, x=xs.tolist(), y=(xs / 2).round(4).tolist())
    plink.write_plink(g, str(tmp_path / "p"), intensity=True)
    back = plink.read_plink(spark, str(tmp_path / "p"), intensity=True)
    assert matrix(back) == matrix(g)
    assert (tmp_path / "p.bed").stat().st_size == 3 + 6 * -(-n // 4)
    got = {(r.marker_idx, r.sample_idx): r.x for r in back.calls.collect()}
    assert all(abs(got[i, j] - xs[i][j]) < 2e-4 for i in range(6) for j in range(n))


@pytest.mark.parametrize("n", [1, 4, 6])
def test_tasks_write_the_bytes_of_a_fileset_as_folders(spark, tmp_path, monkeypatch, n):
    import pyarrow as pa

    monkeypatch.setattr(plink, "CELLS_PER_PART", 6, raising=False)
    rng = np.random.default_rng(n)
    rows = [[None if v == 3 else int(v) for v in r] for r in rng.integers(0, 4, (7, n))]
    xs = rng.integers(0, 80000, (7, n)) / 10000
    ys = np.where(rng.random((7, n)) < 0.5, 0.0, xs / 2)
    g = make(spark, rows, x=xs.tolist(), y=ys.tolist())
    g = g.with_(calls=g.calls.where("marker_idx not in (2, 3) and (dosage is not null or sample_idx % 2 = 0)"))
    plink.write_plink(g, f"{tmp_path}/one", intensity=True)
    plink.write_plink(g, f"{tmp_path}/many", intensity=True, parts=True)
    for kind in ("bed", "bii"):
        files = sorted((tmp_path / f"many.{kind}").iterdir())
        whole = b"".join(pa.input_stream(f, compression="zstd").read() for f in files)
        assert whole == (tmp_path / f"one.{kind}").read_bytes() and len(files) > 1
    dense = sorted(map(tuple, plink.read_plink(spark, f"{tmp_path}/one", intensity=True).calls.collect()), key=str)
    assert len(dense) == 7 * n
    for called in (False, True):
        for condition, holds in (("true", lambda m: True), ("marker_idx between 1 and 4", lambda m: 1 <= m <= 4), ("marker_idx > 6", lambda m: m > 6)):
            back = plink.read_plink(spark, f"{tmp_path}/many", intensity=True, called=called).calls.where(condition)
            want = [r for r in dense if holds(r[0]) and not (called and r[2] is None)]
            assert sorted(map(tuple, back.collect()), key=str) == want


def test_only_called_cells_of_a_fileset_are_made_where_asked_for(spark, tmp_path):
    g = make(spark, [[None, None, 1, None, None]] * 3, x=[[0.0] * 5] * 3, y=[[0.0] * 5] * 3)
    plink.write_plink(g, str(tmp_path / "p"), intensity=True)
    made = plink.BedReader({"path": str(tmp_path / "p.bed"), "n_samples": "5", "n_markers": "3", "called": "true"})
    assert [x.num_rows for p in made.partitions() for x in made.read(p)] == [3]
    # a call without intensities is there, too
    back = plink.read_plink(spark, str(tmp_path / "p"), intensity=True, called=True).long()
    assert sorted((r.marker_idx, r.sample_idx, r.dosage, r.x, r.y) for r in back.collect()) == [(m, 2, 1, 0.0, 0.0) for m in range(3)]


def test_report_import_and_map_only_markers(spark, tmp_path):
    g = make(spark, [[0, 1], [2, None], [1, 1]], x=[[0.1, 0.2]] * 3, y=[[0.3, 0.4]] * 3)
    report.write_report(g, str(tmp_path / "r"))
    more = g.markers.drop("marker_idx", "filter").unionByName(spark.createDataFrame([("chr1", 1, "extra", 9.0, 9_000_000, "A", "C")], "chr string, chr_order int, marker string, cM double, pos int, A1 string, A2 string"))
    back = report.read_beadstudio(spark, str(tmp_path / "r"), more)
    assert matrix(back) == matrix(g)
    assert back.markers.count() == 4
    assert column(stats.nmiss(back), "n_missing")[3] == 2


def test_a_report_is_written_by_tasks_without_shuffling_missing_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "CELLS_PER_FILE", 6, raising=False)
    g = make(spark, [[0, 1, None, 2], [2, None, None, 1], [1, 1, None, None]], x=[[0.1, 0.2, 0.3, 0.4]] * 3, y=[[0.3, 0.4, 0.5, 1e-5]] * 3)
    g = g.with_(calls=g.calls.where("sample_idx <> 2 and not (marker_idx = 1 and sample_idx = 3)"))
    report.write_report(g, str(tmp_path / "r"))
    files = sorted((tmp_path / "r").glob("part-*"))
    assert len(files) > 1
    lines = "".join(f.read_text() for f in files).split("\n")
    assert lines[:1] + lines[8:10] == ["[Header]", "[Data]", "\t".join(report.COLUMNS.values())]
    assert [tuple(x.split("\t")[:2]) for x in lines[10:-1]] == [(f"snp{m}", f"id{k}") for k in range(1, 5) for m in range(1, 4)]
    assert lines[10] == "snp1\tid1\t0.1\t0.3\tA\tA" and lines[16] == "snp1\tid3\tNaN\tNaN\t-\t-"
    assert lines[20] == "snp2\tid4\tNaN\tNaN\t-\t-" and lines[21] == "snp3\tid4\t0.4\t1.0E-5\t-\t-"
    back = report.read_beadstudio(spark, str(tmp_path / "r"), g.markers.drop("marker_idx", "filter"))
    assert matrix(back) == matrix(g) and back.samples.count() == 4


def test_validate_finds_what_is_wrong(spark):
    g = make(spark, [[0, 1]], a1=["A"], a2=["A"])
    bad = g.with_(calls=g.calls.union(spark.createDataFrame([(7, 0, 5, None, None)], g.calls.schema)))
    found = {r.check: r.n_bad for r in select.validate(bad).collect()}
    assert found["alleles differ"] == 1 and found["calls have a marker"] == 1 and found["dosage in range"] == 1
    assert {r.n_bad for r in select.validate(make(spark, [[0, 1]])).collect()} == {0}


def test_wide_and_rqtl(spark):
    g = make(spark, [[0, 1], [2, None]])
    assert [tuple(r)[-2:] for r in export.wide_table(g).orderBy("pos").collect()] == [(0, 1), (2, None)]
    assert matrix(export.from_rqtl(*export.as_rqtl(g))) == matrix(g)


def test_fix_strand_swaps(spark):
    native = encode.to_native(make(spark, [[0, 2], [0, 2], [0, 1]], a1=["A", "A", "A"], a2=["C", "C", "C"]))
    turned = native.with_(markers=native.markers.withColumns({"A1": F.when(F.col("marker_idx") == 0, "T").otherwise(F.when(F.col("marker_idx") == 1, "G").otherwise(F.col("A1"))), "A2": F.when(F.col("marker_idx") == 0, "G").when(F.col("marker_idx") == 1, "G").otherwise(F.col("A2"))}))
    fixed, log = encode.fix_strand_swaps(turned)
    assert column(log, "swapped") == [True, False, False]
    assert column(log, "unresolved") == [False, True, False]
    assert column(fixed.markers, "A1")[0] == "A"


def test_design_of_a_cross(spark):
    """Consensus of each strain, markers fixed between them, and the F1 that is expected there."""
    a, b = [0, 0, 0, 2, 1], [0, 2, 2, 0, 2]
    rows = [[a[i], a[i], b[i], b[i]] for i in range(5)]
    g = make(spark, rows, fid=["A", "A", "B", "B"])
    strains = []
    for j, fid in enumerate("AB"):
        c = stats.consensus(select.subset(g, F.col("fid") == fid, "samples")).withColumn("sample_idx", F.lit(j))
        strains.append(c.select("marker_idx", "sample_idx", "dosage"))
    samples = spark.createDataFrame([(0, "A", "A"), (1, "B", "B")], "sample_idx int, iid string, fid string")
    panel = GenotypeSet(g.markers, samples, strains[0].unionByName(strains[1]))
    assert column(stats.fixed_diffs(panel, "A", "B"), "fixed_diff") == [False, True, True, True, False]
    assert column(pairwise.predict_f1(panel), "dosage") == [0.0, 1.0, 1.0, 1.0, None]
    assert column(stats.informative(g), "informative") == [False, True, True, True, False]


def test_recode_to_a_parent_of_another_set(spark):
    g, parents = make(spark, [[0, 1], [2, 0], [1, 2]]), make(spark, [[2, 0], [0, 0]], ids=["P", "Q"])
    assert matrix(encode.recode_to_parent(g, "P", parents)) == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 2}


def test_wide_tables_of_some_samples(spark):
    g = make(spark, [[0, 2, None], [1, None, 2]])
    assert export.hgdp_table(g, ["id2"]).columns == ["marker", "id2"]
    assert [r.id2 for r in export.hgdp_table(g, ["id2"]).collect()] == [r.id2 for r in export.hgdp_table(g).collect()]
    assert export.wide_table(g, ["id1", "id3"]).columns[-2:] == ["id1", "id3"]
    assert {(r.marker, r.id3) for r in export.wide_table(g, ["id1", "id3"]).collect()} == {(r.marker, r.id3) for r in export.wide_table(g).collect()}
