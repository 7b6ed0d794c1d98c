"""Construction of sets, and calls that arrive as a stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from locusframe.operators import qc, select, stats
from locusframe.plans.adapter import genotypes as adapter
from locusframe.sources.construct import from_matrix, genotypes
from locusframe.streaming import arrivals

MAP = "marker string, chr string, chr_order int, cM double, pos int, A1 string, A2 string"


def small_map(spark, **changes):
    rows = [{"marker": f"snp{i}", "chr": "chr1", "chr_order": 1, "cM": 0.5 * i, "pos": 500_000 * i, "A1": a, "A2": b} | changes for i, (a, b) in enumerate(["ac", "gt", "ag", "cg"], 1)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], MAP)


def test_a_hand_built_native_set(spark):
    """The 4 x 3 set of native calls, its alleles in lower case and its ids with white space."""
    calls = [("snp1", "ACA"), ("snp2", "TGT"), ("snp3", "AGA"), ("snp4", "CGC")]
    cells = spark.createDataFrame([(m, f" id{j + 1}", c) for m, row in calls for j, c in enumerate(row)], "marker string, iid string, call string")
    g = genotypes(cells, small_map(spark))
    assert [r.iid for r in g.samples.orderBy("sample_idx").collect()] == ["id1", "id2", "id3"]
    got = {(r.marker, r.iid): r.dosage for r in g.long().collect()}
    assert [got[f"snp{i}", "id2"] for i in range(1, 5)] == [2, 0, 2, 2]
    assert {r.n_bad for r in select.validate(g).collect()} == {0}


def test_what_the_constructor_refuses(spark):
    names = [f"snp{i}" for i in range(1, 5)]
    rows = [[0, 1]] * 4
    assert from_matrix(spark, rows, names, ["a", "b"], small_map(spark)).alleles == "01"
    with pytest.raises(ValueError, match="not unique"):
        from_matrix(spark, rows, names, ["a", "b"], small_map(spark, marker="same"))
    with pytest.raises(ValueError, match="negative"):
        from_matrix(spark, rows, names, ["a", "b"], small_map(spark, cM=-1.0))
    with pytest.raises(ValueError, match="lacks"):
        from_matrix(spark, rows, ["other", *names[1:]], ["a", "b"], small_map(spark))
    with pytest.raises(ValueError, match="dimensions"):
        from_matrix(spark, rows, names, ["a"], small_map(spark))
    with pytest.raises(ValueError, match="dosages"):
        from_matrix(spark, [[0, 7]] * 4, names, ["a", "b"], small_map(spark))


def test_stream_of_calls_agrees_with_the_batch(spark, sf, tmp_path):
    g = adapter(spark, sf)
    calls = g.observed().select("marker_idx", "sample_idx", F.col("dosage").cast("int").alias("dosage"))
    calls.repartition(5).write.parquet(str(tmp_path / "in"))
    query = arrivals.running_flags(arrivals.call_stream(spark, str(tmp_path / "in"), 1), 60, 0).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.sample_idx: (r.A, r.B, r.H, r.filter) for r in spark.table("running").collect()}
    want = {r.sample_idx: (r.A, r.B, r.H, "H" if r.H > 60 else "") for r in stats.summarize_calls(g).collect()}
    assert got == want


def test_scan_prunes_columns_and_pushes_filters(spark, sf):
    """The plan of a filtered count reads what it needs only."""
    plan = select.subset(adapter(spark, sf), "chr = 'chr3'").observed().groupBy("marker_idx").count()._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "ReadSchema" in plan and "l_quantity" not in plan
    assert qc is not None


def test_hgdp_writes_every_sample(spark, sf, tmp_path, monkeypatch):
    import pyarrow as pa

    from locusframe.plans import all_queries
    from locusframe.plans.adapter import genotypes
    from locusframe.sources import export
    from tests.support import assert_same

    monkeypatch.setattr(export, "CELLS_PER_FILE", 700)
    g = genotypes(spark, sf)
    export.write_hgdp(g, str(tmp_path / "set"))
    files = sorted((tmp_path / "set.geno").iterdir())
    text = "".join(pa.input_stream(str(f), compression="zstd").read().decode() for f in files)
    header, *lines = text.splitlines()
    wide = export.hgdp_table(g)
    assert len(files) == 3 and header.split("\t") == wide.columns
    assert [x.split("\t") for x in lines] == [list(r) for r in wide.collect()]
    # the query makes the whole table before it shows a column
    asked = []
    whole = export.write_hgdp
    monkeypatch.setattr(export, "write_hgdp", lambda g, prefix: (asked.append(g.samples.count()), whole(g, prefix)))
    assert_same(all_queries().QUERIES["hgdp"](spark, sf), sf, all_queries().ORACLE_SQL["hgdp"])
    assert asked == [10]


def test_report_is_written_packed_line_for_line(spark, sf, tmp_path, monkeypatch):
    import pyarrow as pa

    from locusframe.plans import all_queries
    from locusframe.plans.adapter import genotypes
    from locusframe.sources import report
    from tests.support import assert_same

    monkeypatch.setattr(report, "BYTES_AT_ONCE", 1000)
    g = genotypes(spark, sf)
    # s3 has no cell, and a cell of s5 has two rows
    g = g.with_(calls=g.calls.where("sample_idx <> 3").unionByName(g.calls.where("sample_idx = 5 and marker_idx = (select min(l_partkey) from {t} where l_suppkey = 5)".format(t=f"parquet.`{sf}/lineitem.parquet`"))))
    report.write_report(g, str(tmp_path / "text"))
    report.write_report(g, str(tmp_path / "packed"), packed=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "text").glob("part-*")))
    packed = "".join(pa.input_stream(pa.input_stream(str(p), compression="zstd"), compression="zstd").read().decode() for p in sorted((tmp_path / "packed").iterdir()) if p.suffix == ".zst")
    assert text == packed and len(text.splitlines()) == 10 + 200 * 10 + 1
    cells, counts, pairs = report.read_packed(spark, str(tmp_path / "packed"))
    n = {}
    for r in counts.collect():
        n[r.iid] = n.get(r.iid, 0) + r.n
    assert n == {f"s{i}": 200 + (i == 5) for i in range(10)} and pairs["Num SNPs"] == "200"
    whole, _ = report.read_report(spark, str(tmp_path / "text"))
    key = lambda r: (r.marker, r.iid, r.call, str(r.x), str(r.y))
    assert sorted(map(key, cells.collect())) == sorted(key(r) for r in whole.collect() if r.call != "N" or str(r.x) != "nan")
    with pytest.raises(ValueError, match="rows for 200 markers"):
        report.read_beadstudio(spark, str(tmp_path / "packed"), g.markers.drop("marker_idx", "filter"), packed=True)
    assert_same(all_queries().QUERIES["report_import"](spark, sf), sf, all_queries().ORACLE_SQL["report_import"])
