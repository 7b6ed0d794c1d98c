"""Exports to other genetics formats, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet
from locusframe.operators.encode import native_call
from locusframe.operators.pheno import genotype_label
from locusframe.sources.files import resolve

# of a table's file: cells at most, and bytes compressed or read at once
CELLS_PER_FILE, BYTES_AT_ONCE = 1 << 26, 1 << 22


def columns_of(g: GenotypeSet, iids: list[str] | None) -> tuple[GenotypeSet, list[str]]:
    """The set with the samples that a wide table is asked to show, and their names in order; None: all.

    A plan with a column for each of very many samples is itself too large
    for the driver, so who reads a few columns should name them.
    """
    s = g.samples if iids is None else g.samples.where(F.col("iid").isin(iids))
    names = [r["iid"] for r in s.orderBy("sample_idx").select("iid").collect()]
    return g.with_(samples=s), names


def hgdp_table(g: GenotypeSet, iids: list[str] | None = None) -> DataFrame:
    """Wide text genotypes: a row per marker, a column per sample (or per one of ``iids``), A1A1 / A1A2 / A2A2 / -."""
    g, names = columns_of(g, iids)
    t = g.observed().join(F.broadcast(g.markers.select("marker_idx", "marker", "A1", "A2")), "marker_idx").join(F.broadcast(g.samples.select("sample_idx", "iid")), "sample_idx")
    t = t.select("marker_idx", "marker", "iid", genotype_label(F.col("dosage"), F.col("A1"), F.col("A2")).alias("g"))
    wide = t.groupBy("marker_idx").pivot("iid", names).agg(F.first("g"))
    full = g.markers.select("marker_idx", "marker").join(wide, "marker_idx", "left")
    return full.orderBy("marker_idx").select("marker", *[F.coalesce(F.col(f"`{n}`"), F.lit("-")).alias(n) for n in names])


def write_hgdp(g: GenotypeSet, prefix: str) -> None:
    """The whole wide table as text (a line per marker, a field per sample), and its map.

    ``prefix``.geno is a folder of zstd files that tasks write; in order of name they are the table, header first
    (``zstd -dc set.geno/*``).  Only cells with a call are shuffled: a task puts a marker's into a line of missing ones.
    """
    spark = g.markers.sparkSession
    s = g.samples.select("sample_idx", "iid").orderBy("sample_idx").toArrow()  # the small dimension
    n, n_markers = s.num_rows, g.markers.count()
    header = spark.sparkContext.broadcast("\t".join(["marker", *s.column("iid").to_pylist()]).encode())
    place = spark.createDataFrame(s.select(["sample_idx"]).append_column("k", pa.array(range(n), pa.int32())))
    t = g.observed().join(F.broadcast(g.markers.select("marker_idx", "A1", "A2")), "marker_idx").join(F.broadcast(place), "sample_idx")
    t = t.select("marker_idx", "k", genotype_label(F.col("dosage"), F.col("A1"), F.col("A2")).alias("g")).where("g is not null")
    seen = t.groupBy("marker_idx").agg(F.array_sort(F.collect_list(F.struct("k", "g"))).alias("seen"))
    rows = g.markers.select("marker_idx", "marker").join(seen, "marker_idx", "left").select("marker_idx", "marker", F.col("seen.k").alias("k"), F.col("seen.g").alias("g"))
    path = f"{prefix}.geno"
    fs, at = resolve(path)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        fs.delete_dir(at)
    fs.create_dir(at, recursive=True)
    tasks = min(4000, max(1, -(-n * n_markers // CELLS_PER_FILE)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = resolve(path)
        task, blank, lines = TaskContext.get().partitionId(), b"\t-" * n, 0
        to = f"{at}/{task:06d}.zst"
        own = f"{to}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(own) as raw, pa.CompressedOutputStream(raw, "zstd") as f:
            pieces, size = [header.value, b"\n"] if task == 0 else [], 0
            for batch in batches:
                for marker, k, labels in zip(*(batch.column(c).to_pylist() for c in ("marker", "k", "g")), strict=True):
                    pieces.append(marker.encode())
                    upto = 0
                    for i, label in zip(k or (), labels or (), strict=True):
                        if i >= upto:  # of a cell's rows the first
                            pieces += (blank[2 * upto : 2 * i], b"\t", label.encode())
                            upto = i + 1
                    pieces += (blank[2 * upto :], b"\n")
                    lines, size = lines + 1, size + 2 * n
                    if size >= BYTES_AT_ONCE:
                        f.write(b"".join(pieces))
                        pieces, size = [], 0
            f.write(b"".join(pieces))
        fs.move(own, to)  # after another try of the task, too, the file is whole
        yield pa.RecordBatch.from_arrays([pa.array([lines])], names=["lines"])

    written = rows.repartitionByRange(tasks, "marker_idx").sortWithinPartitions("marker_idx").mapInArrow(write, "lines bigint").agg(F.sum("lines")).first()[0] or 0
    if written != n_markers:
        raise OSError(f"{written} of {n_markers} lines were written to {path}")
    g.markers.orderBy("marker_idx").select("marker", "chr", "pos").coalesce(1).write.mode("overwrite").csv(f"{prefix}.map", sep="\t", header=False)


def read_hgdp(spark: SparkSession, prefix: str, iids: list[str]) -> DataFrame:
    """marker and the columns ``iids`` of a table that :func:`write_hgdp` wrote; every line of every file is read."""
    path = f"{prefix}.geno"
    fs, at = resolve(path)
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.endswith(".zst"))
    with pa.input_stream(fs.open_input_file(f"{at}/{names[0]}"), compression="zstd") as f:
        head = b""
        while b"\n" not in head:
            some = f.read(BYTES_AT_ONCE)
            if not some:
                raise ValueError(f"{path} has no header")
            head += some
    columns = head[: head.index(b"\n")].decode().split("\t")
    absent = [x for x in iids if x not in columns[1:]]
    if absent:
        raise ValueError(f"the table has no columns {absent}")
    places, n = [columns.index(x, 1) for x in iids], len(columns)
    most = max(places, default=0) + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = resolve(path)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                first, rest = name == names[0], b""
                with pa.input_stream(fs.open_input_file(f"{at}/{name}"), compression="zstd") as f:
                    while some := f.read(BYTES_AT_ONCE):
                        *lines, rest = (rest + some).split(b"\n")
                        if first and lines:
                            lines, first = lines[1:], False
                        if any(x.count(b"\t") != n - 1 for x in lines):
                            raise ValueError(f"{name} of {path} has lines of other than {n} fields")
                        fields = [x.split(b"\t", most) for x in lines]
                        yield pa.RecordBatch.from_arrays([pa.array([x[i].decode() for x in fields], pa.string()) for i in (0, *places)], names=["marker", *iids])
                if rest:
                    raise ValueError(f"{name} of {path} ends within a line")

    files = spark.createDataFrame([(x,) for x in names], "name string").repartition(min(len(names), 512), "name")
    return files.mapInArrow(read, ", ".join(["marker string", *(f"`{x}` string" for x in iids)]))


def as_rqtl(g: GenotypeSet, chroms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cross data: long codes (dosage + 1) of markers with cM above 0, and phenotypes (-9 missing, female 0, male 1)."""
    m = g.markers.where("cM > 0")
    if chroms is not None:
        m = m.where(F.col("chr").isin(*chroms))
    kind = F.when(F.col("chr").rlike("X"), "X").otherwise("A")
    t = g.observed().join(F.broadcast(m), "marker_idx").join(F.broadcast(g.samples.select("sample_idx", "iid")), "sample_idx")
    codes = t.select(F.regexp_replace("chr", "^chr", "").alias("chr"), kind.alias("class"), "marker", "cM", "iid", (F.col("dosage") + 1).alias("code"))
    sex = F.when(F.col("sex") == 1, 1).when(F.col("sex") == 2, 0)
    return codes, g.samples.select("iid", F.when(F.col("pheno") != -9, F.col("pheno")).alias("pheno"), sex.alias("sex"))


def from_rqtl(codes: DataFrame, phenotypes: DataFrame) -> GenotypeSet:
    """A set from cross data; positions are cM * 1e6, chromosomes get the prefix chr."""
    m = codes.select("chr", "marker", "cM").distinct()
    order = F.coalesce(F.col("chr").try_cast("int"), F.lit(1000))
    m = m.withColumn("marker_idx", F.row_number().over(Window.orderBy(order, "chr", "cM", "marker")) - 1)
    markers = m.select("marker_idx", F.concat(F.lit("chr"), "chr").alias("chr"), order.alias("chr_order"), "marker", "cM", F.floor(F.col("cM") * 1e6).cast("int").alias("pos"), F.lit(None).cast("string").alias("A1"), F.lit(None).cast("string").alias("A2"), F.lit("").alias("filter"))
    s = phenotypes.withColumn("sample_idx", F.row_number().over(Window.orderBy("iid")) - 1)
    none = F.lit(None).cast("string")
    samples = s.select("sample_idx", "iid", F.col("iid").alias("fid"), none.alias("mom"), none.alias("dad"), F.when(F.col("sex") == 1, 1).when(F.col("sex") == 0, 2).otherwise(0).alias("sex"), "pheno", F.lit("").alias("filter"))
    calls = codes.join(F.broadcast(m.select("marker", "marker_idx")), "marker").join(F.broadcast(s.select("iid", "sample_idx")), "iid").select("marker_idx", "sample_idx", (F.col("code") - 1).alias("dosage"))
    return GenotypeSet(markers, samples, calls, "relative")


def export_doqtl(g: GenotypeSet, where: str) -> None:
    """A folder of tables: x, y, calls (native), sex (M, F or null) and markers."""
    m = F.broadcast(g.markers.select("marker_idx", "marker", "A1", "A2"))
    s = F.broadcast(g.samples.select("sample_idx", "iid"))
    t = g.calls.join(m, "marker_idx").join(s, "sample_idx")
    t.select("marker", "iid", "x", "y", native_call(F.col("dosage"), F.col("A1"), F.col("A2")).alias("call")).write.mode("overwrite").parquet(f"{where}/cells")
    g.samples.select("iid", F.when(F.col("sex") == 1, "M").when(F.col("sex") == 2, "F").alias("sex")).write.mode("overwrite").parquet(f"{where}/sex")
    g.markers.write.mode("overwrite").parquet(f"{where}/snps")


def wide_table(g: GenotypeSet, iids: list[str] | None = None) -> DataFrame:
    """Map columns and a column of dosages per sample (or per one of ``iids``)."""
    g, names = columns_of(g, iids)
    t = g.observed().join(F.broadcast(g.samples.select("sample_idx", "iid")), "sample_idx")
    wide = t.groupBy("marker_idx").pivot("iid", names).agg(F.first("dosage"))
    return g.markers.select("marker_idx", "chr", "pos", "cM", "marker", "A1", "A2").join(wide, "marker_idx", "left").drop("marker_idx")


def save(g: GenotypeSet, path: str) -> None:
    """The set as three tables, calls laid out by chromosome so that a region reads its part only."""
    calls = g.calls.join(F.broadcast(g.markers.select("marker_idx", "chr")), "marker_idx")
    calls.repartition("chr", (F.col("marker_idx") / 8192).cast("int")).sortWithinPartitions("marker_idx", "sample_idx").write.mode("overwrite").partitionBy("chr").parquet(f"{path}/calls")
    g.markers.write.mode("overwrite").parquet(f"{path}/markers")
    g.samples.write.mode("overwrite").parquet(f"{path}/samples")


def load(spark: SparkSession, path: str, alleles: str = "01") -> GenotypeSet:
    return GenotypeSet(spark.read.parquet(f"{path}/markers"), spark.read.parquet(f"{path}/samples"), spark.read.parquet(f"{path}/calls"), alleles)
