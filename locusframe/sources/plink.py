"""Binary filesets: .bed genotypes, .bii intensities, .bim markers and .fam samples.

Genotypes and intensities are Spark data sources that read byte ranges, so a
range of markers (pushed down from a filter on ``marker_idx``) touches only
its part of the file.  Of a set too large for one writer, .bed and .bii are
folders of zstd files that tasks write; in order of name they are the file's
bytes (``zstd -dc set.bed/*``), and each is named by its first row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from locusframe.model import GenotypeSet
from locusframe.operators.select import convert_names, unplink_chroms
from locusframe.sources.files import read_bytes, resolve, size_of

# fixed values of the formats
MAGIC = bytes([0x6C, 0x1B, 0x01])
# two bits a call, the first sample in the lowest: 00 is 0 copies, 10 one, 11 two, 01 missing
DOSAGE_OF_BITS = np.array([0, -1, 1, 2], np.int8)
BITS_OF_DOSAGE = {0: 0, 1: 2, 2: 3, None: 1}
INTENSITY_SCALE = 10_000
INTENSITY_MOST = 65_535

MARKERS_PER_TASK = 8192
# of a folder: cells of a file, and tasks at most
CELLS_PER_PART = 1 << 24
TASKS = 512


class MarkerRange(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class Parts(InputPartition):
    """Files of a folder: the first row of each, and the row after its last."""

    def __init__(self, rows: list[tuple[int, int]]):
        self.rows = rows


def part_path(at: str, first: int, prefix: str = "") -> str:
    return f"{at}/{prefix}{first:012d}.zst"


def parts_of(path: str, n: int, prefix: str = "") -> list[tuple[int, int]] | None:
    """First row and end of each file of a folder of ``n`` rows; None if ``path`` is a file."""
    fs, at = resolve(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return None
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(at)))
    firsts = [int(x.removeprefix(prefix).removesuffix(".zst")) for x in names if x.startswith(prefix) and x.endswith(".zst")]
    return list(zip(firsts, [*firsts[1:], n], strict=True))


def read_part(path: str, first: int, size: int) -> np.ndarray:
    """The bytes of a file of a folder; raises if they aren't ``size``."""
    fs, at = resolve(path)
    with fs.open_input_file(part_path(at, first)) as f:
        packed = f.read()
    return np.frombuffer(pa.decompress(packed, decompressed_size=size, codec="zstd"), np.uint8)


class RangeReader(DataSourceReader):
    """Splits the markers into ranges, after filters on ``marker_idx`` have narrowed them."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.n_samples, self.n_markers = int(options["n_samples"]), int(options["n_markers"])
        self.start, self.stop = 0, self.n_markers
        self.called = options.get("called") == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("marker_idx",):
                if isinstance(f, EqualTo):
                    self.start, self.stop = max(self.start, f.value), min(self.stop, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.start = max(self.start, f.value)
                elif isinstance(f, GreaterThan):
                    self.start = max(self.start, f.value + 1)
                elif isinstance(f, LessThanOrEqual):
                    self.stop = min(self.stop, f.value + 1)
                elif isinstance(f, LessThan):
                    self.stop = min(self.stop, f.value)
            yield f  # Spark applies every filter again

    def partitions(self) -> list[InputPartition]:
        parts = self.parts()
        if parts is not None:
            each = max(1, -(-len(parts) // TASKS))
            return [Parts(parts[k : k + each]) for k in range(0, len(parts), each)] or [Parts([])]
        return [MarkerRange(k, min(k + MARKERS_PER_TASK, self.stop)) for k in range(self.start, self.stop, MARKERS_PER_TASK)] or [MarkerRange(0, 0)]

    def cells(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.n_samples
        return np.repeat(np.arange(start, stop, dtype=np.int32), n), np.tile(np.arange(n, dtype=np.int32), stop - start)


class BedReader(RangeReader):
    """All cells, or (option ``called``) those with a call."""

    def parts(self) -> list[tuple[int, int]] | None:
        parts = parts_of(self.path, self.n_markers)
        return parts if parts is None else [(lo, hi) for lo, hi in parts if lo < self.stop and hi > self.start]

    def read(self, partition: MarkerRange | Parts) -> Iterator[pa.RecordBatch]:
        width = -(-self.n_samples // 4)
        step = max(1, (1 << 20) // max(1, self.n_samples))
        if isinstance(partition, Parts):
            for lo, hi in partition.rows:
                raw = read_part(self.path, lo, (hi - lo) * width + (3 if lo == 0 else 0))
                if lo == 0:
                    if raw[:3].tobytes() != MAGIC:
                        raise ValueError(f"{self.path} is no marker-major genotype file")
                    raw = raw[3:]
                start, stop = max(lo, self.start), min(hi, self.stop)
                for k in range(start, stop, step if not self.called else max(1, stop - start)):
                    end = stop if self.called else min(k + step, stop)
                    yield self.decoded(raw[(k - lo) * width : (end - lo) * width].reshape(end - k, width), k)
            return
        if read_bytes(self.path, 0, 3) != MAGIC:
            raise ValueError(f"{self.path} is no marker-major genotype file")
        if size_of(self.path) != 3 + width * self.n_markers:
            raise ValueError(f"{self.path} does not have {self.n_markers} markers of {self.n_samples} samples")
        for k in range(partition.start, partition.stop, step):
            end = min(k + step, partition.stop)
            yield self.decoded(np.frombuffer(read_bytes(self.path, 3 + k * width, (end - k) * width), np.uint8).reshape(end - k, width), k)

    def decoded(self, raw: np.ndarray, first: int) -> pa.RecordBatch:
        """The cells of the markers from ``first`` on."""
        shifts = np.array([0, 2, 4, 6], np.uint8)
        if self.called:
            # four missing cells are 01010101, and only bytes with others are looked at
            row, byte = np.divmod(np.flatnonzero(raw.reshape(-1) != 0x55), raw.shape[1])
            d = DOSAGE_OF_BITS[(raw[row, byte][:, None] >> shifts) & 3]
            s = byte[:, None] * 4 + np.arange(4)
            at, place = np.nonzero((d >= 0) & (s < self.n_samples))
            m, s, d = (first + row[at]).astype(np.int32), s[at, place].astype(np.int32), d[at, place]
        else:
            bits = (raw[:, :, None] >> shifts) & 3
            d = DOSAGE_OF_BITS[bits.reshape(len(raw), -1)[:, : self.n_samples]].reshape(-1)
            m, s = self.cells(first, first + len(raw))
        return pa.RecordBatch.from_arrays([pa.array(m), pa.array(s), pa.array(d.astype(np.int32), mask=d < 0)], names=["marker_idx", "sample_idx", "dosage"])


class BedSource(DataSource):
    """Options: path, n_markers, n_samples; called (true: no cells without a call)."""

    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return "marker_idx int, sample_idx int, dosage int"

    def reader(self, schema: object) -> DataSourceReader:
        return BedReader(self.options)


class BiiReader(RangeReader):
    """16-bit intensities: all of x, sample by sample, then all of y; cells where both are 0 are left out."""

    def parts(self) -> list[tuple[int, int]] | None:
        return parts_of(self.path, self.n_samples, "x")

    def read(self, partition: MarkerRange | Parts) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Parts):
            for lo, hi in partition.rows:
                yield self.decoded_part(lo, hi)
            return
        n = partition.stop - partition.start
        for s in range(self.n_samples):
            at = [2 * (c * self.n_samples * self.n_markers + s * self.n_markers + partition.start) for c in (0, 1)]
            x, y = (np.frombuffer(read_bytes(self.path, a, 2 * n), "<u2").reshape(1, n) for a in at)
            yield self.batch(*self.nonzero(x, y, partition.start, s))

    def decoded_part(self, lo: int, hi: int) -> pa.RecordBatch:
        """The cells of a file of x and its file of y, whose samples are read in blocks that a processor's cache holds."""
        fs, at = resolve(self.path)
        start, stop = self.start, max(self.start, self.stop)
        found, row = [], 2 * self.n_markers
        with pa.input_stream(fs.open_input_file(part_path(at, lo, "x")), compression="zstd") as fx, pa.input_stream(fs.open_input_file(part_path(at, lo, "y")), compression="zstd") as fy:
            step = max(1, (1 << 19) // max(1, row))
            for s in range(lo, hi, step):
                n = min(step, hi - s)
                x, y = (np.frombuffer(f.read(n * row), np.uint8) for f in (fx, fy))
                if len(x) != n * row or len(y) != n * row:
                    raise ValueError(f"{self.path} does not have {self.n_markers} markers of {self.n_samples} samples")
                found.append(self.nonzero(x.view("<u2").reshape(n, -1)[:, start:stop], y.view("<u2").reshape(n, -1)[:, start:stop], start, s))
            if fx.read(1) or fy.read(1):
                raise ValueError(f"{self.path} does not have {self.n_markers} markers of {self.n_samples} samples")
        return self.batch(*(np.concatenate(c) for c in zip(*found, strict=True)))

    def nonzero(self, x: np.ndarray, y: np.ndarray, first: int, sample: int) -> tuple[np.ndarray, ...]:
        """Marker, sample, x and y of the samples from ``sample`` and the markers from ``first`` on."""
        n = max(1, x.shape[1])
        x, y = x.reshape(-1), y.reshape(-1)
        if len(x) % 4:
            at = np.flatnonzero(x | y)
        else:  # four cells at once
            at = (np.flatnonzero(x.view(np.uint64) | y.view(np.uint64))[:, None] * 4 + np.arange(4)).reshape(-1)
            at = at[(x[at] | y[at]) != 0]
        i, j = np.divmod(at, n)
        return (first + j).astype(np.int32), (sample + i).astype(np.int32), x[at], y[at]

    def batch(self, m: np.ndarray, s: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(m), pa.array(s), pa.array(x / INTENSITY_SCALE), pa.array(y / INTENSITY_SCALE)], names=["marker_idx", "sample_idx", "x", "y"])


class BiiSource(DataSource):
    """Options: path, n_markers, n_samples."""

    @classmethod
    def name(cls) -> str:
        return "bii"

    def schema(self) -> str:
        return "marker_idx int, sample_idx int, x double, y double"

    def reader(self, schema: object) -> DataSourceReader:
        return BiiReader(self.options)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a small text table with their running number, split at white space."""
    fs, at = resolve(path)
    with fs.open_input_stream(at) as f:
        # in Arrow: a row of Python's lists takes ten times as much of the driver
        lines = pc.utf8_trim_whitespace(pc.split_pattern(pa.array([f.read().decode()], pa.large_string()), "\n").values)
    t = pa.table({"k": pa.array(np.arange(len(lines), dtype=np.int32)), "f": pc.utf8_split_whitespace(lines)})
    t = t.filter(pc.greater(pc.utf8_length(lines), 0))
    return spark.createDataFrame(t.set_column(1, "f", t.column("f").cast(pa.list_(pa.string()))), "k int, f array<string>")


def read_map(spark: SparkSession, path: str, keep_chr_names: bool = False) -> DataFrame:
    """.bim: chr, marker, cM (0 is missing), pos, A1, A2."""
    t = numbered_lines(spark, path)
    chrom = F.col("f")[0] if keep_chr_names else F.coalesce(unplink_chroms(F.col("f")[0]), F.col("f")[0])
    order = F.dense_rank().over(Window.orderBy("first"))
    t = t.select(F.col("k").alias("marker_idx"), chrom.alias("chr"), F.col("f")[1].alias("marker"), F.nullif(F.col("f")[2].cast("double"), F.lit(0.0)).alias("cM"), F.col("f")[3].cast("int").alias("pos"), F.col("f")[4].alias("A1"), F.col("f")[5].alias("A2"), F.lit("").alias("filter"))
    return t.withColumn("first", F.min("marker_idx").over(Window.partitionBy("chr"))).withColumn("chr_order", order.cast("int")).drop("first")


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """.fam: fid, iid, dad, mom (0 is missing), sex, pheno (0 and -9 are missing)."""
    f = lambda i: F.col("f")[i]
    none = lambda c: F.when(c != "0", c)
    pheno = f(5).cast("double")
    return numbered_lines(spark, path).select(F.col("k").alias("sample_idx"), f(1).alias("iid"), f(0).alias("fid"), none(f(3)).alias("mom"), none(f(2)).alias("dad"), f(4).cast("int").alias("sex"), F.when(~pheno.isin(0.0, -9.0), pheno).alias("pheno"), F.lit("").alias("filter"))


@dataclass(frozen=True)
class Fileset:
    """A pointer to a fileset on disk: the path without ending, and the folder for what is made from it."""

    prefix: str
    work: str

    def __str__(self) -> str:
        return f"fileset {self.prefix}.bed, output to {self.work}"

    def read(self, spark: SparkSession, **options: object) -> GenotypeSet:
        return read_plink(spark, self.prefix, **options)

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: source, work, n_markers, n_samples, bytes of the genotypes; the genotypes themselves aren't read."""
        m, s = (numbered_lines(spark, f"{self.prefix}.{x}").count() for x in ("bim", "fam"))
        return spark.createDataFrame([(f"{self.prefix}.bed", self.work, m, s, size_of(f"{self.prefix}.bed"))], "source string, work string, n_markers long, n_samples long, bytes long")


def plinkify(spark: SparkSession, what: str | GenotypeSet, work: str, name: str = "set") -> Fileset:
    """A pointer to an existing fileset (a path, all of whose files must be there), or to one that a set is written to."""
    if isinstance(what, GenotypeSet):
        prefix = f"{work.rstrip('/')}/{name}"
        write_plink(what, prefix)
        return Fileset(prefix, work)
    prefix = what.removesuffix(".bed")
    for ending in ("bed", "bim", "fam"):
        fs, at = resolve(f"{prefix}.{ending}")
        if not fs.get_file_info(at).is_file:
            raise FileNotFoundError(f"{prefix}.{ending}")
    return Fileset(prefix, work)


def read_plink(
    spark: SparkSession,
    prefix: str,
    intensity: bool = False,
    keep_chr_names: bool = False,
    chr: str | None = None,
    start: int | None = None,
    end: int | None = None,
    markers: list[str] | None = None,
    keep: str | None = None,
    called: bool = False,
) -> GenotypeSet:
    """A lazy set over prefix.bed, .bim, .fam and, on request, .bii.

    ``chr``, ``start`` and ``end`` (positions, inclusive) and ``markers``
    (names) choose markers from the map, and only the byte range that spans
    them is read; ``keep`` is a condition on the samples' columns.
    With ``called`` cells without a call have no row, and of a sparse set
    most of the file makes none.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BedSource, BiiSource):
        spark.dataSource.register(source)
    m, s = read_map(spark, f"{prefix}.bim", keep_chr_names), read_fam(spark, f"{prefix}.fam")
    size = {"n_markers": str(m.count()), "n_samples": str(s.count())}
    calls = spark.read.format("bed").options(path=f"{prefix}.bed", called=str(called).lower(), **size).load()
    if intensity:
        seen = spark.read.format("bii").options(path=f"{prefix}.bii", **size).load()
        zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("x", "y")}
        calls = calls.join(seen, ["marker_idx", "sample_idx"], "left").withColumns(zero)
    region = F.lit(True)
    for given, condition in ((chr, F.col("chr") == chr), (start, F.col("pos") >= start), (end, F.col("pos") <= end), (markers, F.col("marker").isin(markers or []))):
        if given is not None:
            region = region & condition
    if any(x is not None for x in (chr, start, end, markers)):
        m = m.where(region)
        # two numbers of the map
        span = m.agg(F.min("marker_idx").alias("lo"), F.max("marker_idx").alias("hi")).first()
        lo, hi = (0, -1) if span["lo"] is None else (span["lo"], span["hi"])
        calls = calls.where((F.col("marker_idx") >= lo) & (F.col("marker_idx") <= hi)).join(F.broadcast(m.select("marker_idx")), "marker_idx", "left_semi")
    if keep is not None:
        s = s.where(keep)
        calls = calls.join(F.broadcast(s.select("sample_idx")), "sample_idx", "left_semi")
    return GenotypeSet(m, s, calls, "01")


def packed_rows(g: GenotypeSet, n: int) -> DataFrame:
    """The bytes of each marker's row, without Python: two bits a sample, four samples a byte."""
    code = F.when(F.col("dosage") == 0, 0).when(F.col("dosage") == 1, 2).when(F.col("dosage") == 2, 3)
    width = -(-n // 4)
    byte = F.col("sample_idx").cast("int") / 4
    # a missing cell is 01; what a call adds to that is summed by byte
    add = ((code - 1) * F.pow(F.lit(4), F.col("sample_idx") % 4)).cast("int")
    by_byte = g.observed().groupBy("marker_idx", F.floor(byte).cast("int").alias("byte")).agg(F.sum(add).alias("add"))
    per = by_byte.groupBy("marker_idx").agg(F.map_from_entries(F.collect_list(F.struct("byte", "add"))).alias("adds"))
    full = g.markers.select("marker_idx").join(per, "marker_idx", "left")
    base = lambda i: F.when(i == width - 1, F.lit(sum(1 << (2 * k) for k in range(n - 4 * (width - 1))))).otherwise(F.lit(85))
    row = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.lpad(F.hex((base(i) + F.coalesce(F.try_element_at("adds", i), F.lit(0))).cast("long")), 2, "0"))
    return full.select("marker_idx", F.unhex(F.array_join(row, "")).alias("bytes"))


def write_parts(spark: SparkSession, cells: DataFrame, path: str, n_rows: int, n_cells: int, blank: Callable, fill: Callable, head: bytes = b"") -> None:
    """Write ``n_rows`` rows of ``n_cells`` cells as a folder of zstd files; tasks make whole files, one at a time.

    Only ``cells`` (its int column ``row`` and what ``fill`` needs) are
    shuffled: ``blank(n)`` gives the array of n rows without cells for each
    prefix of files' names, ``fill(arrays, first, batch)`` puts cells in.
    """
    each = max(1, CELLS_PER_PART // max(1, n_cells))
    parts = -(-n_rows // each)
    fs, at = resolve(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.Directory:
        fs.delete_dir(at)
    elif info.is_file:
        fs.delete_file(at)
    fs.create_dir(at, recursive=True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = resolve(path)
        codec, tag = pa.Codec("zstd", 1), TaskContext.get().taskAttemptId()
        now, arrays = None, {}

        def done() -> pa.RecordBatch:
            for prefix, a in arrays.items():
                to = part_path(at, now * each, prefix)
                raw = memoryview(a.reshape(-1)).cast("B")
                with fs.open_output_stream(f"{to}.{tag}") as f:
                    f.write(codec.compress(pa.py_buffer(head + bytes(raw) if now == 0 and head else raw)))
                fs.move(f"{to}.{tag}", to)  # after another try of the task, too, the file is whole
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], names=["part"])

        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)] if len(part) else []
            for lo, hi in zip(edges, edges[1:]):  # noqa: B905
                if part[lo] != now:
                    if now is not None:
                        yield done()
                    now = int(part[lo])
                    arrays = blank(min(each, n_rows - now * each))
                some = batch.slice(lo, hi - lo)
                fill(arrays, now * each, some.filter(pc.is_valid(some.column("row"))))
        if now is not None:
            yield done()

    # a row without a cell for each file, so that those without cells are there
    every = spark.range(parts).select(F.col("id").cast("int").alias("part"))
    dealt = cells.withColumn("part", F.floor(F.col("row") / each).cast("int")).unionByName(every, allowMissingColumns=True)
    dealt = dealt.repartition(max(1, min(TASKS, parts)), "part").sortWithinPartitions("part")
    written = dealt.mapInArrow(pack, "part int").agg(F.count_distinct("part")).first()[0]
    if written != parts:
        raise OSError(f"{written} of {parts} files were written to {path}")


def write_bed_parts(calls: DataFrame, path: str, n: int, n_markers: int) -> None:
    """A folder for .bed: two bits a sample, four samples a byte."""
    width = -(-n // 4)
    last = sum(1 << (2 * k) for k in range(n - 4 * (width - 1)))

    def blank(rows: int) -> dict[str, np.ndarray]:
        a = np.full((rows, width), 0x55, np.uint8)
        a[:, -1:] = last
        return {"": a}

    def fill(arrays: dict[str, np.ndarray], first: int, batch: pa.RecordBatch) -> None:
        row, s, d = (batch.column(c).to_numpy() for c in ("row", "sample_idx", "dosage"))
        # a missing cell is 01; samples of one byte change bits of their own
        change = (np.array([0, 2, 3], np.uint8)[d] ^ 1) << (2 * (s % 4)).astype(np.uint8)
        np.bitwise_xor.at(arrays[""], (row - first, s // 4), change)

    seen = calls.where("dosage is not null").select(F.col("marker_idx").alias("row"), "sample_idx", "dosage")
    write_parts(calls.sparkSession, seen, path, n_markers, n, blank, fill, MAGIC)


def write_bii_parts(calls: DataFrame, path: str, n: int, n_markers: int) -> None:
    """A folder for .bii: the files of x, then those of y."""

    def blank(rows: int) -> dict[str, np.ndarray]:
        return {c: np.zeros((rows, n_markers), "<u2") for c in "xy"}

    def fill(arrays: dict[str, np.ndarray], first: int, batch: pa.RecordBatch) -> None:
        row, m = batch.column("row").to_numpy(), batch.column("marker_idx").to_numpy()
        for c in "xy":
            arrays[c][row - first, m] = batch.column(c).to_numpy()

    seen = calls.select(F.col("sample_idx").alias("row"), "marker_idx", "x", "y")
    write_parts(calls.sparkSession, seen, path, n, n_markers, blank, fill)


def stored(c: str) -> Column:
    """An intensity as .bii has it."""
    return F.coalesce(F.least(F.floor(F.col(c) * INTENSITY_SCALE), F.lit(INTENSITY_MOST)), F.lit(0)).cast("int")


def write_plink(g: GenotypeSet, prefix: str, intensity: bool = False, keep_chr_names: bool = False, parts: bool = False) -> None:
    """Write prefix.bed, .bim and .fam (and .bii): markers by chromosome, position, cM and name.

    Rows are packed by Spark; one ordered binary file has one writer, so the
    driver streams the packed rows through, a partition at a time.  With
    ``parts`` .bed and .bii are folders of compressed files that tasks write
    side by side, for sets whose dense files are too large for that; the
    bytes are the same.
    """
    order = Window.orderBy("chr_order", "pos", F.coalesce("cM", F.lit(0.0)), "marker")
    m = g.markers.withColumn("__k", F.row_number().over(order) - 1)
    s = g.samples.withColumn("__s", F.row_number().over(Window.orderBy("sample_idx")) - 1)
    n, n_markers = s.count(), m.count()
    calls = g.calls.join(F.broadcast(m.select("marker_idx", "__k")), "marker_idx").join(F.broadcast(s.select("sample_idx", "__s")), "sample_idx")
    calls = calls.drop("marker_idx", "sample_idx").withColumnsRenamed({"__k": "marker_idx", "__s": "sample_idx"})
    fs, at = resolve(prefix)
    if parts:
        cells = calls.select(*(F.col(c).cast("int").alias(c) for c in ("marker_idx", "sample_idx", "dosage")), *(stored(c).alias(c) for c in "xy" if intensity))
        if intensity:  # what makes the calls runs once for both
            held = f"{prefix}.cells" if "://" in prefix else f"file://{at}.cells"
            cells.write.mode("overwrite").parquet(held)
            cells = g.calls.sparkSession.read.schema(cells.schema).parquet(held)
        write_bed_parts(cells, f"{prefix}.bed", n, n_markers)
        if intensity:
            write_bii_parts(cells, f"{prefix}.bii", n, n_markers)
            fs.delete_dir(f"{at}.cells")
    else:
        write_files(g, calls, m, s, prefix, n, n_markers, intensity)
    names = F.col("chr") if keep_chr_names else convert_names(F.col("chr"), "plink")
    table = m.orderBy("__k").select(names.alias("chr"), "marker", F.coalesce("cM", F.lit(0.0)).alias("cM"), F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("A1", F.lit("0")).alias("A1"), F.coalesce("A2", F.lit("0")).alias("A2"))
    with fs.open_output_stream(f"{at}.bim") as f:
        f.write(lines(table, "\t"))
    zero = F.lit("0")
    fam = s.orderBy("__s").select("fid", "iid", F.coalesce("dad", zero), F.coalesce("mom", zero), F.coalesce("sex", F.lit(0)), F.coalesce("pheno", F.lit(-9.0)))
    with fs.open_output_stream(f"{at}.fam") as f:
        f.write(lines(fam, " "))


def lines(t: DataFrame, sep: str) -> bytes:
    """The text of a small table."""
    batches = t.toArrow().to_batches(max_chunksize=10_000)
    return b"".join("".join(sep.join(map(str, r)) + "\n" for r in zip(*(c.to_pylist() for c in b.columns), strict=True)).encode() for b in batches)


def write_files(g: GenotypeSet, calls: DataFrame, m: DataFrame, s: DataFrame, prefix: str, n: int, n_markers: int, intensity: bool) -> None:
    """.bed and .bii, each as one file, by the driver."""
    fs, at = resolve(prefix)
    packed = packed_rows(g.with_(calls=calls, markers=m.drop("marker_idx").withColumnRenamed("__k", "marker_idx")), n).orderBy("marker_idx")
    with fs.open_output_stream(f"{at}.bed") as f:
        f.write(MAGIC)
        for r in packed.toLocalIterator():
            f.write(bytes(r["bytes"]))
    if intensity:
        with fs.open_output_stream(f"{at}.bii") as f:
            for c in ("x", "y"):
                rows = calls.groupBy("sample_idx").agg(F.array_sort(F.collect_list(F.struct("marker_idx", stored(c).alias("v")))).alias("v"))
                rows = s.select(F.col("__s").alias("sample_idx")).join(rows, "sample_idx", "left").orderBy("sample_idx")
                for r in rows.toLocalIterator():
                    out = np.zeros(n_markers, "<u2")
                    for cell in r["v"] or []:
                        out[cell["marker_idx"]] = cell["v"]
                    f.write(out.tobytes())
