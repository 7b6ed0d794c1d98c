"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset in a local session (as in tests) a temporary folder is
    made and set as the session's checkpoint folder; executors on other
    machines would not see it, so there the setting is required.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="locusframe-")
        spark.sparkContext.setCheckpointDir(at)
        return at
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{work_dir(spark).rstrip('/')}/locusframe/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again.

    This cuts the lineage: a later loss of an executor re-reads the table
    instead of running what made it a second time.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch() -> None:
    """Remove what :func:`materialize` and the archive writer left in the shared folder."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            if path.startswith("file:"):
                shutil.rmtree(urlsplit(path).path, ignore_errors=True)


atexit.register(remove_scratch)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session passes Arrow batches of at most 8 MB to Python from now on.

    A batch is held several times, by the JVM and by the worker, and the
    default of 64 MB is much for an executor whose heap is in use.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which the worker gives freed memory back to the system.

    Workers live on from task to task and stage to stage; what the allocator
    keeps of one stage's arrays would count against the next stage's.
    """

    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(col: str | Column) -> Column:
    """A 128-bit key of a whole text (null: empty), equal for equal texts."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    return F.unhex(F.md5(c))


def hot_keys(big: DataFrame, on: str, floor: int = 256, hot_share: int = 5000, counted: str | None = None) -> DataFrame | None:
    """Keys that hold more than ``floor`` rows and more than one ``hot_share``-th of all rows of ``big``, and into how many parts to deal them.

    They number less than ``hot_share``, so they can be broadcast; None if there can be none.  ``big`` should be a table made by :func:`materialize`.
    Where its column ``counted`` has the number of a key's rows, they aren't counted again.
    """
    rows = big.count()
    if rows <= floor:
        return None
    least = max(floor, -(-rows // hot_share))
    if counted:
        counts = big.select(on, F.col(counted).alias("__n")).where(F.col("__n") > least).distinct()
    else:
        counts = big.groupBy(on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least)
    return counts.select(on, F.ceil(F.col("__n") / least).cast("int").alias("__parts"))


def dealt(big: DataFrame, hot: DataFrame | None, on: str, by: str) -> DataFrame:
    """``big`` with ``__part``: the rows of a hot key are dealt to its parts by the column ``by``."""
    if hot is None:
        return big.withColumn("__part", F.lit(0))
    found = big.join(F.broadcast(hot), on, "left")
    return found.withColumn("__part", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")


def repeated(small: DataFrame, hot: DataFrame | None, on: str) -> DataFrame:
    """``small`` with ``__part``: a row of a hot key is repeated for each of its parts."""
    if hot is None:
        return small.withColumn("__part", F.lit(0))
    found = small.join(F.broadcast(hot), on, "left")
    return found.withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")


def attach(big: DataFrame, keys: DataFrame, on: str, hot_share: int = 5000) -> DataFrame:
    """Inner join of ``big`` to ``keys`` (one row a key; its column ``n`` counts the key's rows in ``big``).

    Keys that hold at least one ``hot_share``-th of all rows number at most
    ``hot_share``, so they can be broadcast; of the others none can load a
    task.  ``big`` is read once for each of the two joins and should be a
    scan or a table made by :func:`materialize`, as should ``keys``.
    """
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(2, -(-int(total) // hot_share))
    hot = F.broadcast(keys.where(F.col("n") >= least).drop("n"))
    cold = keys.where(F.col("n") < least).drop("n")
    return big.join(hot, on).unionByName(big.join(cold, on))
