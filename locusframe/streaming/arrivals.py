"""Running quality control over calls that arrive in files.

Reports of new samples come as Parquet files of long calls (marker_idx,
sample_idx, dosage).  Counts by sample are kept as streaming state that grows
with samples only, so flags can be read while an import is under way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "marker_idx int, sample_idx int, dosage int"


def call_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Calls of files as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_counts(calls: DataFrame) -> DataFrame:
    """A, B, H and N by sample so far."""
    d = F.col("dosage")
    return calls.groupBy("sample_idx").agg(F.count_if(d == 0).alias("A"), F.count_if(d == 2).alias("B"), F.count_if(d == 1).alias("H"), F.count_if(d.isNull()).alias("N"))


def running_flags(calls: DataFrame, max_H: int, max_N: int) -> DataFrame:
    """The running counts with the flags of sample quality control."""
    flag = F.concat(F.when(F.col("H") > max_H, "H").otherwise(""), F.when(F.col("N") > max_N, "N").otherwise(""))
    return running_counts(calls).withColumn("filter", flag)
