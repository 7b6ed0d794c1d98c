"""A genotype set over the star-schema tables, and the same as SQL for an independent engine.

Every part is a marker, every supplier a sample, and line items give calls and
two intensities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.model import GenotypeSet

SQL = """
markers as (select cast(p_partkey as int) as marker_idx, 'm' || cast(p_partkey as varchar) as marker,
    case p_partkey % 20 when 19 then 'chrM' when 18 then 'chrY' when 17 then 'chrX'
         else 'chr' || cast(p_partkey % 20 + 1 as varchar) end as chr,
    cast(p_partkey % 20 + 1 as int) as chr_order,
    cast(p_partkey // 20 as double) * 0.5e0 as cM, cast((p_partkey // 20 + 1) * 10000 as int) as pos,
    case when p_partkey % 4 in (0, 2) then 'A' when p_partkey % 4 = 1 then 'C' else 'G' end as A1,
    case when p_partkey % 4 = 0 then 'G' when p_partkey % 4 in (1, 2) then 'T' else 'C' end as A2
  from part),
samples as (select cast(s_suppkey as int) as sample_idx, 's' || cast(s_suppkey as varchar) as iid,
    'f' || cast(s_nationkey as varchar) as fid, cast(1 + s_suppkey % 2 as int) as sex,
    case when s_acctbal < 0 then null when s_acctbal < 5000 then 1e0 else 2e0 end as pheno, s_acctbal as qpheno
  from supplier),
cells as (select cast(l_partkey as int) as marker_idx, cast(l_suppkey as int) as sample_idx,
    cast(sum(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end) % 3 as int) as dosage,
    cast(sum(l_quantity) as double) / (50e0 * count(*)) as x,
    cast(sum(cast(round(l_discount * 100) as int)) as double) / (10e0 * count(*)) as y
  from lineitem group by l_partkey, l_suppkey),
cube as (select m.*, s.*, c.dosage, c.x, c.y
  from markers m cross join samples s left join cells c on c.marker_idx = m.marker_idx and c.sample_idx = s.sample_idx)
"""


def with_cube(sql: str) -> str:
    """A query for DuckDB over the adapter's tables."""
    return f"with {'recursive ' if 'union all' in sql else ''}{SQL.strip()}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().removeprefix('+')}"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier", "lineitem", "embeddings")}


def genotypes(spark: SparkSession, sf_dir: str) -> GenotypeSet:
    """The adapter's genotype set: every part is a marker, dealt over 20 chromosomes by id, in order of id on each."""
    key = F.col("p_partkey")
    order, place = (key % 20).cast("int") + 1, F.floor(key / 20)
    chrom = F.when(order == 20, "chrM").when(order == 19, "chrY").when(order == 18, "chrX").otherwise(F.concat(F.lit("chr"), order.cast("string")))
    t = tables(spark, sf_dir)
    markers = t["part"].select(
        key.cast("int").alias("marker_idx"),
        F.concat(F.lit("m"), key.cast("string")).alias("marker"),
        chrom.alias("chr"),
        order.alias("chr_order"),
        (place.cast("double") * 0.5).alias("cM"),
        ((place + 1) * 10000).cast("int").alias("pos"),
        F.when((key % 4).isin(0, 2), "A").when(key % 4 == 1, "C").otherwise("G").alias("A1"),
        F.when(key % 4 == 0, "G").when((key % 4).isin(1, 2), "T").otherwise("C").alias("A2"),
        F.lit("").alias("filter"),
    )
    s = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    samples = t["supplier"].select(
        s.cast("int").alias("sample_idx"),
        F.concat(F.lit("s"), s.cast("string")).alias("iid"),
        F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("fid"),
        none.alias("mom"),
        none.alias("dad"),
        (1 + s % 2).cast("int").alias("sex"),
        F.when(F.col("s_acctbal") < 0, None).when(F.col("s_acctbal") < 5000, 1.0).otherwise(2.0).alias("pheno"),
        F.col("s_acctbal").alias("qpheno"),
        F.lit("").alias("filter"),
    )
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    calls = (
        t["lineitem"]
        .groupBy(F.col("l_partkey").cast("int").alias("marker_idx"), F.col("l_suppkey").cast("int").alias("sample_idx"))
        .agg(
            (F.sum(flag) % 3).cast("int").alias("dosage"),
            (F.sum("l_quantity").cast("double") / (F.lit(50.0) * F.count(F.lit(1)))).alias("x"),
            (F.sum(F.round(F.col("l_discount") * 100).cast("int")).cast("double") / (F.lit(10.0) * F.count(F.lit(1)))).alias("y"),
        )
    )
    return GenotypeSet(markers, samples, calls, "01")
