"""Mixing sources to target weights by systematic sampling (operator 8).

DataFrame functions only.  Each source's target says how many copies of each
of its documents are expected; the expected copies are prefix-summed within
the source, one random offset is added, and a document is emitted once for
each integer boundary that its interval crosses.

Within a source documents are ordered by size, then by a hash of their id, so
that the words taken follow the target closely.  The prefix sums are taken in
levels - size classes of a source, sizes of a class, hash buckets of a size,
documents of a bucket - of which only the last touches documents, so a source
that holds most of the rows, or a size that many documents share, is spread
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import materialize

BUCKETS_HEX = 2  # hash buckets of a size: 16 ** this
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    """Number of maximal runs other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], total: float, cap: float) -> DataFrame:
    """Targets by source (columns __none, __source, source_size).

    ``total`` times all words are shared by weight; a target stops at ``cap``
    times its source's size, and what is above it is shared again by weight
    among the others until none is above.  That is a water level: sources are
    capped in ascending order of size per weight as long as their cap lies
    below their share of what remains.
    """
    place = F.row_number().over(Window.orderBy("__none", "__source")) - 1
    cycle = F.array(*[F.lit(w).cast("double") for w in weights])
    s = sizes.withColumn("__w", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    s = s.withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("__cap") / F.col("__w"), "__none", "__source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(float(total))).alias("__t"),
        F.sum("__w").over(every).alias("__all_w"),
        F.coalesce(F.sum("__cap").over(before), F.lit(0.0)).alias("__cap_below"),
        F.coalesce(F.sum("__w").over(before), F.lit(0.0)).alias("__w_below"),
    )
    capped = F.col("__cap") * (F.col("__all_w") - F.col("__w_below")) <= F.col("__w") * (F.col("__t") - F.col("__cap_below"))
    s = s.withColumn("__capped", capped)
    s = s.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("__capped"), F.col("__cap"))).over(every), F.lit(0.0)).alias("__cap_sum"),
        F.coalesce(F.sum(F.when(F.col("__capped"), F.col("__w"))).over(every), F.lit(0.0)).alias("__w_sum"),
    )
    open_share = F.try_divide(F.col("__w") * (F.col("__t") - F.col("__cap_sum")), F.col("__all_w") - F.col("__w_sum"))
    return s.select("__none", "__source", "source_size", F.when(F.col("__capped"), F.col("__cap")).otherwise(open_share).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    total: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: tuple[str, ...] = ("doc_id",),
    narrow: bool = True,
) -> DataFrame:
    """Copies of each document in a mix of ``total`` times the corpus.

    Sources, ordered by code point with null last, have the given weights in
    turn; null is a source of its own.  Returns ``keep`` with size (words of
    the text, null: 0), source_size, target (of the row's source), copies and
    taken (copies * size).  No row has more than ceil(``cap``) copies.  The
    result depends on rows and ``seed`` only, not on how they are dealt out;
    rows that share an id are sampled one by one.  An empty table gives an
    empty one; a source without words has target 0 and no copies.

    ``narrow``: ``keep`` holds no texts, so the sized rows are written once
    and the texts are read once.
    """
    held = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    ident = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    sized = docs.select(
        *held,
        n_words(text).alias("size"),
        F.col(source).isNull().alias("__none"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"),
        F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("__hash"),
        F.col(key).alias("__id"),
    ).withColumn("__bucket", F.substring("__hash", 1, BUCKETS_HEX))
    if narrow:
        sized = materialize(sized, "sized")
    group = ["__none", "__source", "size", "__bucket"]
    buckets = materialize(sized.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), "buckets")
    sizes = buckets.groupBy("__none", "__source", "size").agg(F.sum("n").alias("n")).withColumn("__class", F.floor(F.log(F.col("size") + F.lit(1.0)) * 6))
    classes = sizes.groupBy("__none", "__source", "__class").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("__words"))
    up_to = (Window.unboundedPreceding, -1)

    def before(by: list[str], order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(*up_to)), F.lit(0))

    targets = source_targets(classes.groupBy("__none", "__source").agg(F.sum("__words").alias("source_size")), weights, total, cap)
    classes = classes.withColumn("__below1", before(["__none", "__source"], "__class")).drop("n", "__words")
    classes = classes.join(targets, ["__none", "__source"])
    sizes = sizes.withColumn("__below2", before(["__none", "__source", "__class"], "size")).drop("n")
    sizes = sizes.join(classes, ["__none", "__source", "__class"]).withColumn("__below2", F.col("__below1") + F.col("__below2")).drop("__below1", "__class")
    starts = buckets.withColumn("__below", before(["__none", "__source", "size"], "__bucket")).drop("n")
    starts = starts.join(sizes, ["__none", "__source", "size"]).withColumn("__below", F.col("__below") + F.col("__below2")).drop("__below2")
    within = F.row_number().over(Window.partitionBy(*group).orderBy("__hash", "__id"))
    placed = sized.withColumn("__rank", within).join(starts, group)
    rank = F.col("__below") + F.col("__rank")
    rate = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    name = F.when(F.col("__none"), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("__source")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = F.coalesce(F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1)), F.lit(0))
    back = [F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)]
    return placed.withColumn("copies", copies.cast("long")).select(*back, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def oracle(seed: int = 20) -> str:
    """The same for DuckDB, with the parameters of the registered query."""
    return f"""
with d as (
  select doc_id, source is null as none, coalesce(source, '') as source,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    md5('{seed}:' || coalesce(cast(doc_id as varchar), 'null')) as hash
  from documents),
s as (select none, source, cast(sum(size) as bigint) as source_size from d group by none, source),
w as (select *, case (row_number() over (order by none, source) - 1) % 3 when 0 then 3e0 when 1 then 1e0 else 2e0 end as w,
    source_size * 2e0 as cap, sum(source_size) over () * 1.5e0 as t from s),
l as (select *, sum(w) over () as all_w,
    coalesce(sum(cap) over (order by cap / w, none, source rows between unbounded preceding and 1 preceding), 0e0) as cap_below,
    coalesce(sum(w) over (order by cap / w, none, source rows between unbounded preceding and 1 preceding), 0e0) as w_below from w),
c as (select *, cap * (all_w - w_below) <= w * (t - cap_below) as capped from l),
g as (select none, source, source_size, case when capped then cap else w * (t - coalesce(sum(case when capped then cap end) over (), 0e0))
    / nullif(all_w - coalesce(sum(case when capped then w end) over (), 0e0), 0e0) end as target from c),
r as (select d.*, source_size, target, row_number() over (partition by d.none, d.source order by size, hash, doc_id) as rank,
    cast(('0x' || substr(md5('{seed}/' || case when d.none then 'n' else 's' || d.source end), 1, 8)) as bigint) / 4294967296e0 as u,
    target / nullif(cast(source_size as double), 0e0) as rate
  from d join g on d.none = g.none and d.source = g.source)
select doc_id, size, source_size, cast(target as double) as target,
  size * cast(coalesce(floor(u + rate * rank) - floor(u + rate * (rank - 1)), 0) as bigint) as taken
from r
"""
