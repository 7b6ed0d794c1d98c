"""Approximate nearest neighbours by adaptive dimension scan (operator 6).

Vectors are normalised, rotated by a random orthogonal matrix and dealt to the
lists of an inverted file.  Within each probed list candidates are scanned in
blocks of rotated dimensions: after each block a hypothesis test compares the
scaled partial distance with the distance of the worst neighbour held so far,
and candidates that fail are abandoned.  Survivors are scored by the exact
cosine of the original vectors in double precision.

Equal vectors are one class that carries its least ids, so a vector that many
rows share is scanned once.  Large lists and large query groups are cut into
blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import materialize

SAMPLE = 20_000
MOST_LISTS = 2048
BLOCK = 4096
DIMS = 16


def usable(vector: str) -> Column:
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0)


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """The vectors in the precision they have."""
    return np.asarray(col.flatten()).reshape(-1, dims)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two (which is exact) that brings its largest component to between 1/2 and 1."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    y = scaled(x)
    return (y / np.sqrt((y * y).sum(1, keepdims=True))).astype(np.float32)


def exact_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, in double precision."""
    q, x = scaled(q[None])[0], scaled(x)
    return (x * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))


def rotation(dims: int, seed: int) -> np.ndarray:
    a = np.random.default_rng(seed).standard_normal((dims, dims))
    q, r = np.linalg.qr(a)
    return (q * np.sign(np.diag(r))).astype(np.float32)


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + 2048] @ centers.T, 1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.where(size > 0, size, 1), centers).astype(np.float32)
    return centers


def probes_for(points: np.ndarray, centers: np.ndarray, k: int, target: float, asked: int = 256) -> int:
    """The number of nearest lists that hold the share ``target`` of true neighbours, by brute force on the sample."""
    k = min(k, len(points) - 1)
    if k < 1:
        return 1
    own = np.concatenate([np.argmax(points[i : i + 2048] @ centers.T, 1) for i in range(0, len(points), 2048)])
    at = np.linspace(0, len(points) - 1, min(asked, len(points))).astype(int)
    near = points[at] @ points.T
    near[np.arange(len(at)), at] = -np.inf
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(points[at] @ centers.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[top], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1


def adaptive_scan(q: np.ndarray, x: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Rows of ``x`` that may be among the ``k`` nearest of ``q`` (both rotated unit vectors).

    The squared distance over d of D rotated dimensions, times D / d, exceeds
    the full one by more than a factor (1 + slack / sqrt(d)) ** 2 with small
    probability only; a candidate whose partial distance fails that test
    against the worst of the k best so far is abandoned.
    """
    dims = x.shape[1]
    if len(x) <= 2 * k:
        return np.arange(len(x))
    first = max(2 * k, 64)
    alive_all = [np.arange(min(first, len(x)))]
    best = np.sort(((x[:first] - q) ** 2).sum(1))[:k]
    for lo in range(first, len(x), 1024):
        alive = np.arange(lo, min(lo + 1024, len(x)))
        part = np.zeros(len(alive), np.float32)
        for d in range(0, dims, DIMS):
            hi = min(d + DIMS, dims)
            diff = x[alive, d:hi] - q[d:hi]
            part = part + np.einsum("ij,ij->i", diff, diff)
            if hi < dims:
                keep = part * (dims / hi) <= best[-1] * (1 + slack / np.sqrt(hi)) ** 2 + 1e-6
                alive, part = alive[keep], part[keep]
                if not len(alive):
                    break
        if len(alive):
            keep = part <= best[-1] + 1e-5
            alive_all.append(alive[keep])
            best = np.sort(np.concatenate([best, part[keep]]))[:k]
    return np.concatenate(alive_all)


def nearest(
    table: DataFrame,
    queries: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    target_recall: float = 0.97,
    least_probes: int = 4,
    slack: float = 2.1,
    seed: int = 6,
) -> DataFrame:
    """The ``k`` nearest rows by cosine of each row for which ``queries`` holds.

    Returns query_id, rank (from 1), ``key``, score (double); the nearest
    first, ties to the smaller id; a query's own id is no candidate.  Rows
    whose id is null, or whose vector is null, empty, zero, of another length
    than most, or holds null or non-finite components take no part.  Rows that
    share id and vector count once.  Scores are cosines of the vectors as given
    (float or double components; others as double) in double precision.  The lists' centres are fitted on at most
    ``SAMPLE`` vectors; every row is indexed.  Each query probes as many of the
    nearest lists as hold ``target_recall`` of the sample's own true
    neighbours (``least_probes`` at least, and on until they hold k + 1 rows).
    """
    spark = table.sparkSession
    rows = table.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).alias("id"), F.col(vector).alias("v"), queries.alias("asked"))
    element = table.schema[vector].dataType.elementType.simpleString()
    kind = f"array<{element if element in ('float', 'double') else 'double'}>"
    rows = rows.select("id", "asked", F.col("v").cast(kind).alias("v"), F.xxhash64("v").alias("k1"), F.hash("v").alias("k2"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    id_type = table.schema[key].dataType.simpleString()
    if common is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, `{key}` {id_type}, score double")
    dims = int(common["d"])
    rows = materialize(rows.where(F.size("v") == dims), "vectors")
    by_id = Window.partitionBy("k1", "k2").orderBy("id")
    held = rows.select("k1", "k2", "id", F.dense_rank().over(by_id).alias("r")).where(F.col("r") <= k + 1)
    ids = held.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    one = rows.withColumn("r", F.row_number().over(by_id)).where("r = 1").select("k1", "k2", "v")
    classes = materialize(one.join(ids, ["k1", "k2"]), "classes")
    total = classes.count()
    sample = classes.orderBy("k1", "k2").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    lists = int(max(1, min(MOST_LISTS, round(np.sqrt(total)), len(sample) // 8)))
    turn = rotation(dims, seed)
    points = unit(matrix(sample, dims))
    centers = spherical_kmeans(points, lists, seed)
    probes = min(lists, max(least_probes, probes_for(points, centers, k, target_recall)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column("v"), dims))
            own = np.concatenate([np.argmax(x[i : i + 2048] @ centers.T, 1) for i in range(0, len(x), 2048)] or [np.zeros(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "list"])

    indexed = classes.mapInArrow(assign, f"k1 bigint, k2 int, v {kind}, ids array<{id_type}>, list int")
    indexed = materialize(indexed, "indexed")
    sizes = np.zeros(lists, np.int64)
    for r in indexed.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["count"]
    asked = rows.where("asked")
    queried = asked.select("id", "k1", "k2").distinct()
    query_classes = classes.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "v")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = unit(matrix(batch.column("v"), dims)) @ centers.T
            order = np.argsort(-near, axis=1, kind="stable")
            reach = np.cumsum(sizes[order], axis=1)
            n = np.maximum(probes, (reach < k + 1).sum(1) + 1).clip(max=lists)
            flat = np.concatenate([o[:m] for o, m in zip(order, n, strict=True)] or [np.zeros(0, np.int64)])
            at = np.repeat(np.arange(len(n)), n)
            some = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([some.column("k1"), some.column("k2"), some.column("v"), pa.array(flat.astype(np.int32))], names=["k1", "k2", "v", "list"])

    probed = materialize(query_classes.mapInArrow(probe, f"k1 bigint, k2 int, v {kind}, list int"), "probed")
    asks = np.zeros(lists, np.int64)
    for r in probed.groupBy("list").count().collect():
        asks[r["list"]] = r["count"]
    cuts, qcuts = np.maximum(1, -(-sizes // BLOCK)), np.maximum(1, -(-asks // BLOCK))
    cut_of, qcut_of = (F.element_at(F.array(*[F.lit(int(c)) for c in x]), F.col("list") + 1) for x in (cuts, qcuts))
    data = indexed.withColumn("cut", F.pmod(F.col("k1"), cut_of).cast("int")).withColumn("qcut", F.explode(F.sequence(F.lit(0), qcut_of - 1)))
    asking = probed.withColumn("qcut", F.pmod(F.col("k1"), qcut_of).cast("int")).withColumn("cut", F.explode(F.sequence(F.lit(0), cut_of - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            q, x = (matrix(t.column("v").combine_chunks(), dims) for t in (left, right))
            qr, xr = unit(q) @ turn, unit(x) @ turn
            ids = right.column("ids").to_pylist()
            k1, k2 = left.column("k1").to_pylist(), left.column("k2").to_pylist()
            for i in range(len(q)):
                some = adaptive_scan(qr[i], xr, k + 1, slack)
                score = exact_cosine(q[i], x[some])
                top = np.argsort(-score, kind="stable")[: k + 1]
                least = score[top[-1]]
                found = sorted((-score[j], n) for j in np.flatnonzero(score >= least) for n in ids[some[j]])[: k + 1]
                for s, n in found:
                    for column, value in zip(out, (k1[i], k2[i], n, -s), strict=True):
                        column.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], right.schema.field("ids").type.value_type), pa.array(out[3], pa.float64())], names=["k1", "k2", "id", "score"])

    group = ["list", "cut", "qcut"]
    found = asking.groupBy(*group).cogroup(data.groupBy(*group)).applyInArrow(search, f"k1 bigint, k2 int, id {id_type}, score double")
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "id")
    merged = materialize(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "found")
    pairs = materialize(queried.withColumnRenamed("id", "query_id"), "queries").join(merged, ["k1", "k2"]).where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id", "k1", "k2").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
