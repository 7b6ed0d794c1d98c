"""Near-duplicate detection by ProbMinHash (operator 7).

A text's five-word shingles are elements of Poisson processes whose rates are
their weights: how often they occur in the text.  Each arrival falls on a
register; a register keeps the element that arrives first, and a process ends
as soon as its next arrival is later than the last of the document's register
minima.  The share of registers on which two documents agree estimates their
probability Jaccard similarity

    J = sum over common i of 1 / (sum over j of max(x[j] / x[i], y[j] / y[i])),

which for weights of 1 is the Jaccard similarity of the shingle sets.

Registers are banded; texts that share a bucket are candidates, and candidates
are verified exactly by J on their weighted shingles.  Exact copies are one
node from the start.  In a bucket every node is compared with the bucket's hub
(a star).  In buckets that still hold several components, exact bounds rule out
what cannot be linked, and the rest is compared with more and more centres
until the bucket holds one component or no possible pair across components is
left, so no link between candidates is lost and pairs within a component are
never enumerated.  Components come from min-label propagation with pointer
jumping; every step reads tables written in the shared folder.

The bounds: if P of the one text's weight and Q of the other's lies on common
shingles (as shares), J is at most 1 / (1 / P + 1 / Q - 1).  For a common i the
sum over j is at least 1 / p[i] + (1 - Q) / q[i] for shares p and q, so J is at
most the sum of p q / (q + (1 - Q) p), which is concave and homogeneous in
(p, q) and so at most its value at the totals (P, Q).

Any share of the rows may have one key.  Comparisons, whose rows are wide, deal
the rows of such a hub to many tasks, and so do the rounds the rows of a large
bucket; other joins of narrow rows on a bucket or label leave that to the
adaptive skew join, and ranks are taken within parts of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm import textcore as tc
from locusframe.llm.common import attach, dealt, hot_keys, materialize, repeated, small_batches, text_key, tidy

BANDS, ROWS = 28, 5
FEW = 32
RARE = 24
EPS = 1e-9
PART = 128
#: Numbers of 64 bits in a sketch, which tells in which cells a text lacks shingles of its hub, and in which it has others.
WIDE = 2
#: Centres of a bucket in the first round.
FIRST_CENTRES = 64
#: Texts in question that are broadcast (24 bytes each); beyond it all texts are shuffled by key instead.
MOST_SENT = 1_000_000
_U = np.uint64


def prob_minhash(h: np.ndarray, weight: np.ndarray, offs: np.ndarray, registers: int) -> np.ndarray:
    """Signatures (rows x registers) of weighted sets: distinct element hashes and weights by row.

    A row without elements has all zeros.
    """
    rows = len(offs) - 1
    first = np.full(rows * registers, np.inf)
    out = np.zeros(rows * registers, _U)
    el = np.arange(len(h))
    row = np.repeat(np.arange(rows), np.diff(offs))
    at = np.zeros(len(h))
    last = np.full(rows, np.inf)
    step = 0
    while len(el):
        step += 1
        r = tc.mix(h[el] + _U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        # u in (0, 1]: the time until the element's next arrival is -ln(u) / weight
        u = ((r >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53
        at = at - np.log(u) / weight[el]
        alive = at < last[row]
        el, row, at, r = el[alive], row[alive], at[alive], r[alive]
        reg = row * registers + (tc.mix(r ^ _U(0xA0761D6478BD642F)) % _U(registers)).astype(np.int64)
        np.minimum.at(first, reg, at)
        won = first[reg] == at
        out[reg[won]] = h[el[won]]
        last = first.reshape(rows, registers).max(1)
        alive = at < last[row]
        el, row, at = el[alive], row[alive], at[alive]
    return out.reshape(rows, registers)


def subset(h: np.ndarray, w: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = offs[rows + 1] - offs[rows]
    new = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=new[1:])
    at = np.arange(new[-1]) + np.repeat(offs[rows] - new[:-1], size)
    return h[at], w[at], new


def weighted_shingles(s: tc.Slice, k: int, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, their weights, and offsets by row."""
    starts, ends = tc.words(s)
    wh = tc.span_hash(tc.prefix_hash(s.data), starts, ends)
    h, counts, offs = tc.unique_per_row(*tc.shingles(wh, tc.word_offsets(starts, s.offs), k))
    return h, counts if weighted else np.ones(len(h), np.int64), offs


def probability_jaccard(w1: np.ndarray, w2: np.ndarray, i: np.ndarray, j: np.ndarray) -> float:
    """Sum over common elements of 1 / sum over all of max(w1 / w1[common], w2 / w2[common]); ``i`` and ``j`` are where the common ones lie."""
    if not len(i):
        return 0.0
    a, b = w1[i].astype(float), w2[j].astype(float)
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    # for each element those with a smaller ratio add their w2 over its w2, the others their w1 over its w1
    low = np.concatenate([[0.0], np.cumsum(b)])[:-1]
    high = np.cumsum(a[::-1])[::-1]
    rest1, rest2 = w1.sum() - a.sum(), w2.sum() - b.sum()
    return float((1.0 / ((high + rest1) / a + (low + rest2) / b)).sum())


def signatures(texts: pa.Array, k: int, registers: int, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash signatures and numbers of distinct shingles of whole texts.

    Texts with few shingles need many rounds; they are gathered so that those
    rounds are run once a batch.
    """
    sig = np.zeros((len(texts), registers), _U)
    size = np.zeros(len(texts), np.int64)
    small: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for s in tc.slices(texts):
        h, w, offs = weighted_shingles(s, k, weighted)
        n = np.diff(offs)
        size[s.lo : s.hi] = n
        big = np.flatnonzero(n >= FEW)
        sig[s.lo + big] = prob_minhash(*subset(h, w, offs, big), registers)
        few = np.flatnonzero((n > 0) & (n < FEW))
        small.append((s.lo + few, *subset(h, w, offs, few)))
    if small:
        at = np.concatenate([x[0] for x in small])
        n = np.concatenate([np.diff(x[3]) for x in small])
        offs = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=offs[1:])
        sig[at] = prob_minhash(np.concatenate([x[1] for x in small]), np.concatenate([x[2] for x in small]), offs, registers)
    return sig, size


def buckets_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    out = np.tile((np.arange(bands, dtype=_U) + _U(1)) * _U(0xE7037ED1A0B428DB), (len(sig), 1))
    for j in range(rows):
        out = tc.mix(out * _U(0x8EBC6AF09C88C6E3) + sig[:, j::rows][:, :bands])
    return out


def node_of(text: str) -> Column:
    """A text's key of 128 bits: null counts as empty, equal texts have one."""
    return text_key(text)


def banded(docs: DataFrame, key: str, text: str, k: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """A row per document: id, text key, buckets (empty for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, size = signatures(batch.column("text"), k, bands * rows, weighted)
            b = buckets_of(sig, bands, rows).view(np.int64)
            n = np.where(size > 0, bands, 0)
            offs = np.zeros(len(n) + 1, np.int32)
            np.cumsum(n, out=offs[1:])
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(b[size > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), lists], names=["id", "key", "buckets"])

    chosen = docs.select(F.col(key).alias("id"), node_of(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return small_batches(chosen).mapInArrow(tidy(run), f"id {docs.schema[key].dataType.simpleString()}, key binary, buckets array<bigint>")


def unseen(batch: pa.RecordBatch, seen: set[bytes]) -> pa.Array:
    """Which rows of a batch hold a text for the first time."""
    fresh = []
    for key in batch.column("key").to_pylist():
        fresh.append(key not in seen)
        seen.add(key)
    return pa.array(fresh, pa.bool_())


def shingle_sets(docs: DataFrame, nodes: DataFrame, text: str, k: int, weighted: bool) -> DataFrame:
    """The distinct shingle hashes in ascending unsigned order (``set``) of ``nodes`` (node, key), their weights (null: each 1) and the sum of these (``mass``)."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            yield batch.filter(unseen(batch, seen))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tc.slices(batch.column("text")):
                h, w, offs = weighted_shingles(s, k, weighted)
                n, mass = np.diff(offs), tc.per_row(w, offs)
                plain = mass == n
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(h.view(np.int64)))
                at = np.zeros(len(offs), np.int32)
                np.cumsum(np.where(plain, 0, n), out=at[1:])
                weights = pa.ListArray.from_arrays(pa.array(at), pa.array(w[np.repeat(~plain, n)], pa.int64()), mask=pa.array(plain))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(s.lo, len(s)), lists, weights, pa.array(mass, pa.int64())], names=["node", "set", "weights", "mass"])

    # copies of a text within a task go on once, so a text that fills the corpus is a row per task
    docs = small_batches(docs)
    texts = docs.select(node_of(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(tidy(once), "key binary, text string")
    few = nodes.count() <= MOST_SENT
    one = texts.join(F.broadcast(nodes) if few else nodes.hint("shuffle_merge"), "key").dropDuplicates(["key"])
    return small_batches(one.select("node", "text")).mapInArrow(tidy(sets), "node bigint, set array<bigint>, weights array<bigint>, mass bigint")


def lists_of(col: pa.ListArray) -> list[np.ndarray | None]:
    """A list column's rows as arrays, null rows as None."""
    at, values = np.asarray(col.offsets), np.asarray(col.values)
    return [None if gone else values[a:b] for a, b, gone in zip(at[:-1], at[1:], np.asarray(col.is_null()), strict=True)]


def cells_of(h: np.ndarray) -> list[int]:
    """The cells that hold any of these shingles, as the bits of ``WIDE`` numbers."""
    bits = np.zeros(64 * WIDE, np.uint8)
    bits[(h >> _U(32)) % _U(64 * WIDE)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def sketch_columns(*names: str) -> list[str]:
    return [f"{name}{k}" for name in names for k in range(WIDE)]


def compare(pairs: DataFrame, sets: DataFrame, least: float, sketched: bool = False) -> DataFrame:
    """Pairs (a, b) with the number of their common shingles (``common``) and whether their similarity is at least ``least`` (``near``).

    If ``sketched``, also the cells (:func:`cells_of`) of b's shingles that a lacks (``lacks0``, ...) and of a's that b lacks (``adds0``, ...).
    ``pairs`` should be a table made by :func:`materialize`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, near, sketch = [], [], []
            for ha, wa, hb, wb in zip(*(lists_of(batch.column(c)) for c in ("sa", "wa", "sb", "wb")), strict=True):
                ha, hb = ha.view(_U), hb.view(_U)
                if sketched:
                    sketch.append(cells_of(np.setdiff1d(hb, ha, assume_unique=True)) + cells_of(np.setdiff1d(ha, hb, assume_unique=True)))
                if len(ha) > len(hb):
                    ha, wa, hb, wb = hb, wb, ha, wa
                at = np.searchsorted(hb, ha)
                at[at == len(hb)] = 0
                i = np.flatnonzero(hb[at] == ha) if len(hb) else at
                common.append(len(i))
                if wa is None and wb is None:
                    value = len(i) / max(1, len(ha) + len(hb) - len(i))
                else:
                    value = probability_jaccard(np.ones(len(ha)) if wa is None else wa, np.ones(len(hb)) if wb is None else wb, i, at[i])
                near.append(value >= least - EPS)
            more = {c: pa.array([x[k] for x in sketch], pa.int64()) for k, c in enumerate(cells)}
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(near, pa.bool_()), *more.values()], names=["a", "b", "common", "near", *more])

    cells = sketch_columns("lacks", "adds") if sketched else []
    rows = pairs.select("a", "b")
    hot_b = hot_keys(rows, "b")
    hot_a = hot_keys(rows, "a")
    first, second = (sets.select(F.col("node").alias(n), F.col("set").alias(f"s{n}"), F.col("weights").alias(f"w{n}")) for n in "ab")
    rows = dealt(rows, hot_a, "a", "b").join(repeated(first, hot_a, "a"), ["a", "__part"]).drop("__part")
    rows = dealt(rows, hot_b, "b", "a").join(repeated(second, hot_b, "b"), ["b", "__part"]).drop("__part")
    return small_batches(rows).select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(tidy(run), "a bigint, b bigint, common bigint, near boolean" + "".join(f", {c} bigint" for c in cells))


def verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b) those that are similar by at least ``least``."""
    return compare(pairs, sets, least).where("near").select("a", "b")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Connected components: (node, label), the label being a component's least node.

    ``labels`` is an earlier result; its nodes stay together.
    """
    if labels is not None:
        links = links.unionByName(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    now = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        known = now.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        heard = both.join(known, "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = now.join(heard, "node").select("node", F.least("label", "theirs").alias("label"), F.col("label").alias("before"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = materialize(step.join(jump, "label").select("node", F.col("root").alias("label"), "before"), "labels")
        if new.where("label <> before").count() == 0:
            return new.select("node", "label")
        now = new.select("node", "label")


def joined(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels after more links, which often are none."""
    links = materialize(links, "new_links")
    return labels if links.count() == 0 else components(links, labels)


def hubs_of(members: DataFrame) -> DataFrame:
    """Each bucket's hub, the node that shares buckets with most others: (bucket, hub).

    ``members``: bucket, node, and the number of the bucket's nodes (``held``).
    An original shares more buckets with its copies than those do with each
    other, so the star around it finds most links at once.
    """
    fraction = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(2.0**21)  # a tie-break
    reach = members.groupBy("node").agg((F.sum("held") + F.first(fraction)).alias("reach"))
    return members.join(reach, "node").groupBy("bucket").agg(F.max_by("node", "reach").alias("hub"))


def possible(common: Column, n: Column, mass: Column, n2: Column, mass2: Column, least: float) -> Column:
    """Whether texts of n and n2 distinct shingles that weigh mass and mass2 in all can be as similar as ``least`` if at most ``common`` are in both.

    Each other shingle weighs 1 at least, so x = mass - n + common bounds the weight of the common ones.
    Where some can't be common at all, their weight may be counted in n instead of their number.
    """
    x, y = ((m - k + common).cast("double") for m, k in ((mass, n), (mass2, n2)))
    return F.lit(1 + least) * x * y >= F.lit(least - EPS) * (x * mass2 + y * mass)


def only_in(x: str, y: str) -> Column:
    """How many cells of the sketch ``x`` are not in ``y``: so many shingles at least are behind ``x`` and not behind ``y``."""
    counts = [F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b)))) for a, b in zip(sketch_columns(x), sketch_columns(y), strict=True)]
    return sum(counts[1:], counts[0])


def rare_pairs(named: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """What rare shingles (of at most ``RARE`` of the nodes in question) tell about nodes and pairs.

    Returns each node's set size, mass, number of rare shingles (``own``) and
    their weight and the number of the others (``counted``), and the pairs of different components that share so many rare shingles that
    they can be similar.  In any other pair a node's rare shingles are not
    the other's, which bounds the pair's similarity.
    """
    nodes = materialize(named.select("node", "label").distinct(), "open_nodes")
    mine = materialize(sets.join(nodes, "node", "left_semi").select("node", "set", "weights", "mass"), "open_sets")
    theirs = mine.select("node", "weights", F.posexplode("set").alias("at", "shingle"))
    theirs = theirs.select("node", "shingle", F.when(F.col("weights").isNull(), 1).otherwise(F.get("weights", F.col("at"))).alias("w"))
    rare = theirs.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= RARE)
    held = materialize(theirs.join(rare, "shingle"), "rare_held")
    own = held.groupBy("node").agg(F.count(F.lit(1)).alias("own"), F.sum("w").alias("own_mass"))
    facts = mine.select("node", F.size("set").cast("long").alias("size"), "mass").join(own, "node", "left").na.fill(0, ["own", "own_mass"])
    facts = materialize(facts.select("node", "size", "mass", "own", (F.col("own_mass") + F.col("size") - F.col("own")).alias("counted")), "facts")
    # lists of at most RARE nodes, so a shingle gives at most RARE * (RARE - 1) / 2 pairs
    lists = held.where("df > 1").groupBy("shingle").agg(F.array_sort(F.collect_list("node")).alias("l"))
    pairs = lists.select(F.explode(F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", 1, i), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    shared = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"))
    known = facts.join(nodes, "node")
    a, b = (known.select(*[F.col(c).alias(f"{c}_{n}") for c in known.columns]) for n in "ab")
    shared = shared.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b"))
    most = F.least(F.col("size_a") - F.col("own_a"), F.col("size_b") - F.col("own_b")) + F.col("shared")
    can = (F.col("label_a") != F.col("label_b")) & possible(most, F.col("size_a"), F.col("mass_a"), F.col("size_b"), F.col("mass_b"), similarity)
    return facts, shared.where(can).select("a", "b")


def ranked_rows(named: DataFrame, facts: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The rows of open buckets with what bounds their similarities, and their places (``rank``) in the order of centres.

    Rows outside a bucket's largest component (``minor``) come first, then
    those with few rare shingles: every pair across components has a minor
    row, so when those have been centres the bucket is done.  Rows that cannot
    be similar to anything in their bucket are left out.  ``sketches``: of
    nodes and hubs (node, hub and the columns of :func:`compare`).
    """
    hub_own = facts.select(F.col("node").alias("hub"), F.col("own").alias("hub_own"))
    # what a node has beyond the hub's set, less its rare shingles there: no pair that is left shares those; the hub has all of its own set
    named = named.join(facts, "node").join(hub_own, "hub").withColumn("common", F.coalesce("common", F.col("size")).cast("long"))
    named = named.withColumn("beyond", F.col("size") - F.col("common") - F.greatest(F.col("own") - F.col("hub_own"), F.lit(0)))
    named = materialize(named.drop("hub_own"), "bounded")
    count = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least_size"), F.max("mass").alias("most_mass"))
    largest = count.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("n"), F.min("least_size").alias("least_size"), F.max("most_mass").alias("most_mass"))
    named = attach(named, materialize(largest.withColumn("rows", F.col("n")), "largest"), "bucket")
    # with the smallest set of the bucket, none of it its own, if that isn't smaller than what can be common
    most = F.col("size") - F.col("own")
    named = named.where(possible(most, F.col("counted"), F.col("mass"), F.greatest(F.col("least_size"), most), F.greatest("most_mass", "least_size", most), similarity))
    named = named.withColumn("minor", F.col("label") != F.col("largest"))
    # a large bucket's ranks are interleaved from parts that are ranked each
    parts = F.ceil(F.col("rows") / PART)
    named = named.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("node"), parts)})
    within = F.row_number().over(Window.partitionBy("bucket", "part").orderBy(F.desc("minor"), "own", "node"))
    named = named.withColumn("rank", (within - 1) * F.col("parts") + F.col("part") + 1).drop("least_size", "largest", "most_mass", "rows", "parts", "part")
    named = materialize(named, "placed").join(sketches, ["node", "hub"], "left").drop("hub")
    return named.withColumns({c: F.coalesce(c, F.lit(0)) for c in sketch_columns("lacks", "adds")})  # the hub itself: none


def compare_rest(members: DataFrame, sets: DataFrame, labels: DataFrame, sketches: DataFrame, similarity: float, hot: DataFrame | None) -> DataFrame:
    """Find the links that the stars left out; returns the new labels.

    ``members``: bucket, node, the bucket's hub, and how much of its set the
    node shares with the hub (``common``; null for the hub itself).
    Only buckets that still hold several components matter.  Pairs of their
    nodes that share rare shingles are compared; in all other pairs the rare
    shingles of either node bound the similarity, and so do the cells of what
    each lacks of the hub's set and has beyond it, which rules out most nodes
    and pairs exactly.  What is left is compared in rounds, each with twice as many
    centres of a bucket as before (see :func:`ranked_rows`),
    until a bucket is one component or no possible pair is left.
    ``hot``: the buckets whose rows are dealt to many tasks (see :func:`hot_keys`).
    """
    rest, centers, done = members, 0, None
    while True:
        named = rest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        last = F.max(F.when(F.col("minor"), F.col("rank"))) if centers else F.lit(1)
        open_ = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), last.alias("last")).where((F.col("lo") < F.col("hi")) & (F.col("last") > centers)).select("bucket")
        named = materialize(dealt(named, hot, "bucket", "node").join(repeated(open_, hot, "bucket"), ["bucket", "__part"]).drop("__part"), "named")
        if named.count() == 0:
            return labels
        if centers == 0:
            facts, more = rare_pairs(named, sets, similarity)
            done = materialize(more, "pairs")
            labels = joined(verify(done, sets, similarity), labels)
            named = ranked_rows(named.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), facts, sketches, similarity)
            named = materialize(named, "ranked")
            # later rounds have no other buckets
            hot = hot_keys(named.select("bucket"), "bucket")
            hot = materialize(hot, "hot") if hot is not None else None
        upto = max(FIRST_CENTRES, 2 * centers)
        new = named.where((F.col("rank") > centers) & (F.col("rank") <= upto)).select("bucket", *[F.col(c).alias(f"c_{c}") for c in ("node", "label", "size", "mass", "own", "counted", "common", "beyond", "rank", *sketch_columns("lacks", "adds"))])
        # what both share of the hub (of what the one has of it, not what only the other lacks), and what both can share beyond it
        within = F.least(F.col("common") - only_in("c_lacks", "lacks"), F.col("c_common") - only_in("lacks", "c_lacks"))
        beyond = F.least("beyond", "c_beyond", F.col("size") - F.col("common") - only_in("adds", "c_adds"), F.col("c_size") - F.col("c_common") - only_in("c_adds", "adds"))
        most = within + F.greatest(beyond, F.lit(0))
        most = F.least(most, F.col("size") - F.col("own"), F.col("c_size") - F.col("c_own"))
        fits = (F.col("rank") > F.col("c_rank")) & (F.col("label") != F.col("c_label")) & possible(most, F.col("counted"), F.col("mass"), F.col("c_counted"), F.col("c_mass"), similarity)
        pairs = dealt(named, hot, "bucket", "node").join(repeated(new, hot, "bucket"), ["bucket", "__part"]).where(fits).select(F.greatest("node", "c_node").alias("a"), F.least("node", "c_node").alias("b")).distinct()
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        labels = joined(verify(pairs, sets, similarity), labels)
        done = done.unionByName(pairs)
        rest = named.drop("label")
        centers = upto


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    similarity: float = 0.8,
    bands: int = BANDS,
    rows: int = ROWS,
    key: str = "doc_id",
    text: str = "text",
    weighted: bool = True,
) -> DataFrame:
    """Classes of near-duplicate documents.

    Shingles weigh as often as they occur, and the similarity is the
    probability Jaccard of the weights; if not ``weighted`` each weighs 1, and
    it is the Jaccard similarity of the sets.  Returns a row per row of ``docs``: ``key``, class_id (the least id of the
    class), class_size (rows of the class), text_class (the least id among
    exact copies of the row's text), node (the text's key of 128 bits) and label
    (a number of the class in this run).  Two texts are
    linked if the similarity of their ``k``-word shingles is at least
    ``similarity``; a text of fewer words has one shingle of them
    all; classes are connected components of links and exact copies.  A null
    text counts as empty, and texts without words are classes by exact text
    only.  A class whose ids are all null has a null class_id.  With the given
    bands a candidate pair at similarity 0.8 is missed with probability
    1.5e-5, and at 0.85 with 7e-8.
    """
    base = materialize(banded(docs, key, text, k, bands, rows, weighted), "banded")
    texts = base.groupBy("key").agg(F.min("id").alias("text_class"), F.count(F.lit(1)).alias("n"), F.first("buckets").alias("buckets"))
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    held = texts.select(F.explode("buckets").alias("bucket"), "node")
    several = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    members = materialize(held.join(several, "bucket"), "members")
    hot = hot_keys(members, "bucket", counted="held")
    involved = texts.select("node", "key").join(members.select("node").distinct(), "node", "left_semi")
    sets = materialize(shingle_sets(docs, materialize(involved, "involved"), text, k, weighted), "sets")
    members = materialize(members.join(hubs_of(members), "bucket"), "starred")
    stars = materialize(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    compared = materialize(compare(stars, sets, similarity, sketched=True), "overlaps")
    labels = components(compared.where("near").select("a", "b"))
    members = members.join(compared.select(F.col("a").alias("node"), F.col("b").alias("hub"), "common"), ["node", "hub"], "left")
    labels = compare_rest(members.drop("held"), sets, labels, compared.select(F.col("a").alias("node"), F.col("b").alias("hub"), *sketch_columns("lacks", "adds")), similarity, hot)
    tagged = texts.select("key", "node", "text_class", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = tagged.groupBy("label").agg(F.min("text_class").alias("class_id"), F.sum("n").alias("class_size"))
    by_text = materialize(tagged.join(classes, "label").select("key", "label", "class_id", "class_size", "text_class", "n"), "classes")
    return attach(base.select("id", "key"), by_text, "key").select(F.col("id").alias(key), "class_id", "class_size", "text_class", F.col("key").alias("node"), "label")


#: For DuckDB, with the parameters of the registered query: all pairs that share a shingle, and their components.
ORACLE = """
with recursive d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from d),
s as (select doc_id, sh, cast(count(*) as double) as x from (
  select doc_id, array_to_string(w[i : i + 4], ' ') as sh from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)) group by doc_id, sh),
m as (select doc_id, sum(x) as mass from s group by doc_id),
q as (select a.doc_id as a, b.doc_id as b, sum(a.x) as sx, sum(b.x) as sy from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
p as (select a, b, sx, sy, k.mass as ma, l.mass as mb from q join m k on k.doc_id = a join m l on l.doc_id = b where k.mass / sx + l.mass / sy - 1 <= 1.2500001e0),
i as (select p.*, s.x as x, z.x as y, s.x / z.x as ratio from p join s on s.doc_id = a join s z on z.doc_id = b and z.sh = s.sh),
t as (select a, b, x, y, ma, mb, sx, sy, sum(y) over below as low_y, sx - sum(x) over below as high_x from i
  window below as (partition by a, b order by ratio range between unbounded preceding and current row)),
e as (select a, b from t group by a, b having sum(1 / ((high_x + ma - sx) / x + (low_y + mb - sy) / y)) >= 0.8e0 - 1e-9
  union select a.doc_id, b.doc_id from d a join d b on a.t = b.t and a.doc_id < b.doc_id),
both_ways as (select a, b from e union all select b, a from e),
reach(node, root) as (select doc_id, doc_id from d union select both_ways.b, reach.root from reach join both_ways on both_ways.a = reach.node),
c as (select node, min(root) as class_id from reach group by node)
select d.doc_id, c.class_id, count(*) over (partition by c.class_id) as class_size, min(d.doc_id) over (partition by d.t) as text_class
from d join c on c.node = d.doc_id
"""
