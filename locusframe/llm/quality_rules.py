"""Quality rules judged by an isolation forest (operator 9).

Rule statistics are computed over every whole text.  The forest is grown on
the statistics of labelled good rows; a row's score comes from its mean path
length over random splits.  The threshold is calibrated on labelled rows of
both classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm import textcore as tc
from locusframe.llm.common import materialize, small_batches, tidy
from locusframe.llm.labelled import agreed_labels

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = (*COUNTS, "n_lines", "n_upper", "n_digits", "n_marks", "n_same")
ROWS_OF_TREE, SCORE_STEPS = 256, 1 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def rule_statistics(s: tc.Slice) -> dict[str, np.ndarray]:
    """Counts by row: those of ``COUNTS``, and n_lines, n_upper, n_digits, n_marks, n_same (words equal to the word before)."""
    data, offs, rows = s.data, s.offs, len(s)
    space = tc.IS_SPACE[data]
    starts, ends = tc.words(s)
    woffs = tc.word_offsets(starts, offs)
    out = {"n_words": np.diff(woffs)}
    out["word_chars"] = tc.per_row(~space & ((data & 0xC0) != 0x80), offs)
    for name, lut in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = tc.per_row(lut[data], offs)
    pre = tc.prefix_hash(data)
    # lines with a word
    lo, hi = tc.spans_of(data != 0x0A, offs)
    held = np.searchsorted(starts, hi) > np.searchsorted(starts, lo) if len(lo) else np.zeros(0, bool)
    lo, hi = lo[held], hi[held]
    loffs = np.searchsorted(lo, offs, "left")
    out["n_lines"] = np.diff(loffs)
    _, counts, uoffs = tc.unique_per_row(tc.span_hash(pre, lo, hi), loffs)
    out["n_dup_lines"] = out["n_lines"] - np.diff(uoffs)
    # words in windows of three that the text has twice or more
    wh = tc.span_hash(pre, starts, ends)
    n = out["n_words"]
    wins = np.maximum(n - 2, 0)
    winoffs = np.zeros(rows + 1, np.int64)
    np.cumsum(wins, out=winoffs[1:])
    row = np.repeat(np.arange(rows), wins)
    at = woffs[row] + np.arange(int(winoffs[-1])) - winoffs[row]
    if len(at):
        h = tc.mix(tc.mix(wh[at] * np.uint64(3) + wh[at + 1]) * np.uint64(5) + wh[at + 2])
        order = np.lexsort((h, row))
        same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + 3, -1)
        covered = np.cumsum(edge)[:-1] > 0
        out["n_repeat_words"] = tc.per_row(covered, woffs)
    else:
        out["n_repeat_words"] = np.zeros(rows, np.int64)
    again = np.zeros(len(wh), bool)
    again[1:] = wh[1:] == wh[:-1]
    again[woffs[:-1][woffs[:-1] < len(wh)]] = False
    out["n_same"] = tc.per_row(again, woffs)
    return out


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that the forest splits on; each is bounded in its effect by a logarithm or a ratio."""
    n = np.maximum(stats["n_words"], 1).astype(float)
    chars = np.maximum(stats["word_chars"], 1).astype(float)
    lines = np.maximum(stats["n_lines"], 1).astype(float)
    return np.stack(
        [
            np.minimum(np.log(stats["word_chars"] / n + 1e-9), 4),
            stats["n_symbols"] / n,
            np.maximum(stats["n_dup_lines"] / lines, stats["n_repeat_words"] / n),
            stats["n_upper"] / chars,
            stats["n_marks"] / chars,
            stats["n_same"] / n,
        ],
        axis=1,
    )


@dataclass
class IsolationForest:
    """Trees as flat arrays; a leaf's children are itself."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    depth: int
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length): near 1 is anomalous."""
        out = np.empty(len(x))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            node = np.tile(self.roots, (len(part), 1))
            who = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[who, self.feature[node]] < self.split[node], self.left[node], self.right[node])
            out[lo : lo + 4096] = self.path[node].mean(1)
        return 2.0 ** (-out / self.norm)


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow_forest(x: np.ndarray, trees: int = 128, rows: int = 256, seed: int = 1) -> IsolationForest:
    """Grow trees on random sub-samples, splitting at random between a feature's least and largest value.

    A feature that is constant among the sub-sample splits just beyond its
    value, so that rows unlike all of those are isolated at once.
    """
    rng = np.random.default_rng(seed)
    take = min(rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(2, take)))))
    feature, split, left, right, path, roots = [], [], [], [], [], []

    def build(part: np.ndarray, level: int) -> int:
        me = len(feature)
        for column, value in ((feature, 0), (split, 0.0), (left, me), (right, me), (path, level + expected_path(len(part)))):
            column.append(value)
        if level >= depth or len(part) <= 1:
            return me
        f = int(rng.integers(x.shape[1]))
        lo, hi = part[:, f].min(), part[:, f].max()
        margin = 0.05 * (hi - lo) + 1e-3
        cut = rng.uniform(lo - margin, hi + margin)
        below = part[:, f] < cut
        feature[me], split[me] = f, cut
        left[me] = build(part[below], level + 1)
        right[me] = build(part[~below], level + 1)
        return me

    for _ in range(trees):
        roots.append(build(x[rng.choice(len(x), take, replace=False)], 0))
    arrays = (np.array(feature, np.int32), np.array(split), np.array(left, np.int32), np.array(right, np.int32), np.array(path), np.array(roots, np.int32))
    return IsolationForest(*arrays, depth=depth, norm=max(expected_path(take), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, cost: float = 40.0) -> float:
    """The threshold with the most (rejected bad share - ``cost`` * rejected good share); a row is rejected above it."""
    if len(scores) == 0:
        return np.inf
    at, place = np.unique(scores, return_inverse=True)
    return threshold_of(at, *(np.bincount(place[rows], minlength=len(at)) for rows in (good, ~good)), cost)


def threshold_of(at: np.ndarray, good: np.ndarray, bad: np.ndarray, cost: float = 40.0) -> float:
    """:func:`calibrate` from how many good and bad rows have each score; ``at``: the scores, ascending."""
    above_g, above_b = ((n.sum() - np.cumsum(n)) / max(1, n.sum()) for n in (good, bad))
    best = int(np.argmax(above_b - cost * above_g))
    return float((at[best] + at[min(best + 1, len(at) - 1)]) / 2)


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def score_rows(rows: DataFrame, forest: IsolationForest, extra: str) -> DataFrame:
    """``extra`` (a bigint column) and the score of rows of statistics."""
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in STATS})
            yield pa.RecordBatch.from_arrays([batch.column(extra), pa.array(sent.value.score(x))], names=[extra, "score"])

    return rows.select(extra, *STATS).mapInArrow(tidy(run), f"{extra} bigint, score double")


def fit(known: DataFrame, trees: int = 128, seed: int = 1) -> tuple[IsolationForest, float] | None:
    """Forest and threshold from the statistics of all labelled rows (columns __id, label and ``STATS``).

    A tree is grown, as the method has it, on 256 random rows; they are drawn
    from all good rows but a third.  The threshold is set on every row of that
    third and every bad one: their scores are counted in steps of 2 ** -20.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    held = materialize(known.where(~failed).withColumn("label", F.col("label").cast("long")), "labelled")
    if held.where("label = 1").count() < 8:
        return None
    # the threshold is set on good rows that the forest has not seen
    judged = (F.col("label") == 0) | (F.pmod(F.xxhash64("__id", F.lit("judged")), F.lit(3)) == 0)
    drawn = held.where(~judged).orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(trees * ROWS_OF_TREE).select(*STATS).toArrow()
    if not len(drawn):
        return None
    forest = grow_forest(features({c: drawn.column(c).to_numpy() for c in STATS}), trees=trees, rows=ROWS_OF_TREE, seed=seed)
    steps = score_rows(held.where(judged), forest, "label").groupBy(F.floor(F.col("score") * SCORE_STEPS).alias("step"))
    t = steps.agg(*[F.count_if(F.col("label") == c).alias(n) for c, n in ((1, "good"), (0, "bad"))]).orderBy("step").toArrow()
    if not len(t):
        return forest, np.inf
    return forest, threshold_of((t.column("step").to_numpy() + 0.5) / SCORE_STEPS, t.column("good").to_numpy(), t.column("bad").to_numpy())


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), trees: int = 128, seed: int = 1) -> DataFrame:
    """Rule statistics, base rules and the forest's verdict of every whole text.

    Returns ``keep``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (bigint), base_failed, anomaly (double) and kept.  The
    forest is fitted on all labelled rows, none of them held out (crc32 of the
    id modulo 5 is 0): its trees' rows are drawn from two thirds of the good
    ones, and the threshold is set on all others and all bad ones;
    without at least 8 good rows that pass the base rules, the base rules
    decide alone.  A null text counts as empty (all counts 0, base_failed);
    repeated rows give repeated results (of rows that share an id those of the least statistics
    are fitted); other columns are not read.  Texts are read once: their
    statistics, a narrow table, are written in the shared folder.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [rule_statistics(s) for s in tc.slices(batch.column("__text"))]
            stats = {c: np.concatenate([x[c] for x in stats]) if stats else np.zeros(0, np.int64) for c in STATS}
            held = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(stats[c].astype(np.int64)) for c in STATS)], names=[*batch.schema.names[:-1], *STATS])

    chosen = docs.select(*keep, F.col("doc_id").alias("__id"), F.col(text).alias("__text"))
    kept_schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)
    counts = ", ".join(f"{c} bigint" for c in STATS)
    table = materialize(small_batches(chosen).mapInArrow(tidy(count), f"{kept_schema}, __id {chosen.schema['__id'].dataType.simpleString()}, {counts}"), "statistics")
    known = table.join(agreed_labels(labels, skip_held_out=True), "__id").groupBy("__id").agg(F.min("label").alias("label"), F.min(F.struct(*STATS)).alias("s")).select("__id", "label", "s.*")
    held_model = docs.sparkSession.sparkContext.broadcast(fit(known, trees, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held_model.value
        for batch in batches:
            stats = {c: batch.column(c).to_numpy() for c in STATS}
            failed = base_failed(stats)
            score = model[0].score(features(stats)) if model else np.zeros(len(failed))
            kept = ~failed & (score <= model[1] if model else True)
            held = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*held, *(batch.column(c) for c in COUNTS), pa.array(failed), pa.array(score), pa.array(kept)], names=[*keep, *COUNTS, "base_failed", "anomaly", "kept"])

    return table.drop("__id").mapInArrow(tidy(run), f"{kept_schema}, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, anomaly double, kept boolean")
