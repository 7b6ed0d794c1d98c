"""Quality classification by nearest-neighbour voting (operator 1).

A document's terms are hashed trigrams of character classes (letters of every
language are one class, so that style and not vocabulary or language counts)
and marks of repetition.  Square-rooted term rates, weighted by inverse
document frequency, are projected by a truncated singular value decomposition
fitted on a bounded labelled sample: latent-semantic vectors.  The sample's
vectors and labels are broadcast, exact cosines with all of them are computed
in blocks for every document, and the nearest ones' labels vote with weights
that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm import textcore as tc
from locusframe.llm.common import small_batches, tidy
from locusframe.llm.labelled import held_out, labelled_sample

TERMS = 1024
MARKS = 4
BLOCK = 1024
#: Cosines (in single precision) that differ by less are ties.
TIE = 1e-6

# Classes of bytes: letters that aren't ASCII capitals are one class, and so are digits; each other ASCII character is its own.
_CLASS = np.ones(256, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[0x0A] = 5
for _i, _c in enumerate(c for c in range(0x21, 0x7F) if not chr(c).isalnum()):
    _CLASS[_c] = 6 + _i
_CLASS[[c for c in range(0x20) if c not in range(0x09, 0x0E)] + [0x7F]] = 38


def term_rates(s: tc.Slice) -> np.ndarray:
    """Square roots of the rates of each row's terms: ``TERMS`` hashed trigrams and ``MARKS`` marks of repetition."""
    rows = len(s)
    out = np.zeros((rows, TERMS + MARKS), np.float32)
    kind = _CLASS[s.data]
    # a run of one class counts once, or twice if it is longer, so trigrams reach across words
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[s.offs[:-1][s.offs[:-1] < len(kind)]] = True
    second = np.zeros(len(kind), bool)
    second[1:] = first[:-1] & ~first[1:]
    at = np.flatnonzero(first | second)
    k = kind[at]
    offs = np.searchsorted(at, s.offs, "left")
    if len(k) > 2:
        row = np.repeat(np.arange(rows), np.diff(offs))
        whole = row[2:] == row[:-2]
        code = (k[:-2] * 64 + k[1:-1]) * 64 + k[2:]
        term = (tc.mix(code.astype(np.uint64)) % np.uint64(TERMS)).astype(np.int64)
        counts = np.bincount(row[2:][whole] * TERMS + term[whole], minlength=rows * TERMS).reshape(rows, TERMS)
        out[:, :TERMS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    starts, ends = tc.words(s)
    woffs = tc.word_offsets(starts, s.offs)
    n = np.diff(woffs)
    wh = tc.span_hash(tc.prefix_hash(s.data), starts, ends)
    for j, width in enumerate((1, 2, 3)):
        again = np.zeros(len(wh), bool)
        if len(wh) > width:
            again[width:] = wh[width:] == wh[:-width]
        begin = woffs[:-1]
        for step in range(width):
            edge = begin + step
            again[edge[edge < len(wh)]] = False
        out[:, TERMS + j] = np.sqrt(tc.per_row(again, woffs) / np.maximum(n, 1))
    three, soffs = tc.shingles(wh, woffs, 3)
    _, _, uoffs = tc.unique_per_row(three, soffs)
    m = np.diff(soffs)
    out[:, TERMS + 3] = np.sqrt((m - np.diff(uoffs)) / np.maximum(m, 1))
    out[n == 0] = 0
    return out


@dataclass
class NeighbourModel:
    """Term weights, projection, and the labelled unit vectors with their labels and vote weights."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    neighbours: int
    sharpness: float

    def project(self, rates: np.ndarray) -> np.ndarray:
        z = (rates * self.weight) @ self.basis
        size = np.linalg.norm(z, axis=1, keepdims=True)
        return np.divide(z, size, out=np.zeros_like(z), where=size > 0)

    def score(self, rates: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors; 0 for a text without words."""
        out = np.zeros(len(rates))
        k = min(self.neighbours, len(self.vectors))
        for lo in range(0, len(rates), BLOCK):
            z = self.project(rates[lo : lo + BLOCK])
            near = z @ self.vectors.T
            least = np.partition(near, len(self.vectors) - k, axis=1)[:, len(self.vectors) - k]
            # all that are as near as the k-th vote; those that tie with it have equal parts of the places left
            r, c = np.nonzero(near >= (least - TIE)[:, None])
            cos = near[r, c].astype(float)
            above = cos > least[r] + TIE
            n_above = np.bincount(r, above, len(z))
            part = np.where(above, 1.0, ((k - n_above) / np.maximum(np.bincount(r, ~above, len(z)), 1))[r])
            w = np.exp(self.sharpness * (np.clip(cos, 0, 1) - near.max(1).clip(0, 1)[r])) * self.votes[c] * part
            share = np.bincount(r, w * self.labels[c], len(z)) / np.bincount(r, w, len(z))
            out[lo : lo + BLOCK] = np.where((z != 0).any(1), share, 0.0)
        return np.clip(out, 0, 1)


def fit(sample: DataFrame, dims: int = 48, neighbours: int = 15, sharpness: float = 60.0, prior: float | None = None) -> NeighbourModel | None:
    """Fit on a bounded labelled sample (columns text, label); None without both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column("label"))
            for s in tc.slices(batch.column("text")):
                rates = term_rates(s)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rates], pa.binary()), pa.array(label[s.lo : s.hi], pa.int32())], names=["rates", "label"])

    got = sample.select("text", "label").mapInArrow(tidy(run), "rates binary, label int").toArrow()
    rows = sorted(zip(got.column("rates").to_pylist(), got.column("label").to_pylist(), strict=True))  # the order in which tasks end must not matter
    if len({y for _, y in rows}) < 2:
        return None
    x = np.frombuffer(b"".join(r for r, _ in rows), np.float32).reshape(len(rows), TERMS + MARKS)
    y = np.array([v for _, v in rows], np.float64)
    live = (x != 0).any(1)
    x, y = x[live], y[live]
    seen = (x > 0).sum(0)
    weight = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 1
    weight[TERMS:] = 3.0
    xw = x * weight
    value, vector = np.linalg.eigh((xw.T @ xw).astype(np.float64))
    basis = vector[:, ::-1][:, : min(dims, len(value))].astype(np.float32)
    model = NeighbourModel(weight, basis, np.zeros((0, 0)), y, np.ones(len(y)), neighbours, sharpness)
    model.vectors = np.ascontiguousarray(model.project(x))
    if prior is not None:
        share = max(1e-9, min(1 - 1e-9, y.mean()))
        model.votes = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    return model


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 2048,
    threshold: float = 0.3,
    dims: int = 48,
    neighbours: int = 15,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """A quality score of every whole text: ``keep``, held_out, score (0 to 1) and predicted (0/1).

    The model is fitted on at most ``per_class`` labelled rows of each class
    (a broadcast of at most 2 * per_class vectors of ``dims`` numbers, whatever
    the size of the corpus), none of them held out.  A score depends on the
    text alone.  A null or wordless text scores 0; without labelled rows of
    both classes every other text scores 0.5.  Labelled vectors that tie for the
    last place among the neighbours share it.  Repeated rows give repeated
    results; a null id is not held out.
    """
    model = fit(labelled_sample(docs, labels, per_class, label, key, text, skip_held_out=True), dims, neighbours)
    held_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held_model.value
        for batch in batches:
            parts = [np.zeros(0)]
            for s in tc.slices(batch.column("__text")):
                rates = term_rates(s)
                parts.append(m.score(rates) if m else np.where((rates != 0).any(1), 0.5, 0.0))
            score = np.concatenate(parts)
            held = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    chosen = docs.select(*keep, held_out(key).alias("held_out"), F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in (*keep, "held_out")), "score double", "predicted int"])
    return small_batches(chosen).mapInArrow(tidy(run), schema)
