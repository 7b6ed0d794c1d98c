"""Main-text extraction by a linear-chain conditional random field (operator 5).

A page is a sequence of DOM leaf blocks.  Each block's features are its
ancestors' tags and names and its own text's shape; the chain's labels say
whether it is main text.  The field is trained by stochastic gradient ascent
of the conditional likelihood on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import small_batches, tidy
from locusframe.llm.html_blocks import Block, leaf_blocks
from locusframe.llm.html_training import labelled_pages

SENTENCE_ENDS = frozenset(".!?;:…。")


SECTIONING = frozenset("t:article t:main t:nav t:aside t:header t:footer t:section t:form t:menu t:dialog t:figure t:table".split())


def path_features(path: tuple[str, ...]) -> set[str]:
    """All ancestors' tags and names, the innermost sectioning element (``d:``), and the names of the innermost named element (``k:``)."""
    out = set(path)
    names: list[str] = []
    for f in reversed(path):
        if f.startswith("c:"):
            names.append(f)
        elif names:
            break
    out.update(f"k:{f[2:]}" for f in names)
    out.update(f"p:{f[2:7]}" for f in path if f.startswith("c:"))  # commentlist, comments and comment are alike
    inner = next((f for f in reversed(path) if f in SECTIONING), None)
    out.add(f"d:{inner}")
    return out


def text_features(b: Block) -> tuple[str, ...]:
    """The shape of a block's text: length, how much of it is linked, how it ends, a few marks."""
    n = len(b.text)
    out = [f"o:{b.own}", f"n:{min(12, n.bit_length())}", f"l:{int(b.linked * 4)}"]
    if b.text[-1] in SENTENCE_ENDS:
        out.append("ends")
    if "©" in b.text:
        out.append("copyright")
    return tuple(out)


@dataclass
class Field:
    """Feature weights (difference main - other) and transition weights of a two-label chain."""

    weights: dict[str, float]
    start: np.ndarray
    moves: np.ndarray
    paths: dict[tuple[str, ...], float] = field(default_factory=dict)
    texts: dict[tuple[str, ...], float] = field(default_factory=dict)

    def unary(self, b: Block) -> float:
        """Score of main text over other; what ancestors add is kept by path."""
        score = self.paths.get(b.path)
        if score is None:
            if len(self.paths) > 10_000:
                self.paths.clear()
            score = self.paths[b.path] = sum(self.weights.get(f, 0.0) for f in path_features(b.path))
        shape = text_features(b)
        more = self.texts.get(shape)
        if more is None:
            more = self.texts[shape] = sum(self.weights.get(f, 0.0) for f in shape)
        return score + more

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels, by Viterbi."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = self.start.tolist()
        back: list[tuple[int, int]] = []
        for i, block in enumerate(blocks):
            u = self.unary(block)
            if i == 0:
                b += u
                continue
            to0, to1 = (a + m00, b + m10), (a + m01, b + m11)
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            a, b = max(to0), max(to1) + u
        label = int(b > a)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Field:
    """Fit by AdaGrad on the log-likelihood; gradients by the forward-backward recursion."""
    names: dict[str, int] = {}
    rows = []
    for blocks, labels in pages:
        rows.append(([np.array([names.setdefault(f, len(names)) for f in {*path_features(b.path), *text_features(b)}]) for b in blocks], np.array(labels)))
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-6)
    chain, chain_seen = np.zeros(6), np.full(6, 1e-6)  # two starts, four moves
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for p in rng.permutation(len(rows)):
            feats, y = rows[p]
            n = len(y)
            u = np.zeros((n, 2))
            u[:, 1] = [w[f].sum() for f in feats]
            moves = chain[2:].reshape(2, 2)
            alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
            alpha[0] = chain[:2] + u[0]
            for i in range(1, n):
                alpha[i] = np.logaddexp(alpha[i - 1, 0] + moves[0], alpha[i - 1, 1] + moves[1]) + u[i]
            for i in range(n - 2, -1, -1):
                nxt = u[i + 1] + beta[i + 1]
                beta[i] = np.logaddexp(moves[:, 0] + nxt[0], moves[:, 1] + nxt[1])
            z = np.logaddexp(*alpha[-1])
            prob = np.exp(alpha + beta - z)
            miss = y - prob[:, 1]
            grad = np.zeros(6)
            grad[y[0]] += 1
            grad[:2] -= prob[0]
            if n > 1:
                pair = np.exp(alpha[:-1, :, None] + moves + (u[1:] + beta[1:])[:, None, :] - z)
                np.add.at(grad, 2 + y[:-1] * 2 + y[1:], 1)
                grad[2:] -= pair.sum(0).reshape(-1)
            chain_seen += grad**2
            chain += rate * grad / np.sqrt(chain_seen)
            flat = np.concatenate(feats)
            g = np.bincount(flat, np.repeat(miss, [len(f) for f in feats]), minlength=0)
            used = np.unique(flat)
            step = g[used] - decay * w[used]
            seen[used] += step**2
            w[used] += rate * step / np.sqrt(seen[used])
    return Field({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-4}, chain[:2].copy(), chain[2:].reshape(2, 2).copy())


@lru_cache(2)
def trained(pages: int = 1500, seed: int = 11) -> Field:
    """The field trained on pages made by rule; once a driver process."""
    return train(labelled_pages(pages, seed))


def main_text(html: str, model: Field) -> str:
    blocks = leaf_blocks(html)
    if not blocks:
        return ""
    return "\n".join(b.text for b, label in zip(blocks, model.decode(blocks), strict=True) if label)


def extract_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Field | None = None) -> DataFrame:
    """The main text of every whole page: ``keep``, text (empty if there is none) and n_chars.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a line feed in page order.  A null page counts
    as empty; text outside any element is a block like others; repeated rows
    give repeated results; no other column is read.
    """
    held_model = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held_model.value
        for batch in batches:
            texts = [main_text(x or "", fitted) for x in batch.column("__html").to_pylist()]
            held = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    chosen = pages.select(*keep, F.col(html).alias("__html"))
    schema = ", ".join([*(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep), "text string", "n_chars bigint"])
    return small_batches(chosen).mapInArrow(tidy(run), schema)
