"""Vector bin packing of token sequences (operator 3).

Examples are packed under simultaneous limits on tokens, segments and
loss-bearing tokens.  A task streams its documents: blocks that fill a
sequence by themselves leave at once, the rests go to a pool of bounded size.
A pool is packed by the dot-product heuristic: of the items that fit in every
dimension, the open sequence takes the one whose demand vector has the largest
dot product with what remains.  Where none fits and tokens remain, the largest
item is cut so that the sequence is full.  What is left at a task's end is cut
into sequences whose lengths are powers of two, which need no padding.

No shuffle takes place: a sequence is made of one task's documents, its id of
the task's partition and a running number, so a task that runs again gives the
same sequences.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm import textcore as tc
from locusframe.llm.common import small_batches, tidy

POOL = 2048
END_ID = 1
MAX_WORDS = 400_000
RUN = 250_000
AT_ONCE = 4096


# Classes of bytes: white space, ASCII letters, ASCII digits, what may bind to its neighbours (apostrophes, all that isn't ASCII), other ASCII marks.
_KIND = np.full(256, 4, np.uint8)
_KIND[tc.IS_SPACE] = 0
_KIND[[c for c in range(128) if chr(c).isalpha()]] = 1
_KIND[[c for c in range(128) if chr(c).isdigit()]] = 2
_KIND[0x80:] = 3
_KIND[ord("'")] = 3
#: Where two bytes meet that no pre-token spans: a digit and any ASCII character, a letter and a mark.
_APART = np.zeros((5, 5), bool)
for _a, _b in ((2, 2), (1, 2), (2, 1), (2, 4), (4, 2), (1, 4), (4, 1)):
    _APART[_a, _b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class HashIndex:
    """A vectorised open-addressing map from 64-bit keys to running numbers."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 for those that aren't there."""
        at = keys & self.mask
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held != 0))
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that aren't there."""
        at, todo = keys & self.mask, np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = keys[free]
            self.values[at[free]] = values[free]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask


#: The normaliser and the pattern of the files for which texts are cut by :meth:`WordTokenizer.pieces`.
LOWERING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def cuts_words(file: dict) -> bool:
    """Whether a tokenizer file lower-cases and splits as :meth:`WordTokenizer.pieces` takes for granted."""
    normalizer, split = file.get("normalizer") or {}, (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return normalizer.get("normalizers") == LOWERING and split[0].get("pattern") == {"Regex": PATTERN} and split[0].get("behavior") == "Removed" and bool(split[0].get("invert"))


class WordTokenizer:
    """Ids of whole texts from a tokenizer that lower-cases and whose tokens never cross white space.

    Files of another kind are told by their normaliser and pattern; with those whole texts are encoded by the library.

    A text is cut where no pre-token can reach across: at white space, between
    an ASCII letter and an ASCII mark, and beside ASCII digits.  Each distinct
    piece is encoded by the library once and kept (up to ``MAX_WORDS`` pieces,
    then the store is begun anew).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.special = [a["content"].encode() for a in whole["added_tokens"]]
        self.cuts = cuts_words(whole)
        self.begin()

    def begin(self) -> None:
        self.index, self.count = HashIndex(MAX_WORDS.bit_length() + 1), 0
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        n = self.count
        while n + len(texts) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        # the library's results are large, so they are taken a few at a time
        lists = [e.ids for k in range(0, len(texts), AT_ONCE) for e in self.library.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[n : n + len(size)] = size
        self.start[n : n + len(size)] = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.count += len(texts)
        self.index.put(hashes, np.arange(n, self.count, dtype=np.int32))

    def pieces(self, s: tc.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slice's bytes in lower case, and starts and ends of its pieces."""
        kind, data = _KIND[s.data], s.data
        whole = data.tobytes()
        if any(x in whole for x in self.special):
            return (data, *tc.words(s))
        meet = np.zeros(len(data) + 1, bool)
        meet[1:-1] = _APART[kind[:-1], kind[1:]]
        meet[s.offs] = True
        solid = kind != 0
        starts = np.flatnonzero(solid & (meet[:-1] | np.concatenate([[True], ~solid[:-1]])))
        ends = np.flatnonzero(solid & (meet[1:] | np.concatenate([~solid[1:], [True]]))) + 1
        return _LOWER[data], starts, ends

    def encode(self, s: tc.Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and offsets by row."""
        if not self.cuts:
            lists = [e.ids for e in self.library.encode_batch_fast([s.row_bytes(i).decode() for i in range(len(s))], add_special_tokens=False)]
            offs = np.cumsum([0, *map(len, lists)])
            return np.fromiter(chain.from_iterable(lists), np.uint32, int(offs[-1])), offs
        if len(s.data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(s) + 1, np.int64)
        data, starts, ends = self.pieces(s)
        woffs = tc.word_offsets(starts, s.offs)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(s) + 1, np.int64)
        hashes = tc.span_hash(tc.prefix_hash(data), starts, ends) | np.uint64(1)
        parts = [self.encode_pieces(data, starts[k : k + RUN], ends[k : k + RUN], hashes[k : k + RUN]) for k in range(0, len(starts), RUN)]
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(np.concatenate([size for _, size in parts]), out=total[1:])
        return np.concatenate([ids for ids, _ in parts]), total[woffs]

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of at most ``RUN`` pieces, and how many each has."""
        if self.count > MAX_WORDS:
            self.begin()
        word = self.index.get(hashes)
        new = np.flatnonzero(word < 0)
        if len(new):
            fresh, some = np.unique(hashes[new], return_index=True)
            at = new[some]
            self.learn(fresh, [data[a:b].tobytes().decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            word[new] = self.index.get(hashes[new])
        size = self.size[word]
        total = np.cumsum(size)
        at = np.arange(total[-1]) + np.repeat(self.start[word] - (total - size), size)
        return self.ids[at], size


@lru_cache(4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Packer:
    """Packs one task's documents; :meth:`add` and :meth:`finish` yield pieces.

    A piece is (document number, start, length, sequence number, offset).
    """

    def __init__(self, capacity: int, max_segments: int, max_loss: int):
        if min(capacity, max_segments, max_loss) < 1:
            raise ValueError("each limit must be at least 1")
        self.limits = np.array([capacity, max_segments, max_loss], np.float64)
        self.capacity, self.max_segments, self.max_loss = capacity, max_segments, max_loss
        self.sequence = 0
        self.pool: list[tuple[int, int, int, int]] = []  # document, start, length, first loss-bearing token

    def loss(self, start: int, length: int, first: int) -> int:
        return max(0, start + length - max(start, first))

    def fitting(self, start: int, length: int, first: int, tokens: int, loss: int) -> int:
        """How much of an item's front fits in the given tokens and loss-bearing tokens."""
        return min(length, tokens, max(0, first - start) + loss)

    def add(self, doc: int, length: int, first: int) -> Iterator[tuple[int, int, int, int, int]]:
        start = 0
        while length - start >= self.capacity:
            size = self.fitting(start, length - start, first, self.capacity, self.max_loss)
            yield doc, start, size, self.sequence, 0
            self.sequence += 1
            start += size
        if start < length:
            self.pool.append((doc, start, length - start, first))
            if len(self.pool) >= POOL:
                yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[tuple[int, int, int, int, int]]:
        items, self.pool = self.pool, []
        demand = np.array([[n, 1, self.loss(s, n, f)] for _, s, n, f in items], np.float64)
        scaled = demand / self.limits
        alive = np.ones(len(items), bool)
        left = len(items)
        while left:
            room, chosen = self.limits.copy(), []
            while left and room[0] > 0 and room[1] > 0:
                fits = alive & (demand <= room).all(1)
                if not fits.any():
                    break
                k = int(np.argmax(np.where(fits, scaled @ (room / self.limits), -1.0)))
                doc, start, size, _ = items[k]
                chosen.append((doc, start, size))
                room -= demand[k]
                alive[k] = False
                left -= 1
            if left and room[0] > 0 and room[1] > 0:
                # cut the item of which most fits
                best, size = -1, 0
                for k in np.flatnonzero(alive)[np.argsort(-demand[alive, 0], kind="stable")][:8]:
                    _, start, length, first = items[k]
                    some = self.fitting(start, length, first, int(room[0]), int(room[2]))
                    if some > size:
                        best, size = int(k), some
                if best >= 0:
                    doc, start, length, first = items[best]
                    chosen.append((doc, start, size))
                    room -= (size, 1, self.loss(start, size, first))
                    items[best] = (doc, start + size, length - size, first)
                    demand[best] = (length - size, 1, self.loss(start + size, length - size, first))
                    scaled[best] = demand[best] / self.limits
            if not left and room[0] > 0:
                if not last:
                    firsts = {d: f for d, _, _, f in items}
                    self.pool = [(d, s, n, firsts[d]) for d, s, n in chosen]
                    return
                yield from self.powers(chosen)
                return
            yield from self.close(chosen)

    def close(self, chosen: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        offset = 0
        for doc, start, size in chosen:
            yield doc, start, size, self.sequence, offset
            offset += size
        self.sequence += 1

    def powers(self, chosen: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """Deal the last sequence's pieces out to sequences whose lengths are powers of two."""
        rest = sum(n for _, _, n in chosen)
        chosen = list(chosen)
        while rest:
            want = 1 << (rest.bit_length() - 1)
            rest -= want
            part = []
            while want:
                doc, start, size = chosen[0]
                some = min(size, want)
                part.append((doc, start, some))
                want -= some
                if some == size:
                    chosen.pop(0)
                else:
                    chosen[0] = (doc, start + some, size - some)
            yield from self.close(part)

    def finish(self) -> Iterator[tuple[int, int, int, int, int]]:
        if self.pool:
            yield from self.pack(last=True)


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    key: str = "doc_id",
    capacity: int = 2048,
    max_segments: int = 256,
    max_loss: int | None = None,
    loss_from: str | int | None = None,
) -> DataFrame:
    """Pack tokenized documents into sequences.

    A document's ids are the tokenizer's, without special tokens, then id 1.
    ``loss_from`` names a column with the number of leading ids that bear no
    loss (an instruction's prompt; null or no column: all ids bear loss), or
    is that number for all rows.
    Returns a row per piece: ``key``, start, length, ids (little-endian
    unsigned 32-bit ids of the piece), doc_tokens, loss_tokens, sequence_id,
    offset.  Each id of each row lies in exactly one piece; a null or empty
    text has the single id 1; repeated rows are packed each; an empty table
    gives an empty one; no other column is read.  No sequence exceeds a limit;
    the ids kept in memory are those of one pool and one Arrow batch.
    """
    limit_loss = capacity if max_loss is None else max_loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        packer = Packer(capacity, max_segments, limit_loss)
        partition = TaskContext.get().partitionId() if TaskContext.get() else 0
        held: dict[int, list] = {}  # document number: key, ids, ids not yet emitted, first loss-bearing id
        number, schema_key = 0, None
        out: list[list] = [[] for _ in range(8)]
        waiting = 0

        def emit(pieces: Iterator[tuple[int, int, int, int, int]]) -> None:
            nonlocal waiting
            for doc, start, size, sequence, offset in pieces:
                d = held[doc]
                row = (d[0], start, size, d[1][start : start + size].tobytes(), len(d[1]), max(0, start + size - max(start, d[3])), (partition << 33) + sequence, offset)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                waiting += size
                d[2] -= size
                if d[2] == 0:
                    del held[doc]

        def flush() -> pa.RecordBatch:
            nonlocal waiting
            kinds = [schema_key, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["key", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"])
            for column in out:
                column.clear()
            waiting = 0
            return batch

        for batch in batches:
            schema_key = batch.schema.field(0).type
            keys, firsts = batch.column(0), batch.column(1)
            for s in tc.slices(batch.column(2)):
                ids, offs = words.encode(s)
                for i in range(len(s)):
                    own = np.append(ids[offs[i] : offs[i + 1]], np.uint32(END_ID)).astype("<u4")
                    first = firsts[s.lo + i].as_py() or 0
                    held[number] = [keys[s.lo + i].as_py(), own, len(own), first]
                    emit(packer.add(number, len(own), first))
                    number += 1
                    if waiting > 1 << 19:
                        yield flush()
        emit(packer.finish())
        if out[0]:
            yield flush()

    first = F.lit(0).cast("long") if loss_from is None else (F.lit(loss_from) if isinstance(loss_from, int) else F.col(loss_from)).cast("long")
    chosen = docs.select(F.col(key).alias("__key"), first.alias("__first"), F.col(text).alias("__text"))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint"
    return small_batches(chosen).mapInArrow(tidy(run), schema)
