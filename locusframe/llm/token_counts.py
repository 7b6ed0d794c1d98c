"""Token counts by compiled finite-state transducers (operator 2).

A byte-level BPE vocabulary is compiled to two deterministic transducers.

*Pre-tokenizer.*  Its input symbol is a code point's class together with the
class of the code point that follows (one symbol of look-ahead); each
transition says whether a pre-token begins there.  A slice of text is cut into
chunks of equal length.  Each chunk is run from *every* state at once, which
gives its state map; the maps compose associatively, so a parallel prefix scan
over chunks (doubling steps) gives each chunk's true entry state, and a second
pass from there marks the pre-tokens.

*BPE.*  Its input is bytes, its states say all that later bytes can depend on:
the longest suffix that a token can still begin with, and for each position in
that suffix the last token of the encoding up to there with the number of
tokens since.  A transition is annotated with the number of tokens it adds
(which may be negative: a byte can merge what stood apart).  That the last
token of a prefix is the one whose pair with the token before it stays apart
under the merges is a property of BPE, so the transducer gives exactly the
merge procedure's counts, in one step a byte and for pre-tokens of any length.
It is determinised lazily; before it would have more than ``MAX_STATES`` states
it is begun anew with the states in use, which affects nothing but time.
Pre-tokens reset it, so the sum of the counts that its transitions annotate over
a document is the document's token count.  Equal pre-tokens of a slice (by a
64-bit hash and length) are run once.  A long pre-token is cut into chunks: each
is entered in the state that the bytes before it lead to from the start, all
chunks are run side by side, and their maps from entry state to (exit state,
count) are composed; a chunk whose entry isn't the exit before it is run again.

Special strings in a text count one token each and split the text, as the
library does by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm import textcore as tc
from locusframe.llm.common import small_batches, tidy

MAX_STATES = 1 << 18
CHUNK = 64
#: A pre-token of more bytes is cut into chunks, which are entered with so many bytes of run-up.
LONG, RUN_UP = 512, 96
#: An entry of the transducer's table holds the tokens added, plus half of this, beside the next state.
ADDED = 1 << 12

# Classes of code points. The letters are those of the contractions 's 't 'm 'd 're 've 'll.
LETTER, SINGLE, R, V, L, E, NUMBER, OTHER, QUOTE, BLANK, SPACE = range(11)
NEXT_SPACE, NEXT_E, NEXT_L, NEXT_ANY = range(4)
# States: what the last code point leaves open.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_SPACE, AFTER_QUOTE, IN_PAIR = range(8)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        found = np.array([ord(c) for c in regex.findall(pattern, every)], np.int64)
        out[found] = kind
    # the separators 0x1C to 0x1F are no white space in Unicode's property
    out[0x1C:0x20] = OTHER
    for c in "stmd":
        out[ord(c)] = SINGLE
    for c, kind in (("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE), (" ", BLANK)):
        out[ord(c)] = kind
    return out


def _step(state: int, kind: int, then: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token begins at this code point."""
    if kind in (BLANK, SPACE):
        begins = state != IN_SPACE or then != NEXT_SPACE
        if then == NEXT_SPACE:
            return IN_SPACE, state != IN_SPACE
        return (AFTER_BLANK if kind == BLANK else FREE), begins
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if kind in (OTHER, QUOTE):
        if state in (IN_OTHERS, AFTER_BLANK, AFTER_QUOTE):
            return IN_OTHERS, False
        return (AFTER_QUOTE if kind == QUOTE else IN_OTHERS), True
    if state in (IN_LETTERS, AFTER_BLANK):
        return IN_LETTERS, False
    if state == IN_PAIR:
        return FREE, False
    if state == AFTER_QUOTE:
        if kind == SINGLE:
            return FREE, False
        if (kind in (R, V) and then == NEXT_E) or (kind == L and then == NEXT_L):
            return IN_PAIR, False
    return IN_LETTERS, True


@lru_cache(1)
def pre_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next states and begin marks by ``symbol * 8 + state``; symbols from 44 on begin a text."""
    to, begins = np.zeros(88 * 8, np.uint8), np.zeros(88 * 8, bool)
    for fresh in (0, 1):
        for kind in range(11):
            for then in range(4):
                for state in range(8):
                    at = ((fresh * 44) + kind * 4 + then) * 8 + state
                    to[at], begins[at] = _step(FREE if fresh else state, kind, then)
                    begins[at] |= bool(fresh)
    return to, begins


def chunk_maps(symbols: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each chunk (a row of symbols) the state in which it ends, by the state it begins in."""
    maps = np.tile(np.arange(8, dtype=np.int32), (len(symbols), 1))
    base = symbols.astype(np.int32) * 8
    for k in range(symbols.shape[1]):
        maps = to[base[:, k, None] + maps].astype(np.int32)
    return maps


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, in a logarithmic number of parallel steps."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
        step *= 2
    return maps


def pre_tokens(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens begin, in texts of valid UTF-8 that ``offs`` delimits."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    n = len(at)
    if n == 0:
        return at
    code = data[at].astype(np.int32)
    if n < len(data):
        size = np.diff(np.append(at, len(data)))
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32) & 0x3F
        for width, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            w = np.flatnonzero(size == width)
            c = code[w] & mask
            for j in range(1, width):
                c = (c << 6) | padded[at[w] + j]
            code[w] = c
    kind = char_classes()[code]
    after = np.empty(n, np.uint8)
    lut = np.full(11, NEXT_ANY, np.uint8)
    lut[[BLANK, SPACE]] = NEXT_SPACE
    lut[E], lut[L] = NEXT_E, NEXT_L
    after[:-1] = lut[kind[1:]]
    after[-1] = NEXT_SPACE
    begin = offs[:-1][np.diff(offs) > 0]
    first = np.searchsorted(at, begin)
    after[first[first > 0] - 1] = NEXT_SPACE
    symbols = (kind * 4 + after).astype(np.uint8)
    symbols[first] += 44
    to, begins = pre_tables()
    rows = -(-n // CHUNK)
    grid = np.zeros(rows * CHUNK, np.uint8)
    grid[:n] = symbols
    grid = grid.reshape(rows, CHUNK)
    state = np.zeros(rows, np.int32)
    if rows > 1:
        state[1:] = scan(chunk_maps(grid, to))[:-1, FREE]
    marks = np.empty((rows, CHUNK), bool)
    columns = grid.T.astype(np.int32) * 8
    for k in range(CHUNK):
        where = columns[k] + state
        marks[:, k] = begins[where]
        state = to[where].astype(np.int32)
    return at[marks.reshape(-1)[:n]]


def byte_symbols() -> dict[str, int]:
    """The byte that each printable symbol of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, self.special = whole["model"], [a["content"].encode() for a in whole["added_tokens"]]
        split = whole["pre_tokenizer"]
        if whole["normalizer"] is not None or model["type"] != "BPE" or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
            raise ValueError(f"{path}: only byte-level BPE with the usual pattern is compiled")
        symbol = byte_symbols()
        names = {a["content"] for a in whole["added_tokens"]}
        self.ids = {bytes(symbol[c] for c in t): i for t, i in model["vocab"].items() if t not in names}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            left, right = (bytes(symbol[c] for c in x) for x in (a, b))
            self.rank[self.ids[left], self.ids[right]] = (r, self.ids[left + right])
        self.bytes_of = {i: t for t, i in self.ids.items()}

    def merge(self, text: bytes) -> list[int]:
        """Encode by the merge procedure itself; used on pairs of tokens only."""
        ids = [self.ids[text[i : i + 1]] for i in range(len(text))]
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 60, -1)) for p in zip(ids, ids[1:], strict=False)))
            if best[1] < 0:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.rank.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


class BpeTransducer:
    """The lazily determinised BPE transducer.

    ``table[state * 256 + byte]`` holds the next state times ``ADDED`` plus the
    number of tokens added plus ``ADDED / 2``, or -1 where it isn't compiled yet.
    """

    def __init__(self, vocabulary: Vocabulary, max_states: int = MAX_STATES):
        if max_states * ADDED >= 1 << 31:
            raise ValueError("too many states for 32-bit entries")
        self.v, self.max_states = vocabulary, max_states
        self.prefixes = {t[:k] for t in vocabulary.ids for k in range(len(t) + 1)}
        self.apart: dict[tuple[int, int], bool] = {}
        self.begin()

    def begin(self) -> None:
        start = (b"", ((-1, 0),))
        self.states, self.number = [start], {start: 0}
        self.table = np.full(256 * 1024, -1, np.int32)

    def add(self, content: tuple) -> int:
        """The number of a state."""
        number = self.number.get(content)
        if number is None:
            number = self.number[content] = len(self.states)
            self.states.append(content)
            if len(self.states) * 256 > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, self.table.dtype)])
        return number

    def make_room(self, states: np.ndarray, more: int) -> np.ndarray:
        """``states``, renumbered if the machine had to be begun anew to take ``more`` new ones."""
        if len(self.states) + more <= self.max_states:
            return states
        used, at = np.unique(states, return_inverse=True)
        contents = [self.states[x] for x in used.tolist()]
        self.begin()
        return np.array([self.add(c) for c in contents], np.int64)[at]

    def stays_apart(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.apart.get(key)
        if known is None:
            if a < 0:
                known = self.v.merge(self.v.bytes_of[b]) == [b]
            else:
                known = self.v.merge(self.v.bytes_of[a] + self.v.bytes_of[b]) == [a, b]
            if len(self.apart) > 1 << 20:
                self.apart.clear()
            self.apart[key] = known
        return known

    def compile(self, state: int, byte: int) -> int:
        """Add the transition and return its entry."""
        suffix, past = self.states[state]
        grown = suffix + bytes((byte,))
        for size in range(len(grown), 0, -1):
            token = self.v.ids.get(grown[-size:])
            if token is not None:
                last, since = past[size - 1]
                if self.stays_apart(last, token):
                    break
        else:
            raise ValueError(f"no token ends in {grown!r}")
        added = since + 1
        while grown not in self.prefixes:
            grown = grown[1:]
        after = (grown, ((token, 0), *((t, c - added) for t, c in past[: len(grown)])))
        if not -ADDED // 2 <= added < ADDED // 2:
            raise ValueError(f"a transition adds {added} tokens")
        entry = self.add(after) * ADDED + added + ADDED // 2
        self.table[state * 256 + byte] = entry
        return entry

    def run(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and tokens of spans in order of falling size, by a byte of each at a time."""
        state, total = state.copy(), np.zeros(len(size), np.int64)
        alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for k, n in enumerate(alive.tolist()):
            byte = data[begin[:n] + k].astype(np.int64)
            at = state[:n] * 256 + byte
            entry = self.table[at]
            if (entry < 0).any():
                missing = np.unique(at[entry < 0])
                # ended spans' states are kept, too: they are results
                renumbered = self.make_room(state, len(missing))
                if renumbered is not state:
                    state = renumbered
                    at = state[:n] * 256 + byte
                    missing = np.unique(at[self.table[at] < 0])
                for key in missing.tolist():
                    self.compile(key >> 8, key & 255)
                entry = self.table[at]
            state[:n] = entry // ADDED
            total[:n] += entry % ADDED - ADDED // 2
        return state, total

    def long(self, data: np.ndarray, a: int, b: int) -> int:
        """Tokens of one long pre-token: maps of chunks, composed."""
        block, whole, before = max(1, self.max_states // 4), 0, self.states[0]
        for lo in range(a, b, block * LONG):
            begin = np.arange(lo, min(b, lo + block * LONG), LONG)
            size = np.minimum(b - begin, LONG)
            up = np.minimum(begin - a, RUN_UP)[::-1]
            entry = self.run(data, begin[::-1] - up, up, np.zeros(len(begin), np.int64))[0][::-1]
            # numbers of states may change in a run, what they stand for doesn't
            entered = [self.states[x] for x in entry.tolist()]
            out, tokens = self.run(data, begin, size, entry)
            left = [self.states[x] for x in out.tolist()]
            for k in range(len(begin)):
                if entered[k] != before:
                    self.make_room(np.zeros(0, np.int64), 1)
                    again, n = self.run(data, begin[k : k + 1], size[k : k + 1], np.array([self.add(before)], np.int64))
                    left[k], tokens[k] = self.states[int(again[0])], n[0]
                before = left[k]
                whole += int(tokens[k])
        return whole

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        if not len(starts):
            return np.zeros(0, np.int64)
        size = ends - starts
        hashes = tc.span_hash(tc.prefix_hash(data), starts, ends) ^ tc.mix(size.astype(np.uint64))
        _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
        order = np.argsort(-size[first], kind="stable")
        begin, length = starts[first][order], size[first][order]
        total = np.zeros(len(first), np.int64)
        n_long = int(np.searchsorted(-length, -4 * LONG, "left"))
        for k in range(n_long):
            total[k] = self.long(data, int(begin[k]), int(begin[k] + length[k]))
        block = max(1, self.max_states // 4)
        for lo in range(n_long, len(first), block):
            some = slice(lo, lo + block)
            total[some] = self.run(data, begin[some], length[some], np.zeros(len(begin[some]), np.int64))[1]
        out = np.empty(len(first), np.int64)
        out[order] = total
        return out[same]


@lru_cache(4)
def transducer(path: str) -> BpeTransducer:
    """One transducer a worker process and vocabulary file."""
    return BpeTransducer(Vocabulary(path))


def count_slice(s: tc.Slice, machine: BpeTransducer) -> np.ndarray:
    """Tokens of each row of a slice."""
    data, offs = s.data, s.offs
    extra = np.zeros(len(s), np.int64)
    whole = data.tobytes() if any(x[:1] in b"<" or len(x) for x in machine.v.special) else b""
    cuts = []
    for special in machine.v.special:
        at = whole.find(special)
        while at >= 0:
            row = int(tc.rows_of(np.array([at]), offs)[0])
            if at + len(special) <= offs[row + 1]:
                cuts.append((at, at + len(special)))
                extra[row] += 1
                at = whole.find(special, at + len(special))
            else:
                at = whole.find(special, at + 1)
    pieces = offs
    if cuts:
        keep = np.ones(len(data), bool)
        for a, b in cuts:
            keep[a:b] = False
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        edges = np.unique(np.concatenate([before[offs], before[[a for a, _ in cuts]]]))
        data, offs, pieces = data[keep], before[offs], edges
    starts = pre_tokens(data, pieces)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    n = machine.counts(data, starts, ends)
    sums = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=sums[1:])
    first = np.searchsorted(starts, offs, "left")
    return sums[first[1:]] - sums[first[:-1]] + extra


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """UTF-8 bytes and tokens of every whole text, and whether they exceed ``limit``.

    Returns the columns ``keep`` with n_bytes, n_tokens (bigint) and over_limit.
    A null text counts as empty (0 bytes, 0 tokens); repeated rows give
    repeated results; other columns of ``docs`` are not read; an empty table
    gives an empty one.  ``vocabulary`` is the path of a byte-level BPE file
    on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in batches:
            col = batch.column("__text")
            n_bytes, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in tc.slices(col):
                n_bytes.append(np.diff(s.offs))
                n_tokens.append(count_slice(s, machine))
            tokens = np.concatenate(n_tokens)
            held = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*held, pa.array(np.concatenate(n_bytes)), pa.array(tokens), pa.array(tokens > limit)],
                names=[*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"],
            )

    chosen = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep] + ["n_bytes bigint", "n_tokens bigint", "over_limit boolean"])
    return small_batches(chosen).mapInArrow(tidy(run), schema)
