"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Pre-tokenisation uses no regex. Every code point gets a class; each class is a function on the
seven states of a small automaton; the functions are closed under composition (a few dozen in
all), so composing two is one table lookup and the state before every code point comes from one
associative prefix scan. Slice starts follow from (state, class).

Defined results: null text encodes as the empty text; the empty text has no ids; runs of any
length are merged with a heap (no quadratic case); other columns pass through untouched.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices

LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE, BLANK, END = range(8)
#: States: START (a new slice must begin), in a run of letters / numbers / others, after one blank,
#: one / two code points of a contraction still to come.
START, IN_L, IN_N, IN_O, AFTER_BLANK, NEED1, NEED2 = range(7)

#: Code points with the White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Ranges of letters and numbers that Unicode 16 added to Unicode 15.1.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Contraction endings after an apostrophe.
ENDINGS1, ENDINGS2 = "stmd", ("re", "ve", "ll")

CACHE_SLICES, GROUP_CHARS, SCAN_WIDTH = 300_000, 1 << 20, 64


def _step(state: int, cls: int) -> int:
    if cls == END:
        return START
    if state == NEED2:
        return NEED1
    if state == NEED1:
        return START
    if cls in (QUOTE1, QUOTE2) and state not in (IN_O, AFTER_BLANK):
        return NEED1 if cls == QUOTE1 else NEED2
    return {LETTER: IN_L, NUMBER: IN_N, SPACE: START, BLANK: AFTER_BLANK}.get(cls, IN_O)


def _starts(state: int, cls: int) -> bool:
    """Whether a non-space code point of this class begins a slice."""
    if state in (NEED1, NEED2) and cls != END:
        return False
    own = {LETTER: IN_L, NUMBER: IN_N}.get(cls, IN_O)
    return cls == END or state not in (own, AFTER_BLANK)


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class -> function, composition table, (function, state) -> state, (state, class) -> starts)."""
    generators = [tuple(_step(s, c) for s in range(7)) for c in range(8)]
    functions = [tuple(range(7))]
    index = {functions[0]: 0}
    for f in functions:
        for g in generators:
            if (h := tuple(g[s] for s in f)) not in index:
                index[h] = len(functions)
                functions.append(h)
    compose = np.array([[index[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
    starts = np.array([[_starts(s, c) for c in range(8)] for s in range(7)])
    return np.array([index[g] for g in generators], np.uint8), compose, np.array(functions, np.uint8), starts


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            t[a : b + 1] = kind
    t[list(WHITE_SPACE)] = SPACE
    t[32] = BLANK
    return t


def prefix_functions(g: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of the functions `g`, by a blocked associative scan."""
    if len(g) <= SCAN_WIDTH:
        out = g.copy()
        for i in range(1, len(g)):
            out[i] = compose[out[i - 1], g[i]]
        return out
    rows = -(-len(g) // SCAN_WIDTH)
    padded = np.zeros(rows * SCAN_WIDTH, np.uint8)
    padded[: len(g)] = g
    columns = np.ascontiguousarray(padded.reshape(rows, SCAN_WIDTH).T)
    for j in range(1, SCAN_WIDTH):
        columns[j] = compose[columns[j - 1], columns[j]]
    before = np.zeros(rows, np.uint8)
    before[1:] = prefix_functions(columns[-1].copy(), compose)[:-1]
    return np.ascontiguousarray(compose[before[None, :], columns].T).reshape(-1)[: len(g)]


def slice_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the slices of concatenated texts; `ends` are the positions of the end marks between them."""
    to_function, compose, apply, starts = automaton()
    cls = class_table()[points]
    quotes = np.flatnonzero(points == 39)
    cls[ends] = END
    if len(quotes):
        a = points[np.minimum(quotes + 1, len(points) - 1)]
        b = points[np.minimum(quotes + 2, len(points) - 1)]
        one = np.isin(a, [ord(x) for x in ENDINGS1]) & (cls[np.minimum(quotes + 1, len(points) - 1)] != END)
        two = np.zeros(len(quotes), bool)
        for x, y in ENDINGS2:
            two |= (a == ord(x)) & (b == ord(y))
        quotes_end = cls[quotes] == END
        cls[quotes[one & ~quotes_end]] = QUOTE1
        cls[quotes[two & ~quotes_end]] = QUOTE2
    after = apply[prefix_functions(to_function[cls], compose), START]
    state = np.empty_like(after)
    state[0], state[1:] = START, after[:-1]
    begins = starts[state, cls]
    white = (cls == SPACE) | (cls == BLANK)
    i = np.flatnonzero(white)
    if len(i):  # a run's first, and its last if text follows
        following = cls[np.minimum(i + 1, len(cls) - 1)]
        first = np.ones(len(i), bool)
        first[i > 0] = ~white[i[i > 0] - 1]
        begins[i] = first | ((following < SPACE))
    return np.flatnonzero(begins)


class Merger(dict):
    """slice -> ids, filled on demand by merging the pair of lowest rank first; bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pairs = ranks, {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    self.pairs[a << 32 | b] = rank
        self.single = [ranks[bytes([b])] for b in range(256)]

    def __missing__(self, text: str) -> tuple[int, ...]:
        piece = text.encode()
        if (whole := self.ranks.get(piece)) is not None:
            ids = (whole,)
        else:
            ids = tuple(self._short(piece) if len(piece) <= 200 else self._long(piece))
        if len(piece) <= 200:
            self[text] = ids
        return ids

    def _short(self, piece: bytes) -> list[int]:
        pair, none = self.pairs.get, 1 << 40
        ids = [self.single[b] for b in piece]
        ranks = [pair(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i] = low
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pair(low << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = pair(ids[i - 1] << 32 | low, none)
        return ids

    def _long(self, piece: bytes) -> list[int]:
        """The same merges with a heap over a linked list."""
        pair, n = self.pairs.get, len(piece)
        ids: list[int] = [self.single[b] for b in piece]
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := right[i]) >= n or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = rank, False, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := pair(rank << 32 | ids[right[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[right[i]]))
            if left[i] >= 0 and (r := pair(ids[left[i]] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, left[i], ids[left[i]], rank))
        return [x for x, live in zip(ids, alive) if live]


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(load_ranks(path))


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids of all texts, ids per text, ids per slice, slices per text."""
    cache, ids, per_text, per_slice, slices = merger(path), [], [], [], []
    at = 0
    while at < len(texts):
        size, to = len(texts[at]), at + 1
        while to < len(texts) and size + len(texts[to]) < GROUP_CHARS:
            size += len(texts[to])
            to += 1
        group = texts[at:to]
        at = to
        if len(cache) > CACHE_SLICES:
            cache.clear()
        joined = "\0".join(group) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in group]) - 1
        starts = slice_starts(points, ends)
        bounds = starts.tolist()
        found = list(map(cache.__getitem__, map(joined.__getitem__, map(slice, bounds, [*bounds[1:], len(joined)]))))
        marks = np.searchsorted(starts, ends)
        for k in marks.tolist():
            found[k] = ()
        n = np.fromiter(map(len, found), np.int32, len(found))
        total = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        ids.append(np.fromiter(chain.from_iterable(found), np.int32, total[-1]))
        edge = np.concatenate(([0], marks + 1))
        per_text.append(np.diff(total[edge]))
        slices.append(np.diff(edge) - 1)
        keep = np.ones(len(n), bool)
        keep[marks] = False
        per_slice.append(n[keep])
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return cat(ids, np.int32), cat(per_text, np.int64), cat(per_slice, np.int32), cat(slices, np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str = "slice_ids", round_trip: str | None = None) -> DataFrame:
    """`df` with `ids` (array<int>) and `offsets` (array<int>: how many ids each pre-token slice has).

    No shuffle. `path` is a rank file; columns of `df` that clash with the new names are replaced.
    `round_trip` names a boolean column to add: whether the decoded ids are the text's bytes. It is
    worked out beside the encoding, so that texts and ids need not pass a second Python worker.
    """
    new = [ids, offsets, *([round_trip] if round_trip else [])]
    kept = [f for f in df.schema.fields if f.name not in new]
    numbers = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*kept, T.StructField(ids, numbers), T.StructField(offsets, numbers), *([T.StructField(round_trip, T.BooleanType())] if round_trip else [])])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            flat, per_text, per_slice, n_slices = encode_texts(texts, path)
            added = [_lists(flat, per_text, pa.int32()), _lists(per_slice, n_slices, pa.int32())]
            if round_trip:
                parts = np.split(flat, np.cumsum(per_text)[:-1])
                added.append(pa.array([decode_ids(x, path).tobytes() == t.encode() for x, t in zip(parts, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added], [*names, *new])

    return bounded_batches(df.select(*names)).mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = sorted((rank, token) for token, rank in load_ranks(path).items())
    size = np.zeros(tokens[-1][0] + 1, np.int64)
    size[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
    return np.frombuffer(b"".join(t for _, t in tokens), np.uint8), np.concatenate(([0], np.cumsum(size)[:-1])), size


def decode_ids(flat: np.ndarray, path: str) -> np.ndarray:
    """The bytes of a run of ids."""
    blob, start, size = _bytes_of(path)
    n = size[flat]
    shift = np.repeat(start[flat] - (np.cumsum(n) - n), n)
    return blob[shift + np.arange(len(shift))]


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`df` with column `into` (binary): the bytes that `ids` stand for. Null ids give null."""

    @F.pandas_udf(T.BinaryType())
    def run(column):
        return column.map(lambda x: None if x is None else decode_ids(np.asarray(x, np.int64), path).tobytes())

    return df.withColumn(into, run(F.col(ids)))
