"""An n-gram trie of Elias-Fano levels in one flat buffer, that can be mapped from memory or a file.

A key is a run of word ids, a context and a last word. Level 0 holds the distinct first ids. Each further level
holds, for every distinct prefix of keys in turn, the ids that follow it; each run of ids is raised by the last value before
it, so the whole level is one monotone sequence. Pointers (where a prefix's run begins) are monotone as well, and
both are Elias-Fano coded: low bits packed, high bits in unary. A key is found from its context down: the pointer gives a
node's run and the value before it, and a successor search for that value plus the id gives the child, or that there is none.

The last level holds quantised log10 probabilities (one byte, 0 for none) and quantised backoff weights (two bytes).
"""

from __future__ import annotations

import mmap
import struct
from functools import cache

import numpy as np
import zstandard

MAGIC = b"EFNG0001"
#: log10 values from -RANGE to 0 in equal steps, for codes 1 to most.
RANGE, PROB_MOST, BACK_MOST = 12.0, 255, 65535
ONE = np.uint64(1)


def quantised(value: np.ndarray, most: int) -> np.ndarray:
    """Codes 1..most of positive values up to 1."""
    step = np.log10(np.maximum(value, 10.0**-RANGE)) / RANGE * (most - 1)
    return (np.rint(step) + most).astype(np.int64)


@cache
def _values(most: int) -> np.ndarray:
    return np.concatenate(([0.0], 10.0 ** ((np.arange(1, most + 1) - most) / (most - 1) * RANGE)))


def value_of(code: np.ndarray, most: int) -> np.ndarray:
    """The value of a code; code 0 is 0."""
    return _values(most)[code]


@cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Each column packed by itself, after its length in bytes."""
    packed = [pack(c) for c in columns]
    return b"".join(struct.pack("<I", len(p)) + p for p in packed)


def unpack_columns(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        out.append(unpack(data[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers, a plane of bytes after the other from the lowest on, compressed."""
    v = np.ascontiguousarray(values, np.uint64)
    width = (int(v.max(initial=0)).bit_length() + 7) // 8 or 1
    planes = b"".join((v >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(width))
    return bytes([width]) + _compressor().compress(planes)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_decompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = planes[0].astype(np.int64)
    for k in range(1, data[0]):
        if planes[k].any():
            out |= planes[k].astype(np.int64) << (8 * k)
    return out


def grouped(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an index of each distinct code, ascending; each code's place among them)."""
    bits = len(code).bit_length()
    if int(code.max(initial=0)).bit_length() + bits <= 63:  # one sort of codes and indexes together
        both = np.sort((code << bits) | np.arange(len(code)))
        order, ordered = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(code)
        ordered = code[order]
    new = np.ones(len(code), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(code), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


class EliasFano:
    """A monotone sequence of non-negative integers."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.cumsum(ones)
        self.zeros = np.cumsum(64 - ones)
        self.places: list[np.ndarray | None] = [None, None]
        self.top = (int(self.zeros[-1]) if len(high) else 0) - 1  # zeros there are

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v, n = np.ascontiguousarray(values, np.uint64), len(values)
        width = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros(n * width // 64 + 2, np.uint64)
        at = np.arange(n, dtype=np.int64) * width
        word, off = at >> 6, (at & 63).astype(np.uint64)
        part = v & ((ONE << np.uint64(width)) - ONE)
        np.bitwise_or.at(low, word, part << off)
        np.bitwise_or.at(low, word + 1, (part >> ONE) >> (np.uint64(63) - off))
        upper = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(upper[-1]) + 2 + 63) // 64 if n else 1, np.uint64)
        np.bitwise_or.at(high, upper >> 6, ONE << (upper & 63).astype(np.uint64))
        return cls(n, width, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.width
        word, off = at >> 6, (at & 63).astype(np.uint64)
        both = (self.low[word] >> off) | ((self.low[word + 1] << ONE) << (np.uint64(63) - off))
        return (both & ((ONE << np.uint64(self.width)) - ONE)).astype(np.int64)

    def _select(self, i: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the i-th bit that is set (or not, if `flip`). Few are searched for, many are looked up among all."""
        if i.size * 8 > self.n:
            if self.places[flip] is None:
                bits = np.unpackbits(self.high.view(np.uint8), bitorder="little")
                self.places[flip] = np.flatnonzero(bits == 0 if flip else bits)
            return self.places[flip][i]
        words, total = self.high, self.zeros if flip else self.ones
        word = np.searchsorted(total, i, side="right")
        rest = i - np.where(word > 0, total[word - 1], 0)
        bits = ~words[word] if flip else words[word].copy()
        place = word << 6
        for half in (32, 16, 8, 4, 2, 1):
            under = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            beyond = rest >= under
            rest = np.where(beyond, rest - under, rest)
            bits = np.where(beyond, bits >> np.uint64(half), bits)
            place = place + half * beyond
        return place

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        upper = self._select(i, False) - i
        return (upper << self.width) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first value that is x at least (n if there is none), and whether it is x."""
        h = x >> self.width
        inside = h <= self.top
        upper = np.minimum(h, max(0, self.top))
        begin = np.where(upper > 0, self._select(np.maximum(upper - 1, 0), True) - (upper - 1), 0)
        end = np.minimum(self._select(upper, True) - upper, self.n)
        begin, wanted, last = np.minimum(begin, end), x & ((1 << self.width) - 1), end.copy()
        while (open_ := np.flatnonzero(begin < end)).size:
            middle = (begin[open_] + end[open_]) >> 1
            less = self._low(middle) < wanted[open_]
            begin[open_] = np.where(less, middle + 1, begin[open_])
            end[open_] = np.where(less, end[open_], middle)
        equal = inside & (begin < last)
        equal[equal] = self._low(begin[equal]) == wanted[equal]
        return np.where(inside, begin, self.n), equal


class Trie:
    """Keys of one length with their codes. `find` gives a key's index in sorted order, or -1."""

    def __init__(self, pointers: list[EliasFano], levels: list[EliasFano], probs: np.ndarray, backs: np.ndarray):
        self.pointers, self.levels, self.probs, self.backs = pointers, levels, probs, backs

    @classmethod
    def of(cls, keys: np.ndarray, probs: np.ndarray, backs: np.ndarray) -> Trie:
        """From sorted distinct keys (rows of ids)."""
        n, k = keys.shape
        fresh = np.ones(n, bool)
        fresh[1:] = keys[1:, 0] != keys[:-1, 0]
        levels, pointers = [EliasFano.of(keys[fresh, 0])], []
        for j in range(1, k):
            node = np.cumsum(fresh) - 1  # of the prefix before
            here = fresh.copy()
            here[1:] |= keys[1:, j] != keys[:-1, j]
            own, parent = keys[here, j] + 1, node[here]
            begin = np.searchsorted(parent, np.arange(int(fresh.sum()) + 1))
            last = own[begin[1:] - 1] if n else own
            base = np.cumsum(last) - last
            pointers.append(EliasFano.of(begin))
            levels.append(EliasFano.of(base[parent] + own if n else own))
            fresh = here
        return cls(pointers, levels, probs.astype(np.uint8), backs.astype(np.uint16))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Keys that follow one another with the same context search for it once."""
        if not self.levels[0].n or not len(keys):
            return np.full(len(keys), -1)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:, 0] != keys[:-1, 0]
        at, found = self.levels[0].successor(keys[new, 0])
        for j, (pointer, level) in enumerate(zip(self.pointers, self.levels[1:]), 1):
            group = np.cumsum(new) - 1  # of the prefix before
            new[1:] |= keys[1:, j] != keys[:-1, j]
            ends = pointer[np.stack((np.where(found, at, 0), np.where(found, at + 1, 0)))]
            before = np.where(ends[0] > 0, level[np.maximum(ends[0] - 1, 0)], 0)
            group = group[new]
            at, equal = level.successor(before[group] + keys[new, j] + 1)
            found = found[group] & equal & (at < ends[1][group])
        index = np.cumsum(new) - 1
        return np.where(found, at, -1)[index]

    def codes(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, backoff) codes of keys, 0 for those that aren't held."""
        at = self.find(keys)
        there = at >= 0
        pick = lambda c: np.where(there, c[np.maximum(at, 0)], 0).astype(np.int64) if len(c) else np.zeros(len(keys), np.int64)
        return pick(self.probs), pick(self.backs)

    def to_bytes(self) -> bytes:
        """MAGIC, number of sequences, backoff and probability codes; n, width, words of low and high of every sequence; then all words, codes last."""
        sequences = [*self.levels, *self.pointers]
        head = MAGIC + struct.pack("<qqq", len(sequences), len(self.backs), len(self.probs))
        head += b"".join(struct.pack("<qqqq", s.n, s.width, len(s.low), len(s.high)) for s in sequences)
        return head + b"".join(x.tobytes() for s in sequences for x in (s.low, s.high)) + self.backs.tobytes() + self.probs.tobytes()

    @classmethod
    def open(cls, buffer) -> Trie:
        """Views over a buffer (bytes, or a memory map)."""
        if bytes(buffer[:8]) != MAGIC:
            raise ValueError("not an n-gram trie")
        count, backs, probs = struct.unpack_from("<qqq", buffer, 8)
        heads, at, sequences = [struct.unpack_from("<qqqq", buffer, 32 + 32 * i) for i in range(count)], 32 + 32 * count, []
        for size, width, low, high in heads:
            sequences.append(EliasFano(size, width, np.frombuffer(buffer, np.uint64, low, at), np.frombuffer(buffer, np.uint64, high, at + 8 * low)))
            at += 8 * (low + high)
        levels = (count + 1) // 2
        return cls(sequences[levels:], sequences[:levels], np.frombuffer(buffer, np.uint8, probs, at + 2 * backs), np.frombuffer(buffer, np.uint16, backs, at))


def mapped(data: bytes) -> mmap.mmap:
    """The bytes in a memory map of their own, that the system may page out."""
    held = mmap.mmap(-1, max(1, len(data)))
    held[: len(data)] = data
    return held
