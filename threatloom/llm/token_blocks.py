"""Token ids on disk: independently reset, checksummed blocks of range-coded ids.

A block holds whole documents. Its ids are dealt to interleaved lanes (consecutive runs of the
block) that are coded in step; every step predicts all lanes from the same model, codes one id per
lane, then learns from all of them. The model mixes three orders with weights learned per
confidence context:

- order 2 and order 1: the id last seen after the two / one ids before, with a confidence;
- order 0: adaptive id frequencies.

P(id) = w2 [id = guess2] + w1 [id = guess1] + w0 freq(id) / total, in 24-bit integers; a carryless
64-bit range coder per lane turns it into 32-bit words.

Defined results: null text counts as empty; each document ends with `end_id`; repeated doc_ids stay
separate documents, in the order of their ids; documents with a null doc_id come first and keep it;
an empty table gives no blocks.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAGIC, HEAD = b"TLB1", struct.Struct("<4sIIIIIII")
PRECISION = 24
SCALE, LEAST0, TOTAL0 = 1 << PRECISION, 1 << 20, 1 << 20
BLOCK_IDS, MAX_LANES, LANE_IDS, SHARD_ROWS = 1 << 19, 4096, 64, 1 << 16
CACHE_WORDS = 600_000
U32 = np.uint64(32)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW32 = np.uint64(0xFFFFFFFF)
ONE32 = np.uint64(1 << 32)


class _Model:
    """Predictions for one block; encoder and decoder drive it alike."""

    def __init__(self, alphabet: int, n: int, lanes: int):
        bits = max(10, min(18, int(n).bit_length()))
        self.mask = np.uint32((1 << bits) - 1)
        self.t2, self.t1 = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.seen = np.tile(np.array([1, 1, 6], np.int64), (32, 1))
        self.counts, self.recent, self.cum, self.total0 = np.zeros(alphabet, np.int64), [], None, 0
        self.p1, self.p2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.step, self.alphabet = 0, alphabet
        self._frequencies()

    def _frequencies(self) -> None:
        if self.recent:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.alphabet)
            self.recent = []
        self.places = None
        have = int(self.counts.sum())
        f = np.ones(self.alphabet, np.int64) if not have else 1 + self.counts * (TOTAL0 - self.alphabet) // have
        self.cum = np.concatenate(([0], np.cumsum(f)))
        self.total0 = np.int64(self.cum[-1])

    def order0(self, at: np.ndarray) -> np.ndarray:
        """The ids whose frequency ranges hold the places `at`."""
        if len(self.p1) < 512:
            return np.searchsorted(self.cum, at, side="right") - 1
        if self.places is None:
            self.places = np.zeros(self.total0, np.int32)
            self.places[self.cum[1:-1]] = 1  # every frequency is 1 at least
            np.cumsum(self.places, out=self.places)
        return self.places.take(at)

    def predict(self):
        """guess2, guess1, w2, w1 for every lane."""
        h = self.p1 * np.uint32(0x9E3779B1)
        self.h1 = (h >> np.uint32(7) & self.mask).astype(np.intp)
        self.h2 = (h + self.p2 * np.uint32(0x85EBCA77) >> np.uint32(11) & self.mask).astype(np.intp)
        self.e2, self.e1 = self.t2.take(self.h2), self.t1.take(self.h1)
        g2, g1 = self.e2 >> 2, self.e1 >> 2
        self.context = ((self.e2 & 3) << 3 | (self.e1 & 3) << 1 | (g2 == g1)).astype(np.intp)
        w2, w1 = 1 + self.seen[:, :2].T * (SCALE - LEAST0 - 2) // self.seen.sum(axis=1)
        return g2, g1, w2.take(self.context), w1.take(self.context)

    def learn(self, ids: np.ndarray, event: np.ndarray) -> None:
        small = ids.astype(np.int32)
        for table, at, entry in ((self.t2, self.h2, self.e2), (self.t1, self.h1, self.e1)):
            trust = entry & 3
            hit = entry >> 2 == small
            table[at] = np.where(hit, entry + (trust < 3), np.where(trust > 0, entry - 1, small << 2))
        self.seen += np.bincount(self.context * 3 + event, minlength=96).reshape(32, 3)
        if self.seen.max() > 1 << 16:
            self.seen = (self.seen + 1) >> 1
        self.recent.append(ids)
        self.p2, self.p1 = self.p1, ids.astype(np.uint32)
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 16 == 0:
            self._frequencies()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(MAX_LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, alphabet: int, head: bytes = b"") -> bytes:
    """A self-contained block; `head` is kept as it is and returned by decode_block."""
    n = len(ids)
    lanes, steps = _shape(n) if n else (1, 0)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(alphabet, n, lanes)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, FULL)
    words, at = np.zeros((steps + 2, lanes), np.uint32), np.zeros(lanes, np.int64)
    for t in range(steps):
        x = grid[t]
        g2, g1, w2, w1 = model.predict()
        event = np.where(x == g2, 0, np.where(x == g1, 1, 2))
        w0 = SCALE - w2 - w1
        a, b = model.cum.take(x) * w0 // model.total0, model.cum.take(x + 1) * w0 // model.total0
        start = np.where(event == 0, 0, np.where(event == 1, w2, w2 + w1 + a)).astype(np.uint64)
        size = np.where(event == 0, w2, np.where(event == 1, w1, b - a)).astype(np.uint64)
        unit = wide >> np.uint64(PRECISION)
        low += unit * start
        wide = unit * size
        i = np.flatnonzero(wide < ONE32)
        if len(i):
            l, r = low[i], wide[i]
            r = np.where(((l ^ (l + r - np.uint64(1))) >> U32) != 0, ONE32 - (l & LOW32), r)
            words[at[i], i] = l >> U32
            at[i] += 1
            low[i], wide[i] = l << U32, r << U32
        model.learn(x, event)
    every = np.arange(lanes)
    for part in (low >> U32, low & LOW32):
        words[at, every] = part
        at += 1
    data = words.T[np.arange(steps + 2)[None, :] < at[:, None]].astype("<u4").tobytes()
    body = at.astype("<u4").tobytes() + data
    raw = zlib.crc32(np.ascontiguousarray(ids).astype("<u4").tobytes())
    return HEAD.pack(MAGIC, n, lanes, steps, alphabet, len(head), raw, zlib.crc32(head + body)) + head + body


def decode_block(block: bytes) -> tuple[np.ndarray, bytes]:
    """(ids, head) of a block; a block that fails a checksum raises ValueError."""
    magic, n, lanes, steps, alphabet, size, raw, crc = HEAD.unpack_from(block)
    rest = memoryview(block)[HEAD.size :]
    if magic != MAGIC or zlib.crc32(rest) != crc:
        raise ValueError("damaged block")
    head, body = bytes(rest[:size]), rest[size:]
    count = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.frombuffer(body, "<u4", offset=4 * lanes).astype(np.uint64)
    at = np.concatenate(([0], np.cumsum(count)[:-1]))
    model = _Model(alphabet, n, lanes)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, FULL)
    code = words[at] << U32 | words[at + 1]
    at += 2
    grid = np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        g2, g1, w2, w1 = model.predict()
        w0, both = SCALE - w2 - w1, w2 + w1
        unit = wide >> np.uint64(PRECISION)
        d = ((code - low) // unit).astype(np.int64)
        event = (d >= w2).astype(np.int64) + (d >= both)
        x = np.where(event == 0, g2, g1).astype(np.int64)
        start, width = np.where(event == 0, 0, w2), np.where(event == 0, w2, w1)
        i = np.flatnonzero(event == 2)
        if len(i):
            v = w0[i]
            found = model.order0(((d[i] - both[i] + 1) * model.total0 - 1) // v)
            x[i] = found
            a = model.cum[found] * v // model.total0
            start[i], width[i] = both[i] + a, model.cum[found + 1] * v // model.total0 - a
        low += unit * start.astype(np.uint64)
        wide = unit * width.astype(np.uint64)
        i = np.flatnonzero(wide < ONE32)
        if len(i):
            l, r = low[i], wide[i]
            r = np.where(((l ^ (l + r - np.uint64(1))) >> U32) != 0, ONE32 - (l & LOW32), r)
            code[i] = code[i] << U32 | words[np.minimum(at[i], len(words) - 1)]
            at[i] += 1
            low[i], wide[i] = l << U32, r << U32
        model.learn(x, event)
        grid[t] = x
    ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != raw:
        raise ValueError("damaged block")
    return ids, head


_TAIL, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_TAIL[list(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~')] = True  # no apostrophe (contractions), nothing that ends a special token
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
SHORT, SLOTS = 15, 1 << 22  # bytes of a word in the table; places in the table


def _keys(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words of SHORT bytes at most, and their size, as two integers: equal exactly if the words are."""
    u = np.frombuffer(data + bytes(24 - len(data) % 8), "<u8")
    q, r = starts >> 3, ((starts & 7) << 3).astype(np.uint64)
    back, one = np.uint64(63) - r, np.uint64(1)
    w0, w1, w2 = u[q], u[q + 1], u[np.minimum(q + 2, len(u) - 1)]
    first = (w0 >> r | w1 << back << one) & _MASK[np.minimum(sizes, 8)]
    return first, (w1 >> r | w2 << back << one) & _MASK[np.maximum(sizes - 8, 0)] | sizes.astype(np.uint64) << np.uint64(56)


def _tails(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the signs (8 at most) begin that end a word behind an ASCII letter or digit or a Latin-1 letter."""
    out = [ends[:0]]
    for k in range(1, 9):
        more = (ends - k > starts) & _TAIL[b[ends - k]]
        starts, ends = starts[more], ends[more]
        last = b[ends - k - 1]
        letter = _LETTER[last] | (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (b[ends - k - 2] == 0xC3) & (ends - k - 1 > starts)
        out.append(ends[letter] - k)
    return np.concatenate(out)


def _slot(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * np.uint64(0x9E3779B97F4A7C15) ^ second * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ h >> U32) * np.uint64(0x94D049BB133111EB) >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)


class _Words:
    """Words and their ids by the tokenizers library: a bounded open-addressing table. The library's
    normaliser and splitter never look across white space, nor across a letter and the
    signs behind it, so the ids of a text are those of these parts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.wide = np.dtype("<u2" if self.alphabet <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.first, self.second = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.at, self.n = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used, self.words = np.zeros(1 << 20, self.wide), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of words into the pool: (places, counts). Latin-1 letters give one piece each,
        whatever stands around them, so such words are joined by blanks and cut at the ids that end a word."""
        text = [w.decode() for w in words]
        plain = [i for i, w in enumerate(text) if w.isalpha() and (w.isascii() or max(w) < "\u0100")]
        rest = sorted(set(range(len(text))) - set(plain))
        at, n, flat, used = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), [], self.used
        groups = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]
        for part, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([text[i] for i in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.wide)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                rest += part
                continue
            n[part] = np.diff(cuts, prepend=0)
            at[part] = used + cuts - n[part]
            flat.append(ids)
            used += len(ids)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([text[i] for i in rest], add_special_tokens=False)):
            at[i], n[i] = used, len(e.ids)
            flat.append(np.array(e.ids, self.wide))
            used += len(e.ids)
        while used > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        if flat:
            self.pool[self.used : used] = np.concatenate(flat)
        self.used = used
        return at, n

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The table's places of words, -1 for words that it lacks."""
        out = _slot(first, second)
        left, at = np.arange(len(out)), out.copy()
        while len(left):
            there = self.second[at]
            hit = (there == second[left]) & (self.first[at] == first[left])
            out[left[hit]] = at[hit]
            none = there == 0
            out[left[none]] = -1
            on = ~(hit | none)
            left, at = left[on], (at[on] + 1) & (SLOTS - 1)
        return out

    def add(self, first: np.ndarray, second: np.ndarray, words: list[bytes]) -> None:
        """Add distinct words that the table lacks."""
        pool_at, n = self.encode(words)
        left, at = np.arange(len(words)), _slot(first, second)
        while len(left):
            free = self.second[at] == 0
            where, which = np.unique(at[free], return_index=True)
            put = left[free][which]
            self.first[where], self.second[where], self.at[where], self.n[where] = first[put], second[put], pool_at[put], n[put]
            on = ~((self.second[at] == second[left]) & (self.first[at] == first[left]))
            left, at = left[on], (at[on] + 1) & (SLOTS - 1)
        self.words += len(words)


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def encode_column(texts: pa.Array, path: str, end_id: int) -> list[bytes]:
    """The packed ids of each text (null: empty), closed by `end_id`."""
    known = _words(path)
    if not len(texts):
        return []
    column = texts.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2].slice(int(edges[0]), int(edges[-1] - edges[0])).to_pybytes() if edges[-1] > edges[0] else b""
    edges = edges - edges[0]
    b = np.frombuffer(data, np.uint8)
    white = (b == 32) | (b == 10)
    begin, stop = np.zeros(len(b) + 1, bool), np.zeros(len(b) + 1, bool)
    begin[1:], stop[:-1] = white, white
    begin[edges], stop[edges] = True, True
    begin[:-1] &= ~white
    begin[-1] = False
    stop[1:] &= ~white
    stop[0] = False
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    point = _tails(b, starts, ends)
    begin[point], stop[point] = True, True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    sizes = ends - starts
    short = sizes <= SHORT
    if len(starts) > SLOTS // 4:  # more words than the table may meet at once
        if len(texts) > 1:
            half = len(texts) // 2
            return encode_column(texts[:half], path, end_id) + encode_column(texts[half:], path, end_id)
        cut = int(starts[len(starts) // 2])
        before, behind = encode_column(pa.array([data[:cut].decode(), data[cut:].decode()], pa.large_string()), path, end_id)
        return [before[: -known.wide.itemsize] + behind]
    if known.words > SLOTS // 2 - len(starts) or len(known.long) > CACHE_WORDS:
        known.clear()
    first, second = _keys(data, starts, np.minimum(sizes, SHORT))
    places = known.find(first, second)
    places[~short] = 0
    lacking = np.flatnonzero(places < 0)
    if len(lacking):
        new: dict[bytes, int] = {}
        for i, s, e in zip(lacking.tolist(), starts[lacking].tolist(), ends[lacking].tolist()):
            new.setdefault(data[s:e], i)
        one = np.fromiter(new.values(), np.int64, len(new))
        known.add(first[one], second[one], list(new))
        places[lacking] = known.find(first[lacking], second[lacking])
    at, n = known.at[places].astype(np.int64), known.n[places].astype(np.int64)
    far = np.flatnonzero(~short)
    if len(far):
        own = [data[s:e] for s, e in zip(starts[far].tolist(), ends[far].tolist())]
        lack = list({w for w in own if w not in known.long})
        known.long.update(zip(lack, zip(*(x.tolist() for x in known.encode(lack)))))
        at[far], n[far] = np.array([known.long[w] for w in own], np.int64).T
    upto = np.concatenate(([0], np.cumsum(n)))
    ids = known.pool[np.repeat(at - upto[:-1], n) + np.arange(upto[-1])]
    cuts = upto[np.searchsorted(starts, edges)].tolist()
    end = np.array([end_id], known.wide).tobytes()
    return [ids[i:j].tobytes() + end for i, j in zip(cuts[:-1], cuts[1:])]


def encode_texts(texts: list[str | None], path: str, end_id: int) -> list[bytes]:
    return encode_column(pa.array(texts, pa.string()), path, end_id)


def write_blocks(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", shards: int | None = None) -> None:
    """Tokenise `text` and write blocks in ascending `key` order as a table (shard, block, start, n_ids, payload).

    Shards are ranges of `key`; ids (not texts) are shuffled, once. `start`: ids before the block in
    its shard. Null keys come first.
    """
    spark = df.sparkSession
    small = df.select(F.col(key).cast("long").alias("k"))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-small.count() // SHARD_ROWS))
    cuts = small.agg(F.percentile_approx("k", [i / shards for i in range(1, shards)] or [0.5], 10_000)).first()[0] if shards > 1 else []
    cuts = sorted(set(cuts or []))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(cuts, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                keys = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                ids = encode_column(batch.column(1), tokenizer, end_id)
                shard = pa.array(np.searchsorted(edges, keys, side="left").astype(np.int32))
                yield pa.RecordBatch.from_arrays([shard, batch.column(0), pa.array(ids, pa.binary())], ["shard", "k", "ids"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, wide = _words(tokenizer).alphabet, _words(tokenizer).wide
        now, number, start, keys, parts, size = None, 0, 0, [], [], 0

        def flush():
            head = np.array([k or 0 for k in keys], "<i8").tobytes() + np.array([len(p) for p in parts], "<u4").tobytes() + bytes(k is None for k in keys)
            payload = encode_block(np.concatenate(parts), alphabet, struct.pack("<I", len(keys)) + head)
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "block": pa.array([number], pa.int32()), "start": pa.array([start], pa.int64()), "n_ids": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for shard, k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = np.frombuffer(ids.as_py(), wide)
                if keys and (shard != now or size + len(x) > BLOCK_IDS):
                    yield flush()
                    number, start = (number + 1, start + size) if shard == now else (0, 0)
                    keys, parts, size = [], [], 0
                now = shard
                keys.append(k)
                parts.append(x)
                size += len(x)
        if keys:
            yield flush()

    ids = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(tokenise, "shard int, k long, ids binary")
    dealt = ids.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "k", "ids")
    dealt.mapInArrow(block, "shard int, block int, start long, n_ids long, payload binary").write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Decode the blocks at `path`: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    blocks = spark.read.schema("shard int, block int, start long, n_ids long, payload binary").parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one small row a shard
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, head = decode_block(payload.as_py())
                (n,) = struct.unpack_from("<I", head)
                keys = np.frombuffer(head, "<i8", n, 4)
                sizes = np.frombuffer(head, "<u4", n, 4 + 8 * n).astype(np.int64)
                lacks = np.frombuffer(head, bool, n, 4 + 12 * n)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(keys, pa.int64(), mask=lacks), "start": pa.array(start + ends - sizes, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()),
                    "ids": pa.array([raw[b - s : b].tobytes() for b, s in zip(ends.tolist(), sizes.tolist())], pa.binary()),
                })

    placed = blocks.join(before, "shard").select((F.col("start") + F.col("offset")).alias("start"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
