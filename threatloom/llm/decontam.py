"""Benchmark decontamination with suffix arrays over shards of the training texts.

Words are maximal runs of [0-9A-Za-z] and of bytes from 0x80, lower-cased in A-Z. A shard is a run
of documents of one task; its array sorts, by prefix doubling, the suffixes that can hold a match
(runs of words that the benchmark also uses, long enough for the shortest window: all others can't
match). Every benchmark suffix is then searched by narrowing its interval of the array word by
word, which gives its longest verbatim match and all places of it.

The benchmark's words go to the executors in parts of at most PART_WORDS words; each part is one
more pass over the documents, written before the next, so what is sent at once never grows. No shuffle.

Defined results: null and empty texts have no words and no hits; items that share an id are one in
n_items, and those whose id is null count as one that `items` lists as null; items without words
never occur; repeated documents are judged alike; columns pass through (`contamination` replaces
those that clash with the names it adds, `clean` returns all as they were).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh, stored

WINDOW, PART_WORDS, SHARD_WORDS = 10, 2_000_000, 2_000_000
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if _WORD[b + 32 if 65 <= b <= 90 else b] else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Tests:
    """The suffixes of a part of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids = list(dict.fromkeys(item_id for item_id, _ in items))
        number = {item_id: k for k, item_id in enumerate(self.ids)}
        words, item, need, left = [], [], [], []
        for item_id, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if own:
                words += [*own, 0]
                item += [number[item_id]] * (len(own) + 1)
                need += [min(window, len(own))] * (len(own) + 1)
                left += [*range(len(own), 0, -1), 0]
        self.words, self.item, self.need, self.left = (np.array(x, np.int64) for x in (words, item, need, left))
        self.longest, self.shortest = int(self.left.max(initial=0)), int(self.need.min(initial=window))


def find(words: np.ndarray, doc: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(hit words, (document, place in tests.ids) pairs, longest matches) of a shard; `words`: benchmark word numbers, 0 for others, 0 between documents."""
    hit = np.zeros(len(words), bool)
    none = {k: np.zeros(0, np.int64) for k in ("suffix", "length", "position")}
    stop = np.flatnonzero(words == 0)
    if not len(words) or not len(tests.words):
        return hit, np.zeros((0, 2), np.int64), none
    to = np.searchsorted(stop, np.arange(len(words)))
    run = np.append(stop, len(words))[to] - np.arange(len(words))
    at = np.flatnonzero(run >= tests.shortest)
    if not len(at):
        return hit, np.zeros((0, 2), np.int64), none
    order = sort_suffixes(words, at, tests.longest)
    who = np.flatnonzero(tests.left > 0)
    who = who[tests.left[who] >= tests.need[who]]  # shorter suffixes hold no window
    lo, hi = np.zeros(len(who), np.int64), np.full(len(who), len(order))
    tail = np.concatenate((words, np.zeros(tests.longest + 1, np.int64)))
    pairs, marks, longest = [], [], [[], [], []]
    for d in range(tests.longest):
        want = tests.words[who + d]
        old_lo, old_hi = lo, hi
        lo = _bound(order, tail, d, want, lo, hi, False)
        hi = _bound(order, tail, d, want, lo, hi, True)
        alive = (lo < hi) & (want > 0)
        if not alive.all():
            ended = ~alive & (d >= tests.need[who])
            longest[0].append(who[ended])
            longest[1].append(np.full(int(ended.sum()), d))
            longest[2].append(order[old_lo[ended]] if ended.any() else np.zeros(0, np.int64))
            who, lo, hi = who[alive], lo[alive], hi[alive]
        full = np.flatnonzero(tests.need[who] == d + 1)
        if len(full):
            spans, inverse = np.unique(np.stack((lo[full], hi[full]), 1), axis=0, return_inverse=True)
            inverse = inverse.reshape(-1)
            for k, (a, b) in enumerate(spans.tolist()):
                places = order[a:b]
                marks.append((places, d + 1))
                docs, items = np.unique(doc[places]), np.unique(tests.item[who[full[inverse == k]]])
                pairs.append(np.stack((np.repeat(docs, len(items)), np.tile(items, len(docs))), 1))
        if not len(who):
            break
    if len(who):
        longest[0].append(who)
        longest[1].append(np.full(len(who), tests.longest))
        longest[2].append(order[lo])
    if marks:
        cover = np.zeros(len(words) + 1, np.int64)
        for places, n in marks:
            np.add.at(cover, places, 1)
            np.add.at(cover, places + n, -1)
        hit = np.cumsum(cover[:-1]) > 0
    cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in longest]
    return hit, np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64), dict(zip(("suffix", "length", "position"), cat))


def _bound(order, tail, d, want, lo, hi, right: bool):
    """Per search, the first place in [lo, hi) whose word at depth d is >= want (> want if right)."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        word = tail[order[mid] + d]
        less = word <= want[open_] if right else word < want[open_]
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
    return lo


def sort_suffixes(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of the positions `at`, by prefix doubling on ranks of 1, 2, 4, ... words.

    Ranks are kept for all positions that a compared suffix can reach (its run of known words).
    """
    reach = np.zeros(len(words) + 1, np.int64)
    ends = np.append(np.flatnonzero(words == 0), len(words))
    stop = ends[np.searchsorted(ends, at)]
    np.add.at(reach, at, 1)
    np.add.at(reach, stop, -1)
    used = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
    rank = np.zeros(len(words) + 1, np.int64)
    rank[used] = words[used]
    done = 1
    while done < depth and len(used):
        second = rank[np.minimum(used + done, len(words))]
        key = rank[used] * (np.int64(max(int(rank.max()), int(words.max())) + 1)) + second
        _, new = np.unique(key, return_inverse=True)
        rank[used] = new.reshape(-1) + 1
        done *= 2
        if rank.max() == len(used):
            break
    return at[np.argsort(rank[at], kind="stable")]


ADDED = {"n_words": T.LongType(), "n_hit": T.LongType(), "hit_words": T.BinaryType(), "items": T.ArrayType(T.LongType())}


def _annotate(df: DataFrame, tests: Tests, text: str, named: dict[str, str], first: bool) -> DataFrame:
    """`df` with the ADDED columns under the names `named`, or with more of them (unless `first`)."""
    shared = df.sparkSession.sparkContext.broadcast(tests)
    names = [named[n] for n in ADDED]
    kept = [f for f in df.schema.fields if f.name not in names]
    own = [f.name for f in kept]
    schema = T.StructType([*kept, *(T.StructField(named[n], k) for n, k in ADDED.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        get = tests.vocabulary.get
        for batch in batches:
            at, column = 0, batch.column(text)
            while at < batch.num_rows:
                numbers, sizes, begin = [], [], at
                while at < batch.num_rows and sum(sizes) < SHARD_WORDS:
                    found = [get(w, 0) for w in words_of(column[at].as_py())]
                    numbers.append(np.array([*found, 0], np.int64))
                    sizes.append(len(found))
                    at += 1
                words = np.concatenate(numbers)
                doc = np.repeat(np.arange(len(sizes)), np.array(sizes) + 1)
                hit, pairs, _ = find(words, doc, tests)
                edges = np.concatenate(([0], np.cumsum(np.array(sizes) + 1)))
                items: list[list[int]] = [[] for _ in sizes]
                for d, item in pairs.tolist():
                    items[d].append(tests.ids[item])
                bits = [np.packbits(hit[a : b - 1]).tobytes() if len(items[k]) else b"" for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist()))]
                part = batch.slice(begin, at - begin)
                if not first:
                    for k, (b, i) in enumerate(zip(part.column(named["hit_words"]).to_pylist(), part.column(named["items"]).to_pylist())):
                        bits[k] = _either(bits[k], b)
                        items[k] += i
                n_hit = [int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in bits]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in own), pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.int64()))], [*own, *names])

    return bounded_batches(df).mapInArrow(run, schema)


def _either(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes() if a and b else a or b


def _marked(df: DataFrame, benchmark: DataFrame, text: str, window: int, part_words: int) -> tuple[DataFrame, dict[str, str]]:
    """`df` with the ADDED columns under names that it doesn't have, and these names."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    named = {n: fresh(df, n) for n in ADDED}
    part, size, out, first = [], 0, df, True
    for item_id, item in rows.toLocalIterator():  # a partition at a time
        n = len(words_of(item))
        if part and size + n > part_words:
            out, first = stored(_annotate(out, Tests(part, window), text, named, first), "decontam-pass"), False
            part, size = [], 0
        part.append((item_id, item))
        size += n
    return _annotate(out, Tests(part, window), text, named, first), named


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """`df` with n_words, n_hit (words inside an occurrence of a benchmark window), n_items, items
    (their ids as sorted strings) and contaminated."""
    out, named = _marked(df, benchmark, text, window, part_words)
    ids = F.array_sort(F.transform(F.array_distinct(named["items"]), lambda x: x.cast("string")))
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("n_words", "n_hit", "n_items", "items", "contaminated")]
    return out.select(*own, F.col(named["n_words"]).alias("n_words"), F.col(named["n_hit"]).alias("n_hit"), ids.alias("items")).withColumns(
        {"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0}
    )


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents of `df` that hold no benchmark window, with its columns."""
    out, named = _marked(df, benchmark, text, window, PART_WORDS)
    return out.filter(F.col(named["n_hit"]) == 0).select(*[F.col(f"`{c}`") for c in df.columns])


def brute_force(text: str | None, items: list[tuple[int, str]], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """The contract of one document by comparing every window with every place (for tests)."""
    words, hit, found = words_of(text), set(), set()
    for item_id, item in items:
        own = words_of(item)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item_id)
    ids = ",".join(sorted(str(i) for i in found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def contamination_of(text: str | None, items: list[tuple[int, str]], window: int = WINDOW) -> bool:
    """Whether one text holds a window, by sets of windows (for tests)."""
    words = words_of(text)
    for _, item in items:
        own = words_of(item)
        n = min(window, len(own))
        if n and {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} & {tuple(words[j : j + n]) for j in range(len(words) - n + 1)}:
            return True
    return False
