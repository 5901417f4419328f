"""Near-duplicate documents by order MinHash.

Words are lower-cased and split at white space; k-mers are five words. For the sketches they are
labelled with their occurrence number, so each occurs once. A sketch takes the MINIMA smallest
labelled k-mers under one hash and keeps them in text order; SKETCHES of them make a signature.
Documents that share a sketch are candidates, and an alignment of their k-mer sequences, without
labels, decides: longest common subsequence c, similarity c / (n + m - c) >= SIMILARITY. A chain
that is long enough can't leave the diagonal band, so matches outside it are not looked at.

At similarity s a pair misses one sketch with 1 - s**MINIMA at most, all of them with
(1 - 0.512)**24 = 3e-8 at 0.8. Members of a bucket are compared with its first, its last
and its hub document; then every two members that these links left in different components. Classes
are the connected components of the links, the same as those of all pairs that share a sketch.

Defined results: exact copies (128-bit hash of the text) form one class without alignment; null
texts and null doc_ids are classes of their own (class_id = doc_id); empty texts are copies of each
other; rows that share a doc_id are one document (in one class with the copies of each of its texts,
aligned by the smallest of them). Texts of fewer than five words have one k-mer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, stored

WORDS, SIMILARITY, SKETCHES, MINIMA = 5, 0.8, 24, 3
#: Members of a large bucket meet in blocks of about so many, a pair of blocks at a time.
BLOCK = 256
#: Buckets of more members, and k-mers of more documents among theirs, are large and frequent.
FEW, RARE = 8, 16
#: About so many pairs of one document are aligned in a task.
PAIRS = 1024
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.random.default_rng(20).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def kmers(text: str | None) -> np.ndarray:
    """K-mers of a text in text order."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.fromiter((digest(x.encode()) for x in words), np.uint64, len(words))
    k = min(WORDS, len(w))
    x = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        x = x * _A + w[i : len(w) - k + 1 + i]
    return _mix(x)


def labelled(x: np.ndarray) -> np.ndarray:
    """The k-mers mixed with their occurrence number (from 0, which leaves them as they are), so that all differ."""
    order = np.argsort(x, kind="stable")
    same = x[order][1:] == x[order][:-1]
    if same.any():
        group = np.concatenate(([0], np.where(same, 0, np.arange(1, len(x)))))
        label = np.empty(len(x), np.uint64)
        label[order] = np.arange(len(x)) - np.maximum.accumulate(group)
        x = np.where(label > 0, _mix(x + label * _A), x)
    return x


def signature(x: np.ndarray) -> np.ndarray:
    """One 64-bit sketch per hash of labelled k-mers."""
    m = min(MINIMA, len(x))
    if len(x) <= 1 << 16:
        h = _ODD[:, None] * x[None, :]
        at = np.argpartition(h, m - 1, axis=1)[:, :m] if m < len(x) else np.tile(np.arange(m), (SKETCHES, 1))
    else:
        at = np.stack([np.argpartition(a * x, m - 1)[:m] for a in _ODD])
    at.sort(axis=1)
    out = np.arange(SKETCHES, dtype=np.uint64) * _C
    for i in range(m):
        out = _mix(out * _A + x[at[:, i]])
    return out


def similarity(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned share of the k-mers of two documents, 0.0 as soon as it can't reach `least`."""
    n, m = len(x), len(y)
    if not n or not m:
        return float(n == m)
    needed = least / (1 + least) * (n + m)  # of the chain
    if min(n, m) < needed - 1e-9:
        return 0.0
    lx, ly = labelled(x), labelled(y)
    _, a, b = np.intersect1d(lx, ly, assume_unique=True, return_indices=True)
    if len(a) < needed - 1e-9:  # common k-mers, as often as both hold them
        return 0.0
    if (lx == x).all() and (ly == y).all():
        inside = np.abs(a - b) <= n + m - 2 * needed + 1e-9
        a, b = a[inside], b[inside]
        if len(a) < needed - 1e-9:
            return 0.0
        b = b[np.argsort(a)]
        chain = len(b) if (b[1:] > b[:-1]).all() else _increasing(b.tolist())
    else:
        chain = common_subsequence(x, y, int(n + m - 2 * needed + 1e-9))
    return chain / (n + m - chain) if chain >= needed - 1e-9 else 0.0


def _increasing(values: list[int]) -> int:
    tails: list[int] = []
    for v in values:
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
    return len(tails)


def common_subsequence(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of two sequences that may repeat elements; what takes matches
    more than `band` places off the diagonal only may be missed.

    Few matches: the longest increasing chain of the matches in the band. Many (long runs of equal k-mers):
    bit-parallel rows, a bit for every element of x.
    """
    n, m = len(x), len(y)
    order = np.argsort(x, kind="stable")
    low, high = np.searchsorted(x[order], y, "left"), np.searchsorted(x[order], y, "right")
    if int((high - low).sum()) <= 4 * (n + m):
        times = high - low
        j = np.repeat(np.arange(m), times)
        at = np.arange(len(j)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        i = order[at]
        inside = np.abs(i - j) <= band
        i, j = i[inside], j[inside]
        return _increasing(i[np.lexsort((-i, j))].tolist())
    places: dict[int, int] = {}
    for k in np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1])).tolist():
        value = x[order[k]]
        bits = np.zeros(n, np.uint8)
        bits[order[k : np.searchsorted(x[order], value, "right")]] = 1
        places[int(value)] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    whole = (1 << n) - 1
    rows = whole
    for value in y.tolist():
        if hit := places.get(value):
            both = rows & hit
            rows = ((rows + both) | (rows - both)) & whole
    return n - rows.bit_count()


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, copy (hash of the text), size (k-mers), sketches. Null keys and texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, size = [], []
            for t in batch.column(2).to_pylist():
                x = kmers(t)
                size.append(len(x))
                found.append(signature(labelled(x)).view(np.int64) if len(x) else np.zeros(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc", "copy", "size", "sketches"])

    rows = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("doc"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("copy"), F.col(text))
    return bounded_batches(rows).mapInArrow(run, "doc long, copy binary, size long, sketches array<long>")


def shared_buckets(sketches: DataFrame) -> DataFrame:
    """(bucket, doc, size, n) of the buckets with n > 1 members."""
    rows = sketches.select("doc", "size", F.explode("sketches").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return stored(rows.join(sizes, "bucket"), "neardup-buckets")


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b: every member of a bucket with the bucket's first, last and hub document.

    The hub is the member that meets most documents in all its buckets (ties: the smallest). Of a
    text and its edited copies that is the text, whatever the ids: copies may be too far from each
    other, and each edit puts its copy into buckets that nothing else is in.
    """
    meets = rows.groupBy("doc").agg(F.sum("n").alias("meets"))
    ranked = rows.join(meets, "doc").select("bucket", "doc", F.struct("meets", (-F.col("doc")).alias("back")).alias("rank"))
    ends = ranked.groupBy("bucket").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), (-F.max("rank")["back"]).alias("hub"))
    met = rows.join(ends, "bucket")
    pair = lambda x: F.struct(F.least(x, "doc").alias("a"), F.greatest(x, "doc").alias("b"))
    return met.select(F.explode(F.array(pair("first"), pair("last"), pair("hub"))).alias("p")).select("p.*").filter("a < b").distinct()


def unlinked(rows: DataFrame, found: DataFrame, done: DataFrame, df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """The other pairs (a, b), a < b, of a bucket that may be similar: members of different components (`found`:
    node, root), not compared yet (`done`), without those that bounds rule out.

    Similar documents of n and m k-mers share least / (1 + least) * (n + m) of their labelled k-mers. In buckets of up
    to FEW members only the sizes decide. In larger ones k-mers are rare, in RARE documents at most, or frequent: what
    two documents share is the rare ones that both hold, met by an equi-join, and not more than the frequent ones of
    either. Pairs that may reach it with frequent ones alone meet in pairs of blocks of their bucket.
    """
    rooted = rows.join(found, rows.doc == found.node, "left").select("bucket", "doc", "size", F.coalesce("root", "doc").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
    rooted = stored(rooted.join(mixed.filter("low < high").select("bucket", "members"), "bucket"), "neardup-mixed")
    large = rooted.filter(F.col("members") > FEW)
    docs = large.select("doc", "size", "root").distinct()
    each = stored(_exploded(df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t")).filter("t is not null").join(docs.hint("merge"), "doc", "left_semi").groupBy("doc").agg(F.min("t").alias("t"))), "neardup-kmers")
    held = stored(each.join(each.groupBy("kmer").agg(F.count("*").alias("held")).filter("held > 1").hint("merge"), "kmer"), "neardup-held")
    often = stored(docs.join(held.filter(F.col("held") > RARE).groupBy("doc").agg(F.count("*").alias("often")), "doc", "left").select("doc", "size", "root", F.coalesce("often", F.lit(0)).alias("often")), "neardup-often")

    needed = F.lit(least / (1 + least)) * (F.col("size1") + F.col("size2")) - 1e-9
    named = lambda d, x: d.select(*[F.col(c).alias(c + x) if c in ("doc", "size", "root", "often") else F.col(c) for c in d.columns])
    rare = held.filter(F.col("held") <= RARE).select("kmer", "doc")
    both = named(rare, "1").join(named(rare, "2").hint("merge"), "kmer").filter("doc1 < doc2").groupBy("doc1", "doc2").agg(F.count("*").alias("both"))
    both = both.join(named(often, "1").hint("merge"), "doc1").join(named(often, "2").hint("merge"), "doc2").filter((F.col("root1") != F.col("root2")) & (F.least("often1", "often2") + F.col("both") >= needed))

    few = rooted.filter(F.col("members") <= FEW).withColumn("often", F.col("size"))
    alone = large.select("bucket", "doc", "members").join(often.filter(F.col("often") >= least * F.col("size") - 1e-9).hint("merge"), "doc")
    dealt = few.select("bucket", "doc", "size", "root", "often", "members").unionByName(alone.select("bucket", "doc", "size", "root", "often", "members"))
    dealt = dealt.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("blocks"))).drop("members")
    side = lambda x, own, other, a, b: named(dealt.withColumn(other, F.explode(F.sequence(a, b))).withColumnRenamed("block", own).drop("blocks"), x)
    one, two = side("1", "i", "j", F.col("block"), F.col("blocks") - 1), side("2", "j", "i", F.lit(0).cast("long"), F.col("block"))
    near = F.least("often1", "often2") >= needed
    met = one.join(two.hint("merge"), ["bucket", "i", "j"]).filter((F.col("root1") != F.col("root2")) & ((F.col("i") < F.col("j")) | (F.col("doc1") < F.col("doc2"))) & near)
    pairs = met.select("doc1", "doc2").unionByName(both.select("doc1", "doc2")).select(F.least("doc1", "doc2").alias("a"), F.greatest("doc1", "doc2").alias("b")).distinct()
    return pairs.join(done.hint("merge"), ["a", "b"], "left_anti")


def _exploded(docs: DataFrame) -> DataFrame:
    """(doc, kmer): the labelled k-mers of every (doc, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 32):
            found = [labelled(kmers(t)).view(np.int64) for t in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found))], ["doc", "kmer"])

    return bounded_batches(docs.select("doc", "t")).mapInArrow(run, "doc long, kmer long")


def linked(pairs: DataFrame, df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """The pairs whose texts align. Texts of documents without candidates are not joined; what has
    candidates grows with the corpus and is never broadcast. The pairs of a hub are dealt to tasks by PAIRS or so."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t")).filter("t is not null")
    docs = stored(docs.join(ends.hint("merge"), "doc", "left_semi").groupBy("doc").agg(F.min("t").alias("t")), "neardup-texts")
    a, b = (docs.select(F.col("doc").alias(x), F.col("t").alias(f"t{x}")) for x in "ab")
    deals = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("deals"))
    hubs = deals.filter("deals > 1")
    dealt = pairs.join(hubs.hint("merge"), "a", "left").withColumn("deal", F.pmod(F.xxhash64("b"), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals")
    a = a.join(hubs.hint("merge"), "a", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            recent: dict[str, np.ndarray] = {}
            keep = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if s not in recent:
                    recent = {s: kmers(s)}
                keep.append(similarity(recent[s], kmers(t), least) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return bounded_batches(dealt.join(b, "b").join(a, ["a", "deal"]).select("a", "b", "ta", "tb")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component. Alternating large and small stars, stored each round."""
    edges = stored(edges.distinct(), "neardup-edges")
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("b"), F.col("m").alias("a")), F.struct(F.col("u").alias("b"), F.col("m").alias("a")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").filter("a <> b").distinct(), "neardup-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """A row per row of `df`: the key and class_id, the smallest key of its class."""
    marked = stored(signatures(df, key, text), "neardup-signatures")
    copies = marked.groupBy("copy").agg(F.min("doc").alias("rep"))
    sketches = marked.join(copies, (marked.doc == copies.rep) & (marked.copy == copies.copy), "left_semi")
    rows = shared_buckets(sketches)
    pairs = stored(candidates(rows), "neardup-pairs")
    links = linked(pairs, df, key, text, least)
    mapped = stored(marked.join(copies, "copy").select("doc", "rep").distinct(), "neardup-copies")
    chosen = mapped.groupBy("doc").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    # a doc_id whose rows hold different texts ties their copies together
    twins = mapped.join(chosen.filter("rep < other").select("doc", F.col("rep").alias("a")), "doc").filter("a <> rep").select("a", F.col("rep").alias("b"))
    found = components(links.union(twins))
    rest = stored(unlinked(rows, found, pairs, df, key, text, least), "neardup-pairs")
    found = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).union(linked(rest, df, key, text, least)))
    keys = df.select(F.col(key).cast("long").alias(key)).join(chosen, F.col(key) == chosen.doc, "left")
    return keys.join(found, keys.rep == found.node, "left").select(key, F.coalesce("root", "rep", key).alias("class_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of `df` that are the first of their class, with its columns."""
    gone = classes(df, key, text).filter(F.col(key) != F.col("class_id")).select(F.col(key).alias("_gone")).distinct()
    return df.join(gone.hint("merge"), df[key] == gone["_gone"], "left_anti")  # grows with the corpus: never broadcast
