"""Centroid clustering by ball-tree filtering.

Vectors stay where they are read. Each task builds metric trees over runs of TREE_ROWS of its vectors: a ball
holds its count, its integer sum, its centre (sum / count) and the radius around it. A round sends the centroids
(k rows) to all tasks. Down a tree, a ball keeps the centroids that may be nearest to one of its vectors: by the triangle
inequality, all but those farther from its centre than the nearest is by more than twice the radius. A ball that keeps one goes to it
as a whole, by count and sum; others are descended, and the leaves that remain are decided by exact integer distances.
What comes back is a sum for each centroid and component, added up before and after one small shuffle.

Balls are decided with a margin for rounding in their float distances, and never when two centroids tie, so the result is
that of exact assignment. Equal vectors make a ball of radius 0, however many they are. Distances at the leaves are exact in
doubles while all terms fit 2**53, and in Python's integers beyond.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part, nor do rows without
an id; ids that repeat count each (ties in the hash go by vector); with fewer vectors than k there are as many centroids; no vectors
give no rows; ties go to the smaller centroid; an empty centroid stays. Components beyond 64 bits, distances and inertias become
the nearest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

SIZE, K, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
TREE_ROWS, LEAF = 8192, 32
HIGHEST = (1 << 63) - 1
PARTS = {"ids": np.int64, "vectors": np.int64, "begin": np.int32, "end": np.int32, "up": np.int32, "depth": np.int32, "leaf": np.bool_, "centre": np.float64, "radius": np.float64, "high": np.int64, "low": np.int64}


@dataclass
class Tree:
    """Vectors in leaf order, and balls in order of depth: rows [begin, end), parent, centre, radius, sum = high * 2**32 + low."""

    ids: np.ndarray
    vectors: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    up: np.ndarray
    depth: np.ndarray
    leaf: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    high: np.ndarray
    low: np.ndarray

    def to_bytes(self) -> dict[str, bytes]:
        return {c: np.ascontiguousarray(getattr(self, c), kind).tobytes() for c, kind in PARTS.items()}

    @classmethod
    def of(cls, parts: dict[str, bytes], size: int) -> Tree:
        wide = {"vectors", "centre", "high", "low"}
        return cls(**{c: np.frombuffer(parts[c], kind).reshape(-1, size) if c in wide else np.frombuffer(parts[c], kind) for c, kind in PARTS.items()})


def build(ids: np.ndarray, vectors: np.ndarray) -> Tree:
    """Halve along the line between two far vectors, until a ball holds LEAF vectors at most or equal ones only."""
    order, balls, front, depth = np.arange(len(ids)), [], [(0, len(ids), -1)], 0
    while front:
        deeper = []
        for begin, end, up in front:
            own = vectors[order[begin:end]]
            high, low = (own >> 32).sum(axis=0), (own & 0xFFFFFFFF).sum(axis=0)
            high, low = high + (low >> 32), low & 0xFFFFFFFF
            near = own.astype(np.float64)
            centre = near.mean(axis=0)
            away = np.sqrt(((near - centre) ** 2).sum(axis=1))
            equal = bool((own == own[0]).all())
            last = equal or end - begin <= LEAF
            balls.append((begin, end, up, depth, last, centre, 0.0 if equal else away.max(), high, low))
            if not last:
                one = near[away.argmax()]
                two = near[((near - one) ** 2).sum(axis=1).argmax()]
                middle = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(near @ (two - one), middle)]
                deeper += [(begin, begin + middle, len(balls) - 1), (begin + middle, end, len(balls) - 1)]
        front, depth = deeper, depth + 1
    begin, end, up, deep, last, centre, radius, high, low = (np.array(x) for x in zip(*balls))
    return Tree(ids[order], vectors[order], begin, end, up, deep, last, centre, radius, high, low)


def _exact_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs: exact."""
    most = max(abs(int(f(x))) for x in (vectors, centroids) for f in (np.min, np.max)) if vectors.size else 0
    kind = np.float64 if 4 * most * most * centroids.shape[1] < 1 << 53 else object
    v, c = vectors.astype(kind), centroids.astype(kind)
    d = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
    return d.astype(np.int64) if kind is np.float64 else d


def descend(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(balls, their centroids, leaves): the largest balls that go to one centroid as a whole, and the leaves left to exact distances."""
    c = centroids.astype(np.float64)
    away = np.sqrt(np.stack([((tree.centre - x) ** 2).sum(axis=1) for x in c], axis=1))
    scale = max(np.abs(c).max(initial=0), np.abs(tree.centre).max(initial=0)) + tree.radius
    margin = 2 * tree.radius + 1e-9 * scale * np.sqrt(c.shape[1])
    kept, open_ = np.ones(away.shape, bool), np.ones(len(away), bool)
    whole = np.zeros(len(away), bool)
    for depth in range(int(tree.depth.max()) + 1):
        at = np.flatnonzero(tree.depth == depth)
        if depth:
            at = at[open_[tree.up[at]] & ~whole[tree.up[at]]]
            open_[np.flatnonzero(tree.depth == depth)] = False
            open_[at] = True
            kept[at] = kept[tree.up[at]]
        seen = np.where(kept[at], away[at], np.inf)
        kept[at] &= seen <= seen.min(axis=1, keepdims=True) + margin[at, None]
        whole[at] = kept[at].sum(axis=1) == 1
    balls = np.flatnonzero(whole & open_)
    return balls, kept[balls].argmax(axis=1), np.flatnonzero(open_ & ~whole & tree.leaf)


def _rows(tree: Tree, leaves: np.ndarray) -> np.ndarray:
    return np.concatenate([np.arange(tree.begin[x], tree.end[x]) for x in leaves]) if len(leaves) else np.zeros(0, np.int64)


def sums(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of each centroid, in Python's integers."""
    k, size = centroids.shape
    balls, to, leaves = descend(tree, centroids)
    counts, high, low = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros((k, size), np.int64)
    np.add.at(counts, to, tree.end[balls] - tree.begin[balls])
    np.add.at(high, to, tree.high[balls])
    np.add.at(low, to, tree.low[balls])
    rows = _rows(tree, leaves)
    if len(rows):
        near = _exact_distances(tree.vectors[rows], centroids).argmin(axis=1)
        np.add.at(counts, near, 1)
        np.add.at(high, near, tree.vectors[rows] >> 32)
        np.add.at(low, near, tree.vectors[rows] & 0xFFFFFFFF)
    return counts.astype(object), high.astype(object) * (1 << 32) + low.astype(object)


def nearest(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(centroid, squared distance) of every vector of a tree."""
    balls, to, leaves = descend(tree, centroids)
    label = np.zeros(len(tree.ids), np.int64)
    for ball, c in zip(balls, to):
        label[tree.begin[ball] : tree.end[ball]] = c
    rows = _rows(tree, leaves)
    if len(rows):
        label[rows] = _exact_distances(tree.vectors[rows], centroids).argmin(axis=1)
    distance = np.zeros(len(tree.ids), object)
    for c in range(len(centroids)):
        own = np.flatnonzero(label == c)
        if len(own):
            distance[own] = _exact_distances(tree.vectors[own], centroids[c : c + 1])[:, 0]
    return label, [min(int(d), HIGHEST) for d in distance]


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x), of the vectors of `size` finite components."""
    good = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & good).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def trees(vectors: DataFrame) -> DataFrame:
    """One row a tree, its parts as bytes; stored, as every round reads them."""
    schema = pa.schema([(c, pa.binary()) for c in PARTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0

        def done() -> pa.RecordBatch:
            tree = build(np.concatenate(ids), np.concatenate(held)).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([tree[c]], pa.binary()) for c in PARTS], schema=schema)

        for batch in slices(batches, TREE_ROWS):
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy())
                held.append(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
                n += batch.num_rows
            if n >= TREE_ROWS:
                yield done()
                ids, held, n = [], [], 0
        if n:
            yield done()

    return stored(vectors.select("vec_id", "v").mapInArrow(run, ", ".join(f"{c} binary" for c in PARTS)), "ball-trees")


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of smallest hash of their ids."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r.v for r in vectors.withColumn("h", digest).orderBy("h", "v").limit(k).collect()], np.int64)


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(k, object), np.zeros((k, size), object)
        for batch in slices(batches, 1):
            c, t = sums(Tree.of({p: batch.column(p)[0].as_py() for p in PARTS}, size), centroids)
            counts, total = counts + c, total + t
        each = np.concatenate([counts[:, None], total], axis=1)
        at = np.indices(each.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(map(str, each.ravel()), pa.string())], ["centroid", "part", "total"])

    parts = forest.mapInArrow(run, "centroid int, part int, total string")
    found = parts.groupBy("centroid", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k * (size + 1) rows
    each = np.zeros((k, size + 1), object)
    for r in found:
        each[r.centroid, r.part] = int(r.total)
    return np.array([[int(s) // int(e[0]) for s in e[1:]] if e[0] else c for e, c in zip(each, centroids.tolist())], np.int64)


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            tree = Tree.of({p: batch.column(p)[0].as_py() for p in PARTS}, centroids.shape[1])
            label, distance = nearest(tree, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids), pa.array(label, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of all `vectors` (vec_id long, v array<long> of one length)."""
    spark = vectors.sparkSession
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], shape)
    forest = trees(vectors)
    for _ in range(rounds):
        centroids = moved(forest, centroids)
    each = stored(assigned(forest, centroids), "ball-clusters")
    held = each.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    total = sum(int(r.d) for r in held)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(r.cluster, min(int(r.d), HIGHEST), min(total, HIGHEST), digest[r.cluster]) for r in held], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return each.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
