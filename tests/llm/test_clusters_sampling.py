"""Ball-tree clustering and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threatloom.llm import balltree, importance

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute_clusters(rows, k=8, rounds=10, size=64):
    kept = [(i, [min(max(math.floor(1024 * x), -(1 << 63)), (1 << 63) - 1) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centroids)), key=lambda n: (far(v, centroids[n]), n))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v), []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    most = (1 << 63) - 1
    each = [(i, near(v), v) for i, v in kept]
    inertia = Counter()
    for _, n, v in each:
        inertia[n] += far(v, centroids[n])
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, n, min(far(v, centroids[n]), most), min(inertia[n], most), min(sum(inertia.values()), most), digest[n]) for i, n, v in each)


def spark_clusters(spark, rows, schema=SCHEMA, **how):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], schema)
    return sorted(tuple(r) for r in balltree.cluster(balltree.integer_vectors(df, size=how.pop("size", 64)), **how).collect())


def test_clusters_equal_brute_force(spark):
    random.seed(5)
    centres = [[random.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + random.gauss(0, 0.05 if i % 3 else 0.8) for x in random.choice(centres)]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [rows[1]] * 3  # one hot vector; an id that repeats
    rows += [(None, rows[2][1]), (5000, None), (5001, []), (5002, rows[3][1][:63]), (5003, [float("nan")] + rows[3][1][1:]), (5004, [float("inf")] + rows[3][1][1:]), (5005, [None] + rows[3][1][1:])]
    assert spark_clusters(spark, rows) == brute_clusters(rows)


def test_clusters_of_huge_components_ties_and_few_vectors(spark):
    rows = [(i, [float((i % 5) * 10**j) for j in range(4)]) for i in range(40)] + [(100 + i, [1e300 if i % 2 else -1e300, 9e15, -9e15, float(i)]) for i in range(6)]
    assert spark_clusters(spark, rows, size=4) == brute_clusters(rows, size=4)
    even = [(i, [float(i % 2), 0.0]) for i in range(12)] + [(50, [0.5, 0.0])]
    assert spark_clusters(spark, even, size=2, k=3) == brute_clusters(even, 3, size=2)
    assert spark_clusters(spark, rows[:3], size=4) == brute_clusters(rows[:3], size=4)
    assert spark_clusters(spark, [(1, None)], size=4) == []


def test_balls_are_assigned_whole_and_exactly():
    random.seed(9)
    rng = np.random.default_rng(9)
    centres = rng.integers(-1000, 1000, (8, 64))
    vectors = np.concatenate([c + rng.integers(-20, 20, (500, 64)) for c in centres])
    tree = balltree.build(np.arange(len(vectors)), vectors)
    assert (np.sort(tree.ids) == np.arange(len(vectors))).all() and (vectors[tree.ids] == tree.vectors).all()
    balls, to, leaves = balltree.descend(tree, centres)
    whole = (tree.end[balls] - tree.begin[balls]).sum()
    assert whole + (tree.end[leaves] - tree.begin[leaves]).sum() == len(vectors) and whole > 0.9 * len(vectors)
    label, _ = balltree.nearest(tree, centres)
    assert (label == ((tree.vectors[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)).all()
    again = balltree.Tree.of(tree.to_bytes(), 64)
    assert all((getattr(again, c) == getattr(tree, c)).all() for c in balltree.PARTS)
    counts, total = balltree.sums(tree, centres)
    assert counts.sum() == len(vectors) and (total.sum(axis=0) == vectors.sum(axis=0)).all()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_resample(documents, target, percent=5, least=20, buckets=10_000):
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own = [(i, *features(t)) for i, t in documents]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def spark_resample(spark, documents, target, **how):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in documents], "doc_id long, text string, row int, word string")
    marks = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in importance.resample(docs, marks, **how).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("percent", [5, 40])
def test_resampling_equals_brute_force(spark, percent):
    random.seed(3)
    words = ["the", "Of", "été", "ÀB", "x1", "straße", "日本", "a", "b"]
    documents = [(i, random.choice([" ", "-", "\n", "\x7f"]).join(random.choices(words, k=random.choice([1, 2, 3, 19, 20, 60])))) for i in range(120)]
    documents += [(500, None), (501, ""), (502, " .,\x00;\t"), (None, "a b " * 30), (503, "the Of a " * 30_000), (7, documents[7][1]), (7, documents[7][1])]
    target = ["The OF x1 a b", None, "", "é", "日本 the of"]
    assert spark_resample(spark, documents, target, percent=percent) == brute_resample(documents, target, percent)


def test_resampling_of_empty_tables(spark):
    documents = [(1, "a b c " * 9), (2, "x")]
    assert spark_resample(spark, documents, [], percent=100) == brute_resample(documents, [], 100)
    assert spark_resample(spark, [], ["a"]) == []
