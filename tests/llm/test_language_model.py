"""The n-gram trie and the scores of the language model against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatloom.llm import ngram_lm, ngram_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
END = "\n"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def sentence(text):
    return [END, *WORD.findall((text or "").translate(LOWER)), END]


def brute_scores(documents, order):
    counts = Counter()
    for i, text in documents:
        if not held(i):
            s = sentence(text)
            counts.update(tuple(s[t - k + 1 : t + 1]) for k in range(1, order + 1) for t in range(1, len(s)) if t >= k - 1)
    words = {g[0]: n for g, n in counts.items() if len(g) == 1}
    total, kinds = sum(words.values()), len(words)

    def p(s, t, k):
        if k == 1:
            return (words.get(s[t], 0) + 0.5) / (total + 0.5 * (kinds + 1)) if total else 1.0
        lower = p(s, t, k - 1)
        context = tuple(s[t - k + 1 : t]) if t >= k - 1 else None
        c = counts.get(context, 0) if context else 0
        if not c:
            return lower
        kinds_seen = c**ngram_lm.GROWTH
        return (counts.get((*context, s[t]), 0) + kinds_seen * lower) / (c + kinds_seen)

    out = {}
    for i, text in documents:
        s = sentence(text)
        base = math.fsum(math.log10(p(s, t, 1)) for t in range(1, len(s)))
        full = math.fsum(math.log10(p(s, t, order)) for t in range(1, len(s)))
        out.setdefault(i, []).append((held(i), len(s) - 1, sum(x in words for x in s[1:]), total, base, full))
    return out


def spark_scores(spark, documents, **how):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in documents], "doc_id long, text string, block string, n int").repartition(3)
    out = {}
    for r in ngram_lm.score(df, ngram_lm.held_out(), **how).collect():
        out.setdefault(r.doc_id, []).append(tuple(r)[1:])
    return out


def same(got, expected):
    assert got.keys() == expected.keys()
    for i, rows in expected.items():
        for a, b in zip(sorted(got[i]), sorted(rows), strict=True):
            assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)
            assert abs(a[5] - b[5]) <= 0.025 * b[1]  # half a step of log10 a token


def corpus(n=250):
    random.seed(4)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "É", "é", "x,y", "ß"]
    weights = [1 / (i + 1) for i in range(len(words))]
    documents = [(i, random.choice([" ", "\t", " \n", "\r\f"]).join(random.choices(words, weights, k=random.randint(1, 60)))) for i in range(n)]
    documents += [(1000 + i, documents[3][1]) for i in range(40)] + [documents[5]] * 2
    documents += [(2000, None), (2001, ""), (2002, " \t\n"), (None, "the the W1"), (None, None), (2003, "the w0 " * 30_000), (2004, "unseen word nowhere"), (1 << 60, "w1 w2 w3")]
    return documents


@pytest.mark.parametrize("order,block,shard", [(1, 1 << 20, 1 << 20), (2, 3000, 200), (3, 1 << 20, 1 << 20), (3, 2000, 100), (4, 5000, 300)])
def test_scores_equal_brute_force(spark, order, block, shard):
    documents = corpus()
    same(spark_scores(spark, documents, order=order, block=block, shard=shard), brute_scores(documents, order))


def test_scores_without_training_and_of_empty_tables(spark):
    alone = [(i, "a b") for i in range(60) if held(i)]
    assert {tuple(r[0][2:]) for r in spark_scores(spark, alone).values()} == {(0, 0, 0.0, 0.0)}
    assert spark_scores(spark, []) == {}


def test_smoothing_sums_to_one(spark):
    """Over all words and the end, unknown words together as one word; what the scores of other texts imply for the last word is held against it."""
    learned = [(i, t) for i, t in corpus(80) if not held(i)]
    vocabulary = sorted({w for _, t in learned for w in sentence(t)[1:]} - {END})
    ids = [i for i in range(10_000, 40_000) if held(i)]
    for context in ("the w0", "w1 w2", "nowhere w3"):
        texts = dict(zip(ids, [context, *(f"{context} {w}" for w in [*vocabulary, "never-seen"])]))
        scores = brute_scores([*learned, *texts.items()], 3)
        got = spark_scores(spark, [*learned, *texts.items()])
        same(got, scores)
        ends = {i: _end([*learned], t) for i, t in texts.items()}
        before = scores[ids[0]][0][5] - math.log10(ends[ids[0]])
        summed = lambda by: ends[ids[0]] + sum(10 ** (by[i][0][5] - before) / ends[i] for i in list(texts)[1:])
        assert abs(summed(scores) - 1) < 1e-9 and abs(summed(got) - 1) < 0.12  # quantised words of the context count in each


def _end(learned, text):
    """The exact probability of the end after a text."""
    s, counts = sentence(text), Counter()
    for _, t in learned:
        x = sentence(t)
        counts.update(tuple(x[e - k + 1 : e + 1]) for k in (1, 2, 3) for e in range(1, len(x)) if e >= k - 1)
    words = {g[0]: n for g, n in counts.items() if len(g) == 1}
    p = (words[END] + 0.5) / (sum(words.values()) + 0.5 * (len(words) + 1))
    for context in ((s[-2],), (s[-3], s[-2])):
        if c := counts.get(context, 0):
            p = (counts.get((*context, END), 0) + c**ngram_lm.GROWTH * p) / (c + c**ngram_lm.GROWTH)
    return p


def test_model_grows_with_the_corpus_and_beats_single_words(spark):
    random.seed(8)
    follow = {f"w{i}": [f"w{random.randrange(80)}" for _ in range(3)] for i in range(80)}

    def text(n):
        out = ["w0"]
        while len(out) < n:
            out.append(random.choice(follow[out[-1]]))
        return " ".join(out)

    documents = [(i, text(50)) for i in range(300)]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    model = ngram_lm.Model(df, ngram_lm.held_out())
    rows = [r for r in model.scores().collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > 0.6 * sum(r.base_score for r in rows)  # logs: less far below 0
    half = ngram_lm.Model(df.filter(F.col("doc_id") < 150), ngram_lm.held_out())
    keys = lambda m, k: m.levels[k].filter("block is null").agg(F.sum("n_keys")).first()[0]
    assert keys(model, 3) > keys(half, 3)


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 4):
        keys = np.unique(np.minimum(rng.zipf(1.3, (3000, k)), 5000), axis=0).astype(np.int64)
        probs, backs = rng.integers(1, 256, len(keys)), rng.integers(1, 65536, len(keys))
        trie = ngram_trie.Trie.open(ngram_trie.mapped(ngram_trie.Trie.of(keys, probs, backs).to_bytes()))
        asked = np.concatenate([keys, np.minimum(rng.zipf(1.3, (3000, k)), 6000).astype(np.int64)])
        place = {tuple(r): i for i, r in enumerate(keys.tolist())}
        expected = [place.get(tuple(r), -1) for r in asked.tolist()]
        assert trie.find(asked).tolist() == expected  # many at once, then few
        assert [int(trie.find(asked[i : i + 1])[0]) for i in range(0, len(asked), 97)] == expected[::97]
        assert (trie.codes(keys)[0] == probs).all() and (trie.codes(keys)[1] == backs).all()
    empty = ngram_trie.Trie.open(ngram_trie.Trie.of(np.zeros((0, 2), np.int64), np.zeros(0), np.zeros(0)).to_bytes())
    assert empty.find(np.ones((2, 2), np.int64)).tolist() == [-1, -1]
    with pytest.raises(ValueError):
        ngram_trie.Trie.open(b"something else")


def test_monotone_sequences_and_key_coding():
    rng = np.random.default_rng(2)
    for n, most in ((1, 0), (1, 10**12), (5, 3), (1000, 10**6), (1000, 100), (20_000, 10**9)):
        v = np.sort(rng.integers(0, most + 1, n))
        e = ngram_trie.EliasFano.of(v)
        assert (e[np.arange(n)] == v).all()
        x = np.concatenate([rng.integers(0, 2 * most + 2, 500), v, v + 1])
        at, equal = e.successor(x)
        assert (at == np.searchsorted(v, x)).all() and (equal == np.isin(x, v)).all()
        few = ngram_trie.EliasFano.of(v)
        assert all(few.successor(x[i : i + 1])[0][0] == at[i] and few[np.array([i % n])][0] == v[i % n] for i in range(0, len(x), 31))
    for k in (2, 3):
        keys = np.unique(np.minimum(rng.zipf(1.3, (2000, k)), 5000), axis=0).astype(np.int64)
        n, back = rng.integers(0, 9, len(keys)), mixed_back(keys)
        got = ngram_lm.decoded(ngram_lm.coded(keys, n, back), k)
        assert (got[0] == keys).all() and (got[1] == n).all() and (got[2] == back).all()
    assert (ngram_trie.value_of(ngram_trie.quantised(np.array([1.0, 1e-12]), 255), 255) == [1.0, 1e-12]).all()
    c = np.arange(1, 500)
    assert (ngram_lm.context_count(ngram_lm.backoff(c)) == c).all()


def mixed_back(keys):
    return (keys[:, :-1].sum(axis=1) * 7919) % 65535 + 1
