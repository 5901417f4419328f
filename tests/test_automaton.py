"""Dictionary matching by automata against regular expressions and plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from threatloom.functions import text as X
from threatloom.operators import automaton, match

ALIASES = "attack_id string, type string, canonical string, alias string, exact boolean"


@pytest.mark.parametrize("shard", [10**6, 60])
def test_entities_equal_alternations(spark, shard):
    r = random.Random(shard)
    words = ["bear", "Bear", "BEAR29", "cozy bear", "cozy", "été", "ÉTÉ x", "a.b", "bear bear", "x_y"]
    aliases = sorted({(f"G{i % 12}", "group", f"name{i % 12}", r.choice(words) if i % 3 else f"w{i} {r.choice(words)}", i % 2 == 0) for i in range(60)})
    texts = [(i, r.choice([" ", "  ", "_", "-", "\n", ""]).join(r.choice([*words, "w3", "w15 bear", "W9 BEAR", "z", "é"]) for _ in range(r.randrange(40)))) for i in range(150)] + [(900, None), (901, ""), (902, "cozy bear " * 20_000)]
    chunks = spark.createDataFrame([(i, t, "c") for i, t in texts], "id int, text string, alias string").repartition(3)
    rows = match.entity_mentions(chunks, spark.createDataFrame(aliases, ALIASES), ["id", "alias"], shard=shard)
    expected = {}
    for i, t in texts:
        for e in {a[:3] for a in aliases} if t else ():
            first, n = None, 0
            for exact in (True, False):
                own = sorted({a[3] for a in aliases if a[:3] == e and a[4] == exact}, key=len, reverse=True)
                if own:
                    found = list(re.finditer(rf"(?<![^\W])(?:{'|'.join(map(re.escape, own))})(?![^\W])", t, 0 if exact else re.I))
                    n += len(found)
                    first = first or (found and (exact, found[0].start(), found[0].end())) or None
            if n:
                expected[i, e] = (n, "case-sensitive" if first[0] else "case-insensitive", first[1:])
    assert {(x.id, (x.attack_id, x.type, x.canonical)): (x.n, x.strategy) for x in rows.collect()} == {k: v[:2] for k, v in expected.items()} and expected
    # contexts are those of the column function
    at = spark.createDataFrame([(i, *e, a + 1, b - a) for (i, e), (_, _, (a, b)) in expected.items()], "id int, attack_id string, type string, canonical string, at int, size int")
    both = rows.join(at, ["id", "attack_id", "type", "canonical"]).join(chunks.select("id", "text"), "id")
    assert both.filter(F.col("context") != X.snippet(F.col("text"), F.col("at"), F.col("size"))).count() == 0


@pytest.mark.parametrize("shard", [10**6, 40])
def test_phrases_equal_plain_search(spark, shard):
    r = random.Random(1)
    docs = [(d % 70, "".join(r.choice("abé ") for _ in range(r.randrange(60)))) for d in range(80)] + [(100, None), (101, "")]
    phrases = [(i, "".join(r.choice("abé ") for _ in range(r.randrange(5)))) for i in range(60)] + [(7, "ab"), (70, "ab"), (71, None)]
    found = match.phrase_mentions(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(phrases, "i long, p string"), "d", "t", "i", "p", shard)
    first = {}
    for k, (d, t) in enumerate(docs):
        for i, p in phrases:
            if p and t and p in t:
                first[k, d, i] = min(first.get((k, d, i), 10**9), t.index(p) + 1)
    assert sorted(tuple(x) for x in found.collect()) == sorted((d, i, at) for (_, d, i), at in first.items())
    none = match.phrase_mentions(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame([(1, "")], "i long, p string"), "d", "t", "i", "p")
    assert none.count() == 0 and none.columns == ["d", "i", "at"]


def test_folding_keeps_offsets():
    assert automaton.folded("İSTANBUL É") == "İstanbul é" and len(automaton.folded("İ" * 9)) == 9
    assert automaton.disjoint([(0, 2), (0, 5), (3, 9), (5, 6), (6, 7)]) == [(0, 5), (5, 6), (6, 7)]
