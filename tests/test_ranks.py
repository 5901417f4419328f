"""Distributed selection against sorting."""

import math
import random

import pytest

from threatloom.operators import ranks


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_value_at_equals_sorting(spark, share):
    r = random.Random(7)
    groups = {None: [r.gauss(0, 1) for _ in range(3000)], "a": [1.0] * 500 + [2.0], "b": [3.0], "c": [None], "d": [float(x % 7) for x in range(90)]}
    df = spark.createDataFrame([(g, i % 2 if g == "d" else 0, v) for g, vs in groups.items() for i, v in enumerate(vs)], "g string, h int, v double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a group over several ranges
    try:
        got = {(x.g, x.h): x.p95 for x in ranks.ranked_value(df, ["g", "h"], "v", share).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = {}
    for g, vs in groups.items():
        for h in (0, 1):
            own = sorted(v for i, v in enumerate(vs) if v is not None and (i % 2 if g == "d" else 0) == h)
            if own:
                expected[g, h] = own[max(1, math.floor(len(own) * share)) - 1]
    assert got == expected
    assert ranks.ranked_value(df.limit(0), ["g"], "v").count() == 0
