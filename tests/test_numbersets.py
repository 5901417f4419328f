"""Compact sets of integers, and the two-hop operators that send them instead of pairs: against brute force."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from threatloom.operators import graph, numbersets, search

EXTREMES = [-(2**63), -(2**63) + 1, -300, -1, 0, 1, 127, 128, 2**20, 2**20 + 1, 2**31, 2**62, 2**63 - 1]


def shuffled(df, metric):
    """Sum of a metric over the exchanges of a frame that was collected."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply(metric).value() if plan.metrics().contains(metric) else 0
        return own + sum(walk(plan.children().apply(k)) for k in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_packing_gives_the_numbers_back():
    r = random.Random(1)
    sets = [sorted({r.randrange(-m, m) for _ in range(r.randrange(1, 60))}) for m in (3, 100, 10**4, 10**9, 2**62) for _ in range(20)] + [EXTREMES, [2**63 - 1], [-(2**63)]]
    first = np.cumsum([0, *map(len, sets[:-1])])
    found = numbersets.packed(np.array([x for s in sets for x in s], np.int64), first)
    values, counts = numbersets.unpacked(found)
    assert counts.tolist() == list(map(len, sets)) and values.tolist() == [x for s in sets for x in s]
    values, counts = numbersets.unpacked(pa.concat_arrays([pa.array([b""], pa.binary()), found])[3:5])
    assert counts.tolist() == [len(sets[2]), len(sets[3])] and values.tolist() == sets[2] + sets[3]
    assert [x.tolist() for x in numbersets.unpacked(pa.array([b"", b""], pa.binary()))] == [[], [0, 0]]
    for spread in (50, 2**61):  # codes, and too wide for them
        values, run = np.array([r.randrange(-spread, spread) for _ in range(300)]), np.sort(np.array(r.choices([0, 2, 3], k=300)))
        out, sizes = numbersets.distinct(np.append(values, values), np.append(run, run), 5)
        assert out.tolist() == [v for k in range(5) for v in sorted(set(values[run == k].tolist()))] and sizes.sum() == len(out)


@pytest.mark.parametrize("kind", ["long", "int", "string"])
@pytest.mark.parametrize("start", ["long", "string", "double"])
def test_two_hop_counts(spark, monkeypatch, kind, start):
    """Small pieces and batches, so that keys go over their ends; nulls, repeats, ends without a start and starts without an end."""
    monkeypatch.setattr(numbersets, "PIECE", 3)
    monkeypatch.setattr(numbersets, "ROWS", 5)
    r = random.Random(2)
    ends = [x for x in EXTREMES if kind == "long" or abs(x) < 2**31] + list(range(40))
    of = {"string": str, "double": float}
    to = lambda x, k: x if x is None else of.get(k, int)(x)
    a = [(to(r.choice([None, 1, 2, 3, 4]), start), r.choice([None, *range(8)])) for _ in range(60)] + [(to(9, start), 77)]
    b = [(r.choice([None, *range(10)]), to(r.choice([None, *ends]), kind)) for _ in range(300)]
    expected = defaultdict(set)
    for s, m in a:
        expected[s] |= {e for x, e in b if x == m and m is not None}
    expected = {s: (len(e), min((x for x in e if x is not None), default=None)) for s, e in expected.items() if e}
    out = graph.two_hop_counts(spark.createDataFrame(a, f"s {start}, m int"), spark.createDataFrame(b, f"m int, e {kind}"), "s", "m", "e")
    assert dict(out.dtypes) == {"s": {"long": "bigint"}.get(start, start), "n": "bigint", "least": {"long": "bigint"}.get(kind, kind)}
    rows = out.collect()
    assert len(rows) == len(expected) and {x.s: (x.n, x.least) for x in rows} == expected


def test_only_nulls_at_the_end_of_two_hops(spark):
    out = graph.two_hop_counts(spark.createDataFrame([(1, 1)], "s long, m long"), spark.createDataFrame([(1, None), (1, None)], "m long, e long"), "s", "m", "e")
    assert [tuple(x) for x in out.collect()] == [(1, 1, None)]
    assert graph.two_hop_counts(spark.createDataFrame([], "s long, m long"), spark.createDataFrame([], "m long, e long"), "s", "m", "e").count() == 0


def test_expand_by_numbers_equals_expand_by_names(spark, monkeypatch):
    """Actors that are integers go as sets: the same rows as for names one by one, for some ids and for all."""
    monkeypatch.setattr(numbersets, "PIECE", 2)
    r = random.Random(3)
    records = spark.createDataFrame([(c, "d") for c in range(13)], "cve_id long, description string")
    pattern = spark.createDataFrame([(r.choice([None, *range(12), 13]), f"T{r.randrange(9)}", r.choice([None, "C1", "C2"])) for _ in range(60)] + [(12, "T5", None)], "cve_id long, attack_id string, cwe_id string")
    tactics = spark.createDataFrame([(f"T{r.randrange(6)}", r.choice([None, "x", "y", "z"])) for _ in range(12)], "attack_id string, tactic string")
    rows = [(f"T{r.randrange(3, 9)}", r.choice(["group", "group", "software", "other", None]), r.choice([None, *range(10, 40)])) for _ in range(60)]
    rows = [x for x in rows if x[0] != "T5"] + [("T5", "group", None), ("T4", "other", 11)]
    actors = spark.createDataFrame(rows, "attack_id string, kind string, actor int")
    names = actors.withColumn("actor", F.col("actor").cast("string"))
    plain = lambda df: {x.cve_id: (x.description, x.techniques, *(g if g is None else [str(v) for v in g] for g in (x.groups, x.software))) for x in df.collect()}
    some = records.filter("cve_id % 2 = 0").select("cve_id")
    for ids in (some, records, None):
        found = search.expand(ids, records, pattern, tactics, actors)
        assert found.columns == ["cve_id", "description", "techniques", "groups", "software"] and dict(found.dtypes)["groups"] == "array<int>"
        assert plain(found) == plain(search.expand(records if ids is None else ids, records, pattern, tactics, names))
    assert any(g is None for _, _, g, _ in plain(found).values()) and any(g == [] for _, _, g, _ in plain(found).values())


@pytest.mark.parametrize("name, metric, most", [("q_expand_2hop", "shuffleRecordsWritten", 6 * 4000), ("q_expand_nested", "shuffleBytesWritten", 200 * 4000)])
def test_two_hop_queries_send_no_pairs(spark, tmp_path, name, metric, most):
    """Parts with a hundred suppliers each: what is shuffled grows with the edges and not with the pairs. Names may repeat or be null, and suppliers lack."""
    r = random.Random(4)
    tables = {
        "lineitem": ([(r.randrange(1000), r.randrange(40), r.randrange(500)) for _ in range(4000)] + [(1000, 40, 999), (1001, 41, 7)], "l_orderkey long, l_partkey long, l_suppkey long"),
        "orders": ([(o,) for o in range(1010)], "o_orderkey long"),
        "part": ([(p, f"Brand#{p % 5}", f"TYPE {p % 7}") for p in range(41)], "p_partkey long, p_brand string, p_type string"),
        "supplier": ([(k, None if k % 50 == 0 else f"Supplier#{k % 450:09d}") for k in range(500)], "s_suppkey long, s_name string"),
    }
    con = duckdb.connect()
    for of, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/{of}.parquet")
        con.execute(f"create view {of} as select * from '{tmp_path}/{of}.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    asked = con.execute(__spark_entry__.oracle_sql()[name])
    got, columns = sorted(tuple(x) for x in df.collect()), [c[0] for c in asked.description]
    assert got == sorted(asked.fetchall()) and df.columns == columns
    assert shuffled(df, metric) < most, shuffled(df, metric)
