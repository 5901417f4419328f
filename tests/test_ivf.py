"""The approximate index: every row indexed, recall, filters in the scan, hot lists."""

import random

from pyspark.sql import functions as F

from threatloom.operators import ivf, vector


def rows(n=1500, d=16):
    r = random.Random(2)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(20)]
    return [(i, [x + r.gauss(0, 0.3) for x in r.choice(centres)], i % 3) for i in range(n)]


def test_index_recall_filters_and_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "PART", 200)
    data = rows()
    data += [(5000 + i, data[0][1], 1) for i in range(900)]  # a hot list
    data += [(9000, None, 0), (9001, [float("nan")] * 16, 0), (None, data[1][1], 0)]
    v = spark.createDataFrame(data, "id long, v array<double>, kind int").repartition(5)
    index = ivf.build(v, str(tmp_path / "i"), "id", "v")
    assert index.rows().count() == 2400 and 1 <= index.probes < len(index.centroids)
    asked = v.filter("id % 20 = 0 and id < 1500")
    exact = vector.nearest_batch(ivf.whole(v, "id", "v"), asked, 10, "id", "v")
    again = ivf.load(spark, str(tmp_path / "i"))
    found = again.search_batch(asked, 10)
    assert ivf.recall(found, exact).first().recall >= 0.9
    every = again.search_batch(asked, 10, probes=len(index.centroids))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))  # all lists: exact, ties too
    some = again.search_batch(asked, 5, where=F.col("kind") == 1)
    assert some.join(v.filter("kind <> 1"), F.col("neighbour") == F.col("id")).count() == 0 and some.count() == 5 * asked.count()
    one = again.search(data[7][1], 3, where=F.col("kind") == 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "list_no" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "EqualTo(kind,1)" in plan and one.count() == 3


def test_index_of_few_and_no_rows(spark, tmp_path):
    schema = "id long, v array<double>, kind int"
    one = ivf.build(spark.createDataFrame([(1, [1.0, 0.0], 0)], schema), str(tmp_path / "a"), "id", "v")
    assert one.search_batch(one.rows().select("id", "v"), 3).count() == 0 and one.search([1.0, 0.0], 2).count() == 1
