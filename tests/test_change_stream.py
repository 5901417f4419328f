"""The stateful change stream: new, changed and deleted paths, over several calls."""

import json

from pyspark.sql import functions as F

from threatloom.streaming import sync


def test_four_calls_with_a_deletion_and_a_return(spark, tmp_path):
    log, target, seen = tmp_path / "log", sync.VersionedTable(spark, str(tmp_path / "t"), "path"), []
    log.mkdir()

    def read(paths):
        seen.append(sorted(r.path for r in paths.collect()))
        return paths.withColumn("body", F.concat(F.lit("of "), "path", F.lit(" "), "hash"))

    def call(n, *rows):
        (log / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("path", "hash", "at"), r))) for r in rows))
        sync.sync_changes(spark, str(log), str(tmp_path / "t"), str(tmp_path / "c"), read)
        return sorted((r.path, r.hash, r.body) for r in target.read().collect())

    assert call(1, ("a", "1", 1), ("b", "1", 1), ("c", "0", 1), ("c", "2", 2)) == [("a", "1", "of a 1"), ("b", "1", "of b 1"), ("c", "2", "of c 2")]
    assert call(2, ("a", "2", 3), ("b", "1", 3), ("z", None, 3)) == [("a", "2", "of a 2"), ("b", "1", "of b 1"), ("c", "2", "of c 2")]
    assert call(3, ("b", None, 4), ("c", None, 4), ("c", "2", 4)) == [("a", "2", "of a 2"), ("c", "2", "of c 2")]
    assert call(4, ("b", "1", 5), ("a", None, 5), ("a", "2", 6)) == [("a", "2", "of a 2"), ("b", "1", "of b 1"), ("c", "2", "of c 2")]
    assert seen == [["a", "b", "c"], ["a"], [], ["b"]]  # only what is new or changed is read


def test_change_log_of_listings(spark):
    h = lambda *rows: spark.createDataFrame(rows, "path string, hash string")
    out = sync.change_log(h(("a", "1"), ("b", "2"), ("n", "1")), h(("a", "1"), ("b", "1"), ("g", "1")), 7)
    assert sorted(map(tuple, out.collect())) == [("b", "2", 7), ("g", None, 7), ("n", "1", 7)]
