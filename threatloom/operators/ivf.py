"""An approximate neighbour index: inverted lists of vectors by their nearest centroid, as a partitioned Parquet table.

Centroids are fitted on a bounded sample (SAMPLE rows at most, the smallest hashes of the key), about the square root of the rows in
number; every row is then indexed, in the folder of its list. A probe looks into the lists whose centroids are nearest to a query. How many
that must be is calibrated on queries from the sample, held against exact search in it, until a share TARGET of the true neighbours is
met; that number is part of the index. Filters on other columns and the lists reach the scan of the index.

Lists meet queries in parts of about PART rows, one matrix product each, which return k rows a query at most, so a list that
holds a third of all rows is many tasks. Rows without a key or a vector (null, or not finite) are not indexed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threatloom.operators.vector import unit

SAMPLE, PART, TARGET, ROUNDS, MOST_LISTS = 20_000, 8192, 0.97, 12, 4096


def whole(df: DataFrame, key: str, vector: str) -> DataFrame:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & good)


def fitted(rows: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of unit rows: unit centroids."""
    c = rows[np.linspace(0, len(rows) - 1, lists).astype(int)]
    for _ in range(rounds):
        near = (rows @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, rows)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def calibrated(rows: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """Lists to probe so that, inside the sample, `target` of the k nearest others of its first rows are met."""
    asked = rows[: min(len(rows), 256)]
    score = asked @ rows.T
    np.fill_diagonal(score[:, : len(asked)], -np.inf)
    k = min(k, len(rows) - 1)
    if k < 1:
        return 1
    true = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = np.argsort(-(asked @ centroids.T), axis=1)
    place = np.argsort(order, axis=1)  # of each list among a query's
    own = (rows @ centroids.T).argmax(axis=1)
    needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


@dataclass
class Index:
    """`path`/rows (partitioned by list_no) and `path`/lists (what was fitted)."""

    spark: SparkSession
    path: str
    key: str
    vector: str
    centroids: np.ndarray
    probes: int

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def nearest_lists(self, queries: np.ndarray, probes: int | None = None) -> np.ndarray:
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")[:, : probes or self.probes]

    def search(self, query: list[float], k: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """The k nearest rows of one query, with score: partitions and `where` are pruned in the scan."""
        from threatloom.operators.vector import nearest

        lists = self.nearest_lists(_units([query]), probes)[0].tolist()
        found = self.rows().filter(F.col("list_no").isin(lists))
        return nearest(found if where is None else found.filter(where), query, k, self.key, self.vector).drop("list_no")

    def search_batch(self, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None, digits: int = 6) -> DataFrame:
        """query, neighbour, score, rank of the k nearest other rows of every query row, by (rounded score desc, key)."""
        key, vector = self.key, self.vector
        shared, kind = self.spark.sparkContext.broadcast((self.centroids, probes or self.probes)), queries.schema[key].dataType.simpleString()

        @F.pandas_udf("array<int>")
        def lists(v: pd.Series) -> pd.Series:
            c, n = shared.value
            return pd.Series(list(np.argsort(-(unit(v) @ c.T), axis=1, kind="stable")[:, :n].astype(np.int32))) if len(v) else pd.Series([], dtype=object)

        rows = self.rows() if where is None else self.rows().filter(where)
        rows = rows.select(key, vector, "list_no")
        sizes = {r.list_no: r["count"] for r in rows.groupBy("list_no").count().collect()}  # one row a list, MOST_LISTS at most
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for no, n in sizes.items() for x in (no, -(-n // PART))]), F.col("list_no")), F.lit(1)) if sizes else F.lit(1)
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int"))
        asked = whole(queries, key, vector).select(F.col(key).alias("_query"), F.col(vector).alias("_asked")).withColumn("list_no", F.explode(lists("_asked")))
        asked = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
        scale = 10.0**digits

        def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if rows.empty or asked.empty:
                return pd.DataFrame({"query": rows[key][:0], "neighbour": rows[key][:0], "score": np.zeros(0)})
            own, who = rows[key].to_numpy(), asked["_query"].to_numpy()
            score = np.floor(unit(asked["_asked"]) @ unit(rows[vector]).T * scale + 0.5) / scale
            picked = []
            for i, query in enumerate(who):
                other = np.flatnonzero(own != query)
                if len(other) > k:
                    other = other[score[i, other] >= np.partition(score[i, other], len(other) - k)[len(other) - k]]
                picked.append(other[np.lexsort((own[other], -score[i, other]))[:k]])
            at, of = np.concatenate(picked), np.repeat(np.arange(len(who)), [len(p) for p in picked])
            return pd.DataFrame({"query": who[of], "neighbour": own[at], "score": score[of, at]})

        by = ["list_no", "_part"]
        found = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(run, f"query {kind}, neighbour {kind}, score double")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _units(rows: list) -> np.ndarray:
    return unit(pd.Series(rows)) if len(rows) else np.zeros((0, 1))


def build(vectors: DataFrame, path: str, key: str, vector: str, k: int = 10, lists: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> Index:
    """Fit on a sample, index every row, write both under `path`."""
    spark, rows = vectors.sparkSession, whole(vectors, key, vector)
    n = rows.count()
    drawn = rows.select(vector).orderBy(F.xxhash64(F.col(key))).limit(sample).collect()  # a bounded sample
    units = _units([r[0] for r in drawn])
    lists = min(lists or max(1, round(n**0.5)), MOST_LISTS, max(1, len(units)))
    centroids = fitted(units, lists) if len(units) else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def list_no(v: pd.Series) -> pd.Series:
        return pd.Series((unit(v) @ shared.value.T).argmax(axis=1).astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

    rows.withColumn("list_no", list_no(vector)).repartition("list_no", F.pmod(F.xxhash64(key), F.lit(max(1, n // (lists * PART))))).write.mode("overwrite").partitionBy("list_no").parquet(f"{path}/rows")
    probes = calibrated(units, centroids, k, target) if len(units) else 1
    facts = json.dumps({"key": key, "vector": vector, "probes": probes, "centroids": centroids.tolist()})
    spark.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/lists")
    return Index(spark, path, key, vector, centroids, probes)


def load(spark: SparkSession, path: str) -> Index:
    facts = json.loads(spark.read.text(f"{path}/lists").first()[0])
    return Index(spark, path, facts["key"], facts["vector"], np.array(facts["centroids"]), facts["probes"])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact (query, neighbour) pairs that were found."""
    met = exact.select("query", "neighbour").join(found.select("query", "neighbour", F.lit(1).alias("_f")), ["query", "neighbour"], "left")
    return met.agg(F.count("*").alias("pairs"), F.coalesce(F.count("_f") / F.count("*"), F.lit(1.0)).alias("recall"))
