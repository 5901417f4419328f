"""Vector collections: cosine similarity, filtered k-nearest neighbours, batches of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of vectors and of a block of queries: their scores are one matrix in a task.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision, 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str, vector: str, digits: int = 6) -> DataFrame:
    """The k nearest rows to one vector, by (rounded score desc, key): filters on `vectors` reach the scan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", F.round(cosine(F.col(vector), q), digits))
    return scored.orderBy(F.desc("score"), key).limit(k)


def filtered_nearest(vectors: DataFrame, query: list[float], k: int, key: str, vector: str, late: Column | None = None) -> DataFrame:
    """Over-fetch 2k, then apply `late` inside those hits only, then keep k."""
    hits = nearest(vectors, query, 2 * k, key, vector)
    if late is not None:
        hits = hits.filter(late)
    return hits.orderBy(F.desc("score"), key).limit(k)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str, digits: int = 6) -> DataFrame:
    """query, neighbour, score, rank: the k nearest other rows of every query row, by (rounded score desc, key).

    Rows and queries are dealt to blocks; every pair of blocks is one matrix product in a task, which returns k rows a
    query at most (ties by key, as in the result), so copies never grow what is shuffled. Rows without a vector take no part.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"query {kind}, neighbour {kind}, score double"
    have = lambda df: df.select(key, vector).filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    vectors, queries = have(vectors), have(queries).select(F.col(key).alias("_query"), F.col(vector).alias("_asked"))
    groups, blocks = (max(1, -(-df.count() // rows)) for df, rows in ((vectors, BLOCK_ROWS), (queries, QUERY_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # row numbers, not keys: a key that repeats doesn't fill one group
    block = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    dealt = vectors.withColumn("_g", block(groups)).withColumn("_b", every(blocks)).groupBy("_g", "_b")
    asked = queries.withColumn("_b", block(blocks)).withColumn("_g", every(groups)).groupBy("_g", "_b")
    scale = 10.0**digits

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"query": rows[key][:0], "neighbour": rows[key][:0], "score": np.zeros(0)})
        own, who = rows[key].to_numpy(), asked["_query"].to_numpy()
        score = np.floor(unit(asked["_asked"]) @ unit(rows[vector]).T * scale + 0.5) / scale
        picked = []
        for i, query in enumerate(who):
            other = np.flatnonzero(own != query)
            if len(other) > k:  # all that tie with the k-th, then the smallest keys
                other = other[score[i, other] >= np.partition(score[i, other], len(other) - k)[len(other) - k]]
            picked.append(other[np.lexsort((own[other], -score[i, other]))[:k]])
        at, of = np.concatenate(picked), np.repeat(np.arange(len(who)), [len(p) for p in picked])
        return pd.DataFrame({"query": who[of], "neighbour": own[at], "score": score[of, at]})

    found = dealt.cogroup(asked).applyInPandas(run, schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def unit(column: pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in column])
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def aligned(vectors: DataFrame, metadata: DataFrame) -> int:
    """The number of rows of both, which must agree."""
    n, m = (df.agg(F.count("*")).first()[0] for df in (vectors, metadata))
    if n != m:
        raise ValueError(f"{n} vectors for {m} records")
    return n


def append_vectors(records: DataFrame, path: str, key: str, into_vectors: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add vectors for the records that the table at `path` lacks, as one more Parquet append, and return the whole table.

    `into_vectors` maps records to rows with the key and a vector. A run that fails adds nothing, so it can be repeated.
    """
    spark = records.sparkSession
    try:
        done = spark.read.parquet(path)
    except AnalysisException:  # no table yet
        done = None
    new = records if done is None else records.join(done.select(key).distinct(), key, "left_anti")
    into_vectors(new.dropDuplicates([key])).write.mode("append").parquet(path)
    return spark.read.parquet(path)
