"""Exact top-k inner-product search by a three-phase uniform threshold.

The score is a sum over SLICES groups of dimensions. Each group of dimensions is held by tasks of
its own, which see no other: a query has one local score list in each.

1. Every task sends the top k of its local lists. The missing local scores of what is on top of a
   whole list are looked up by id, and the k-th best total of a query is its safe cutoff t.
2. The cutoffs go to all tasks. What reaches t in total reaches t / SLICES in some list, so the tasks
   send those entries only.
3. Local scores that an entry lacks are looked up by id, and the best k totals remain.

Equal vectors are one candidate, with the k + 1 smallest ids that hold it (and how often), so copies
and ties don't multiply entries. Vectors meet in blocks: candidates are dealt to groups of about
BLOCK_ROWS, queries to blocks of QUERY_ROWS, and every (slice, group, block) is one matrix product.

Defined results: vectors that are null, empty, hold null or non-finite components, or are of another
length than most take no part; rows without an id neither; an id that repeats is a candidate as often
as it stands there, and a query once (its smallest vector); a query is never its own candidate; ties
go to the smaller id. Components, local scores and totals are exact while they fit 64 bits, and become
the nearest long beyond.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SLICES, BLOCK_ROWS, QUERY_ROWS = 2, 4096, 1024
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): components floor(scale * x), of the vectors that are whole and finite."""
    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(good & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in column])


def _exact(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if all sums of their products are exact so, else as Python's integers."""
    largest = [max((abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))) for a in (x, y)]
    kind = np.float64 if largest[0] * largest[1] * x.shape[-1] < 1 << 53 else object
    return x.astype(kind), y.astype(kind)


def _long(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, LOWEST, HIGHEST).astype(np.int64) if scores.dtype == object else scores.astype(np.int64)


def _products(candidates: pd.DataFrame, queries: pd.DataFrame, choose) -> pd.DataFrame:
    """Entries (query_id, u, score) of one pair of blocks, as `choose` picks them from a query's local scores."""
    if candidates.empty or queries.empty:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "u", "score")})
    q, v = _exact(_matrix(queries["v"]), _matrix(candidates["v"]))
    u, own = candidates["u"].to_numpy(np.int64), candidates["only"].to_numpy(np.float64, na_value=np.nan)
    lists = _long(q @ v.T)
    asked = queries["query_id"].to_numpy(np.int64)
    picked = [choose(i, np.flatnonzero(own != query), lists[i]) for i, query in enumerate(asked.tolist())]
    at = np.concatenate(picked)
    rows = np.repeat(np.arange(len(asked)), [len(p) for p in picked])
    return pd.DataFrame({"query_id": asked[rows], "u": u[at], "score": lists[rows, at]})


def _gather(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        def top(i, other, scores):
            return other if len(other) <= k else other[np.argpartition(-scores[other].astype(np.float64), k - 1)[:k]]

        return _products(candidates, queries, top)

    return run


def _sufficient(slices: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        cutoff = queries["cutoff"].tolist()

        def above(i, other, scores):
            return other if pd.isna(cutoff[i]) else other[scores[other] >= -(-int(cutoff[i]) // slices)]

        return _products(candidates, queries, above)

    return run


def _dots(frames):
    for f in frames:
        if len(f):
            a, b = _exact(_matrix(f["q"]), _matrix(f["v"]))
            yield pd.DataFrame({"query_id": f["query_id"], "u": f["u"], "score": _long((a * b).sum(axis=1))})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score. Both sides: (vec_id long, v array<long>)."""
    shape = vectors.filter(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = vectors.filter(F.size("v") == shape.d)
    few = whole.withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    held = few.groupBy("v", "vec_id").agg(F.count("*").alias("times")).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "times"))).alias("ids"))
    held = stored(held.select("v", "ids", F.monotonically_increasing_id().alias("u")), "topk-vectors")
    asked = queries.filter(F.size("v") == shape.d).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))

    slices = min(SLICES, shape.d)
    width = -(-shape.d // slices)
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), slices * width - shape.d))
    cut = F.array(*[F.slice(padded, s * width + 1, width) for s in range(slices)])
    only = F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"])
    lists = stored(held.select("u", only.alias("only"), F.posexplode(cut).alias("slice", "v")), "topk-slices")
    asked = stored(asked.select("query_id", F.posexplode(cut).alias("slice", "v")), "topk-queries")
    groups, blocks = (max(1, -(-df.count() // slices // rows)) for df, rows in ((lists, BLOCK_ROWS), (asked, QUERY_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda key, n: F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n)).cast("int")
    dealt = lists.withColumn("g", block("u", groups)).withColumn("b", every(blocks)).groupBy("slice", "g", "b")
    entry = "query_id long, u long, score long"

    def local(sent: DataFrame, f) -> DataFrame:
        """(query_id, u, slice, score) of all pairs of blocks."""
        placed = sent.withColumn("b", block("query_id", blocks)).withColumn("g", every(groups)).groupBy("slice", "g", "b")
        labelled = lambda key, a, b: f(a, b).assign(slice=key[0])
        return dealt.cogroup(placed).applyInPandas(labelled, f"{entry}, slice int")

    def totals(entries: DataFrame) -> DataFrame:
        """(query_id, u, score): what the entries hold, and the local scores that they lack by id."""
        summed = F.sum(F.col("score").cast("decimal(28,0)"))
        known = entries.groupBy("query_id", "u").agg(summed.alias("score"), F.collect_set("slice").alias("slices"))
        lack = known.select("query_id", "u", F.explode(F.array_except(F.array(*[F.lit(s) for s in range(slices)]), "slices")).alias("slice"))
        met = lack.join(lists.select("u", "slice", "v").hint("merge"), ["u", "slice"]).join(asked.select("query_id", "slice", F.col("v").alias("q")).hint("merge"), ["query_id", "slice"])
        rest = met.select("query_id", "u", "q", "v").mapInPandas(_dots, entry)
        whole = known.select("query_id", "u", "score").unionByName(rest).groupBy("query_id", "u").agg(summed.alias("score"))
        return whole.withColumn("score", F.least(F.greatest("score", F.lit(LOWEST).cast("decimal(38,0)")), F.lit(HIGHEST).cast("decimal(38,0)")).cast("long"))

    best = lambda df, by, *order: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), *order))).filter(F.col("n") <= k)
    tops = stored(best(local(asked, _gather(k)), ["query_id", "slice"], "u").drop("n"), "topk-tops")
    cutoffs = best(totals(tops), ["query_id"], "u").groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("cutoff"))
    cutoffs = stored(cutoffs, "topk-cutoffs")
    entries = stored(local(asked.join(cutoffs.hint("merge"), "query_id", "left"), _sufficient(slices)), "topk-entries")
    reached = totals(entries).join(cutoffs.hint("merge"), "query_id", "left").filter(F.col("cutoff").isNull() | (F.col("score") >= F.col("cutoff")))
    ids = reached.join(held.select("u", "ids").hint("merge"), "u").withColumn("ids", F.filter("ids", lambda x: x["vec_id"] != F.col("query_id")))
    each = best(ids, ["query_id"], F.col("ids")[0]["vec_id"]).select("query_id", "score", F.explode("ids").alias("x"))
    each = each.select("query_id", F.col("x.vec_id").alias("vec_id"), "score", F.explode(F.sequence(F.lit(1), F.least(F.col("x.times"), F.lit(k)).cast("int"))))
    return best(each, ["query_id"], "vec_id").select("query_id", F.col("n").alias("rank"), "vec_id", "score")
