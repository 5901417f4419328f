"""Exact ranked values (percentiles by place) from counts: distributed selection, so that no group's values stand in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threatloom.session import stored


def value_at(counts: DataFrame, by: list[str], value: str, n: str, share: float, into: str) -> DataFrame:
    """`by` and the value at place floor(share x n) (from 1, at least 1) of each group's sorted values.

    `counts` holds a row per (by, value) with its number n. The rows are sorted over ranges of (by, value); every range adds up its
    rows by group, the sums before it say in which range a group's place falls, and only the rows of that range are walked, in
    a window no larger than the range. Null keys are keys.
    """
    key = F.struct(*by)
    ordered = counts.select(key.alias("_key"), F.col(value).alias("_value"), F.col(n).alias("_n")).repartitionByRange("_key", "_value").sortWithinPartitions("_key", "_value")
    rows = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "ranked-counts").withColumn("_part", F.shiftright("_at", 33))
    sums = rows.groupBy("_key", "_part").agg(F.sum("_n").alias("_s"))
    group = Window.partitionBy("_key")  # a row a range that the group reaches into
    sums = sums.withColumns({"_upto": F.sum("_s").over(group.orderBy("_part")), "_all": F.sum("_s").over(group)})
    place = F.greatest(F.lit(1), F.floor(F.col("_all") * F.lit(share)))
    held = sums.withColumn("_place", place - (F.col("_upto") - F.col("_s"))).filter((F.col("_place") > 0) & (F.col("_place") <= F.col("_s")))
    walked = rows.join(held.select("_key", "_part", "_place"), ["_key", "_part"])
    walked = walked.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_key", "_part").orderBy("_at"))).filter(F.col("_upto") >= F.col("_place"))
    return walked.groupBy("_key").agg(F.min("_value").alias(into)).select(*[F.col("_key")[c].alias(c) for c in by], into)


def ranked_value(df: DataFrame, by: list[str], value: str, share: float = 0.95, into: str = "p95") -> DataFrame:
    """value_at of the rows of `df`; null values are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return value_at(counts, by, value, "_n", share, into)
