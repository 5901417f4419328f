"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.session import held_path, shared_dir, stored, table

__all__ = ["bounded_batches", "fresh", "held_path", "numbered", "shared_dir", "slices", "stored", "table"]

BATCH_BYTES = "8m"


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until `df` has no such column (in any case of letters)."""
    name, taken = f"_{name}", {c.lower() for c in df.columns}
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, after lowering the session's Arrow batches to BATCH_BYTES: a batch of whole texts is held
    by the JVM and the Python worker at once, for every task of an executor."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are held as Python strings or sent at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with the place of each row in `order`, from 1: a range-partitioned sort, and the sizes of its partitions."""
    at, part = fresh(df, "at"), fresh(df, "part")
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn(part, F.shiftright(at, 33))
    before, n = {}, 0
    sizes = sorted(rows.groupBy(part).count().collect())  # one row a partition
    for p, size in sizes:
        before[p] = n
        n += size
    starts = df.sparkSession.createDataFrame([(p, k) for p, k in before.items()], f"{part} long, {at}0 long")
    place = F.col(f"{at}0") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(starts), part).withColumn(name, place).select(*df.columns, name)
