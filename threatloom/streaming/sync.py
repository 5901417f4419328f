"""Incremental sync: a file stream of changed records, upserted by key, once per checkpoint.

The checkpoint is the offset: it advances only after a batch is written, so a failed batch is done
again, and the keyed upsert makes that harmless. A fresh checkpoint is an initial load; nothing new
is a no-op. A table is dealt to buckets by a hash of its key; a batch rewrites the buckets that it
touches, as a new version, and the newest complete version of each bucket counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.session import stored


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the last by `order`."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


class VersionedTable:
    """A Parquet table in BUCKETS buckets of a key's hash: `v=N/b=K` holds bucket K as version N wrote it, and `m=N`, written
    last, lists the buckets of version N. A version without its list's `_SUCCESS` doesn't count."""

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("m=")]
        return sorted(int(p.getName()[2:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _paths(self, buckets: set[int] | None = None) -> list[str]:
        """Folders of the newest version of each bucket that has rows."""
        versions = self.versions()
        if not versions:
            return []
        lists = self.spark.read.schema("bucket int, n long, version int").json([f"{self.path}/m={v}" for v in versions])
        newest = lists.groupBy("bucket").agg(F.max_by("n", "version").alias("n"), F.max("version").alias("version")).collect()  # BUCKETS rows at most
        return [f"{self.path}/v={r.version}/b={r.bucket}" for r in newest if r.n and (buckets is None or r.bucket in buckets)]

    def read(self, buckets: set[int] | None = None) -> DataFrame | None:
        """The rows of some buckets (all by default); None for a table without any."""
        paths = self._paths(buckets)
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.BUCKETS)).cast("int")

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Put `rows` in the place of those with their keys, and remove the keys of `gone`."""
        touched = rows.select(self._bucket().alias("b")).union(gone.select(self._bucket().alias("b")) if gone is not None else rows.select(self._bucket()).limit(0)).distinct()
        buckets = {r.b for r in touched.collect()}  # BUCKETS rows at most
        if not buckets:
            return
        version = max(self.versions(), default=0) + 1
        old = self.read(buckets)
        new = rows if old is None else upserted(old, rows, self.key)
        if gone is not None:
            new = new.join(gone.select(self.key).distinct(), self.key, "left_anti")
        new.withColumn("b", self._bucket()).repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/v={version}")
        some = self.spark.createDataFrame([(b,) for b in sorted(buckets)], "b int")
        try:
            held = self.spark.read.parquet(f"{self.path}/v={version}").groupBy("b").agg(F.count("*").alias("n"))
        except AnalysisException:  # every touched bucket is empty now
            held = self.spark.createDataFrame([], "b int, n long")
        listed = some.join(held, "b", "left").select(F.col("b").alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(version).alias("version"))
        listed.coalesce(1).write.mode("overwrite").json(f"{self.path}/m={version}")


def sync(spark: SparkSession, landing: str, schema: str, table: str, checkpoint: str, key: str, order: list[str], transform=None, files_per_batch: int | None = None, reader: str = "json", options: dict | None = None) -> None:
    """Process all files that arrived since the last call, then stop."""
    target = VersionedTable(spark, table, key)
    source = spark.readStream.schema(schema).options(**(options or {}))
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)

    def apply(batch: DataFrame, _: int) -> None:
        target.upsert(latest(transform(batch) if transform else batch, key, order))

    query = source.format(reader).load(landing).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def changes(landing: DataFrame, done: DataFrame, key: str = "path", version: str = "hash") -> DataFrame:
    """(key, change): `new`, `changed` (another version) or `deleted` of what a landing folder holds against what was done."""
    now, was = (df.select(key, F.col(version).alias(x)).distinct() for df, x in ((landing, "_now"), (done, "_was")))
    both = now.join(was, key, "full_outer")
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_now") != F.col("_was"), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


LOG, CHANGE = "path string, hash string, at long", "path string, hash string, change string"


def change_log(landing: DataFrame, done: DataFrame, at: int) -> DataFrame:
    """Log rows (path, hash, at) of what a full listing (path, hash) changes against what was done; a null hash is a deletion."""
    found = changes(landing, done).join(landing.select("path", F.col("hash").alias("_hash")).distinct(), "path", "left")
    return found.select("path", F.when(F.col("change") != "deleted", F.col("_hash")).alias("hash"), F.lit(at).cast("long").alias("at"))


def stateful_changes(log: DataFrame) -> DataFrame:
    """(path, hash, change) of a stream of log rows: `new`, `changed` or `deleted` against the last hash of each path, which is the
    state. Rows of one batch count by their last (in order of `at`, then deletions first); a path that returns is new, and what changes nothing is left out."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        gone = rows["hash"].isna()
        last = rows.assign(_here=~gone, _hash=rows["hash"].fillna("")).sort_values(["at", "_here", "_hash"], kind="stable").iloc[-1]
        before, now = state.get[0] if state.exists else None, last["_hash"] if last["_here"] else None
        if now is None and before is not None:
            state.remove()
        elif now is not None:
            state.update((now,))
        change = None if now == before else "deleted" if now is None else "new" if before is None else "changed"
        yield pd.DataFrame({"path": [key[0]], "hash": [now], "change": [change]}).iloc[: 1 if change else 0]

    return log.groupBy("path").applyInPandasWithState(run, CHANGE, "hash string", "update", "NoTimeout")


def sync_changes(spark: SparkSession, log: str, table: str, checkpoint: str, read: Callable[[DataFrame], DataFrame]) -> None:
    """Process all log files (JSON lines of path, hash, at) that arrived since the last call: `read` turns new and changed paths (path, hash)
    into rows of the table, whose key is `path`; deleted paths leave it. A batch that fails is done again whole, from its state before."""
    target = VersionedTable(spark, table, "path")

    def apply(batch: DataFrame, _: int) -> None:
        rows = stored(batch, "sync-changes")  # once: the state's output isn't computed again for each use
        target.upsert(read(rows.filter("change <> 'deleted'").select("path", "hash")), rows.filter("change = 'deleted'").select("path"))

    source = spark.readStream.schema(LOG).json(log)
    query = stateful_changes(source).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def pending(spark: SparkSession, landing: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Dry run: what a sync would process, newest first, 20 at most."""
    return undone(landing, done, key).orderBy(F.desc(key)).limit(20)


def undone(landing: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """The rows whose key isn't done yet."""
    return landing.join(done.select(key).distinct(), key, "left_anti")


def health(counts: dict[str, int | None]) -> str:
    """`ok` if every part has rows, `not_ready` if none has, else `degraded`; None is a part that failed."""
    full = [bool(n) for n in counts.values()]
    return "ok" if all(full) else "degraded" if any(full) else "not_ready"
