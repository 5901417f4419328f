"""Session and table helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cpus: str | int | None = None, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("threatloom")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. Where it is unset (tests), a local session gets one of its
    own; on a cluster that is an error, as a local folder isn't shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def held_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that `cleaned` knows."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _held(spark).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, and survives lost executors. `cleaned` removes it."""
    spark, path = df.sparkSession, held_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _held(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_threatloom_held"):
        context._threatloom_held = []
    return context._threatloom_held


def cleaned(spark: SparkSession) -> int:
    """Delete what was written to `held_path`s (and so by `stored`) in this session, and how many folders that were. Results that read them must be written
    or collected before."""
    held, jvm = _held(spark), spark.sparkContext._jvm
    for path in held:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    n = len(held)
    held.clear()
    return n


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Python tasks can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_threatloom_shipped", False):
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="threatloom-")) / "threatloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    context._threatloom_shipped = True
