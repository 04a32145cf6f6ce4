"""Helpers shared by the training-data operators: checkpoint folder, column checks, label sampling."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whole texts go to Python workers in batches of at most so many rows and bytes; the defaults would hold tens of megabytes of text on either side.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or the one that the session's context has. Without either a temporary one where all runs on one machine (tests), and an error on a cluster, whose executors wouldn't share it."""
    found, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if found is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="graphloom-"))
    return found or sc._jsc.sc().getCheckpointDir().get()


def ship(spark: SparkSession) -> None:
    """Bounds Arrow batches, and makes this package importable in Python workers, where neither PYTHONPATH nor the working folder has it: once for each context, through Spark's own file server."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    package = Path(__file__).resolve().parents[1]
    root, sc = str(package.parent), spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(":") or os.getcwd() == root or getattr(sc, "_graphloom_shipped", False):
        return
    made = f"{tempfile.mkdtemp(prefix='graphloom-')}/graphloom_package.zip"
    with zipfile.ZipFile(made, "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    sc.addPyFile(made)
    sc._graphloom_shipped = True


def lean(run):
    """A function for mapInArrow that hands what its task has freed back to the system: idle workers wait beside the busy ones in an executor's memory."""

    def all_of(batches):
        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return all_of


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint: lineage ends there, and lost executors lose nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spilled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared checkpoint folder and read again (columnar, for wide scratch tables); the files go when the application ends."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema, jvm = df.schema, df.sparkSession._jvm
    df.write.parquet(path)
    made = jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(made)
    return df.sparkSession.read.schema(schema).parquet(path)


def id_bucket(column: str, n: int):
    """crc32 of the id's decimal text, modulo n: the fold rule of every learning operator here."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def need(df: DataFrame, *columns: str) -> None:
    """Fails early, by name, where an input lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def bounded_by_class(df: DataFrame, key: str, label: str, per_class: int, seed: int = 17) -> DataFrame:
    """About per_class rows of each label, chosen by a hash of the key: one count by label, then a filter; no sort, no group in one task."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return df.limit(0)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    unit = (F.xxhash64(F.col(key), F.lit(seed)).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))).cast("double")
    return df.where(unit < share)
