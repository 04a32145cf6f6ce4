"""Checkpoints for iterative operators, and bounds of their one-task endings."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Up to this many edges a loop may end in one grouped task; more go on level by level.
ONE_TASK_EDGES = 200_000
#: Frontiers are broadcast up to this many rows.
BROADCAST_ROWS = 100_000


#: Most nodes and edges that go to the driver for a document, a dictionary or the block format; formats by rows have no such bound.
MOST_ROWS = 1_000_000


class TooLargeError(ValueError):
    """More rows than a driver should hold; nothing was collected."""


def held_by_driver(graph, most: int = MOST_ROWS) -> None:
    """An error where the graph has more than `most` nodes and edges."""
    n = graph.node_count() + graph.edge_count()
    if n > most:
        raise TooLargeError(f"{n} nodes and edges; at most {most} go to the driver")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or the one that the session's context has. Without either a temporary one where all runs on one machine (tests), and an error on a cluster, whose executors wouldn't share it."""
    found, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if found is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="graphloom-"))
    return found or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df as Parquet in the shared folder, by the columns' values, and read again; the files go when the application ends."""
    spark, schema = df.sparkSession, df.schema
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(made)
    return spark.read.schema(schema).parquet(path)
