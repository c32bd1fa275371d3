"""Loops over DataFrames without growing lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes a statement's shuffle files when it ends, where this is set; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables that ``settle`` wrote and ``clear`` has not deleted yet.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Where neither is set, a local session gets a folder of its own, and a cluster its warehouse: never a folder of one machine.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if place:
        return place
    if not spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/quill-shared"
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quill-shared-"))
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, so that a lost executor costs nothing and its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quill-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes tables that ``settle`` returned and nothing reads any more."""
    for df in frames:
        path = df._sc._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(df.settled_at)


def steady(df: DataFrame) -> DataFrame:
    """``df`` itself where reading it is a scan, with no more than filters and projections; else settled.

    Loops name their edges once a round: a stored table is read anew, a derived one must not be derived anew.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return settle(df) if any(word in plan for word in ("Aggregate", "Join", "Window", "Sort", "Generate", "Distinct", "Except", "Intersect", "MapIn", "InMemory")) else df


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this process settled. Frames that were made of them cannot be read any more."""
    gone = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
