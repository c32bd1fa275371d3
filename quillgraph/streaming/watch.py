"""Following changes: files with Structured Streaming, and windowed counts over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.plans.index import IndexStats, index
from quillgraph.sources.files import Config
from quillgraph.sources.store import Store


class Watch:
    """The queries that follow a directory."""

    def __init__(self, *queries: StreamingQuery):
        self.queries = queries

    def awaitTermination(self, timeout: float | None = None) -> None:
        self.queries[0].awaitTermination(timeout)

    def stop(self) -> None:
        for q in self.queries:
            q.stop()


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, config: Config | None = None, told: Callable[[IndexStats], None] | None = None, once: bool = False) -> Watch:
    """Indexes ``root`` anew whenever files arrive or change; files of one trigger make one run.

    The file source tells that something changed; the run itself compares checksums, so that it also sees what is gone.
    Every ``rescan_seconds`` a run looks for what no arrival told, such as files that are gone; 0 leaves this out.
    """
    config = config or Config()
    seen = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(root).select("path")

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            stats = index(spark, root, store, config)
            if told:
                told(stats)

    def start(frame: DataFrame, name: str, every: str) -> StreamingQuery:
        writer = frame.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/{name}")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()

    queries = [start(seen, "files", f"{config.debounce_ms} milliseconds")]
    if config.rescan_seconds and not once:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        queries.append(start(ticks, "rescan", f"{config.rescan_seconds} seconds"))
    return Watch(*queries)


def event_rates(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, value of a stream or table of events; with a watermark, so that state stays bounded."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")
