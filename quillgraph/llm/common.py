"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.iterate import settle as cut

__all__ = ["ASCII_LOWER", "BATCH_ROWS", "cut", "held_out", "map_batches", "read", "regroup", "small_batches", "without"]

#: Rows in one Arrow batch. Texts may be long, so batches are kept short to bound a Python worker's memory.
BATCH_ROWS = 128

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is 0. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts == 0


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add (case does not count)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches. All operators ask for the same number of rows, so the order of calls plays no part."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def regroup(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, for work on rows of bounded size that pays by the batch."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def map_batches(df: DataFrame, added: T.StructType, work: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """Adds the columns of ``added``, which ``work`` makes of each Arrow batch; keeps ``keep`` (all, if None) of the others."""
    small_batches(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in added}]
    schema = T.StructType([df.schema[c] for c in kept] + list(added))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=names)

    return df.mapInArrow(run, schema)
