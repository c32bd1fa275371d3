"""The graph's tables as Parquet: a baseline that only the scheduled job writes, and an overlay for local runs.

All access goes through Hadoop's file systems. Each run writes its tables into a folder of its own; the file ``CURRENT`` names the
folder of every table, and replacing it, one atomic step, is what makes a run visible.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = ["artifacts", "nodes", "edges", "provenance", "refs", "diagnostics"]


class Store:
    def __init__(self, spark: SparkSession, root: str, overlay: bool = True):
        self.spark, self.root, self.overlay = spark, root, overlay

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _current(self, side: str) -> dict[str, str]:
        """Table: folder below the side."""
        at, fs = self._path(f"{self.root}/{side}/CURRENT"), self._fs()
        if not fs.exists(at):
            return {}
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        out = self._fs().create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _at(self, name: str) -> str | None:
        """The overlay's table if there is one, else the baseline's."""
        for side in ["overlay", "baseline"] if self.overlay else ["baseline"]:
            folder = self._current(side).get(name)
            if folder:
                return f"{self.root}/{side}/{folder}/{name}"
        return None

    def exists(self) -> bool:
        return self._at("artifacts") is not None

    def read(self, name: str) -> DataFrame:
        at = self._at(name)
        if at is None:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        return self.spark.read.parquet(at)

    def write(self, **tables: DataFrame) -> None:
        """Writes the tables, then makes them current together. Folders that neither this run nor the last one names are deleted."""
        name = "overlay" if self.overlay else "baseline"
        side, fresh = f"{self.root}/{name}", f"v-{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{side}/{fresh}/{table}")
        before = self._current(name)
        now = before | dict.fromkeys(tables, fresh)
        self._write_text(f"{side}/{fresh}/CURRENT", json.dumps(now))
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(side).toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs().makeQualified(self._path(f"{side}/{fresh}/CURRENT")), self._fs().makeQualified(self._path(f"{side}/CURRENT")), how)
        kept = set(now.values()) | set(before.values())
        for status in self._fs().listStatus(self._path(side)):
            folder = status.getPath().getName()
            if folder.startswith("v-") and folder not in kept:
                self._fs().delete(status.getPath(), True)

    @contextmanager
    def locked(self, wait: float = 600.0) -> Iterator[None]:
        """One writer at a time: a file that only one can create. ``TimeoutError`` if it stays for ``wait`` seconds."""
        lock, until = self._path(f"{self.root}/.lock"), time.monotonic() + wait
        while not self._create(lock):
            if time.monotonic() > until:
                raise TimeoutError(f"{lock.toString()} is held; delete it if its writer is gone")
            time.sleep(0.5)
        try:
            yield
        finally:
            self._fs().delete(lock, False)

    def _create(self, path) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            self._fs().create(path, False).close()
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()) or self._fs().exists(path):
                return False
            raise
