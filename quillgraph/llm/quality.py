"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

Every whole text is cut into blocks of ``BLOCK`` bytes, so that the dictionary, not the text's own history, does
the work; each block is compressed with either dictionary. The difference of the two sizes, normalised by the
bytes of the text and by the larger size, goes through a logistic curve fitted on labelled texts that the
dictionaries have not seen. The score is the probability of label 1.

Bounded sample: ``per_class`` labelled rows of each class at most, in the order of their ids' hash; half of them (by the
hash) make the dictionaries, half the curve, for which they are scored whole where they lie. A dictionary is trained on
``dict_blocks`` blocks at most (None: all of its sample), drawn at random with a fixed seed from its rows' blocks, of which each row gives ``row_blocks`` at
most, chosen by their hash from the whole text. Everything that is scored is scored whole.

Defined results
  null or empty text: no difference, so the curve's value at 0, as for any text that neither dictionary prefers.
  null labels or labels other than 0 and 1: ignored. An id with both labels counts as 0.
  one class without rows: every score is the share of label 1, (ones + 1) / (rows + 2).
  repeated documents: one row each. Other columns stay; columns named like an added one are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import cut, map_batches, without

BLOCK, LEVEL, DICT_BYTES = 512, 3, 65_536
PER_CLASS, ROW_BLOCKS = 2000, 40
#: About a hundred times a dictionary's size.
DICT_BLOCKS = DICT_BYTES * 100 // BLOCK

SCORE = T.StructType([T.StructField("score", T.DoubleType())])


class Model:
    """Two dictionaries and a curve; ``curve`` is None where only ``prior`` is known."""

    def __init__(self, good: bytes, bad: bytes, curve: tuple[float, ...] | None, prior: float):
        self.good, self.bad, self.curve, self.prior = good, bad, curve, prior
        self._pair = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}

    def pair(self) -> list[zstandard.ZstdCompressor]:
        if self._pair is None:
            self._pair = []
            for raw in (self.good, self.bad):
                kind = zstandard.ZstdCompressionDict(raw)
                kind.precompute_compress(LEVEL)
                self._pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_content_size=False, write_dict_id=False))
        return self._pair

    def features(self, text: str | None) -> tuple[float, float]:
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return 0.0, 0.0
        good, bad = self.pair()
        g = b = 0
        for i in range(0, len(data), BLOCK):
            part = data[i : i + BLOCK]
            g += len(good.compress(part))
            b += len(bad.compress(part))
        return (b - g) / len(data), (b - g) / max(g, b)

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return self.prior
        x = self.features(text)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.curve[0] + self.curve[1] * x[0] + self.curve[2] * x[1]))))


def _dictionary(parts: list[bytes], blocks: int | None = DICT_BLOCKS) -> bytes:
    order = np.random.default_rng(0).permutation(len(parts))
    parts = [parts[i] for i in order[:blocks]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(parts)[:DICT_BYTES].ljust(8, b" ")


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method on standardised inputs, with a slight ridge."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [0.05] * (a.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[1:] / spread
    return (float(w[0] - slope @ mean), *map(float, slope))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", label: str = "quality", per_class: int = PER_CLASS, row_blocks: int = ROW_BLOCKS, dict_blocks: int | None = DICT_BLOCKS) -> Model:
    """Learns from rows of ``docs`` for which ``usable`` holds and which ``labels`` marks; both have doc_id."""
    # ids first: only the chosen rows' texts are looked at
    marked = labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    marked = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    ones, n = counts.get(1, 0), sum(counts.values())
    prior = Model(b"", b"", None, (ones + 1) / (n + 2))
    if len(counts) < 2:
        return prior
    ranked = marked.withColumn("h", F.xxhash64("doc_id"))
    chosen = ranked.where("y = 0").orderBy("h", "doc_id").limit(per_class).unionAll(ranked.where("y = 1").orderBy("h", "doc_id").limit(per_class))
    body = docs.select("doc_id", F.col(text).alias("t")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "h", "y").agg(F.min("t").alias("t")).where("t <> ''")
    body = cut(body)
    order = [(r.doc_id, r.y) for r in body.select("doc_id", "y", "h").orderBy("h", "doc_id").collect()]
    halves = order[::2], order[1::2]
    if any({y for _, y in half} != {0, 1} for half in halves):
        halves = order, order
    if {y for _, y in order} != {0, 1}:
        return prior
    spark = docs.sparkSession
    first, second = (F.broadcast(spark.createDataFrame([(d,) for d, _ in half], body.select("doc_id").schema)) for half in halves)
    parts = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    some = F.slice(F.array_sort(F.transform(parts, lambda p, i: F.struct(F.xxhash64(p, i).alias("h"), p.alias("p")))), 1, row_blocks)
    taken = body.join(first, "doc_id", "left_semi").select("y", "h", "doc_id", some["p"].alias("p")).orderBy("h", "doc_id").collect()
    good, bad = (_dictionary([p.encode("utf-8", "replace") for r in taken if r.y == y for p in r.p], dict_blocks) for y in (1, 0))
    model = Model(good, bad, None, prior.prior)
    shared = spark.sparkContext.broadcast(model)

    def compare(batch: pa.RecordBatch) -> list[pa.Array]:
        x = [shared.value.features(t) for t in batch.column("t").to_pylist()]
        return [pa.array([v[i] for v in x], pa.float64()) for i in range(2)]

    seen = map_batches(body.join(second, "doc_id", "left_semi"), T.StructType([T.StructField(f"x{i}", T.DoubleType()) for i in range(2)]), compare, ["doc_id", "h", "y"])
    rows = sorted((r.h, r.doc_id, r.y, r.x0, r.x1) for r in seen.collect())
    y = np.array([r[2] for r in rows], float)
    curve = _curve(np.array([r[3:] for r in rows]), y)
    # the sample holds as many rows of either class; the odds of the labelled rows are put back
    shift = math.log(ones / (n - ones)) - math.log(max(y.sum(), 1) / max(len(y) - y.sum(), 1))
    model.curve = (curve[0] + shift, *curve[1:])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score``, the probability that the text is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        own = shared.value
        return [pa.array([own.score(t) for t in batch.column(text).to_pylist()], pa.float64())]

    return map_batches(without(docs, ["score"]), SCORE, work, keep)
