"""MinHash near-duplicates with odd sketches, confirmed on full shingle sets.

1. Each text becomes its set of hashed word shingles, ``HASHES`` MinHash samples, ``BANDS`` band keys, and an odd
   sketch: a bitmap that the samples toggle, so that the XOR of two has as many bits as samples differ, but for
   collisions, which the estimate corrects. Texts with the same set are one class with one representative.
2. Representatives that share a band key form a bucket. The member that shares the most buckets with others,
   which lies nearest to the group's middle, leads the bucket; the others are compared with it. Pairs whose sketches
   estimate a similarity below ``FLOOR`` cannot be linked but by an error of over five deviations; the others are
   confirmed on their full sets. Confirmed links make components.
3. A leader's members that are still in different components were not compared with one another yet. Those outside the
   group's largest component are outliers; each is compared with all members, which stay in blocks of ``BLOCK``: first by
   sketches, then, those with a partner left, on full sets. Only links that join components are written, so a group of any
   size adds no more links than members; what is copied is a row an outlier and block.
Pairs at a similarity of 0.8 share a band key with probability 1 - (1 - 0.8^5)^32, over 0.999996; more if closer.

Defined results
  no words or null text: empty set, no link. Fewer words than a shingle: the whole sequence is the one shingle.
  null id: the row is linked with nothing. Rows that share an id are one document. Extra columns play no part.
  ids that are no whole numbers count as text, and the smallest is the first in text order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillgraph.llm.common import ASCII_LOWER, cut, small_batches
from quillgraph.llm.components import components

ROWS, BANDS = 5, 32
HASHES = ROWS * BANDS
BITS = 1024
FLOOR = 0.62
BLOCK = 256
#: Outliers held at once beside a block.
ASKERS = 1024
#: Ids that may be broadcast to pick texts; beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000
MEMO = 400_000

_RNG = np.random.Generator(np.random.PCG64(20_240_607))
_MULT = _RNG.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Memo(dict):
    """Hashes of words; the most that are kept is fixed."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:
            self[word] = h
        return h


_hash_of = _Memo()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _P2
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.encode("utf-8", "replace").translate(ASCII_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    acc = np.full(len(h) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        acc = (acc ^ h[k : k + len(acc)]) * _P1
        acc ^= acc >> np.uint64(31)
    return np.unique(_mix(acc))


def minhash(hashes: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(best, (_MULT[:, None] * low[None, i : i + 2048]).min(1), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """[texts, HASHES] samples to [texts, BANDS] keys; a key tells its band too."""
    s = samples.astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    acc = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _P3), s.shape[:2]).copy()
    for k in range(ROWS):
        acc = _mix((acc ^ s[:, :, k]) * _P1)
    return acc.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """[texts, HASHES] samples to [texts, BITS / 64] parity words."""
    at = _mix(_mix(samples.astype(np.uint64) + (np.arange(1, HASHES + 1, dtype=np.uint64) << np.uint64(32))) * _P1) % np.uint64(BITS)
    at = at.astype(np.int64) + np.arange(len(samples))[:, None] * BITS
    odd = np.bincount(at.reshape(-1), minlength=len(samples) * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(samples), BITS), axis=1, bitorder="little").view(np.int64)


def most_bits(similarity: float) -> int:
    """XOR bits at which the estimate falls to ``similarity``."""
    return int(BITS / 2 * (1 - math.exp(-4 * HASHES * (1 - similarity) / BITS)))


def estimate(bits: float) -> float:
    inside = 1 - 2 * bits / BITS
    return 1 + BITS / (4 * HASHES) * math.log(inside) if inside > 0 else -math.inf


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.reshape(-1)))


def _signatures(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            samples = np.array([minhash(s) for s in sets], np.uint32).reshape(len(sets), HASHES)
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), _lists(band_keys(samples)), _lists(odd_sketches(samples))],
                names=["doc_id", "n", "print", "bands", "sketch"],
            )

    kind = _kind(docs, doc_id)
    return docs.select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {kind}, n long, print binary, bands array<long>, sketch array<long>")


def _kind(docs: DataFrame, doc_id: str) -> str:
    return "long" if isinstance(docs.schema[doc_id].dataType, T.IntegralType) else "string"


def _sets(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """id and set (sorted hashes as bytes) of the documents named in ``ids``."""
    kind = _kind(docs, doc_id)
    own = docs.select(F.col(doc_id).cast(kind).alias("id"), F.col(text).alias("text"))
    own = own.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "set"])

    return cut(own.mapInArrow(run, f"id {kind}, set binary"))


def _linked(size: int, a: int, b: int, percent: int) -> bool:
    return 100 * size >= percent * (a + b - size)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that are linked by their full sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(_linked(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, _shape(pairs, "a", "b")).distinct()


def _sparse(links: DataFrame) -> DataFrame:
    """The same components by fewer links: each b keeps its smallest a, and a's that share a b are linked with the smallest."""
    low = links.join(links.groupBy("b").agg(F.min("a").alias("m")), "b")
    pairs = F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b"))))
    return cut(low.select("m", "a", "b").select(pairs.alias("p")).select("p.a", "p.b").where("a <> b").distinct())


def _shape(df: DataFrame, *columns: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[tuple]]]:
    """Rows (lead, block, asks, ...) sorted by the first three, as (True, members) for each lead and block, then (False, some askers).

    Askers of a block without members are left out.
    """
    now, asks, held, block = None, 0, [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != now or row[2] != asks or asks and len(held) >= ASKERS:
                if held:
                    yield not asks, held
                now, asks, held = row[:2], row[2], []
            if not asks:
                block = now
            if block == now:
                held.append(row)
    if held:
        yield not asks, held


def _by_sketch(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (lead, block, asks, id, label) of members and askers with a partner that sketches and sizes allow in another component."""
    limit = most_bits(FLOOR)
    members: list[tuple] = []
    told = np.zeros(0, bool)

    def out(rows: list[tuple], hit: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = [rows[i][:5] for i in np.flatnonzero(hit).tolist()]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)

    for first, rows in _met(batches):
        label, n, sketch = np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), np.array([r[6] for r in rows], np.int64).view(np.uint64)
        if first:
            yield from out(members, told)
            members, told, theirs = rows, np.zeros(len(rows), bool), (label, n, sketch)
            continue
        hit = np.zeros(len(rows), bool)
        for a in range(0, len(rows), 128):
            part = slice(a, a + 128)
            fits = label[part, None] != theirs[0][None]
            fits &= np.minimum(n[part, None], theirs[1][None]) * 100 >= percent * np.maximum(n[part, None], theirs[1][None])
            x, y = np.nonzero(fits)
            near = np.bitwise_count(sketch[part][x] ^ theirs[2][y]).sum(1) <= limit if len(x) else np.zeros(0, bool)
            hit[x[near] + a] = True
            told[y[near]] = True
        yield from out(rows, hit)
    yield from out(members, told)


def _by_sets(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Links between components among each block's members and askers: enough to join all that are linked."""
    up: dict = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for first, rows in _met(batches):
        if first:
            up = {}
            parts = [np.frombuffer(r[5], np.uint64) for r in rows]
            ids, labels = [r[3] for r in rows], [r[4] for r in rows]
            sizes = np.array([len(p) for p in parts])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            vocab, flat = np.unique(np.concatenate(parts), return_inverse=True)
            mark = np.zeros(len(vocab), np.int32)
            continue
        made: list[tuple] = []
        for _, _, _, ident, label, raw in rows:
            own = np.frombuffer(raw, np.uint64)
            at = np.minimum(np.searchsorted(vocab, own), len(vocab) - 1)
            at = at[vocab[at] == own]
            mark[at] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[at] = 0
            for y in np.flatnonzero(100 * both >= percent * (len(own) + sizes - both)).tolist():
                mine, theirs = root(label), root(labels[y])
                if mine != theirs:
                    made.append((ident, ids[y]))
                    up[mine] = theirs
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``: near-duplicates share a component."""
    signs = cut(_signatures(docs, doc_id, text, width))
    whole = signs.where("print is not null and doc_id is not null")
    reps = cut(whole.groupBy("print").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    found = reps.select("print", F.col("id").alias("rep"))
    sketches = reps.select("id", "n", "sketch")

    at = reps.select("id", F.explode("bands").alias("key"))
    shared = at.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    at = cut(at.join(shared, "key"))
    middle = at.groupBy("id").agg(F.sum("members").alias("near"))
    at = at.join(middle, "id")
    leads = at.groupBy("key").agg(F.min(F.struct((-F.col("near")).alias("far"), "id")).alias("top")).select("key", F.col("top.id").alias("lead"))
    stars = at.join(leads, "key").where("id <> lead").select("lead", "id").distinct()
    bits = F.aggregate(F.zip_with("s1", "s2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
    stars = stars.join(sketches.select("id", F.col("sketch").alias("s1")), "id").join(sketches.select(F.col("id").alias("lead"), F.col("sketch").alias("s2")), "lead")
    stars = cut(stars.select("lead", "id", (bits <= most_bits(FLOOR)).alias("near")))

    near = stars.where("near").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    sets = _sets(docs, near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), doc_id, text, width)
    links = cut(_confirm(near, sets, percent))
    links = _sparse(links)
    comps = components(links)

    # members of one leader that are in different components have not met yet
    label = stars.select("lead", "id").join(comps, "id", "left").select("lead", "id", F.coalesce("component", "id").alias("label"))
    sizes = label.groupBy("lead", "label").agg(F.count("*").alias("m"))
    open_leads = sizes.groupBy("lead").agg(F.sum("m").alias("all"), F.count("*").alias("kinds"), F.min(F.struct((-F.col("m")).alias("less"), "label")).alias("main")).where("kinds > 1")
    open_leads = open_leads.select("lead", F.col("main.label").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"))
    rows = label.join(_small(cut(open_leads)), "lead").join(sketches, "id")  # a leader may have any number of members
    place = F.array(F.struct(F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("asks")))
    asked = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("asks")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("label") == F.col("main"), place).otherwise(F.concat(place, asked))))
    rows = rows.select("lead", F.col("at.block").alias("block"), F.col("at.asks").alias("asks"), "id", "label", "n", "sketch")
    shape = _shape(rows, "lead", "block", "asks", "id", "label")
    arrow = to_arrow_schema(shape)
    left = cut(rows.repartition("lead", "block").sortWithinPartitions("lead", "block", "asks").mapInArrow(lambda b: _by_sketch(b, percent, arrow), shape))
    if not left.isEmpty():
        sets = _sets(docs, left.select("id").distinct(), doc_id, text, width)
        rows = left.join(sets, "id").select("lead", "block", "asks", "id", "label", "set").repartition("lead", "block").sortWithinPartitions("lead", "block", "asks")
        pair = _shape(links, "a", "b")
        two = to_arrow_schema(pair)
        more = cut(rows.mapInArrow(lambda b: _by_sets(b, percent, two), pair))
        if not more.isEmpty():
            comps = components(links.union(more))

    found = found.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    rows = signs.select("doc_id", F.col("n").alias("n_shingles"), "print").join(found, "print", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` less all but the smallest id of each class; of rows that share this id the first stays, by text and then the other columns.

    Rows with a null id stay.
    """
    kind = _kind(docs, doc_id)
    kept = cut(classes(docs.where(F.col(doc_id).isNotNull()), doc_id, text, width, percent).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("__copies")))
    kept = kept.withColumnRenamed("doc_id", "__kept_id")
    on = F.col(f"`{doc_id}`").cast(kind) == F.col("__kept_id")
    single = docs.join(_small(kept.where("__copies = 1").select("__kept_id")), on, "left_semi")
    several = docs.join(_small(kept.where("__copies > 1").select("__kept_id")), on, "left_semi")
    order = [text] + [f.name for f in docs.schema if f.name != text and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    first = several.withColumn("__first", F.row_number().over(Window.partitionBy(doc_id).orderBy(*[F.col(f"`{c}`") for c in order]))).where("__first = 1").drop("__first")
    return single.union(first).union(docs.where(F.col(doc_id).isNull()))


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
