"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash, are cut into blocks. A source of weight w (its share of all
weights, in ``grain``-ths) releases its i-th block at slot floor(i / w) and must have it placed by slot
ceil((i + 1) / w). Of the released blocks the one with the earliest deadline takes the next slot. At every slot each
source then has its share of the slots, less or more by less than one block. The weights are fractions of the grain, so
the schedule repeats after ``grain`` slots: one period is worked out and every block finds its slot by arithmetic.
The grain is ``FINE`` times the number of sources at least, so that a source of the least share, one part, has
a small part of the mean weight; targets below it are raised to it. One row a source and one number a
slot of the period lie on the driver and are broadcast: what these can hold is the limit to the number of sources.

All rows are kept. Sources that run dry leave their slots empty; ``in_mix`` marks the slots before the first source
runs dry, where the target weights hold.

Defined results
  null source: a source of its own. Sources without a weight: ``ValueError`` where weights are given; by default a
  source weighs the square root of its rows. Weights are rounded to the grain, each at least one of it.
  repeated ids and rows: each is a row of its own; equal rows may change places. Columns named like an added one are
  replaced; others stay.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, without

GRAIN = 10_000
BLOCK = 8
#: Rows of a source that one bucket holds on average.
BUCKET_ROWS = 4_000
#: Parts of the grain that a source of mean weight has at least.
FINE = 64

ADDED = ["block_no", "block_row", "release", "deadline", "slot", "position", "in_mix"]


def shares(weights: dict[str | None, float], grain: int = GRAIN) -> dict[str | None, int]:
    """Whole parts of the grain, by largest remainders; each source has one at least."""
    if len(weights) > grain:
        raise ValueError(f"{len(weights)} sources, but a grain of {grain}")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be above 0")
    whole = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) / whole * (grain - len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    rest = grain - sum(out.values())
    for s in sorted(out, key=lambda s: (int(exact[s]) - exact[s], s is None, s or ""))[:rest]:
        out[s] += 1
    return out


def period(parts: dict[str | None, int], grain: int = GRAIN) -> dict[str | None, list[int]]:
    """Slots of each source's blocks in one period, by earliest deadline first among the released."""
    names = sorted(parts, key=lambda s: (s is None, s or ""))
    due: list[tuple[int, int]] = []
    coming = [(0, k) for k in range(len(names))]
    heapq.heapify(coming)
    done = [0] * len(names)
    out: dict[str | None, list[int]] = {s: [] for s in names}
    for slot in range(grain):
        while coming and coming[0][0] <= slot:
            _, k = heapq.heappop(coming)
            heapq.heappush(due, (-(-(done[k] + 1) * grain // parts[names[k]]), k))
        _, k = heapq.heappop(due)  # the parts fill the grain, so something is always due
        out[names[k]].append(slot)
        done[k] += 1
        if done[k] < parts[names[k]]:
            heapq.heappush(coming, (done[k] * grain // parts[names[k]], k))
    return out


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", doc_id: str = "doc_id", block: int = BLOCK, grain: int = GRAIN) -> DataFrame:
    """``docs`` with block_no, block_row, release, deadline, slot, position (the order to read in) and in_mix."""
    spark = docs.sparkSession
    rows = without(docs, ADDED)
    src, ident = F.col(f"`{source}`"), F.col(f"`{doc_id}`")
    key = F.coalesce(F.concat(F.lit("s"), src.cast("string")), F.lit("n"))  # never null, so that it joins as it is partitioned
    listed = rows.groupBy(src.cast("string").alias("source")).agg(F.count("*").alias("n")).collect()
    sizes = {r.source: r.n for r in listed}
    if weights is None:
        weights = {s: n**0.5 for s, n in sizes.items()}
    elif missing := set(sizes) - set(weights):
        raise ValueError(f"sources without a weight: {sorted(map(str, missing))[:5]}")
    grain = max(grain, FINE * len(weights))
    parts = shares(weights, grain) if weights else {}
    slots = period(parts, grain) if parts else {}
    blocks = {s: -(-n // block) for s, n in sizes.items()}

    def slot_of(s: str | None, i: int) -> int:
        return i // parts[s] * grain + slots[s][i % parts[s]]

    dry = min((slot_of(s, blocks.get(s, 0)) for s in parts), default=0)
    plan = [("n" if s is None else "s" + s, -(-n // BUCKET_ROWS), parts[s], slots[s]) for s, n in sizes.items()]
    table = F.broadcast(spark.createDataFrame(plan, "__mix_k string, __mix_buckets long, __mix_parts long, __mix_slots array<long>"))
    # a source's documents are numbered bucket by bucket, so that no task holds a whole source
    keyed = rows.withColumn("__mix_k", key).withColumn("__mix_hash", F.xxhash64(ident.cast("string"), F.lit("mix")))
    dealt = _dealt(keyed, table)
    largest = dealt.groupBy("__mix_k", "__mix_bucket").count().agg(F.max("count")).first()[0] or 0
    if largest > 16 * BUCKET_ROWS:  # one id, or a null one, has many rows: these are dealt by a number of their own, written down first
        dealt = _dealt(cut(keyed.withColumn("__mix_hash", F.xxhash64("__mix_hash", F.monotonically_increasing_id()))), table)
    before = Window.partitionBy("__mix_k").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__mix_k", "__mix_bucket").agg(F.count("*").alias("n")).select("__mix_k", "__mix_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__mix_from"))
    numbered = dealt.withColumn("__mix_n", F.row_number().over(Window.partitionBy("__mix_k", "__mix_bucket").orderBy("__mix_hash", ident)) - 1)
    numbered = numbered.join(starts, ["__mix_k", "__mix_bucket"]).join(table.select("__mix_k", "__mix_parts", "__mix_slots"), "__mix_k").withColumn("__mix_n", (F.col("__mix_n") + F.col("__mix_from")).cast("long"))
    no = F.floor(F.col("__mix_n") / block).cast("long")
    put = numbered.withColumn("block_no", no).withColumn("block_row", (F.col("__mix_n") % block).cast("long"))
    put = put.withColumn("release", F.floor(F.col("block_no") * grain / F.col("__mix_parts")).cast("long")).withColumn("deadline", F.ceil((F.col("block_no") + 1) * grain / F.col("__mix_parts")).cast("long"))
    put = put.withColumn("slot", (F.floor(F.col("block_no") / F.col("__mix_parts")) * grain + F.expr("__mix_slots[cast(block_no % __mix_parts as int)]")).cast("long"))
    put = put.withColumn("position", F.col("slot") * block + F.col("block_row")).withColumn("in_mix", F.col("slot") < dry)
    return put.select([F.col(f"`{c}`") for c in rows.columns + ADDED])


def _dealt(keyed: DataFrame, table: DataFrame) -> DataFrame:
    return keyed.join(table.select("__mix_k", "__mix_buckets"), "__mix_k").withColumn("__mix_bucket", F.pmod("__mix_hash", "__mix_buckets"))
