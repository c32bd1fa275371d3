"""Language-model scoring by prediction by partial matching over bytes, beside a unigram base score.

Training counts every byte with its five predecessors in all training texts, and every word. All contexts of up to
five bytes that training saw make the model, whatever their number. A byte's probability follows its longest known
context: counts over counts plus distinct symbols, an escape in proportion to the distinct symbols, and on each
shorter context only the symbols not yet excluded; at last equal shares of what no context has seen. Byte 255, which
UTF-8 never uses, stands before the start and ends a text.
A probability depends on the byte and its five predecessors alone, so each distinct six bytes of the scored texts (a
gram) are weighed once, where all grams that share the context's last two bytes lie together: these have all longer
contexts' counts. Shorter contexts are a table of fixed size. A text's code length is a sum of its grams' weights:
the most frequent grams', ``nodes`` at most, are broadcast; the others meet their weights in a shuffle join, in
which no gram is frequent. ``nodes`` sets what is sent, not the result.

Base score: add-0.1 unigrams over lower-cased words and one end token. Counts of the most frequent words, ``head``
at most, are broadcast; the other words of each text meet their counts in a shuffle join, in which
no word is frequent.

Defined results
  null or empty text: one end token, and the code of an end after a start. No training text: N is 0, all words
  unknown, and equal shares for all bytes. Repeated ids or rows: one row each. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import ASCII_LOWER, cut, small_batches

ORDER = 5
#: Grams whose weights are broadcast.
NODES = 1 << 20
HEAD = 131_072
EDGE = 255
SEGMENT = 1 << 20
FLUSH = 400_000
#: Rows weighed at once, or one group of the last two bytes if it is larger.
WEIGHED = 300_000

PAD = bytes([EDGE]) * ORDER


def word_list(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(ASCII_LOWER).split() if text else []


def grams(data: bytes) -> np.ndarray:
    """Each byte with its ``ORDER`` predecessors, as one integer; ``data`` is padded already."""
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(a) - ORDER
    code = a[:n].copy()
    for k in range(1, ORDER + 1):
        code <<= 8
        code |= a[k : k + n]
    return code


def pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Padded stretches of about ``SEGMENT`` bytes: the bytes, the texts they belong to and where each text's part starts."""
    parts, whose, starts, size = [], [], [], 0
    for k, t in enumerate(texts):
        t += bytes([EDGE])
        before = PAD
        for i in range(0, len(t), SEGMENT):
            part = before + t[i : i + SEGMENT]
            before = part[-ORDER:]
            if size and size + len(part) > SEGMENT:
                yield b"".join(parts), whose, starts
                parts, whose, starts, size = [], [], [], 0
            parts.append(part)
            whose.append(k)
            starts.append(size)
            size += len(part)
    if parts:
        yield b"".join(parts), whose, starts


def _own(size: int, starts: list[int]) -> np.ndarray:
    """Which of the stretch's grams lie in one text: those whose first byte is not in another text's tail."""
    keep = np.ones(size - ORDER, bool)
    for s in starts[1:]:
        keep[s - ORDER : s] = False
    return keep


def count(docs: DataFrame, text: str = "text", held_out: str = "held_out") -> DataFrame:
    """gram (null for words), word (null for grams), n: over rows not held out, m: over all rows (grams). Row (null, null) counts texts.

    Words that only rows held out have are not listed.
    """
    small_batches(docs.sparkSession)
    names = ["gram", "word", "n", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[bytes] = Counter()
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = rows = 0

        def merge() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if not waiting:
                return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            keys, n, m = (np.concatenate(c) for c in zip(*waiting, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, n, m = keys[order], n[order], m[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[first], np.add.reduceat(n, first), np.add.reduceat(m, first)

        def out(k: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(len(k), pa.binary()), pa.array(n), pa.array(m)], names=names)

        def out_words() -> pa.RecordBatch:
            n = pa.array(list(tally.values()), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.nulls(len(tally), pa.int64()), pa.array(list(tally), pa.binary()), n, n], names=names)
            tally.clear()
            return made

        for batch in batches:
            texts, apart = [(t or "") for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            learnt = [t for t, h in zip(texts, apart, strict=True) if not h]
            rows += len(learnt)
            for t in learnt:
                tally.update(word_list(t))
            if len(tally) > FLUSH:
                yield out_words()
            for part, times in ((learnt, 1), ([t for t, h in zip(texts, apart, strict=True) if h], 0)):
                for data, _, starts in pieces([t.encode("utf-8", "replace") for t in part]):
                    k, m = np.unique(grams(data)[_own(len(data), starts)], return_counts=True)
                    waiting.append((k, m * times, m))
                    held += len(k)
            if held > 4 * FLUSH:
                k, n, m = merge()
                if len(k) > 2 * FLUSH:
                    yield out(k, n, m)
                    waiting, held = [], 0
                else:
                    waiting, held = [(k, n, m)], len(k)
        k, n, m = merge()
        for i in range(0, len(k), 100_000):
            yield out(k[i : i + 100_000], n[i : i + 100_000], m[i : i + 100_000])
        if tally:
            yield out_words()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([rows], pa.int64()), pa.array([rows], pa.int64())], names=names)

    found = docs.select(F.col(text), F.col(held_out)).mapInArrow(run, "gram long, word binary, n long, m long")
    return found.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def weights(code: np.ndarray, n: np.ndarray, short: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's last byte after the others.

    ``code``, ``n``: distinct grams and their counts, with every gram that shares the last two bytes of a context. ``short``: the
    counts [byte before, byte] of all grams.
    """
    p, mass = np.zeros(len(code)), np.ones(len(code))
    known = np.zeros(len(code), bool)
    # of the next longer context's symbols: how many, and their counts in this context
    kinds_out, total_out = np.zeros(len(code)), np.zeros(len(code))
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # per order: distinct (context, symbol), counts, which of them a gram has
    for k in range(ORDER + 1):
        if k < 2:
            at = code & ((1 << 8 * (k + 1)) - 1)
            table = (short.sum(0) if k == 0 else short.reshape(-1)).astype(np.int64)
            pairs.append((np.arange(len(table)), table, at))
        else:
            keys, at = np.unique(code & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            pairs.append((keys, np.bincount(at, n, len(keys)).astype(np.int64), at))
    for k in range(ORDER, -1, -1):
        keys, times, at = pairs[k]
        _, context = np.unique(keys >> 8, return_inverse=True)
        count_of, kinds_of = np.bincount(context, times), np.bincount(context, times > 0)
        mine, own = times[at], context[at]
        total, kinds = count_of[own] - total_out, kinds_of[own] - kinds_out
        below = np.maximum(total + kinds, 1)
        hit = ~known & (mine > 0)
        p[hit] = (mass * mine / below)[hit]
        known |= hit
        mass = np.where(kinds > 0, mass * kinds / below, mass)
        kinds_out = kinds_of[own]
        if k:
            upper, up, _ = pairs[k - 1]
            in_upper = up[np.searchsorted(upper, keys & ((1 << 8 * k) - 1))]
            total_out = np.bincount(context, np.where(times > 0, in_upper, 0))[own]
    p = np.where(known, p, mass / np.maximum(256 - kinds_out, 1))
    return np.log10(p)


def weigh(counts: DataFrame) -> DataFrame:
    """gram, m, code of every gram of ``counts``."""
    of = counts.where("gram is not null").select("gram", "n", "m")
    short = np.zeros((256, 256), np.int64)
    for r in of.groupBy(F.shiftright("gram", 8).bitwiseAND(F.lit(255)).alias("a"), F.col("gram").bitwiseAND(F.lit(255)).alias("b")).agg(F.sum("n").alias("n")).collect():
        short[r.a, r.b] = r.n
    least = WEIGHED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            code, n, m = (np.concatenate(c) for c in zip(*waiting, strict=True))
            made = weights(code, n, short)
            for i in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in (code, m, made)], names=["gram", "m", "code"])

        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            part = tuple(c.to_numpy() for c in batch.columns)
            if held > least:
                last = int(waiting[-1][0][-1]) >> 8 & 65_535
                same = int(np.searchsorted((part[0] >> 8 & 65_535) != last, True))
                if same < len(part[0]):
                    waiting.append(tuple(c[:same] for c in part))
                    yield from out()
                    waiting, held, part = [], 0, tuple(c[same:] for c in part)
            waiting.append(part)
            held += len(part[0])
        if held:
            yield from out()

    tail = F.shiftright("gram", 8).bitwiseAND(F.lit(65_535))
    return of.repartition(tail).sortWithinPartitions(tail).mapInArrow(run, "gram long, m long, code double")


def _most(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of the largest ``n``, ``limit`` at most: as many whole classes of counts (16 to a doubling) as fit.

    Unlike a sort with a limit, no task gathers candidates from all partitions. What is as frequent as a chosen row, or more, is
    chosen too.
    """
    kind = F.floor(F.log2("n") * 16)
    bound, total = None, 0
    for r in sorted(rows.groupBy(kind.alias("kind")).count().collect(), reverse=True):
        total += r["count"]
        if total > limit:
            break
        bound = r["kind"]
    return rows.where(kind >= bound) if bound is not None else rows.where("false")


class Grams:
    """Weights of the most frequent grams, sorted."""

    def __init__(self, code: np.ndarray, weight: np.ndarray):
        order = np.argsort(code)
        self.code, self.weight = code[order], weight[order]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's sum over the grams listed here; the other grams, and their numbers by text."""
        total, others, sizes = np.zeros(len(texts)), [], np.zeros(len(texts), np.int64)
        for data, whose, starts in pieces(texts):
            code, own = grams(data), _own(len(data), starts)
            order = np.argsort(code)  # sorted distinct grams are looked up far faster
            listed = code[order]
            first = np.flatnonzero(np.r_[True, listed[1:] != listed[:-1]])
            each, times = listed[first], np.diff(np.r_[first, len(listed)])
            found, weight = np.zeros(len(each), bool), np.zeros(len(each))
            if len(self.code):
                at = np.minimum(np.searchsorted(self.code, each), len(self.code) - 1)
                found = self.code[at] == each
                weight = np.where(found, self.weight[at], 0.0)
            hit, cost = np.empty(len(code), bool), np.empty(len(code))
            hit[order], cost[order] = np.repeat(found, times), np.repeat(weight, times)
            cost[~own] = 0
            np.add.at(total, whose, np.add.reduceat(cost, starts))
            rest = own & ~hit
            others.append(code[rest])
            np.add.at(sizes, whose, np.add.reduceat(rest.astype(np.int64), starts))
        return total, np.concatenate(others) if others else np.zeros(0, np.int64), sizes


class Head:
    """log10 of the count plus 0.1 of the most frequent words. Only the columns travel."""

    def __init__(self, words: pa.Array, counts: np.ndarray):
        self.words, self.counts = words, counts
        self.known: dict[bytes, float] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def table(self) -> dict[bytes, float]:
        if self.known is None:
            self.known = dict(zip(self.words.to_pylist(), np.log10(self.counts + 0.1).tolist(), strict=True))
        return self.known


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", nodes: int = NODES, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; rows where ``train`` holds are learnt from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (~train).alias("held_out"))
    counts = cut(count(rows))
    said = counts.agg(F.sum(F.when(F.col("gram").isNull(), F.col("n"))), F.count("word"), F.sum(F.when(F.col("gram").isNull() & F.col("word").isNull(), F.col("n")))).first()
    tokens, texts = said[0] or 0, said[2] or 0
    base = math.log10(tokens + 0.1 * (said[1] + (texts > 0) + 1))
    weighed = cut(weigh(counts))
    common = _most(weighed.withColumnRenamed("m", "n"), nodes).select("gram", "code").toArrow()
    words = counts.where("word is not null").select("word", "n")
    top = _most(words, head).toArrow()
    model = spark.sparkContext.broadcast((Grams(common["gram"].to_numpy(), common["code"].to_numpy()), Head(top["word"].combine_chunks(), top["n"].to_numpy())))
    end = math.log10(texts + 0.1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = model.value[0], model.value[1].table()
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            said = [(t or "") for t in batch.column(1).to_pylist()]
            codes, others, others_of = own.score([t.encode("utf-8", "replace") for t in said])
            sizes, sums, hits, offsets, rare, times = [], [], [], [0], [], []
            for t in said:
                listed = word_list(t)
                s, hit = end, int(texts > 0)
                for w, n in Counter(listed).items():
                    v = known.get(w)
                    if v is None:
                        rare.append(w)
                        times.append(n)
                    else:
                        s += n * v
                        hit += n
                sizes.append(len(listed) + 1)
                sums.append(s)
                hits.append(hit)
                offsets.append(len(rare))
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int32())], names=["word", "times"]))
            unlisted = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(others_of)], pa.int32()), pa.array(others, pa.int64()))
            ids = pa.array(range(row, row + len(said)), pa.int64())
            row += len(said)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(hits, pa.int64()), pa.array(codes, pa.float64()), rest, unlisted],
                names=["row", "doc_id", "held_out", "n_tokens", "head_sum", "head_known", "head_score", "rest", "grams"],
            )

    made = spark.range(0).selectExpr("id row", "true held_out", "id n_tokens", "0D head_sum", "id head_known", "0D head_score", "array(named_struct('word', X'00', 'times', 0)) rest", "array(id) grams").schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in (made[0], rows.schema["doc_id"], *made.fields[1:])])
    scored = cut(rows.mapInArrow(run, schema))
    rare = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    met = rare.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rest_sum"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"),
    )
    other = scored.select("row", F.explode("grams").alias("gram"))
    told = other.join(weighed.select("gram", "code"), "gram").groupBy("row").agg(F.sum("code").alias("rest_score"))
    return scored.drop("rest", "grams").join(met, "row", "left").join(told, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("rest_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("head_score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"),
    )
