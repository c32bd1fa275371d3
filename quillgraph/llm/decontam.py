"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is built over the words of all benchmark items. Each document streams through it once, word by
word, and the length of the longest suffix that some item also holds is tracked. Where this length reaches the
window, the words of the window are hit; an item shorter than the window counts as one window of its own.

Defined results
  null or empty text, or a text without words: 0 words, no hit, no items.
  null, empty or wordless item: takes no part. A null item_id: its windows hit, but no id is listed.
  repeated items or ids: an id is listed once. Repeated documents: one row each, the same result.
  columns of ``docs`` named like an added column are replaced; all others stay as they are.
An automaton is built on the driver and broadcast as integer arrays, some 100 bytes a word and as much again for each
distinct word; building takes some 900 bytes a word. It holds at most about ``max_words`` item words. A larger benchmark is dealt into
several automata: items beyond a tenth of an automaton in pieces that overlap by a window less a word. Then the documents
are written once, each automaton finds its hits in them, and only these, by row number, are put together.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import cut, map_batches, small_batches, without

WINDOW = 10
MAX_WORDS = 200_000

#: Bytes: A-Z become a-z; other ASCII that is neither digit nor letter becomes a blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


class _Building:
    """States as rows of parallel lists while they are made."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _state(self, moves: dict[int, int], length: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone


class SuffixAutomaton:
    """Of several word sequences, as arrays; state 0 is the root. The moves of state s are those from first[s] to first[s + 1], by word."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        built = _Building()
        self.names = [name for name, _ in items]
        self.shortest = window
        paths = []
        for k, (_, item) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in item]
            at = 0
            for w in ids:
                at = built.extend(at, w)
            paths.append((k, ids))
            self.shortest = min(self.shortest, len(ids))
        nxt, link, length = built.next, built.link, built.length
        ends: dict[int, set[int]] = {}  # items that have an end of this state's words, where these fill a window
        whole: dict[int, set[int]] = {}
        for k, ids in paths:  # prefixes' states are looked up anew, as later items may have split them
            at = 0
            for w in ids:
                at = nxt[at][w]
                if length[at] >= window:
                    ends.setdefault(at, set()).add(k)
            if len(ids) < window:
                whole.setdefault(at, set()).add(k)
        order = sorted(range(1, len(length)), key=length.__getitem__)
        for s in reversed(order):
            if length[link[s]] >= window:
                ends.setdefault(link[s], set()).update(ends.get(s, ()))
        # what a match at a state says: items with the last `window` words, and short items that end here
        listed: dict[frozenset[int], int] = {frozenset(): 0}
        self.full = array("i", bytes(4 * len(length)))
        short: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(length)
        for s in order:
            up = link[s]
            if length[s] >= window:
                self.full[s] = self.full[up] if length[up] >= window else listed.setdefault(frozenset(ends.get(s, ())), len(listed))
            short[s] = short[up] + (((length[s], frozenset(whole[s])),) if s in whole else ())
        self.sets = list(listed)
        self.short = {s: x for s, x in enumerate(short) if x}
        self.link, self.length = array("i", link), array("i", length)
        self.first, self.word, self.to = array("i", [0]), array("i"), array("i")
        for moves in nxt:
            for w in sorted(moves):
                self.word.append(w)
                self.to.append(moves[w])
            self.first.append(len(self.word))

    def _move(self, state: int, w: int) -> int:
        """The state after ``w``, or -1."""
        a, b = self.first[state], self.first[state + 1]
        at = bisect_left(self.word, w, a, b)
        return self.to[at] if at < b and self.word[at] == w else -1

    def hits(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of word positions (end exclusive, merged), and the items with an occurring window."""
        ids = np.fromiter(map(self.vocab.get, tokens, (0,) * len(tokens)), np.int64, len(tokens)) if tokens else np.zeros(0, np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        move, link, length, window = self._move, self.link, self.length, self.window
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue  # a match cannot hold an unknown word
            state = size = 0
            for i, w in enumerate(ids[a:b].tolist(), a + 1):
                to = move(state, w)
                while to < 0 and state:
                    state = link[state]
                    size = length[state]
                    to = move(state, w)
                state = max(to, 0)
                size = size + 1 if state else 0
                took = 0
                if size >= window:
                    at = state
                    while length[link[at]] >= size:
                        at = link[at]
                    found |= self.sets[self.full[at]]
                    took = window
                for n, whose in self.short.get(state, ()):
                    if n <= size:
                        found |= whose
                        took = max(took, n)
                if took:
                    if spans and i - took <= spans[-1][1]:
                        a0 = min(spans[-1][0], i - took)
                        spans[-1] = (a0, i)
                        while len(spans) > 1 and spans[-2][1] >= a0:
                            spans[-2:] = [(min(spans[-2][0], a0), i)]
                    else:
                        spans.append((i - took, i))
        return spans, found


ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (ids as sorted strings) and hit_spans (code points [start, end) of merged hits)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t")).where("t is not null").distinct()
    most, out = max(max_words // 10, window), without(docs, ADDED.names)
    pieces = items.mapInArrow(lambda batches: _pieces(batches, window, most), "id string, n long, words binary")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    groups = -(-total // max_words) or 1
    if groups == 1:
        model = docs.sparkSession.sparkContext.broadcast(_automaton(pieces, window))
        return map_batches(out, ADDED, lambda batch: _told(batch.column(text).to_pylist(), model.value, None), _with(keep, text))
    pieces = cut(pieces)
    rows = cut(out.select(*[F.col(f"`{c}`") for c in (out.columns if keep is None else _with(keep, text))], F.monotonically_increasing_id().alias("__row")))
    found = None
    for g in range(groups):
        part = _found(rows, _automaton(pieces.where(F.pmod(F.xxhash64("words"), F.lit(groups)) == g), window), text)
        found = part if found is None else found.union(part)
    merged = found.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
    joined = rows.join(merged, "__row", "left")
    told = map_batches(joined, ADDED, lambda batch: _told(batch.column(text).to_pylist(), None, (batch.column("__spans").to_pylist(), batch.column("__items").to_pylist())))
    return told.drop("__row", "__spans", "__items")


def _with(keep: list[str] | None, text: str) -> list[str] | None:
    return None if keep is None else keep + ([] if text in keep else [text])


def _pieces(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """id, n, words (joined by blanks) of each item, in overlapping pieces of at most ``most`` words."""
    for batch in batches:
        rows = []
        for name, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = words(t)
            for a in range(0, max(len(own) - window + 1, 1) if own else 0, max(most - window + 1, 1)):
                part = own[a : a + most]
                rows.append((name, len(part), b" ".join(part)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["id", "n", "words"])


def _automaton(pieces: DataFrame, window: int) -> SuffixAutomaton:
    listed = pieces.select("id", "words").distinct().toArrow()
    items = zip(listed["id"].to_pylist(), listed["words"].to_pylist(), strict=True)
    return SuffixAutomaton(sorted(((name, w.split()) for name, w in items), key=lambda x: (x[0] or "", x[1])), window)


def _found(rows: DataFrame, automaton: SuffixAutomaton, text: str) -> DataFrame:
    """__row, spans (of word positions) and items of the documents that are hit."""
    small_batches(rows.sparkSession)
    model = rows.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, where, named = [], [], []
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans, items = model.value.hits(words(t))
                if spans:
                    at.append(row)
                    where.append([list(s) for s in spans])
                    named.append(sorted({model.value.names[i] for i in items} - {None}))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(where, pa.list_(pa.list_(pa.int64()))), pa.array(named, pa.list_(pa.string()))], names=["__row", "spans", "items"])

    return cut(rows.select("__row", F.col(f"`{text}`")).mapInArrow(run, "__row long, spans array<array<long>>, items array<string>"))


def _told(texts: list[str | None], automaton: SuffixAutomaton | None, given: tuple[list, list] | None) -> list[pa.Array]:
    """The added columns, from an automaton or from ``given`` spans of word positions and items."""
    n_words, n_hit, named, where = [], [], [], []
    for k, t in enumerate(texts):
        tokens = words(t)
        if given is None:
            spans, found = automaton.hits(tokens)
            names = sorted({automaton.names[i] for i in found} - {None})
        else:
            spans, names = _joined(given[0][k] or []), given[1][k] or []
        chars: list[list[int]] = []
        if spans:
            at = [m.span() for m in WORD.finditer(t.translate(LOWER))]
            chars = [[at[a][0], at[b - 1][1]] for a, b in spans]
        n_words.append(len(tokens))
        n_hit.append(sum(b - a for a, b in spans))
        named.append(names)
        where.append(chars)
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(where, pa.list_(pa.list_(pa.int64())))]


def _joined(spans: list) -> list[tuple[int, int]]:
    """The same positions by spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove(annotated: DataFrame, text: str = "text", max_coverage: float = 0.5) -> DataFrame:
    """Takes the hit spans out of the text; a document with more than ``max_coverage`` of its words hit goes whole.

    Documents without a hit stay as they are, with or without words. The added columns are dropped.
    """
    cutout = F.expr(
        f"""concat_ws('', transform(sequence(0, size(hit_spans)), i -> substring(`{text}`,
            cast(if(i = 0, 1, hit_spans[i - 1][1] + 1) as int),
            cast(if(i = size(hit_spans), length(`{text}`), hit_spans[i][0]) - if(i = 0, 0, hit_spans[i - 1][1]) as int))))"""
    )
    kept = annotated.where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    return kept.withColumn(text, F.when(F.col("n_hit") > 0, cutout).otherwise(F.col(text))).drop(*ADDED.names)
