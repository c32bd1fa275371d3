r"""Token counts by offset-mapped attribution.

Each whole text is encoded once. The tokens' byte lengths give their offsets, which are joined as intervals to the
text's sections. A token that crosses a boundary goes, whole, to one section by ``rule``: ``largest`` (the section that
holds most of its bytes, ties to the earlier), ``first`` or ``last`` (the section of its first or last byte). A token
outside all sections counts under section -1. So the counts of a text's sections add up to its tokens.

Sections are the text's lines, each with its line end, or the spans of a column of array<struct<start, end>> in code
points. Spans are taken in the order of their starts and cut off where the next one starts.

Defined results
  null or empty text: one section 0 of no tokens (lines), or its given spans with none. Texts of any length are whole.
  A run of white space that is too long for the pattern's engine is one piece, as patterns with ``\s+(?!\S)|\s+`` have it.
  null or empty spans column: no sections; all tokens are under -1, a row that only exists where tokens do.
  spans beyond the text are cut to it; null bounds: the span is empty at 0. Repeated ids and rows: rows for each.
"""

from __future__ import annotations

import base64
import importlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("largest", "first", "last")
#: Module that tells the tokenizer's pattern where none is given.
PATTERN_OF = "public_tokenizers"
#: White space as tokenizers' patterns know it, in runs that their engine may have no stack for.
LONG_SPACE = 50_000
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class Encoder:
    """A byte-level BPE from a file of ranks; the ranks travel, each process builds its own encoder."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks, self.pattern, self.ready = ranks, pattern, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ready": None}

    def sizes(self, text: str) -> np.ndarray:
        """The byte length of each token of ``text``, in order."""
        if self.ready is None:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines()) if a}
            length = np.zeros(max(table.values()) + 1, np.int64)
            for piece, rank in table.items():
                length[rank] = len(piece)
            self.ready = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=table, special_tokens={}), length
        encoding, length = self.ready
        if not text:
            return np.zeros(0, np.int64)
        parts, at = [], 0
        for m in re.finditer(f"{_SPACE}{{{LONG_SPACE},}}", text) if len(text) >= LONG_SPACE else ():
            # the last blank before a word goes with the word
            end = m.end() if m.end() == len(text) else m.end() - 1
            if m.start() > at:
                parts.append(encoding.encode_to_numpy(text[at : m.start()], disallowed_special=()))
            parts.append(np.array(encoding._encode_single_piece(text[m.start() : end]), np.int64))
            at = end
        if at < len(text):
            parts.append(encoding.encode_to_numpy(text[at:], disallowed_special=()))
        return length[np.concatenate(parts).astype(np.int64)]


def _pattern() -> str:
    try:
        return importlib.import_module(PATTERN_OF).PATTERN
    except ModuleNotFoundError as e:
        raise ValueError(f"give the tokenizer's pattern: there is no module {PATTERN_OF} to tell it") from e


def allot(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token (-1: none). Sections are byte spans in order that do not overlap."""
    stop = np.cumsum(sizes)
    start = stop - sizes
    if not len(starts):
        return np.full(len(sizes), -1)

    def at(byte: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, byte, "right") - 1
        return np.where((k >= 0) & (byte < ends[k]), k, -1)

    first, last = at(start), at(stop - 1)
    if rule != "largest":
        return first if rule == "first" else last
    out = first.copy()
    for i in np.flatnonzero((first != last) | (first < 0)).tolist():  # tokens at boundaries: few
        a, b = np.searchsorted(ends, start[i], "right"), np.searchsorted(starts, stop[i], "left")
        share = np.minimum(ends[a:b], stop[i]) - np.maximum(starts[a:b], start[i])
        inside = int(share.max()) if len(share) else 0
        out[i] = a + int(share.argmax()) if inside > 0 else -1
    return out


def attribute(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spans: str | None = None, rule: str = "largest", tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """doc_id, section (from 0; -1: outside), start, end (code points), n_tokens: a row for each section of each row."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spark = docs.sparkSession
    if not os.path.isfile(tokenizer):
        raise ValueError(f"no tokenizer file {tokenizer}: give the path of a file of ranks, base64 and number a line")
    pattern = pattern or _pattern()
    with open(tokenizer, "rb") as file:
        encoder = spark.sparkContext.broadcast(Encoder(file.read(), pattern))
    small_batches(spark)
    given = F.col(spans).cast("array<struct<start:bigint,end:bigint>>") if spans else F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), given.alias("spans"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("section", "start", "end", "n_tokens"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, parts = [], []
            for k, (said, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist() if spans else [None] * len(batch), strict=True)):
                said = said or ""
                raw = np.frombuffer(said.encode("utf-8", "replace"), np.uint8)
                lead = (raw & 0xC0) != 0x80
                if spans:
                    n = len(said)
                    chars = sorted((max(0, min(n, (s or {}).get("start") or 0)), max(0, min(n, (s or {}).get("end") or 0))) for s in own or [])
                    a = np.array([c[0] for c in chars], np.int64)
                    b = np.maximum(a, np.minimum(np.array([c[1] for c in chars], np.int64), np.r_[a[1:], n])) if len(a) else a
                    place = np.r_[np.flatnonzero(lead), len(raw)]
                    starts, ends = place[a], place[b]
                else:
                    cut = np.flatnonzero(raw == 10) + 1
                    cut = cut[cut < len(raw)]
                    starts, ends = np.r_[0, cut], np.r_[cut, len(raw)]
                    seen = np.r_[0, np.cumsum(lead)]
                    a, b = seen[starts], seen[ends]
                own_section = allot(encoder.value.sizes(said), starts, ends, rule)
                n_tokens = np.bincount(own_section + 1, minlength=len(starts) + 1)
                section = np.arange(len(starts))
                if n_tokens[0]:
                    section, a, b, n_tokens = np.r_[-1, section], np.r_[0, a], np.r_[0, b], n_tokens
                else:
                    n_tokens = n_tokens[1:]
                which.append(np.full(len(section), k))
                parts.append((section, a, b, n_tokens))
            if parts:
                ids = batch.column(0).take(pa.array(np.concatenate(which)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate([p[i] for p in parts]), pa.int64()) for i in range(4))], names=schema.names)

    return rows.mapInArrow(run, schema)
