import importlib
import re

import numpy as np
import pytest

from quillgraph.llm.tokens import TOKENIZER, Encoder, allot, attribute


@pytest.fixture(scope="module")
def encoder():
    with open(TOKENIZER, "rb") as f:
        return Encoder(f.read(), importlib.import_module("public_tokenizers").PATTERN)


TEXTS = ["Hello world\nsecond line\n\nlast é😀 line", None, "", "\n", "a" * 5000 + "\n" + "b c " * 5000, "no end\n"]


def test_lines_add_up_to_the_whole(spark, encoder):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1)], "doc_id long, text string, section int")
    rows = attribute(df).collect()
    for i, t in enumerate(TEXTS):
        own = [r for r in rows if r.doc_id == i]
        copies = 2 if i == 0 else 1
        assert sum(r.n_tokens for r in own) == copies * len(encoder.sizes(t or ""))
        lines = (t or "").splitlines(keepends=True) or [""]
        assert sorted((r.section, r.start, r.end) for r in own)[::copies] == [(k, sum(map(len, lines[:k])), sum(map(len, lines[: k + 1]))) for k in range(len(lines))]


@pytest.mark.parametrize("rule", ["largest", "first", "last"])
def test_boundaries_by_brute_force(rule):
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(1, 6, 12)
        cuts = np.sort(rng.choice(sizes.sum() + 1, 6, replace=False))
        starts, ends = cuts[::2], cuts[1::2]
        stop = np.cumsum(sizes)
        want = []
        for a, b in zip(stop - sizes, stop, strict=True):
            inside = [k for byte in range(a, b) for k in range(3) if starts[k] <= byte < ends[k]]
            at = {"first": [k for k in range(3) if starts[k] <= a < ends[k]], "last": [k for k in range(3) if starts[k] <= b - 1 < ends[k]]}.get(rule)
            if at is None:
                at = [max(sorted(set(inside)), key=inside.count)] if inside else []
            want.append(at[0] if at else -1)
        assert allot(sizes, starts, ends, rule).tolist() == want


def test_given_spans_gaps_and_nulls(spark, encoder):
    rows = [(1, "alpha beta gamma", [(0, 5), (10, 400)]), (2, "alpha", None), (3, None, [(0, 3)]), (4, "alpha beta", [(None, None), (0, 8), (4, 10)]), (5, "é😀é", [(0, 1), (1, 2), (2, 3)])]
    out = attribute(spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<s:int,e:int>>"), spans="parts").collect()
    for i, t, _ in rows:
        assert sum(r.n_tokens for r in out if r.doc_id == i) == len(encoder.sizes(t or ""))
    assert [(r.section, r.n_tokens) for r in out if r.doc_id == 2] == [(-1, len(encoder.sizes("alpha")))]
    assert [(r.start, r.end) for r in sorted(out, key=lambda r: r.section) if r.doc_id == 1 and r.section >= 0] == [(0, 5), (10, 16)]
    assert attribute(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        attribute(spark.createDataFrame([], "doc_id long, text string"), rule="other")


def test_long_runs_are_encoded_as_the_pattern_has_them(encoder, monkeypatch):
    from quillgraph.llm import tokens

    for text in ("a" + " " * 300 + "b", "\n" * 257 + "  c", " " * 400, "x\t" + " \n" * 150 + "y z" + " " * 299 + "'s", "end" + " " * 250):
        monkeypatch.setattr(tokens, "LONG_SPACE", 10**9)
        whole = encoder.sizes(text).tolist()
        monkeypatch.setattr(tokens, "LONG_SPACE", 200)
        assert encoder.sizes(text).tolist() == whole


def test_a_million_characters_without_a_break(spark):
    texts = ["a" * 1_000_000, " " * 1_200_000 + "end", "\n" * 700_000, "!" * 1_000_000]
    rows = attribute(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).groupBy("doc_id").sum("n_tokens", "section").collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3} and all(r["sum(n_tokens)"] > 0 for r in rows)


def test_what_is_missing_is_told(spark, monkeypatch):
    from quillgraph.llm import tokens

    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="no tokenizer file"):
        attribute(df, tokenizer="/nowhere")
    monkeypatch.setattr(tokens, "PATTERN_OF", "no_such_module")
    with pytest.raises(ValueError, match="pattern"):
        attribute(df)
