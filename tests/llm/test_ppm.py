import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import ppm
from quillgraph.llm.ppm import score

TEXTS = ["the cat sat on the mat", "The dog sat on the log", "the cat and the dog", "", None, "zebra é😀 quilt", "the the the", "a" * 3000] * 3


def model(texts):
    """A plain PPM: counts of all contexts up to ORDER bytes."""
    counts = defaultdict(Counter)
    for t in texts:
        data = ppm.PAD + t.encode() + b"\xff"
        for i in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                counts[data[i - k : i]][data[i]] += 1
    return counts


def log10_probability(text, counts):
    data = ppm.PAD + text.encode() + b"\xff"
    total = 0.0
    for i in range(ppm.ORDER, len(data)):
        seen, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            c = {s: n for s, n in counts.get(data[i - k : i], {}).items() if s not in seen}
            if not c:
                continue
            whole = sum(c.values()) + len(c)
            if data[i] in c:
                p *= c[data[i]] / whole
                break
            p *= len(c) / whole
            seen |= set(c)
        else:
            p /= 256 - len(seen)
        total += math.log10(p)
    return total


def run(spark, texts, nodes=ppm.NODES, head=ppm.HEAD):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    return {r.doc_id: r for r in score(df, F.col("doc_id") % 4 != 0, nodes=nodes, head=head).collect()}


@pytest.mark.parametrize("head", [2, ppm.HEAD])
def test_base_and_model_as_brute_force(spark, head):
    got = run(spark, TEXTS, head=head)
    train = [t or "" for i, t in enumerate(TEXTS) if i % 4]
    words = Counter(w for t in train for w in [*t.encode().lower().split(), None])
    n, v = sum(words.values()), len(words)
    counts = model(train)
    for i, t in enumerate(TEXTS):
        said = [*(t or "").encode().lower().split(), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (i % 4 == 0, len(said), n)
        assert r.n_known == sum(words[w] > 0 for w in said)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in said), rel=1e-9)
        assert r.score == pytest.approx(log10_probability(t or "", counts), rel=1e-4)


@pytest.mark.parametrize("nodes", [1, 40])
def test_every_context_counts_whatever_is_broadcast(spark, monkeypatch, nodes):
    monkeypatch.setattr(ppm, "WEIGHED", 5)
    got = run(spark, TEXTS, nodes=nodes)
    counts = model([t or "" for i, t in enumerate(TEXTS) if i % 4])
    for i, t in enumerate(TEXTS):
        assert got[i].score == pytest.approx(log10_probability(t or "", counts), rel=1e-9)


def test_long_texts_in_segments(spark, monkeypatch):
    whole = run(spark, TEXTS)
    trie_texts = [t.encode() for t in ("the cat sat", "a" * 5000, "")]
    assert [len(list(ppm.pieces(trie_texts)))] == [1]
    monkeypatch.setattr(ppm, "SEGMENT", 64)
    assert len(list(ppm.pieces(trie_texts))) > 50
    grams = [g for data, _, starts in ppm.pieces(trie_texts) for g in ppm.grams(data)[ppm._own(len(data), starts)].tolist()]
    monkeypatch.undo()
    once = [g for data, _, starts in ppm.pieces(trie_texts) for g in ppm.grams(data)[ppm._own(len(data), starts)].tolist()]
    assert Counter(grams) == Counter(once) and whole[0].score < 0


def test_no_training_text_and_empty(spark):
    df = spark.createDataFrame([(1, "ab"), (None, None)], "doc_id long, text string")
    rows = score(df, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known) for r in rows} == {(0, 0)}
    assert sorted(round(r.score, 4) for r in rows) == [round(3 * -math.log10(256), 4), round(-math.log10(256), 4)]
    assert score(df.where("false"), F.lit(True)).count() == 0
