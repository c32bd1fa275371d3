import random

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import neardup
from quillgraph.llm.components import components
from quillgraph.llm.neardup import classes, dedup, estimate, minhash, odd_sketches, shingles


def sets(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(texts, width, percent=80):
    s = [sets(t, width) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(len(s[i]), root(i)) for i in range(len(s))]


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(90)]
    texts = []
    for k in range(60):  # a group of copies with few and with many edits
        t = list(base)
        for _ in range(rng.randrange(0, 14)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    for k in range(30):
        t = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        texts += [" ".join(t), " ".join(t).upper() if k % 3 == 0 else " ".join([*t[1:], "end"])]
    return texts + ["", None, "one", "One", "two words", " \t\n ", "é É", "x " * 50_000]


def test_same_classes_as_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in classes(df, width=width).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, width)


def test_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    texts = corpus(9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in classes(df, width=2).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 2)


def test_odd_sketches_estimate_high_similarities():
    a = " ".join(f"w{i}" for i in range(1000))
    for changed, least, most in ((0, 1, 1), (20, 0.88, 1), (100, 0.6, 0.9)):
        b = " ".join(f"w{i}" if i % 1000 >= changed else f"v{i}" for i in range(1000))
        sk = odd_sketches(np.array([minhash(shingles(t, 2)) for t in (a, b)])).view(np.uint64)
        assert least <= estimate(int(np.bitwise_count(sk[0] ^ sk[1]).sum())) <= most


def test_dedup_keeps_one_of_each_group_and_all_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(50))
    rows = [(3, a, "k"), (1, a, "k"), (2, a + " more", "k"), (4, "other text of few words", None), (5, None, None), (6, "", None), (None, a, "k"), (4, "other text of few words", None)]
    out = dedup(spark.createDataFrame(rows, "doc_id long, text string, _copies string"))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "5", "6", "None"]
    assert out.columns == ["doc_id", "text", "_copies"]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert classes(df).count() == 0 and dedup(df).count() == 0


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    names = rng.sample(range(1000), 60)
    links = list(zip(names, names[1:], strict=False)) + [(2000, 2001), (2001, 2000), (2002, 2002), (None, 1)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[n] for n in names} == {min(names)} and got[2001] == 2000
    assert components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0


def test_ids_that_are_text(spark):
    texts = corpus(3)
    ids = [f"d{i:03}" for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id string, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in classes(df, width=5).collect()}
    assert [got[i] for i in ids] == [(n, ids[c]) for n, c in brute(texts, 5)]
    assert sorted(r.doc_id for r in dedup(df).collect()) == sorted({ids[c] for _, c in brute(texts, 5)})


def test_of_rows_that_share_an_id_the_first_by_text_stays(spark):
    rows = [(1, "b c d e f g", 2), (1, "a c d e f g", 1), (1, "a c d e f g", 0), (2, "z", 0), (None, "z", 0), (None, "z", 0)]
    got = sorted((r.doc_id or 0, r.text, r.x) for r in dedup(spark.createDataFrame(rows, "doc_id long, text string, x int")).collect())
    assert got == [(0, "z", 0), (0, "z", 0), (1, "a c d e f g", 0), (2, "z", 0)]


def test_hot_labels_of_components(spark, monkeypatch):
    from quillgraph.llm import components as c

    monkeypatch.setattr(c, "HOT", 3)
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(9)] + [(200, 201)]
    got = dict(map(tuple, c.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(1, 31), 1), **dict.fromkeys(range(100, 109), 100), 200: 200, 201: 200}


def test_blocks_without_members(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 1)
    texts = corpus(11)[:70]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in classes(df, width=2).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 2)
