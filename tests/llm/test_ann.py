import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm.ann import search

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k):
    out = {}
    for q in queries:
        x = np.array(rows[q], np.float64)
        near = sorted((float(np.sqrt(((np.array(v, np.float64) - x) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out[q] = near[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    rows = {i: v.tolist() for i, v in enumerate(x)}
    df = spark.createDataFrame([(i, v, "x") for i, v in rows.items()], SCHEMA)
    got = search(df, F.col("vec_id") % 50 == 0, sample=500, trials=50).collect()
    want = brute(rows, [i for i in rows if i % 50 == 0], 10)
    hits = 0
    for q, near in want.items():
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(a[2] <= b[2] for a, b in zip(mine, mine[1:]))
        hits += len({m[1] for m in mine} & {i for _, i in near})
        dist = {i: d for d, i in brute(rows, [q], 10**9)[q]}
        assert all(abs(dist[m[1]] - m[2]) < 1e-12 for m in mine)
    assert hits >= 0.9 * 10 * len(want)


def test_ties_copies_and_unusable_vectors(spark):
    same = [[1.0, 2.0]] * 40
    rows = [(i, v, None) for i, v in enumerate(same)]
    rows += [(100, None, None), (101, [0.0, 0.0], None), (102, [1.0, None], None), (103, [float("nan"), 1.0], None), (104, [float("inf"), 1.0], None), (105, [], None), (106, [1.0], None), (None, [1.0, 2.0], None), (3, [1.0, 2.0], None)]
    got = search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=5).collect()
    assert {r.query_id for r in got} == {0, 20}
    for q in (0, 20):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for i in range(6) if i != q][:5]
    assert {r.score for r in got} == {0.0}


@pytest.mark.parametrize("n", [0, 1, 4])
def test_fewer_than_k(spark, n):
    df = spark.createDataFrame([(i * 100, [float(i + 1), 1.0], None) for i in range(n)], SCHEMA)
    assert search(df, F.col("vec_id") % 100 == 0).count() == n * max(0, n - 1)


def test_lower_trees(spark, monkeypatch):
    from quillgraph.llm import ann

    monkeypatch.setattr(ann, "DEAL", 100)
    monkeypatch.setattr(ann, "LEAF", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    x = (centres[np.minimum(rng.integers(0, 20, 3000), 11)] + 0.3 * rng.normal(size=(3000, 8))).astype(np.float32)
    rows = {i: v.tolist() for i, v in enumerate(x)}
    df = spark.createDataFrame([(i, v, "x") for i, v in rows.items()], SCHEMA)
    got = search(df, F.col("vec_id") % 100 == 0, sample=400, trials=60, max_leaves=5, block=20).collect()
    want = brute(rows, [i for i in rows if i % 100 == 0], 10)
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for _, i in near}) for q, near in want.items())
    assert len(got) == 10 * len(want) and hits >= 0.9 * 10 * len(want), hits


def test_lengths_do_not_mix(spark):
    rows = [(i, [float(i), 1.0, 2.0][: 2 + i % 2], None) for i in range(1, 41)]
    got = search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=3).collect()
    assert {r.query_id for r in got} == {20, 40} and all(r.vec_id % 2 == 0 for r in got)


def test_calibration_collects_no_visited_leaves(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from quillgraph.llm import ann

    sizes = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: [sizes.append(len(rows := collect(self))), rows][1])
    monkeypatch.setattr(ann, "LEAF", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)
    # in so many dimensions a trial visits most of the leaves, but has two neighbours only
    ann.search(df, F.col("vec_id") % 500 == 0, k=2, sample=400, trials=40, max_leaves=200)
    assert max(sizes) <= 200, sizes


@pytest.mark.parametrize("last", [False, True])
def test_rows_by_hash(spark, last):
    from quillgraph.llm.ann import _by_hash

    df = spark.range(5000).select("id", F.array(F.col("id").cast("double")).alias("v"))
    order = df.withColumn("h", F.xxhash64("id")).orderBy(F.desc("h") if last else "h")
    want = [r.id for r in order.limit(50).collect()]
    assert _by_hash(df, 5000, 50, last)["id"].to_pylist() == want
    assert _by_hash(df, 10**9, 50, last)["id"].to_pylist() == want  # a limit that is too low
    assert len(_by_hash(df, 5000, 9000, last)) == 5000
