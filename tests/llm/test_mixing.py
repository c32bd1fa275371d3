from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillgraph.llm.mixing import mix, period, shares


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0}, {"a": 7, "b": 1, None: 1.5, "d": 0.01}, {str(i): i + 1 for i in range(23)}])
def test_deviation_stays_below_one_block(weights):
    grain = 500
    parts = shares(weights, grain)
    assert sum(parts.values()) == grain
    slots = period(parts, grain)
    by_slot = {t: s for s, ts in slots.items() for t in ts}
    assert sorted(by_slot) == list(range(grain))
    done = dict.fromkeys(parts, 0)
    for t in range(grain):
        s = by_slot[t]
        release, deadline = done[s] * grain // parts[s], -(-(done[s] + 1) * grain // parts[s])
        assert release <= t < deadline
        done[s] += 1
        for s in parts:
            assert abs(Fraction(parts[s] * (t + 1), grain) - done[s]) < 1


def test_all_rows_stay_in_order_of_the_schedule(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", "x") for i in range(600)] + [(1000, None, None), (5, "hot", "x"), (None, "hot", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    out = mix(df, block=4).collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in out) == sorted((str(i), str(s)) for i, s, _ in rows)
    assert len({r.position for r in out}) == len(out)
    n = {s: sum(r.source == s for r in out) for s in {r.source for r in out}}
    parts = shares({s: c**0.5 for s, c in n.items()})
    taken = dict.fromkeys(parts, 0)
    for slot in range(max(r.slot for r in out if r.in_mix) + 1):
        for s in {r.source for r in out if r.slot == slot}:
            taken[s] += 1
        assert all(abs(parts[s] * (slot + 1) / 10_000 - taken[s]) < 1 for s in parts)
    assert all(r.release <= r.slot < r.deadline for r in out)


def test_empty_and_missing_weights(spark):
    df = spark.createDataFrame([], "doc_id long, source string")
    assert mix(df).count() == 0
    with pytest.raises(ValueError):
        mix(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string"), {"a": 1.0})
    with pytest.raises(ValueError):
        shares({"a": 0.0})


def test_more_sources_than_half_the_grain(spark):
    n = 5_003
    df = spark.range(2 * n).selectExpr("id as doc_id", f"concat('s', id % {n}) as source")
    rows = mix(df).select("slot", "source").collect()
    assert len(rows) == 2 * n and len({r.slot for r in rows}) == n


def test_many_rows_of_one_id(spark, monkeypatch):
    from quillgraph.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = [(None, "a")] * 300 + [(7, "a")] * 200 + [(i, "ab"[i % 2]) for i in range(100)]
    out = mix(spark.createDataFrame(rows, "doc_id long, source string")).collect()
    assert len(out) == 600 and len({r.position for r in out}) == 600
    numbers = sorted((r.source, r.block_no * 8 + r.block_row) for r in out)
    assert numbers == [(s, i) for s, n in (("a", 550), ("b", 50)) for i in range(n)]


def test_shares_follow_the_targets_of_many_sources(spark):
    weights = {f"s{i}": 1.0 + i % 10 for i in range(1500)}
    df = spark.createDataFrame([(i, f"s{i}") for i in range(1500)], "doc_id long, source string")
    got = {r.source: r.deadline for r in mix(df, weights).collect()}
    mean = sum(weights.values()) / len(weights)
    for s, due in got.items():  # the first block is due after the period over the parts
        assert abs(1500 * mean / weights[s] - due) <= 0.05 * due + 1
