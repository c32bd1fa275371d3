"""The registry, and some queries against their SQL on the smallest data."""

import os

import pytest

import __spark_entry__
from quillgraph import queries as core

DATA = "/root/testdata/sf0.001"
SOME = ["in_out_degree", "blast_radius_floor", "ladder_edges", "identifier_split", "module_owner", "markdown_headings", "arm_summary", "sibling_groups", "incremental_changed", "token_budget_pack", "retrieval_stats", "transitive_subtypes"]


def test_every_core_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql())
    assert set(core.queries()) <= set(__spark_entry__.queries())


def plain(frame):
    rows = []
    for row in frame[sorted(frame.columns)].itertuples(index=False, name=None):
        rows.append(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row))
    return sorted(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", SOME)
def test_query_as_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    got, want = core.queries()[name](spark, DATA).toPandas(), db.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["seed", "node_id", "hops"]
