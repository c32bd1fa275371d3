import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.operators import graph as g
from quillgraph.operators import modules as m
from quillgraph.operators import resolve as r
from quillgraph.operators import search as s
from quillgraph.operators import stats
from quillgraph.operators.iterate import CLEANUP, forget, settle


def graph(spark, names, links):
    nodes = spark.createDataFrame([(n, "Method", n, 1.0) for n in names], "id string, type string, label string, confidence double")
    edges = spark.createDataFrame([(f"{a}>{b}", a, b, k, c) for a, b, k, c in links], "id string, src string, dst string, type string, confidence double")
    return nodes, edges


def hops(df):
    return {x.node_id: x.hops for x in df.collect()}


def test_blast_radius_hops_floor_cycle_and_cap(spark):
    n, e = graph(spark, "abcd", [("b", "a", "calls", 0.9), ("c", "b", "calls", 0.45), ("a", "c", "calls", 0.9), ("d", "a", "imports", 1.0)])
    seed = n.where("id = 'a'")
    assert hops(g.blast_radius(n, e, seed)) == {"b": 1, "c": 2}
    assert hops(g.blast_radius(n, e, seed, 0.8)) == {"b": 1}
    assert hops(g.blast_radius(n, e, seed, max_nodes=1)) == {"b": 1}
    assert hops(g.blast_radius(n, e, n.where("id = 'd'"))) == {}


def test_impact_counts_before_the_cap(spark):
    n, e = graph(spark, "abcde", [(x, "a", "calls", 1.0) for x in "bcd"] + [("e", "b", "calls", 1.0), ("ghost", "a", "calls", 1.0)])
    got = g.impact(n, e, "a", 2).collect()
    assert [x.node_id for x in got] == ["b", "c"] and {x.total for x in got} == {3}


def test_components_paths_and_ranks(spark):
    n, e = graph(spark, "abcdef", [("a", "b", "calls", 0.9), ("b", "c", "calls", 0.9), ("a", "c", "calls", 2.0), ("d", "e", "calls", 1.0), ("x", "f", "calls", 1.0)])
    assert {x.id: x.component for x in g.components(n, e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert [x.node_id for x in g.find_path(n, e, "a", "c").orderBy("step").collect()] == ["a", "b", "c"]
    assert [x.node_id for x in g.find_path(n, e, "a", "a").collect()] == ["a"] and g.find_path(n, e, "c", "a").count() == 0
    ranks = {x.id: x["rank"] for x in g.pagerank(n, e, 100, tolerance=1e-9).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["c"] > ranks["b"] > ranks["a"]
    assert {x.id for x in g.isolated(n, g.drop_dangling(n, e)).collect()} == {"f"}


def test_expand_stops_at_missing_nodes(spark):
    n, e = graph(spark, "abd", [("a", "b", "calls", 1.0), ("b", "gone", "calls", 1.0), ("gone", "d", "calls", 1.0)])
    assert hops(g.expand(n, e, n.where("id = 'a'"), 4)) == {"a": 0, "b": 1}


def test_closure_is_safe_on_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "sub string, super string")
    assert g.subtype_closure(pairs).count() == 9


REFS = "ref_id string, name string, referrer string, path string, line int, receiver_type string"


def nodes_of(spark, *ids, kind="Method"):
    return spark.createDataFrame([(i, kind, i.rpartition(".")[2].partition("(")[0]) for i in ids], "id string, type string, label string")


def one(spark, nodes, receiver=None, referrer="src/caller/A.kt#A.caller", imports=None):
    refs = spark.createDataFrame([("1", "callee", referrer, referrer.partition("#")[0], 7, receiver), ("2", "callee", referrer, referrer.partition("#")[0], 3, receiver)], REFS)
    return sorted((x.dst, x.rung, x.confidence, tuple(x.lines)) for x in r.resolve(refs, nodes, imports).collect())


def test_ladder(spark):
    far = "vendor/lib/B.kt#B.callee"
    assert one(spark, nodes_of(spark, far)) == [(far, "repo_unique_name", 0.80, (3, 7))]
    same = "src/caller/C.kt#C.callee"
    assert one(spark, nodes_of(spark, far, same)) == [(same, "same_directory", 0.87, (3, 7))]
    token = spark.createDataFrame([("src/caller/A.kt", "B")], "path string, token string")
    assert one(spark, nodes_of(spark, far, same), imports=token) == [(far, "file_imports", 0.93, (3, 7))]
    local = "src/caller/A.kt#A.callee"
    assert [x[:3] for x in one(spark, nodes_of(spark, far, same, local))] == [(local, "local_scope", 0.97)]
    many = [f"v/{i}/B.kt#B{i}.callee" for i in range(4)]
    assert one(spark, nodes_of(spark, *many)) == []
    assert [x[2] for x in one(spark, nodes_of(spark, *many[:3]))] == [0.45] * 3
    assert [x[0] for x in one(spark, nodes_of(spark, *many), receiver="B2")] == [many[2]]
    assert len(one(spark, nodes_of(spark, *many[:2]), receiver="None")) == 2
    assert one(spark, nodes_of(spark, far, kind="Field")) == []


def test_ownership_of_paths(spark):
    tree = m.build_tree(spark.createDataFrame([("app",), ("app/core",), ("app-core",)], "path string"))
    assert {x.path: x.parent_id for x in tree.collect()} == {"app": None, "app/core": "module:app", "app-core": None}
    files = spark.createDataFrame([("app/core/x.kt",), ("app-core/y.kt",), ("app/z.kt",), ("other.kt",)], "path string")
    assert {x.path: x.owner for x in m.owners(files, tree).collect()} == {"app/core/x.kt": "module:app/core", "app-core/y.kt": "module:app-core", "app/z.kt": "module:app", "other.kt": None}
    rooted = m.build_tree(spark.createDataFrame([("",)], "path string"))
    assert {x.owner for x in m.owners(files, rooted).collect()} == {"module:"}


def test_identifier_words(spark):
    words = {"HTTPServerFactory": ["HTTP", "Server", "Factory"], "get_HTTPResponse-code": ["get", "HTTP", "Response", "code"], "Base64Encoder": ["Base", "64", "Encoder"], "": []}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {x.w: x.s for x in df.select("w", t.split_identifier(F.col("w")).alias("s")).collect()} == words


def test_search_as_sqlite(spark):
    import sqlite3

    texts = ["the cat sat", "cat cat dog", "a dog ran far away from the cat", "nothing here", "dog"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, body)")
    db.executemany("insert into f values (?, ?)", [(str(i), x) for i, x in enumerate(texts)])
    want = {i: -score for i, score in db.execute('select id, bm25(f) from f where f match \'"dog" OR "sat"\'')}
    nodes = spark.createDataFrame([(str(i), "Concept", x, 1.0) for i, x in enumerate(texts)], "id string, type string, label string, confidence double")
    got = {x.id: x.score for x in s.search(nodes, "dog sat!", text=F.col("label")).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    assert s.search(nodes, "?!").count() == 0 and s.search(nodes, " ").count() == 5 and [x.id for x in s.search(nodes, "othin").collect()] == ["3"]


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None)], "k string, v double")
    assert [tuple(x) for x in stats.summarize(df, "v", "k").collect()] == [("a", 2.5, 1.0, 4.0, 2)]
    k = stats.kappa(spark.createDataFrame([(True, True)] * 3, "a boolean, b boolean"), "a", "b").first()
    assert (k.n, k.kappa) == (3, 1.0)
    asked = 'How does `ServeHTTP call` use gin.go, packages/lib/handleIt.ts and 404, e.g. GIN_MODE?'
    assert spark.range(1).select(stats.derive_tokens(F.lit(asked))).first()[0] == ["ServeHTTP call", "ServeHTTP", "gin.go", "packages/lib/handleIt.ts", "handleIt.ts", "handleIt", "GIN_MODE", "404"]
    ranked = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3), (2, "z", 1)], "qid int, file string, position int")
    want = spark.createDataFrame([(1, "y"), (1, "q"), (3, "a")], "qid int, file string")
    assert {x.qid: (x.precision, x.recall, x.mrr) for x in stats.ranking_metrics(ranked, want, 2).collect()} == {1: (0.5, 0.5, 0.5), 2: (0.0, 1.0, 0.0), 3: (0.0, 0.0, 0.0)}
    f1 = stats.set_scores(spark.createDataFrame([("see `./a/B.java:3` and c.go:1",)], "t string").select(stats.answer_set(F.col("t")).alias("got"), F.array(F.lit("a/B.java:3")).alias("want")), "got", "want").first()
    assert (f1.precision, f1.recall) == (0.5, 1.0)


def test_budget_elides_all_after_the_first_overflow(spark):
    df = spark.createDataFrame([(1, i, c, 1) for i, c in enumerate([5, 4, 3, 1])], "g int, i int, cost long, brief long")
    got = [(x.full, x.used) for x in t.pack_budget(df, 10, "g", "i", "cost", "brief").orderBy("i").collect()]
    assert got == [(True, 5), (True, 9), (False, 10), (False, 11)]


def test_components_with_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(g, "HOT", 3)
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("x", f"y{i}") for i in range(6)]
    nodes = spark.createDataFrame(sorted({(i,) for p in pairs for i in p} | {("alone",)}), "id string")
    edges = spark.createDataFrame([(f"e{k}", a, b) for k, (a, b) in enumerate(pairs)], "id string, src string, dst string")
    got = dict(map(tuple, g.components(nodes, edges).collect()))
    assert got == {**{f"n{i:02}": "n00" for i in range(21)}, **{f"y{i}": "x" for i in range(6)}, "x": "x", "alone": "alone"}


def _of_links(names, pairs):
    up = {n: n for n in names}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a in up and b in up:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {n: top(n) for n in names}


@pytest.mark.parametrize(("chunk", "links"), [(2_000_000, 40), (7, 300), (4, 90)])
def test_components_by_parts_rounds_and_ends_that_are_no_nodes(spark, monkeypatch, chunk, links):
    monkeypatch.setattr(g, "CHUNK", chunk)
    rng = random.Random(chunk)
    names = [f"n{i}" for i in range(60)] + ["é", "z\U0001f600"]
    pairs = [(rng.choice([*names, "ghost"]), rng.choice([*names, "ghost", None])) for _ in range(links)]
    nodes = spark.createDataFrame([(n, n) for n in [*names, *names[:3]]], "id string, label string")
    edges = spark.createDataFrame(pairs, "src string, dst string").repartition(5)
    want = _of_links(names, pairs)
    assert sorted(map(tuple, g.components(nodes, edges).collect())) == sorted(want.items())
    if chunk > links:
        sizes = Counter(want[n] for n in [*names, *names[:3]])
        assert {x.component: x["size"] for x in g.clusters(nodes, edges, 1000).collect()} == sizes


def test_components_write_ends_of_parts_and_not_every_link(spark, monkeypatch):
    written = []
    monkeypatch.setattr(g, "settle", lambda df: (out := settle(df), written.append(out.count()))[0])
    names = [f"n{i:02}" for i in range(60)]
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    edges = spark.createDataFrame([(a, b) for a in names for b in names], "src string, dst string").repartition(2)
    assert {x.component for x in g.components(nodes, edges).collect()} == {"n00"}
    assert sum(written) < 1000  # of 3,540 links


def test_forgotten_tables_are_gone(spark):
    before = spark.conf.get(CLEANUP, None)
    table = settle(spark.range(100).repartition(3, "id"))
    assert table.count() == 100 and spark.conf.get(CLEANUP, None) == before
    forget(table)
    assert not os.path.exists(table.settled_at.removeprefix("file:"))


def test_find_path_of_any_length(spark):
    names = [f"n{i}" for i in range(11)]
    nodes = spark.createDataFrame([(n,) for n in [*names, "far"]], "id string")
    edges = spark.createDataFrame([(f"e{i}", a, b, 0.5) for i, (a, b) in enumerate(zip(names, names[1:]))], "id string, src string, dst string, confidence double")
    got = [r.node_id for r in g.find_path(nodes, edges, "n0", "n10").orderBy("step").collect()]
    assert got == names
    assert [r.node_id for r in g.find_path(nodes, edges, "n3", "n3").collect()] == ["n3"]
    assert g.find_path(nodes, edges, "n0", "far").count() == 0 and g.find_path(nodes, edges, "n0", "none").count() == 0


def test_pagerank_goes_by_confidence(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("1", "a", "b", 0.9), ("2", "a", "c", 0.1)], "id string, src string, dst string, confidence double")
    got = dict(map(tuple, g.pagerank(nodes, edges).collect()))
    assert abs(sum(got.values()) - 1) < 1e-9 and got["b"] > got["c"] > 0
    even = dict(map(tuple, g.pagerank(nodes, edges, weighted=False).collect()))
    assert abs(even["b"] - even["c"]) < 1e-12


def test_budgets_over_several_ranges(spark):
    rows = [(f"g{i % 2}", i, 1 + i % 5, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, cost int, brief int").repartition(7)
    got = {r.i: (r.full, r.used) for r in t.pack_budget(df, 300, "g", "i", "cost", "brief").collect()}
    for g0 in (0, 1):
        spent = used = 0
        for _, i, cost, brief in rows[g0::2]:
            spent += cost
            used += cost if spent <= 300 else brief
            assert got[i] == (spent <= 300, used)


def test_windows_of_time_across_stretches(spark):
    from quillgraph.operators import stats

    times = [0, 1, 59, 60, 61, 64 * 60 - 1, 64 * 60, 64 * 60 + 58, 64 * 60 + 60, 200 * 60]
    df = spark.createDataFrame([("k", t0) for t0 in times] + [("z", 5)], "k string, s long").selectExpr("k", "s", "timestamp_seconds(s) as ts")
    got = {(r.k, r.s): r.in_window for r in stats.rate_window(df, "ts", "k", 60).collect()}
    assert got == {**{("k", a): sum(a - 60 <= b <= a for b in times) for a in times}, ("z", 5): 1}


def test_counted_rungs_are_those_of_listed_candidates(spark):
    """Counts against the listed candidates: types, imports, directories, own files, repeated rows and ids."""
    import random

    from pyspark.sql import functions as F

    from quillgraph.operators import resolve as r

    rng = random.Random(5)
    ids = [f"{d}/{f}.java#{t}.{n}" for d in "ab" for f in "fgh" for t in ("T", "U", "T.V") for n in ("run", "go")] + ["top.java#run", "a/f.java"]
    nodes = spark.createDataFrame([(i, k, i.split(".")[-1]) for i in ids for k in ("Method",) * rng.randint(1, 2)] + [("x#T.run", "Field", "run"), ("y#T.q", "Method", None)], "id string, type string, label string")
    refs = []
    for k in range(300):
        at = rng.choice(ids)
        path = at.split("#")[0] if rng.random() < 0.8 else rng.choice(["c/z.java", None, "top.java"])
        refs.append((f"r{k // 2 if k < 20 else k}", rng.choice(["run", "go", "none"]), at if rng.random() < 0.9 else None, path, k, rng.choice(["T", "U", "V", "W", None])))
    refs = spark.createDataFrame(refs, "ref_id string, name string, referrer string, path string, line int, receiver_type string")
    imports = spark.createDataFrame([("a/f.java", "g"), ("a/f.java", "g"), ("c/z.java", "h"), ("b/g.java", ""), ("top.java", "f")], "path string, token string")
    listed = r.candidates(refs, nodes)
    narrowed = r.narrow(listed)
    assert sorted(r.candidate_counts(refs, nodes).collect()) == sorted(listed.groupBy("name").count().collect())
    assert sorted(r.narrow_counts(refs, nodes).collect()) == sorted(narrowed.groupBy("ref_id").count().collect())
    for told in (imports, None):
        by = r.with_rung(narrowed, told).groupBy("ref_id", "rung").agg(F.count("*").alias("n"))
        want = by.groupBy("ref_id").agg(F.min(F.struct("rung", "n")).alias("l")).select("ref_id", "l.rung", "l.n").collect()
        got = r.lowest_rungs(refs, nodes, told).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {x.rung for x in got} >= ({0, 1, 2, 3} if told else {0, 2, 3})


def test_common_names_are_counted_not_listed(spark):
    from quillgraph.operators import resolve as r

    n = 200_000  # 4e10 pairs
    nodes = spark.range(n).selectExpr("concat('d/P', id, '.java#T', id % 5, '.run') as id", "'Method' as type", "'run' as label")
    refs = spark.range(n).selectExpr("cast(id as string) as ref_id", "'run' as name", "concat('e/O', id, '.java#O.run') as referrer", "concat('e/O', id, '.java') as path", "0 as line", "concat('T', id % 10) as receiver_type")
    assert [tuple(x) for x in r.candidate_counts(refs, nodes).collect()] == [("run", n * n)]
    assert sorted(map(tuple, r.narrow_counts(refs, nodes).groupBy("n").count().collect())) == [(n // 5, n // 2), (n, n // 2)]
    assert sorted(map(tuple, r.lowest_rungs(refs, nodes).groupBy("rung", "n").count().collect())) == [(3, n // 5, n // 2), (3, n, n // 2)]


def test_ranks_after_some_rounds(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(40)]
    pairs = [(rng.choice(names[:25]), rng.choice([*names, "ghost"]), rng.choice([0.45, 0.8, 0.97])) for _ in range(120)] + [("n1", "n1", 0.9), ("ghost", "n2", 0.9), ("ghost", "n30", 0.9)]
    nodes, edges = graph(spark, names, [(a, b, "calls", c) for a, b, c in pairs])
    used = [(a, b, c) for a, b, c in pairs if "ghost" not in (a, b)]
    for rounds in (0, 1, 6):
        ranks, out = dict.fromkeys(names, 1 / 40), Counter()
        for a, _, c in used:
            out[a] += c
        for _ in range(rounds):
            fresh = dict.fromkeys(names, (0.15 + 0.85 * sum(ranks[x] for x in names if x not in out)) / 40)
            for a, b, c in used:
                fresh[b] += 0.85 * ranks[a] * c / out[a]
            ranks = fresh
        for tolerance in (None, 0.0):
            got = {x.id: x["rank"] for x in g.pagerank(nodes, edges, rounds, tolerance=tolerance).collect()}
            assert got == pytest.approx(ranks, rel=1e-9)
    assert g.pagerank(nodes.where("false"), edges, 3, tolerance=None).count() == 0
    assert [x["rank"] for x in g.pagerank(nodes, edges.where("false"), 3, tolerance=None).collect()] == pytest.approx([1 / 40] * 40)


def test_rounds_leave_out_what_no_walk_reaches(spark, monkeypatch):
    leaves = [f"l{i}" for i in range(500)]
    nodes, edges = graph(spark, [*leaves, "a", "b", "c"], [(x, "a", "calls", 0.9) for x in leaves] + [("a", "b", "calls", 0.9), ("b", "c", "calls", 0.9), ("c", "b", "calls", 0.9)])
    sizes = []

    def counted(df):
        out = settle(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(g, "settle", counted)
    assert g.pagerank(nodes, edges, 10, tolerance=None).count() == 503
    assert sum(x > 100 for x in sizes) == 1  # the links, once


@pytest.mark.parametrize("large", [7, 2**60 + 5])
def test_bundle_over_numbers_as_sql(spark, tmp_path, large):
    import duckdb

    from quillgraph.plans import derived
    from quillgraph.queries import graphs

    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R0"), (1, "R1")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(i, f"N{i}", i % 3) for i in range(4)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(i, f"C{i}", i % 5) for i in range(12)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(i, f"S{i}", i % 4) for i in range(6)]),
        "part": ("p_partkey long, p_name string", [(i, f"P{i}") for i in [*range(8), large]]),
        "orders": ("o_orderkey long, o_custkey long", [(i, i * 5 % 14) for i in range(30)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", [(i % 31, large if i % 9 == 8 else i * 3 % 10, i % 7, i % 6) for i in range(150)] + [(1, None, 2, 1), (None, 2, 3, 2), (2, 2**61 + 1, 1, 0), (2**62, 3, -(2**63), 0)]),
    }
    db = duckdb.connect()
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    ids, links = derived.numbered(spark, str(tmp_path))
    assert dict(ids.dtypes)["id"] == ("bigint" if large == 7 else "string") and links.count() == links.select("src", "dst").distinct().count()
    got = graphs.bundle_rank(spark, str(tmp_path)).toPandas()[["id", "label", "position", "total"]]
    want = db.execute(graphs.ORACLES["bundle_rank"]).df()[["id", "label", "position", "total"]]
    assert got.values.tolist() == want.values.tolist()
