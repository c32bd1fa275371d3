import pytest

from quillgraph.plans.engine import Engine
from quillgraph.plans.index import index
from quillgraph.sources.files import Config, discover
from quillgraph.sources.store import Store
from quillgraph.streaming.watch import event_rates, watch

FILES = {
    "src/a.py": "from src.b import helper\n\ndef caller():\n    return helper()\n",
    "src/b.py": "def helper():\n    return 1\n\nclass Shape:\n    pass\n",
    "web/A.java": "package p;\npublic class A implements Api { public void go() { run(); } void run() { } }\n",
    "web/Api.java": "package p;\ninterface Api { }\n",
    "docs/notes.md": "# Notes\n## Decision: use Spark\n**Big Graph** and **one**\n- [ ] size it\nIt MUST hold.\n[x](http://e.org)\n",
    "db/schema.sql": "CREATE TABLE users (id int, name varchar(20));\nCREATE TABLE posts (id int, u int, FOREIGN KEY (u) REFERENCES users(id));\n",
    "package.json": '{"dependencies": {"left": "1"}, "scripts": {"test": "x"}}',
    ".env": "SECRET=1",
    "node_modules/x.js": "function no() {}",
    "skip.log": "x",
    ".gitignore": "*.log\n",
}


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def ids(df):
    return {r.id for r in df.select("id").collect()}


def test_discovery_prunes_and_hides_secrets(spark, repo):
    got = {r.path for r in discover(spark, str(repo)).collect()}
    assert got == set(FILES) - {".env", "node_modules/x.js", "skip.log"}
    assert Config.load("/nowhere").max_file_bytes == Config().max_file_bytes


def test_index_increment_and_queries(spark, repo, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = index(spark, str(repo), store)
    assert first.artifacts == 8 and first.skipped == 0
    edges = {(r.src, r.dst): (r.type, r.rung, r.confidence) for r in store.read("edges").collect()}
    assert edges["src/a.py#caller", "src/b.py#helper"] == ("calls", "file_imports", 0.93)
    assert edges["web/A.java#A.go()", "web/A.java#A.run()"] == ("calls", "local_scope", 0.97)
    assert edges["web/A.java#A", "web/Api.java#Api"][0] == "implements"
    assert edges["table:db/schema.sql:posts", "table:db/schema.sql:users"][0] == "depends_on"
    nodes = ids(store.read("nodes"))
    assert {"decision:docs/notes.md:1", "requirement:docs/notes.md:3", "requirement:docs/notes.md:4", "concept:big_graph", "dep:left", "script:package.json:test"} <= nodes

    again = index(spark, str(repo), store)
    assert again.skipped == 8 and (again.nodes, again.edges) == (first.nodes, first.edges)

    # an edit of b changes what a, which is skipped, resolves to
    (repo / "src/b.py").write_text("def other():\n    return 1\n")
    (repo / "web/A.java").unlink()
    third = index(spark, str(repo), store)
    assert third.skipped == 6
    edges = {(r.src, r.dst) for r in store.read("edges").collect()}
    assert ("src/a.py#caller", "src/b.py#helper") not in edges and not any("A.java" in s for s, _ in edges)
    (repo / "src/b.py").write_text(FILES["src/b.py"])
    index(spark, str(repo), store)

    engine = Engine(store, str(repo))
    assert "src/b.py#helper" in ids(engine.search("helper").nodes)
    assert {r.node_id for r in engine.blast_radius("src/b.py#helper").collect()} >= {"src/a.py#caller"}
    assert [r.node_id for r in engine.find_path("src/a.py", "src/b.py#helper", "hops").orderBy("step").collect()] == ["src/a.py", "src/a.py#caller", "src/b.py#helper"]
    assert engine.find_path("src/b.py#helper", "src/a.py").count() == 0
    assert {r.path for r in engine.related_files("src/b.py#helper").collect()} == {"src/b.py"}
    assert engine.impact("src/b.py#helper").count() == 2
    assert engine.build_context("which function calls helper").nodes.count() > 2
    told = engine.explore("what calls the helper function").symbols.orderBy("rank").collect()
    assert told[0].id == "src/b.py#helper" and told[0].full and any(h.node_id == "src/a.py#caller" for h in told[0].blast_radius)
    assert told[0].source == "def helper():\n    return 1"
    report = engine.report()
    assert "## Clusters" in report and "artifacts" in report and "helper" in engine.html()
    engine.export_json(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes")).count() == engine.nodes.count()


def test_watch_indexes_new_files(spark, repo, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    got = []
    watch(spark, str(repo), store, str(tmp_path / "ck"), told=got.append, once=True).awaitTermination(120)
    assert got and got[-1].artifacts == 8


def test_event_rates_in_batch_and_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 3.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) as ts", "event_type", "value")
    assert sorted((r.event_type, r.n, r.value) for r in event_rates(df).collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]
    df.write.parquet(str(tmp_path / "in"))
    q = event_rates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rates").count() == 2
