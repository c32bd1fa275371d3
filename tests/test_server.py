import io
import json

import pytest

from quillgraph.__main__ import ci_write_allowed, main
from quillgraph.plans.engine import Engine
from quillgraph.plans.index import index
from quillgraph.plans.server import Server
from quillgraph.sources.store import Store

FILES = {
    "settings.gradle": "include ':core', ':app'\n",
    "core/a.py": "def helper():\n    return 1\n",
    "app/b.py": "from core.a import helper\n\ndef caller():\n    return helper()\n",
    "app/broken.py": "def (\n",
    "deploy/docker-compose.yml": "services:\n  web:\n    image: x\n",
    "deploy/Dockerfile": "FROM base:1\nRUN x\n",
    "notes.txt": "Related Work\nas [Doe et al., 2020] says\n",
    "db/s.sql": "CREATE TABLE t (id int);\n",
    "doc.md": "# Top\n[x](http://e.org)\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root, place = tmp_path_factory.mktemp("project"), str(tmp_path_factory.mktemp("store"))
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    store = Store(spark, place)
    stats = index(spark, str(root), store)
    return str(root), store, stats, Engine(store, str(root))


def test_what_the_index_holds(built):
    _, store, stats, engine = built
    nodes = {r.id: r for r in store.read("nodes").collect()}
    edges = {(r.src, r.dst): r.type for r in store.read("edges").collect()}
    assert nodes["module:core"].type == "CodeModule" and {r.path for r in engine.modules().collect()} == {"core", "app"}
    assert edges["file:deploy/docker-compose.yml", "service:web"] == "contains" and edges["file:deploy/Dockerfile", "image:base:1"] == "uses"
    assert edges["section:doc.md:Top", "link:http://e.org"] == "references"
    assert edges["section:notes.txt:Related Work", "citation:notes.txt:[Doe et al., 2020]"] == "cites"
    assert nodes["table:db/s.sql:t"].confidence == 0.85 and nodes["core/a.py#helper"].line_end == 2
    assert stats.artifacts == len(FILES) and stats.warnings >= 1


def test_explore_names_modules_and_shows_source(built):
    found = built[3].explore("where does the app use helper")
    assert [r.name for r in found.modules.orderBy("rank").collect()] == ["app"]
    symbols = {r.id: r for r in found.symbols.collect()}
    assert symbols["core/a.py#helper"].source == "def helper():\n    return 1"
    assert built[3].explore("where does the app use helper", budget=1).symbols.where("full").count() == 0


def test_messages(built):
    server = Server(built[3], lambda path: (built[3], "done"))
    asked = [
        {"id": 1, "method": "initialize"},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "search_nodes", "arguments": {"query": "helper", "limit": 1}}},
        {"id": 4, "method": "tools/call", "params": {"name": "get_node", "arguments": {"nodeId": "none"}}},
        {"id": 5, "method": "tools/call", "params": {"name": "find_path", "arguments": {"fromId": "app/b.py", "toId": "core/a.py#helper", "by": "hops"}}},
        {"id": 6, "method": "tools/call", "params": {"name": "explore", "arguments": {}}},
        {"id": 7, "method": "resources/read", "params": {"uri": "graph://project"}},
        {"id": 8, "method": "prompts/get", "params": {"name": "find_context_for_task", "arguments": {"task": "T"}}},
        {"id": 9, "method": "prompts/get", "params": {"name": "none"}},
        {"id": 10, "method": "none"},
        {"id": 11, "method": "resources/list"},
        {"id": 12, "method": "prompts/list"},
        {"id": 13, "method": "tools/call", "params": {"name": "index_project", "arguments": {"path": "."}}},
    ]
    out = io.StringIO()
    server.serve(io.StringIO("\n".join(map(json.dumps, asked)) + "\nnot json\n"), out)
    got = [json.loads(line) for line in out.getvalue().splitlines()]
    by = {m["id"]: m for m in got}
    assert set(by) == {None, *range(1, 14)}
    assert len(by[2]["result"]["tools"]) == 11 and len(by[11]["result"]["resources"]) == 6 and len(by[12]["result"]["prompts"]) == 4
    assert "helper" in by[3]["result"]["content"][0]["text"]
    assert by[4]["result"]["isError"] and by[6]["result"]["isError"]
    assert by[5]["result"]["content"][0]["text"] == "app/b.py -> app/b.py#caller -> core/a.py#helper"
    assert json.loads(by[7]["result"]["contents"][0]["text"])["artifacts"] == len(FILES)
    assert "T" in by[8]["result"]["messages"][0]["content"]["text"] and by[9]["error"]["code"] == -32602 and by[10]["error"]["code"] == -32601


def test_what_is_cut_off_is_told(built):
    engine = built[3]
    top = engine.search("helper caller").nodes
    assert engine.render(top, 1, 9).endswith("... 8 more not shown (showing 1 of 9) -- raise 'limit' to see the rest. This list is INCOMPLETE.")
    assert engine.search("helper").average_confidence() > 0
    assert [r.file for r in engine.ranked_files("which function calls helper").orderBy("position").collect()][0] in FILES


def test_configuration_and_the_baseline(built, tmp_path, capsys):
    place = str(tmp_path / "s")
    assert main(["init", place]) == 0 and main(["config", place, "set", "rescan_seconds", "5"]) == 0
    assert main(["config", place, "get", "rescan_seconds"]) == 0 and capsys.readouterr().out.strip() == "5"
    assert main(["config", place, "set", "rescan_seconds", "soon"]) == 2 and main(["config", place, "get", "none"]) == 2
    assert ci_write_allowed(False, None) and ci_write_allowed(True, "TRUE") and not ci_write_allowed(True, None)
    capsys.readouterr()
    assert main(["ci-reindex", place, built[0]]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["status"] == "ok" and told["artifacts"] == len(FILES)
    assert Store(built[1].spark, place).exists() and not Store(built[1].spark, place)._current("overlay")


def test_runs_are_seen_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(nodes=spark.range(3), edges=spark.range(1))
    held = store.read("nodes")
    store.write(nodes=spark.range(5))
    assert held.count() == 3 and store.read("nodes").count() == 5 and store.read("edges").count() == 1
    with store.locked(), pytest.raises(TimeoutError):
        with store.locked(wait=0.2):
            pass
    with store.locked():
        pass
