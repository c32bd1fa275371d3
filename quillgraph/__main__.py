"""python -m quillgraph COMMAND STORE ARGUMENTS...

init STORE [DIRECTORY]            an empty configuration, and a first run if a directory is given
index|refresh STORE DIRECTORY     brings the overlay up to date
ci-reindex STORE DIRECTORY        writes the baseline anew; only without a terminal, or with QUILLGRAPH_CI=true
watch STORE DIRECTORY             follows changes
config STORE get|set KEY [VALUE]  settings; values are JSON
modules STORE                     the module tree
search|context|explore STORE WORDS...
node|evidence|files|expand|impact|blast STORE NODE
path STORE FROM TO
report|html STORE
export STORE DIRECTORY
serve STORE [DIRECTORY]           tools over standard input and output
"""

from __future__ import annotations

import json
import os
import sys
from dataclasses import asdict, fields

from pyspark.sql import SparkSession

from quillgraph.operators.iterate import clear
from quillgraph.plans.engine import Engine
from quillgraph.plans.index import index
from quillgraph.sources.files import Config
from quillgraph.sources.store import Store


def ci_write_allowed(has_terminal: bool, forced: str | None) -> bool:
    """The baseline has one writer, the scheduled job, which has no terminal."""
    return not has_terminal or (forced or "").lower() == "true"


def _configure(path: str, rest: list[str]) -> int:
    config = Config.load(path)
    known = {f.name for f in fields(Config)}
    if len(rest) < 2 or rest[0] not in ("get", "set") or rest[1] not in known or (rest[0] == "set" and len(rest) < 3):
        print(f"config STORE get|set KEY [VALUE]; keys: {', '.join(sorted(known))}", file=sys.stderr)
        return 2
    if rest[0] == "get":
        print(json.dumps(getattr(config, rest[1])))
        return 0
    try:
        value = json.loads(rest[2])
    except ValueError:
        value = rest[2]
    if type(value) is not type(getattr(config, rest[1])):
        print(f"{rest[1]} is a {type(getattr(config, rest[1])).__name__}", file=sys.stderr)
        return 2
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        json.dump(asdict(config) | {rest[1]: value}, file, indent=2)
    return 0


def _ci(spark: SparkSession, place: str, root: str, config: Config) -> int:
    """One line of JSON, whatever happens."""
    if not ci_write_allowed(sys.stdin.isatty(), os.environ.get("QUILLGRAPH_CI")):
        print(json.dumps({"status": "refused", "message": "ci-reindex writes the baseline and runs without a terminal; QUILLGRAPH_CI=true overrides this"}), file=sys.stderr)
        return 1
    config.llm_enabled = False
    try:
        print(json.dumps({"status": "ok"} | asdict(index(spark, root, Store(spark, place, overlay=False), config, fresh=True))))
        return 0
    except Exception as e:
        print(json.dumps({"status": "error", "message": str(e)}), file=sys.stderr)
        return 1


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    command, place, *rest = args
    settings = f"{place}/config.json"
    if command == "config":
        return _configure(settings, rest)
    if command == "init":
        if not os.path.exists(settings):
            os.makedirs(place, exist_ok=True)
            with open(settings, "w") as file:
                json.dump(asdict(Config()), file, indent=2)
        if not rest:
            return 0
        command = "index"
    spark = SparkSession.builder.appName("quillgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, config = Store(spark, place), Config.load(settings)
    if command == "ci-reindex":
        return _ci(spark, place, rest[0], config)
    if command in ("index", "refresh"):
        print(index(spark, rest[0], store, config))
        clear(spark)
        return 0
    if command == "watch":
        from quillgraph.streaming.watch import watch

        watch(spark, rest[0], store, f"{place}/.watch", config, told=print).awaitTermination()
        return 0
    engine = Engine(store, rest[0] if command == "serve" and rest else None)
    show = {
        "search": lambda: engine.render(engine.search(" ".join(rest)).nodes),
        "context": lambda: engine.render(engine.build_context(" ".join(rest)).nodes),
        "expand": lambda: engine.render(engine.expand_node(rest[0]).nodes),
        "report": engine.report,
        "html": engine.html,
    }
    tables = {
        "node": lambda: engine.node(rest[0]),
        "evidence": lambda: engine.evidence(rest[0]),
        "files": lambda: engine.related_files(rest[0]),
        "path": lambda: engine.find_path(rest[0], rest[1]),
        "impact": lambda: engine.impact(rest[0]),
        "blast": lambda: engine.blast_radius(rest[0]),
        "explore": lambda: engine.explore(" ".join(rest)).symbols,
        "modules": engine.modules,
    }
    if command in show:
        print(show[command]())
    elif command in tables:
        tables[command]().show(50, truncate=False)
    elif command == "export":
        engine.export_json(rest[0])
    elif command == "serve":
        from quillgraph.plans.server import Server

        def again(path: str) -> tuple[Engine, object]:
            told = index(spark, path, store, config)
            return Engine(store, path), told

        Server(engine, again).serve()
    else:
        print(__doc__)
        return 2
    clear(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
