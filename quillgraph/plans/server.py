"""The engine's methods as tools of a JSON-RPC server over standard input and output, with resources and prompts."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import graph as g
from quillgraph.plans.engine import Engine

PROTOCOL = "2024-11-05"
#: Rows of a table that a resource shows.
SHOWN = 1000
WHOLE, TEXT, NUMBER = {"type": "integer"}, {"type": "string"}, {"type": "number"}

#: Prompts: name, description, arguments, text.
PROMPTS: list[tuple[str, str, list[str], str]] = [
    ("explain_codebase", "Explain this codebase", [], "Explain this codebase: its modules, their main symbols and how they depend on one another. Begin with the report."),
    ("find_context_for_task", "Find relevant context for a task", ["task"], "Find what is relevant for this task: {task}. Begin with build_context."),
    ("analyze_change_impact", "Analyze change impact", ["nodeId"], "What would a change of {nodeId} affect? Begin with blast_radius."),
    ("summarize_research", "Summarize this research collection", [], "Summarize the documents, their claims and what they cite."),
]


class Server:
    """``reindex``: brings the store up to date with a folder and returns a new engine and what it did."""

    def __init__(self, engine: Engine, reindex: Callable[[str], tuple[Engine, object]] | None = None):
        self.engine, self.reindex = engine, reindex
        #: Name: description, arguments (name, shape, required), function.
        self.tools: dict[str, tuple[str, list[tuple[str, dict, bool]], Callable[[dict], str]]] = {
            "explore": ("Modules, symbols, source, edges and dependents for a question", [("question", TEXT, True), ("tokenBudget", WHOLE, False)], self._explore),
            "index_project": ("Brings the graph up to date with a folder", [("path", TEXT, True)], self._index),
            "search_nodes": ("Nodes that a question's words find", [("query", TEXT, True), ("types", TEXT, False), ("minConfidence", NUMBER, False), ("limit", WHOLE, False)], self._search),
            "get_node": ("One node with its evidence", [("nodeId", TEXT, True)], self._node),
            "expand_node": ("What lies around a node", [("nodeId", TEXT, True), ("depth", WHOLE, False), ("limit", WHOLE, False)], self._expand),
            "find_path": ("The way from one node to another", [("fromId", TEXT, True), ("toId", TEXT, True), ("by", TEXT, False)], self._path),
            "get_evidence": ("Where a node comes from", [("nodeId", TEXT, True)], self._evidence),
            "impact_analysis": ("Direct dependents of a node", [("nodeId", TEXT, True), ("limit", WHOLE, False)], self._impact),
            "related_files": ("Files of a node", [("nodeId", TEXT, True)], lambda a: _rows(self.engine.related_files(a["nodeId"]), "path")),
            "build_context": ("What is relevant for a task", [("task", TEXT, True), ("depth", WHOLE, False), ("limit", WHOLE, False)], self._context),
            "generate_report": ("A summary of the graph in Markdown", [], lambda a: self.engine.report()),
        }
        self.resources: dict[str, tuple[str, str, Callable[[], str]]] = {
            "graph://project": ("Project", "application/json", lambda: json.dumps({"artifacts": self.engine.artifacts.count(), "nodes": self.engine.nodes.count(), "edges": self.engine.edges.count()})),
            "graph://nodes": ("Nodes", "application/json", lambda: _rows(self.engine.nodes, "id")),
            "graph://edges": ("Edges", "application/json", lambda: _rows(self.engine.edges, "id")),
            "graph://artifacts": ("Artifacts", "application/json", lambda: _rows(self.engine.artifacts, "path")),
            "graph://report": ("Report", "text/markdown", lambda: self.engine.report()),
            "graph://clusters": ("Clusters", "application/json", lambda: _rows(g.clusters(self.engine.nodes, self.engine.edges), "component")),
        }

    def _explore(self, a: dict) -> str:
        found = self.engine.explore(a["question"], a.get("tokenBudget") or 15_000)
        return json.dumps({"modules": json.loads(_rows(found.modules, "rank")), "symbols": json.loads(_rows(found.symbols, "rank"))})

    def _index(self, a: dict) -> str:
        if self.reindex is None:
            raise ValueError("this server does not index")
        self.engine, told = self.reindex(a["path"])
        return str(told)

    def _search(self, a: dict) -> str:
        types = [t.strip() for t in a["types"].split(",") if t.strip()] if a.get("types") else None
        limit = a.get("limit") or 20
        found = self.engine.search(a["query"], types, a["minConfidence"] if a.get("minConfidence") is not None else 0.5, limit)
        return self.engine.render(found.nodes, limit, found.nodes.count())

    def _node(self, a: dict) -> str:
        node = self.engine.node(a["nodeId"])
        if node.isEmpty():
            raise ValueError(f"Node not found: {a['nodeId']}")
        return self.engine.render(node.withColumn("position", F.lit(1)), 1)

    def _expand(self, a: dict) -> str:
        self._node(a)
        limit = a.get("limit") or 50
        top = self.engine.expand_node(a["nodeId"], a.get("depth") or 2, limit).nodes
        first = top.select("total").first()
        return self.engine.render(top, limit, first.total if first else 0)

    def _path(self, a: dict) -> str:
        path = self.engine.find_path(a["fromId"], a["toId"], a.get("by") or "confidence").orderBy("step").collect()
        return " -> ".join(r.node_id for r in path) or "No path"

    def _evidence(self, a: dict) -> str:
        return _rows(self.engine.evidence(a["nodeId"]), "path")

    def _impact(self, a: dict) -> str:
        return _rows(self.engine.impact(a["nodeId"], a.get("limit") or 50), "node_id")

    def _context(self, a: dict) -> str:
        top = self.engine.build_context(a["task"], a.get("depth") or 2).nodes
        first = top.select("total").first()
        return self.engine.render(top, a.get("limit") or 50, first.total if first else 0)

    def answer(self, message: dict) -> dict | None:
        """The response to one request; none to a notification."""
        if "id" not in message:
            return None
        try:
            return {"jsonrpc": "2.0", "id": message["id"], "result": self._result(message.get("method"), message.get("params") or {})}
        except LookupError as e:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32602, "message": f"unknown or missing: {e}"}}
        except NotImplementedError as e:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no method {e}"}}

    def _result(self, method: str | None, params: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "quillgraph", "version": "1"}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: v for k, v, _ in args}, "required": [k for k, _, must in args if must]}} for n, (d, args, _) in self.tools.items()]}
        if method == "tools/call":
            _, args, run = self.tools[params["name"]]
            given = params.get("arguments") or {}
            missing = [k for k, _, must in args if must and not given.get(k)]
            try:
                text, wrong = (f"Error: Missing '{missing[0]}' argument", True) if missing else (run(given), False)
            except ValueError as e:
                text, wrong = f"Error: {e}", True
            return {"content": [{"type": "text", "text": text}], "isError": wrong}
        if method == "resources/list":
            return {"resources": [{"uri": u, "name": n, "mimeType": kind} for u, (n, kind, _) in self.resources.items()]}
        if method == "resources/read":
            _, kind, read = self.resources[params["uri"]]
            return {"contents": [{"uri": params["uri"], "mimeType": kind, "text": read()}]}
        if method == "prompts/list":
            return {"prompts": [{"name": n, "description": d, "arguments": [{"name": a, "required": True} for a in args]} for n, d, args, _ in PROMPTS]}
        if method == "prompts/get":
            name, description, args, text = next((p for p in PROMPTS if p[0] == params["name"]), (None, None, None, None))
            if name is None:
                raise LookupError(params["name"])
            given = params.get("arguments") or {}
            return {"description": description, "messages": [{"role": "user", "content": {"type": "text", "text": text.format(**{a: given[a] for a in args})}}]}
        raise NotImplementedError(method)

    def serve(self, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
        """Answers a message a line until the input ends."""
        for line in source:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
            except ValueError:
                told = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            else:
                told = self.answer(message)
            if told is not None:
                sink.write(json.dumps(told) + "\n")
                sink.flush()


def _rows(df: DataFrame, order: str) -> str:
    """The first ``SHOWN`` rows as a JSON list."""
    return "[" + ", ".join(r.j for r in df.orderBy(order).limit(SHOWN).select(F.to_json(F.struct(*df.columns)).alias("j")).collect()) + "]"
