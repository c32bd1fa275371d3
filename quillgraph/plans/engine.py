"""The query API over a stored graph."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.operators import graph as g
from quillgraph.operators import modules as m
from quillgraph.operators import search as s
from quillgraph.operators.iterate import settle
from quillgraph.sources import files as f
from quillgraph.sources.store import Store

#: Node types that answer each kind of question.
WANTED = {"DEVELOPER": ["Function", "Method", "Class", "Interface", "Module", "Component", "TestFile"], "RESEARCHER": ["Concept", "Claim", "Decision", "Requirement", "Document"], "GENERAL": None}
EXPLORE_FLOOR, EXPLORE_BUDGET, EXPLORE_SYMBOLS, EDGE_CAP = 0.80, 15_000, 40, 20


INCOMPLETE = "... {more} more not shown (showing {shown} of {total}) -- raise 'limit' to see the rest. This list is INCOMPLETE."


@dataclass
class Bundle:
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame

    def average_confidence(self) -> float:
        """Of the nodes; 0 where there are none."""
        return self.nodes.agg(F.coalesce(F.avg("confidence"), F.lit(0.0))).first()[0]


@dataclass
class Explored:
    """modules(rank, id, name, path, description, score, method) and symbols(rank, id, label, type, path, line, line_end, score, full, used, source, edges, blast_radius)."""

    modules: DataFrame
    symbols: DataFrame


class Engine:
    """``root``: where the indexed files lie, for the text of symbols."""

    def __init__(self, store: Store, root: str | None = None):
        self.spark, self.root = store.spark, root
        self.nodes = store.read("nodes")
        # joined once, not in each round of a loop
        self.edges = settle(g.drop_dangling(self.nodes, store.read("edges")))
        self.provenance = store.read("provenance")
        self.artifacts = store.read("artifacts")

    def _bundle(self, ids: DataFrame, limit: int = 50) -> Bundle:
        chosen = self.nodes.join(ids, "id", "left_semi")
        top = g.bundle(chosen, self.edges, limit)
        evidence = self.provenance.join(top.select(F.col("id").alias("entity_id"), "position"), "entity_id").orderBy("position", "line")
        return Bundle(top, g.induced(chosen, self.edges), evidence)

    def node(self, ident: str) -> DataFrame:
        return self.nodes.where(F.col("id") == ident)

    def search(self, question: str, types: list[str] | None = None, min_confidence: float = 0.5, limit: int = 20) -> Bundle:
        """Ranked by PageRank times confidence among what the words find."""
        return self._bundle(s.search(self.nodes, question, types, min_confidence, limit))

    def build_context(self, task: str, depth: int = 2) -> Bundle:
        kind = self.spark.range(1).select(t.intent(F.lit(task))).first()[0]
        seeds = s.search(self.nodes, task, WANTED[kind], 0.5, 10)
        return self._bundle(g.expand(self.nodes, self.edges, seeds, depth).withColumnRenamed("node_id", "id"))

    def expand_node(self, ident: str, depth: int = 2, limit: int = 50) -> Bundle:
        return self._bundle(g.expand(self.nodes, self.edges, self.node(ident), depth).withColumnRenamed("node_id", "id"), limit)

    def find_path(self, source: str, target: str, by: str = "confidence") -> DataFrame:
        weight = {"confidence": F.col("confidence"), "hops": F.lit(1.0), "doubt": 1 - F.col("confidence")}[by]
        return g.find_path(self.nodes, self.edges, source, target, weight)

    def evidence(self, ident: str) -> DataFrame:
        return self.provenance.where(F.col("entity_id") == ident)

    def related_files(self, ident: str) -> DataFrame:
        return self.evidence(ident).select("path").distinct()

    def impact(self, ident: str, limit: int = 50) -> DataFrame:
        return g.impact(self.nodes, self.edges, ident, limit)

    def blast_radius(self, ident: str, floor: float = 0.0, max_depth: int = 3, max_nodes: int = 50) -> DataFrame:
        return g.blast_radius(self.nodes, self.edges, self.node(ident), floor, max_depth, max_nodes)

    def ranked_files(self, question: str) -> DataFrame:
        """file, position: the distinct files of the evidence of ``build_context``, in its order."""
        told = self.build_context(question).evidence
        order = F.struct("position", F.coalesce("line", F.lit(0)), "path")
        first = told.groupBy(F.col("path").alias("file")).agg(F.min(order).alias("at"))
        return first.select("file", F.row_number().over(Window.orderBy("at")).alias("position"))

    def modules(self) -> DataFrame:
        """id, path, name, build_system, parent_id."""
        return m.read_tree(self.nodes)

    def explore(self, question: str, budget: int = EXPLORE_BUDGET, similar: DataFrame | None = None) -> Explored:
        """Modules and symbols for a question, the best first; symbols with source, edges and dependents as far as the budget goes.

        ``similar`` (id, score): modules that an embedding finds, before those that words find.
        """
        tokens = self.spark.range(1).select(t.question_tokens(F.lit(question))).first()[0]
        tree = self.modules().withColumn("description", F.lit(None).cast("string")).select("id", "name", "path", "description")
        modules = settle(s.match_modules(tree, tokens, similar)) if tokens else tree.withColumn("score", F.lit(0.0)).withColumn("method", F.lit("")).withColumn("rank", F.lit(0)).where("false")
        if not tokens:
            none = self.nodes.where("false").select(F.lit(0).alias("rank"), "id", "label", "type")
            return Explored(modules, none)
        within = [r.path for r in modules.select("path").collect()]  # five at most
        ranked = settle(s.match_symbols(self.nodes, tokens, within, limit=EXPLORE_SYMBOLS))
        seeds = ranked.select("id")
        hits = g.blast_radius(self.nodes, self.edges, seeds, EXPLORE_FLOOR).groupBy(F.col("seed").alias("id")).agg(F.array_sort(F.collect_list(F.struct("hops", "node_id"))).alias("blast_radius"))
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("into"), F.col("type"), F.col("dst").alias("other"), "confidence"), F.struct(F.col("dst").alias("id"), F.lit(1).alias("into"), F.col("type"), F.col("src").alias("other"), "confidence"))).alias("e")).select("e.*")
        ends = ends.join(F.broadcast(seeds), "id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("into", "type", "other"))).where(F.col("n") <= EDGE_CAP)
        views = ends.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "type", "other", "confidence"))).alias("edges"))
        # the bundle is forty symbols at most: its parts meet in one small table
        full = ranked.join(views, "id", "left").join(hits, "id", "left").join(self._sources(ranked), "id", "left")
        empty = F.greatest(F.coalesce(F.size("edges"), F.lit(0)), F.lit(0)), F.greatest(F.coalesce(F.size("blast_radius"), F.lit(0)), F.lit(0))
        chars = F.coalesce(F.length("source"), F.lit(0)) + F.length("label") + 60 + 40 * (empty[0] + empty[1])
        brief = F.length("label") + F.coalesce(F.length("path"), F.lit(0)) + 30
        cost = full.withColumn("cost", F.greatest(F.floor(chars / 4), F.lit(1)).cast("long")).withColumn("brief", F.greatest(F.floor(brief / 4), F.lit(1)).cast("long")).withColumn("one", F.lit(1))
        packed = t.pack_budget(cost, budget, "one", "rank", "cost", "brief")
        shown = [F.when(F.col("full"), F.col(c)).alias(c) for c in ("source", "edges", "blast_radius")]
        return Explored(modules, packed.select("rank", "id", "label", "type", "path", "line", "line_end", "score", "full", "used", *shown))

    def _sources(self, symbols: DataFrame) -> DataFrame:
        """id, source: the lines of symbols(id, path, line, line_end) as they stand in their files."""
        if self.root is None:
            return symbols.select("id", F.lit(None).cast("string").alias("source"))
        text = f.read_text(self.spark, self.root, symbols)
        return symbols.select("id", "path", "line", "line_end").join(text, "path").select("id", t.slice_lines(F.col("content"), F.col("line"), F.col("line_end")).alias("source"))

    def render(self, nodes: DataFrame, limit: int = 30, total: int | None = None) -> str:
        """The first ``limit`` of nodes(position, id, label, type), each with its place, and how many are not shown."""
        place = self.provenance.groupBy(F.col("entity_id").alias("id")).agg(F.min(F.struct("path", "line", "line_end")).alias("at"))
        total = nodes.count() if total is None else total
        rows = nodes.orderBy("position").limit(limit).join(place, "id", "left").orderBy("position").collect()
        out = []
        for r in rows:
            lines = "-".join(dict.fromkeys(str(x) for x in (r["at"].line, r["at"].line_end) if x is not None)) if r["at"] else ""
            out.append(f"[{r.type}] {r.label}\n  id={r.id}" + (f"\n  at {r['at'].path}{':' + lines if lines else ''}" if r["at"] else ""))
        if total > len(rows):
            out.append(INCOMPLETE.format(more=total - len(rows), shown=len(rows), total=total))
        return "\n".join(out)

    def report(self) -> str:
        """Markdown; only small aggregates come to the driver."""
        n, e, a = self.nodes.count(), self.edges.count(), self.artifacts.count()
        out = ["# Graph report", "", f"{a} artifacts, {n} nodes, {e} edges", "", "## Artifacts by type", ""]
        out += [f"- {r.type}: {r['count']}" for r in self.artifacts.groupBy("type").count().orderBy(F.desc("count"), "type").collect()]
        ranks = g.pagerank(self.nodes, self.edges).join(self.nodes.select("id", "label"), "id").withColumn("r", F.round("rank", 9))
        out += ["", "## Most important", "", *(f"- {r.label} (`{r.id}`): {r.r:.4f}" for r in ranks.orderBy(F.desc("r"), "id").limit(10).collect())]
        deg = g.degrees(self.nodes, self.edges).select("id", (F.col("in_degree") + F.col("out_degree")).alias("d"))
        out += ["", "## Most connected", "", *(f"- `{r.id}`: {r.d}" for r in deg.orderBy(F.desc("d"), "id").limit(10).collect())]
        out += ["", "## Clusters", "", *(f"- {r['size']} nodes: {', '.join(x or '' for x in r.labels)}" for r in g.clusters(self.nodes, self.edges, 5, 3).orderBy(F.desc("size"), "component").collect())]
        out += ["", "## Low confidence", "", *(f"- `{r.id}` {r.confidence:.2f}" for r in self.edges.where(F.col("confidence") < g.LOW_CONFIDENCE).orderBy("id").limit(20).collect())]
        out += ["", "## Isolated", "", *(f"- `{r.id}`" for r in g.isolated(self.nodes, self.edges).orderBy("id").limit(20).collect())]
        return "\n".join(out) + "\n"

    def export_json(self, path: str) -> None:
        """Nodes, edges and artifacts as JSON lines in three folders; written by the executors."""
        for name, df in (("nodes", self.nodes), ("edges", self.edges), ("artifacts", self.artifacts)):
            df.write.mode("overwrite").json(f"{path}/{name}")

    def html(self, limit: int = 500) -> str:
        """A page that draws up to ``limit`` nodes of confidence 0.5 or more, coloured by type, and the edges among them."""
        top = self.nodes.where("confidence >= 0.5").orderBy("id").limit(limit).select("id", F.left("label", F.lit(50)).alias("label"), "type")
        edges = g.induced(top, self.edges.where("confidence >= 0.5")).select("src", "dst", "type")
        data = json.dumps({"nodes": [r.asDict() for r in top.collect()], "edges": [r.asDict() for r in edges.collect()]}).replace("<", "\\u003c")
        return _PAGE.replace("DATA", data)


_PAGE = """<!DOCTYPE html><meta charset='utf-8'><title>Graph</title><style>svg{width:100%;height:95vh}text{font:9px sans-serif}</style><svg viewBox='-520 -520 1040 1040'></svg><script>
const graph = DATA, svg = document.querySelector('svg'), kinds = [...new Set(graph.nodes.map(n => n.type))].sort(), at = {};
const colour = type => `hsl(${360 * kinds.indexOf(type) / kinds.length} 65% 50%)`;
const add = (name, attributes, text) => { const e = document.createElementNS('http://www.w3.org/2000/svg', name); for (const k in attributes) e.setAttribute(k, attributes[k]); if (text) e.textContent = text; svg.append(e); };
graph.nodes.sort((a, b) => a.type < b.type ? -1 : a.type > b.type ? 1 : 0).forEach((n, i) => { const t = 2 * Math.PI * i / graph.nodes.length; at[n.id] = [480 * Math.cos(t), 480 * Math.sin(t)]; });
graph.edges.forEach(e => { const [a, b] = [at[e.src], at[e.dst]]; add('path', {d: `M${a}Q0 0 ${b}`, fill: 'none', stroke: '#999', 'stroke-opacity': .4}); });
graph.nodes.forEach(n => { const [x, y] = at[n.id]; add('circle', {cx: x, cy: y, r: 4, fill: colour(n.type)}); add('text', {x: x + 5, y: y + 3}, n.label); });
kinds.forEach((k, i) => add('text', {x: -515, y: -500 + 12 * i, fill: colour(k)}, k));
</script>"""
