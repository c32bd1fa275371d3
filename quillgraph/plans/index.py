"""Indexing a directory: changed files are parsed, unchanged ones kept, and derived edges rebuilt from all references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import modules as m
from quillgraph.operators import resolve as r
from quillgraph.operators.iterate import settle
from quillgraph.sources import extract as x
from quillgraph.sources import files as f
from quillgraph.sources import grammars
from quillgraph.sources.store import Store


@dataclass
class IndexStats:
    artifacts: int
    nodes: int
    edges: int
    skipped: int
    failed: int
    warnings: int


def _document_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of Markdown, SQL, build and configuration files and of documents with pages."""
    art = F.col("artifact_id")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("fqn", "string"), ("kind", "string"), ("supertypes", "array<string>"), ("returns", "string"))]

    def node(df: DataFrame, ident, kind: str, label, confidence: float, line=F.lit(1)) -> DataFrame:
        return df.select(ident.alias("id"), F.lit(kind).alias("type"), label.alias("label"), F.lit(confidence).alias("confidence"), *none, art.alias("path"), line.cast("int").alias("line"), F.lit(None).cast("int").alias("line_end"))

    def edge(df: DataFrame, kind: str, src, dst, name: str, confidence: float) -> DataFrame:
        return df.select(F.concat_ws(":", F.lit(name), src, dst).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))

    md, sql = docs.where("type = 'MarkdownFile'"), docs.where("type = 'DatabaseSchema'")
    package, gradle = docs.where("path rlike '(^|/)package[.]json$'"), docs.where("path rlike '[.]gradle([.]kts)?$'")
    file = F.concat(F.lit("file:"), art)
    h, b, links, special = x.headings(md), x.bold_concepts(md), x.links(md), x.special_lines(md)
    tables, columns, keys = x.sql_tables(sql), x.sql_columns(sql), x.sql_foreign_keys(sql)
    deps, gdeps = x.package_json(package), x.gradle(gradle)
    config = docs.where("type = 'ConfigFile'")
    images = x.dockerfile(config.where("lower(path) rlike '(^|/)dockerfile([.][^/]*)?$'"))
    services = x.compose_services(config.where("lower(path) rlike '(^|/)(docker-)?compose[^/]*[.]ya?ml$'"))
    paged = docs.where("type in ('PDF', 'Document')")
    pages, cited = x.page_sections(paged), x.section_citations(paged)
    image, service = F.concat(F.lit("image:"), "image"), F.concat(F.lit("service:"), "service")
    cite = F.concat(F.lit("citation:"), art, F.lit(":"), F.col("citation"))
    page = F.concat(F.lit("section:"), art, F.lit(":"), F.col("label"))
    section = F.concat(F.lit("section:"), art, F.lit(":"), F.col("label"))
    parent = F.when(F.col("parent").isNull(), file).otherwise(F.concat(F.lit("section:"), art, F.lit(":"), F.col("parent")))
    concept = F.concat(F.lit("concept:"), F.lower(F.regexp_replace("label", r"\s+", "_")))
    table = F.concat(F.lit("table:"), art, F.lit(":"), F.col("table"))
    column = F.concat(F.lit("column:"), art, F.lit(":"), F.col("table"), F.lit(":"), F.col("column"))
    target = F.concat(F.lit("table:"), art, F.lit(":"), F.col("target"))
    dep = F.concat(F.when(F.col("kind") == "script", F.concat(F.lit("script:"), art, F.lit(":"))).when(F.col("kind") == "project", F.lit("gradle-project:")).otherwise(F.lit("dep:")), F.col("name"))
    pkg, schema = F.concat(F.lit("file:"), art), F.concat(F.lit("schema:"), art)
    nodes = [
        node(docs.where("type in ('MarkdownFile', 'PackageFile', 'ConfigFile', 'PDF', 'Document')"), file, "File", F.substring_index("path", "/", -1), 1.0),
        node(h, section, "Concept", F.col("label"), x.HEADING, F.col("idx") + 1),
        node(b, concept, "Concept", F.col("label"), x.CONCEPT),
        node(links, F.concat(F.lit("link:"), "destination"), "Document", F.col("destination"), x.CONCEPT),
        node(special.where("type = 'Decision'"), F.concat(F.lit("decision:"), art, F.lit(":"), "idx"), "Decision", F.col("label"), x.HEADING, F.col("idx") + 1),
        node(special.where("type = 'Requirement'"), F.concat(F.lit("requirement:"), art, F.lit(":"), "idx"), "Requirement", F.col("label"), x.CONCEPT, F.col("idx") + 1),
        node(sql, schema, "DatabaseSchema", F.substring_index("path", "/", -1), 1.0),
        node(tables, table, "Table", F.col("table"), x.SQL_PATTERN),
        node(columns, column, "Column", F.col("column"), x.SQL_PATTERN),
        node(images, image, "Component", F.col("image"), x.DEPENDENCY),
        node(services, service, "Component", F.col("service"), x.DEPENDENCY),
        node(pages, page, "Concept", F.col("label"), x.SECTION, F.col("idx") + 1),
        node(cited.select("artifact_id", "citation").distinct(), cite, "Claim", F.col("citation"), x.CONCEPT),
        node(deps.union(gdeps).where("kind <> 'script'"), dep, "Module", F.col("name"), x.DEPENDENCY),
        node(deps.where("kind = 'script'"), dep, "Function", F.col("name"), x.DEPENDENCY),
    ]
    edges = [
        edge(h, "contains", parent, section, "contains", x.HEADING),
        edge(b, "defines", file, concept, "defines", x.CONCEPT),
        edge(x.section_links(md), "references", F.when(F.col("label").isNull(), file).otherwise(section), F.concat(F.lit("link:"), "destination"), "references", x.CONCEPT),
        edge(tables, "contains", schema, table, "contains", x.SQL_PATTERN),
        edge(columns, "contains", table, column, "contains", x.SQL_PATTERN),
        edge(images, "uses", file, image, "uses", x.DEPENDENCY),
        edge(services, "contains", file, service, "contains", x.DEPENDENCY),
        edge(pages, "contains", file, page, "contains", x.SECTION),
        edge(cited, "cites", F.when(F.col("label").isNull(), file).otherwise(page), cite, "cites", x.CONCEPT),
        edge(keys, "depends_on", table, target, "fk", x.SQL_PATTERN),
        edge(deps.union(gdeps).where("kind <> 'script'"), "depends_on", pkg, dep, "depends", x.DEPENDENCY),
        edge(deps.where("kind = 'script'"), "contains", pkg, dep, "contains", x.DEPENDENCY),
    ]

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates(["id"])

    return union(nodes), union(edges)


def index(spark: SparkSession, root: str, store: Store, config: f.Config | None = None, purge: bool = True, fresh: bool = False) -> IndexStats:
    """Brings the store up to date with the files below ``root``. ``purge``: files that are gone leave the graph. ``fresh``: all files are read anew."""
    with store.locked():
        now = settle(f.read_files(spark, root, config))
        old = store.read("artifacts") if store.exists() and not fresh else None
        state = f.changes(now, old if old is not None else now.where("false"))
        state = settle(state)
        todo = now.join(state.where("state in ('added', 'changed')"), "path", "left_semi")
        rows = settle(grammars.extract(todo.where("type in ('CodeFile', 'TestFile')")))
        nodes, edges, refs, warnings = grammars.split(rows)
        doc_nodes, doc_edges = _document_rows(todo.withColumn("artifact_id", F.col("path")))
        nodes, edges = nodes.unionByName(doc_nodes).dropDuplicates(["id"]), edges.unionByName(doc_edges)
        nodes = nodes.withColumn("properties", F.to_json(F.struct("fqn", "kind", "returns", "supertypes")))
        provenance = nodes.select(F.col("path").alias("artifact_id"), F.col("id").alias("entity_id"), F.lit("node").alias("entity_kind"), "path", "line", "line_end")
        edges = edges.withColumn("rung", F.lit(None).cast("string")).withColumn("lines", F.lit(None).cast("array<int>"))
        if old is not None:
            gone = state.where("state = 'changed'" + (" or state = 'removed'" if purge else "")).select(F.col("path").alias("artifact_id"))
            n, e, p = f.replace_artifacts(store.read("nodes"), store.read("edges"), store.read("provenance"), gone)
            keep = gone.withColumnRenamed("artifact_id", "path")
            n = n.where("type <> 'CodeModule'")
            nodes, provenance = n.unionByName(nodes, allowMissingColumns=True).dropDuplicates(["id"]), p.unionByName(provenance, allowMissingColumns=True)
            edges = e.where("type not in ('calls', 'implements', 'sibling_of')").unionByName(edges).dropDuplicates(["id"])
            refs = store.read("refs").join(keep, "path", "left_anti").unionByName(refs)
            warnings = store.read("diagnostics").join(keep, "path", "left_anti").unionByName(warnings)
        roots = config.module_roots if config else None
        modules = settle(m.detect(now.select("path", "content"), roots))  # anew from all files, as one file may change what others are
        nodes = nodes.unionByName(m.as_nodes(modules), allowMissingColumns=True)
        held = modules.where("parent_id is not null").select(F.concat_ws(":", F.lit("contains"), "parent_id", "id").alias("id"), F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("type"), F.lit(1.0).alias("confidence"))
        edges = edges.where("src not like 'module:%'").unionByName(held, allowMissingColumns=True)
        nodes, edges, refs = settle(nodes), settle(edges), settle(refs)
        edges = edges.unionByName(derive(nodes, edges, refs))
        arts = now.select("id", "type", "path", "checksum", "size")
        store.write(artifacts=arts, nodes=nodes, edges=edges, provenance=provenance, refs=refs, diagnostics=warnings)
        skipped = state.where("state = 'same'").count()
        told = store.read("diagnostics").groupBy("severity").count().collect()
        failed = sum(r["count"] for r in told if r.severity == "ERROR")
        return IndexStats(arts.count(), store.read("nodes").count(), store.read("edges").count(), skipped, failed, sum(r["count"] for r in told) - failed)


def derive(nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Calls, implements and sibling edges of all references and nodes."""
    imports = edges.where("type = 'imports'").select(F.col("src").alias("path"), "dst").join(nodes.select(F.col("id").alias("dst"), "label"), "dst")
    tokens = imports.select("path", F.explode(F.split("label", r"[./\\]")).alias("token")).where("token <> ''").distinct()
    pairs = nodes.where("type in ('Class', 'Interface', 'Enum', 'Record')").select(F.col("label").alias("sub"), F.explode("supertypes").alias("super")).distinct()
    typed = _receivers(refs, nodes, pairs)
    calls = r.resolve(typed, nodes, tokens).select("id", "src", "dst", F.lit("calls").alias("type"), "confidence", "rung", "lines")
    impl = r.implements_edges(nodes).select(F.concat_ws(":", F.lit("implements"), "src", "dst").alias("id"), "src", "dst", F.lit("implements").alias("type"), F.lit(r.IMPLEMENTS).alias("confidence"))
    sib = r.siblings(nodes.where("type <> 'Module'")).select(F.concat_ws(":", F.lit("sibling_of"), "src", "dst").alias("id"), "src", "dst", F.lit("sibling_of").alias("type"), F.lit(r.SIBLING).alias("confidence"))
    return calls.unionByName(impl.unionByName(sib), allowMissingColumns=True)


def _receivers(refs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """References whose receiver is a call get the type that all candidates of this call return."""
    from quillgraph.operators.graph import subtype_closure

    open_refs = refs.where("receiver_type is null and receiver_call is not null")
    if open_refs.isEmpty():
        return refs
    calls = nodes.where(F.col("type").isin(r.CALLABLE)).select(F.col("label").alias("receiver_call"), F.col("id").alias("candidate"), "returns")
    common = r.common_return(open_refs.select("ref_id", "receiver_call").join(calls, "receiver_call"), subtype_closure(pairs))
    return refs.join(common, "ref_id", "left").withColumn("receiver_type", F.coalesce("receiver_type", "common")).drop("common")
