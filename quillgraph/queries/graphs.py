"""Lookups, statistics, traversals and rankings of the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import graph as g
from quillgraph.plans.derived import SQL, edges, links, nodes, numbered, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.replace("GRAPH", SQL)
        return f

    return add


def _seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query("with GRAPH select 'nodes' as what, count(*) as n from nodes union all select 'edges', count(*) from edges union all select 'artifacts', count(*) from documents")
def graph_stats(spark, d):
    counts = [nodes(spark, d).agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n"), edges(spark, d).agg(F.count("*")).select(F.lit("edges"), "count(1)"), table(spark, d, "documents").agg(F.count("*")).select(F.lit("artifacts"), "count(1)")]
    return counts[0].union(counts[1]).union(counts[2])


@query("with GRAPH select type, count(*) as n from nodes group by type")
def node_type_histogram(spark, d):
    return nodes(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query("with GRAPH select type, count(*) as n, round(avg(confidence), 6) as confidence from edges group by type")
def edge_type_histogram(spark, d):
    return edges(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("select source, lang, count(*) as n from documents group by source, lang")
def artifact_type_histogram(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("with GRAPH select id, type, label, confidence from nodes where id = 'part:7'")
def node_lookup(spark, d):
    return nodes(spark, d).where("id = 'part:7'")


@query("with GRAPH select id, src, dst from edges where confidence >= 0.9 and type = 'calls'")
def edges_min_confidence(spark, d):
    return edges(spark, d).where("confidence >= 0.9 and type = 'calls'").select("id", "src", "dst")


@query("with GRAPH select id, label from nodes where type in ('supplier', 'nation')")
def nodes_by_type(spark, d):
    return nodes(spark, d).where(F.col("type").isin("supplier", "nation")).select("id", "label")


@query("with GRAPH select id, type from nodes where label = (select p_name from part where p_partkey = 3)")
def nodes_by_label(spark, d):
    label = table(spark, d, "part").where("p_partkey = 3").select(F.col("p_name").alias("label"))
    return nodes(spark, d).join(F.broadcast(label.limit(1)), "label", "left_semi").select("id", "type")


@query("with GRAPH select id, confidence from edges where confidence < 0.65")
def low_confidence_edges(spark, d):
    return edges(spark, d).where(F.col("confidence") < g.LOW_CONFIDENCE).select("id", "confidence")


@query("with GRAPH select id from nodes where id not in (select src from edges union select dst from edges)")
def isolated_nodes(spark, d):
    return g.isolated(nodes(spark, d), edges(spark, d)).select("id")


@query("with GRAPH select n.id, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree from nodes n left join (select dst, count(*) as n from edges group by dst) i on i.dst = n.id left join (select src, count(*) as n from edges group by src) o on o.src = n.id")
def in_out_degree(spark, d):
    return g.degrees(nodes(spark, d), edges(spark, d))


@query("with GRAPH select id, count(*) as degree from (select src as id from edges union all select dst from edges) group by id order by degree desc, id limit 10")
def top_degree(spark, d):
    deg = g.degrees(nodes(spark, d), edges(spark, d))
    return deg.select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree")).orderBy(F.desc("degree"), "id").limit(10)


@query("with GRAPH select id, dst from edges where src = 'part:1'")
def edges_out(spark, d):
    return g.edges_out(edges(spark, d), "part:1").select("id", "dst")


@query("with GRAPH select id, src from edges where dst = 'supplier:1'")
def edges_in(spark, d):
    return g.edges_in(edges(spark, d), "supplier:1").select("id", "src")


@query("with GRAPH select distinct id, src, dst from edges where src in (select id from nodes where type in ('part', 'supplier')) and dst in (select id from nodes where type in ('part', 'supplier'))")
def induced_subgraph(spark, d):
    return g.induced(nodes(spark, d).where(F.col("type").isin("part", "supplier")), edges(spark, d)).select("id", "src", "dst")


@query("with GRAPH select type, count(*) as n from edges where src in (select id from nodes where type <> 'supplier') and dst in (select id from nodes where type <> 'supplier') group by type")
def dangling_edge_filter(spark, d):
    return g.drop_dangling(nodes(spark, d).where("type <> 'supplier'"), edges(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


_BOTH = "b as (select src as u, dst as v, type from edges union all select dst, src, type from edges)"


@query(f"with recursive GRAPH, {_BOTH}, r(id, h) as (select 'supplier:3', 0 union select b.v, r.h + 1 from r join b on b.u = r.id where r.h < 2) select id as node_id, min(h) as hops from r group by id")
def expand_depth2(spark, d):
    return g.expand(nodes(spark, d), edges(spark, d), _seed(spark, "supplier:3"), 2)


@query(f"with recursive GRAPH, {_BOTH}, r(id, h) as (select 'nation:2', 0 union select b.v, r.h + 1 from r join b on b.u = r.id and b.type = 'contains' where r.h < 2) select id as node_id, min(h) as hops from r group by id")
def expand_typed(spark, d):
    return g.expand(nodes(spark, d), edges(spark, d), _seed(spark, "nation:2"), 2, ["contains"])


@query(f"with recursive GRAPH, {_BOTH}, r(id, h) as (select 'nation:2', 0 union select b.v, r.h + 1 from r join b on b.u = r.id and b.type = 'contains' where r.h < 2), w as (select id from r group by id having min(h) < 2) select distinct id from edges where type = 'contains' and (src in (from w) or dst in (from w))")
def expand_edges(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return g.expanded_edges(e, g.expand(n, e, _seed(spark, "nation:2"), 2, ["contains"]), 2, ["contains"]).select("id")


def _blast(floor: float, limit: str) -> str:
    return f"with recursive GRAPH, r(seed, id, h) as (select s, s, 0 from (values ('supplier:5'), ('nation:3')) t(s) union select r.seed, e.src, r.h + 1 from r join edges e on e.dst = r.id and e.confidence >= {floor} and e.type in ('calls', 'contains') where r.h < 3), m as (select seed, id, min(h) as hops from r group by seed, id having min(h) > 0) select seed, node_id, hops from (select seed, id as node_id, hops, row_number() over (partition by seed order by hops, id) as n from m) {limit}"


@query(_blast(0.0, "where n <= 50"))
def blast_radius(spark, d):
    return g.blast_radius(nodes(spark, d), edges(spark, d), _seed(spark, "supplier:5", "nation:3")).select("seed", "node_id", "hops")


@query(_blast(0.8, ""))
def blast_radius_floor(spark, d):
    return g.blast_radius(nodes(spark, d), edges(spark, d), _seed(spark, "supplier:5", "nation:3"), 0.8, 3, None).select("seed", "node_id", "hops")


@query("with GRAPH, x as (select distinct src as node_id from edges where dst = 'part:5') select node_id, count(*) over () as total from x order by node_id limit 20")
def impact_direct(spark, d):
    return g.impact(nodes(spark, d), edges(spark, d), "part:5", 20)


@query("with recursive GRAPH, r(id, c) as (select 'order:1', 0.0::double union select e.dst, round(r.c + e.confidence, 9) from r join edges e on e.src = r.id where r.c < 6) select id as node_id, round(min(c), 6) as distance from r group by id")
def shortest_distance(spark, d):
    return g.distances(edges(spark, d), "order:1").select("node_id", F.round("distance", 6).alias("distance"))


@query("with recursive GRAPH, r(id, c) as (select 'order:2', 0 union select e.dst, r.c + 1 from r join edges e on e.src = r.id where r.c < 4) select id as node_id, cast(min(c) as double) as distance from r group by id")
def hop_distance(spark, d):
    return g.distances(edges(spark, d), "order:2", F.lit(1.0)).select("node_id", "distance")


_RANK = """, link as (select src, dst, sum(confidence) as w from edges where src in (select id from nodes) and dst in (select id from nodes) group by src, dst),
deg as (select src, sum(w) as w from link group by src),
num as (select count(*)::double as n from nodes),
r(i, id, rank) as (select 0, id, 1 / num.n from nodes, num
  union all select r.i + 1, k.id, (0.15 + 0.85 * coalesce((select sum(x.rank) from r x where x.id not in (select src from deg)), 0)) / max(num.n) + 0.85 * coalesce(max(got.s), 0)
  from r join nodes k on k.id = r.id cross join num
  left join (select link.dst, sum(r2.rank * link.w / deg.w) as s from link join r r2 on r2.id = link.src join deg on deg.src = link.src group by link.dst) got on got.dst = k.id
  where r.i < 10 group by r.i, k.id)"""


def _ranks(spark, d):
    return g.pagerank(nodes(spark, d), edges(spark, d), iterations=10, tolerance=None)


@query(f"with recursive GRAPH{_RANK} select id, round(rank, 10) as rank from r where i = 10")
def pagerank_10(spark, d):
    return _ranks(spark, d).select("id", F.round("rank", 10).alias("rank"))


@query(f"with recursive GRAPH{_RANK} select id, round(rank, 10) as rank from (select id, round(rank, 12) as rank from r where i = 10) order by rank desc, id limit 10")
def pagerank_top10(spark, d):
    ranks = _ranks(spark, d).select("id", F.round("rank", 12).alias("rank"))
    return ranks.orderBy(F.desc("rank"), "id").limit(10).select("id", F.round("rank", 10).alias("rank"))


@query(f"with recursive GRAPH{_RANK} select id, label, row_number() over (order by score desc, id) as position, total from (select r.id, label, round(rank * confidence, 12) as score, count(*) over () as total from r join nodes on nodes.id = r.id where i = 10) order by position limit 15")
def bundle_rank(spark, d):
    return g.bundle(*numbered(spark, d), limit=15, iterations=10, tolerance=None, by="name").select(F.col("name").alias("id"), "label", "position", "total")


#: Smallest labels next to each node, in more rounds than the longest path has edges: the types' chain is shorter than that.
_SAME = """, e2 as (select src as u, dst as v from edges where src in (select id from nodes) and dst in (select id from nodes) union select dst, src from edges where src in (select id from nodes) and dst in (select id from nodes)),
r(i, id, c) as (select 0, id, id from nodes
  union all select r.i + 1, r.id, least(min(r.c), coalesce(min(near.c), min(r.c)))
  from r left join (select e2.u, min(x.c) as c from e2 join r x on x.id = e2.v group by e2.u) near on near.u = r.id
  where r.i < 16 group by r.i, r.id),
k as (select id, c from r where i = 16)"""


@query(f"with recursive GRAPH{_SAME} select id, c as component from k")
def connected_components(spark, d):
    return g.components(nodes(spark, d), links(spark, d))


@query(f"with recursive GRAPH{_SAME} select c as component, count(*) as size from k group by c")
def component_sizes(spark, d):
    return g.components(nodes(spark, d), links(spark, d)).groupBy("component").agg(F.count("*").alias("size"))


@query(f"with recursive GRAPH{_SAME}, z as (select nodes.label, c, count(*) over (partition by c) as size, row_number() over (partition by c order by nodes.id) as n from nodes join k using (id)), t as (select c, any_value(size) as size from z group by c order by 2 desc, c limit 20) select c as component, z.size, string_agg(label, '|' order by n) as labels from z join t using (c) where n <= 5 group by c, z.size")
def graph_clusters(spark, d):
    return g.clusters(nodes(spark, d), links(spark, d)).select("component", "size", F.array_join("labels", "|").alias("labels"))


# the way with the fewest hops is not unique, but its length is, and each step is an edge
@query("with recursive GRAPH, r(id, h) as (select 'order:3', 0 union select e.dst, r.h + 1 from r join edges e on e.src = r.id where r.h < 6), b as (select min(h) as h from r where id = 'region:2' or id = 'nation:4') select cast(coalesce(h, -1) as int) as steps, true as linked from b")
def find_path_length(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    path = g.find_path(n, e, "order:3", "nation:4", F.lit(1.0))
    pairs = path.alias("a").join(path.alias("b"), F.col("b.step") == F.col("a.step") + 1).select(F.col("a.node_id").alias("src"), F.col("b.node_id").alias("dst"))
    bad = pairs.join(e.select("src", "dst"), ["src", "dst"], "left_anti").agg(F.count("*").alias("bad"))
    return path.agg(F.coalesce(F.max("step"), F.lit(-1)).alias("steps")).crossJoin(bad).select("steps", (F.col("bad") == 0).alias("linked"))


@query("with recursive p as (select distinct p_brand || '/' || p_type as sub, p_brand as super from part union select distinct p_brand, 'Thing' from part), r(sub, super) as (select sub, sub from p union select super, super from p union select r.sub, p.super from r join p on p.sub = r.super) select sub, super from r")
def transitive_subtypes(spark, d):
    part = table(spark, d, "part")
    pairs = part.select(F.concat("p_brand", F.lit("/"), "p_type").alias("sub"), F.col("p_brand").alias("super")).union(part.select("p_brand", F.lit("Thing"))).distinct()
    return g.subtype_closure(pairs)
