"""Graph operators over nodes(id, type, label, confidence) and edges(id, src, dst, type, confidence).

Edges point from the dependent to what it depends on, so what a change reaches is found against their direction.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.iterate import forget, settle, steady

LOW_CONFIDENCE = 0.65
#: Nodes under one label that a join by this label may put in one task; a label with more meets its own in a broadcast.
HOT = 1_000_000
#: Edges, and bytes of them, that a task joins at once.
CHUNK, CHUNK_BYTES = 2_000_000, 64 << 20
#: Rows of a table of parts that a broadcast holds.
SMALL = 100_000


def edges_out(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node)


def edges_in(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node)


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes; parallel edges stay."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes, each id once."""
    return drop_dangling(nodes, edges).dropDuplicates(["id"])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of every node; parallel edges count."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    sums = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(ends, "id", "left_anti")


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, types: list[str] | None = None) -> DataFrame:
    """node_id and hops of all that an undirected walk of ``depth`` steps from the seeds (column id) reaches. Missing nodes stop it."""
    used = steady((edges.where(F.col("type").isin(types)) if types else edges).select("src", "dst"))
    steps = used.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(used.select("dst", "src"))
    known = nodes.select("id")
    frontier = settle(seeds.select("id").distinct().join(known, "id", "left_semi"))
    seen = frontier.select("id", F.lit(0).alias("hops"))
    for hop in range(1, depth + 1):
        reached = steps.join(frontier.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = settle(reached.join(seen, "id", "left_anti").join(known, "id", "left_semi"))
        seen = seen.union(frontier.select("id", F.lit(hop).alias("hops")))
    return seen.select(F.col("id").alias("node_id"), "hops")


def expanded_edges(edges: DataFrame, reached: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """Edges at the nodes that ``expand`` walked on from (hops below ``depth``), each once."""
    used = edges.where(F.col("type").isin(types)) if types else edges
    inner = reached.where(F.col("hops") < depth).select("node_id")
    out = used.join(inner.withColumnRenamed("node_id", "src"), "src", "left_semi").select(edges.columns)
    into = used.join(inner.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(edges.columns)
    return out.union(into).dropDuplicates(["id"])


def blast_radius(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, floor: float = 0.0, max_depth: int = 3, max_nodes: int | None = 50, types: tuple[str, ...] = ("calls", "contains")) -> DataFrame:
    """seed, node_id, hops, via_edge: dependents against the edges' direction, at their fewest hops, for each seed (column id).

    Only edges of ``types`` at ``floor`` or above count. The edge of the smallest id tells how a node was reached. At
    most ``max_nodes`` nodes a seed, nearest first, then by id (all, if None).
    """
    used = steady(edges.where(F.col("type").isin(*types) & (F.col("confidence") >= floor)).select("src", "dst", F.col("id").alias("via_edge")))
    frontier = settle(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node_id")).distinct())
    seen = frontier.select("seed", "node_id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via_edge"))
    for hop in range(1, max_depth + 1):
        step = used.join(frontier, used["dst"] == frontier["node_id"]).groupBy("seed", F.col("src").alias("node_id")).agg(F.min("via_edge").alias("via_edge"))
        step = step.join(seen.select("seed", "node_id"), ["seed", "node_id"], "left_anti").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
        step = settle(step.select("seed", "node_id", F.lit(hop).alias("hops"), "via_edge"))
        frontier = step.select("seed", "node_id")
        seen = seen.union(step)
    hits = seen.where("hops > 0")
    if max_nodes is None:
        return hits
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("hops", "node_id"))).where(F.col("n") <= max_nodes).drop("n")


def impact(nodes: DataFrame, edges: DataFrame, node: str, limit: int = 50) -> DataFrame:
    """node_id and total: direct dependents by edges of any type, the first ``limit`` by id; the total is before the limit."""
    direct = edges_in(edges, node).select(F.col("src").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")
    counted = direct.crossJoin(F.broadcast(direct.agg(F.count("*").alias("total"))))
    return counted.select(F.col("id").alias("node_id"), "total").orderBy("node_id").limit(limit)


def distances(edges: DataFrame, source: str, weight: Column | None = None, rounds: int = 100, digits: int = 9) -> DataFrame:
    """node_id, distance, via: least sums of weights along directed paths from ``source``; via is the last edge.

    ``weight`` defaults to the confidence, so paths of little confidence are the short ones. Relaxed until nothing
    changes; sums are rounded to ``digits``. Ties: the edge of the smallest id.
    """
    spark = edges.sparkSession
    used = edges.select("src", "dst", F.col("id").alias("via"), (F.col("confidence") if weight is None else weight).cast("double").alias("w"))
    used = steady(used)
    best = settle(spark.createDataFrame([(source, 0.0, None)], "node_id string, distance double, via string"))
    moved = best
    for _ in range(rounds):
        step = used.join(moved.select(F.col("node_id").alias("src"), "distance"), "src")
        step = step.groupBy(F.col("dst").alias("node_id")).agg(F.min(F.struct(F.round(F.col("distance") + F.col("w"), digits).alias("distance"), "via")).alias("s"))
        step = step.select("node_id", "s.distance", "s.via")
        old = best.select("node_id", F.col("distance").alias("old"))
        moved = settle(step.join(old, "node_id", "left").where("old is null or distance < old").select("node_id", "distance", "via"))
        if moved.isEmpty():
            break
        best = settle(best.join(moved, "node_id", "left_anti").select("node_id", "distance", "via").union(moved))
    return best


def find_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, weight: Column | None = None) -> DataFrame:
    """step, node_id from ``source`` to ``target``; no rows if there is no path. One row if they are the same node."""
    spark = edges.sparkSession
    if nodes.where(F.col("id").isin(source, target)).select("id").distinct().count() < len({source, target}):
        return spark.createDataFrame([], "step int, node_id string")
    best = distances(drop_dangling(nodes, edges), source, weight)
    jump = settle(best.join(edges.select(F.col("id").alias("via"), "src"), "via", "left").select("node_id", F.col("src").alias("up")))
    # places on the way back from the target; each round doubles how far back they reach
    back = settle(spark.createDataFrame([(0, target)], "back int, node_id string"))
    reach = 1
    while True:
        more = settle(back.join(jump, "node_id").where("up is not null").select((F.col("back") + reach).alias("back"), F.col("up").alias("node_id")))
        if more.isEmpty():
            break
        back, reach = settle(back.union(more)), 2 * reach
        jump = settle(jump.join(jump.toDF("up", "next"), "up", "left").select("node_id", F.col("next").alias("up")))
    last = back.agg(F.max("back").alias("last"), F.max_by("node_id", "back").alias("first")).where(F.col("first") == source)
    return back.crossJoin(F.broadcast(last)).select((F.col("last") - F.col("back")).alias("step"), "node_id")


def _links(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of edges(src, dst, w): links(src, dst, share) and given(id, v), the sums of shares by their end, both settled; the number of different nodes.

    Ends that are no nodes are looked for among the different ends, of which there are fewer than edges; where there are any, their edges are
    dropped and the shares are worked out again.
    """
    edges = edges.where("src is not null and dst is not null")
    while True:
        out = edges.groupBy("src").agg(F.sum("w").alias("out"))
        links = settle(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
        given = settle(links.groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("v")))
        ends = given.select("id").union(links.select("src").distinct()).select("id", F.lit(False).alias("node"))
        ends = ends.union(nodes.select("id", F.lit(True))).groupBy("id").agg(F.max("node").alias("node"))
        n, ghosts = ends.agg(F.count_if("node"), F.count_if(~F.col("node"))).first()
        if not ghosts:
            return links, given, n
        gone = settle(ends.where("not node").select("id"))
        edges = links.withColumnRenamed("share", "w").join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 100, damping: float = 0.85, weighted: bool = True, tolerance: float | None = 1e-4) -> DataFrame:
    """id, rank. Rank goes along edges in proportion to their confidence; nodes without outgoing edges give theirs to all.

    Stops early once no rank moves by ``tolerance``. Without one, a rank is a sum over the walks of each length that end at the node: each
    round goes on only from where the walks of its length end, so what no walk reaches takes no part in it.
    """
    links, given, held = _links(nodes, edges.select("src", "dst", (F.col("confidence") if weighted else F.lit(1.0)).alias("w")))
    n = max(nodes.count(), 1)
    if tolerance is None:
        return _by_walks(nodes, links, given, n, held, iterations, damping)
    gives = links.select(F.col("src").alias("id"), F.lit(True).alias("gives")).distinct()
    vertices = settle(nodes.select("id").distinct().join(gives, "id", "left"))
    ranks = vertices.select("id", "gives", F.lit(1.0 / n).alias("rank"))
    for _ in range(iterations):
        got = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = ranks.where("gives is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        fresh = (F.lit(1 - damping) + F.lit(damping) * F.col("lost")) / F.lit(float(n)) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        after = settle(ranks.withColumnRenamed("rank", "old").join(got, "id", "left").crossJoin(F.broadcast(lost)).select("id", "gives", fresh.alias("rank"), "old"))
        ranks = after.select("id", "gives", "rank")
        if after.where(F.abs(F.col("rank") - F.col("old")) >= tolerance).isEmpty():
            break
    return ranks.select("id", "rank")


def _by_walks(nodes: DataFrame, links: DataFrame, given: DataFrame, n: int, held: int, iterations: int, damping: float) -> DataFrame:
    """id, rank after so many rounds. ``walks[k]`` has v, the shares along the walks of k + 1 links that end at id.

    A round gives each node the same ``base``, and what it gave k rounds ago comes along the walks of k links. What gets no further along
    them is at nodes without links, which give theirs to all.
    """
    walks, base, sums, at, table = [given], [1.0 / n], [float(held)], held, links
    for i in range(1, iterations + 1):
        if i > 1 and at:
            hit = links.join(walks[-1].toDF("src", "v"), "src").select("src", "dst", "share", "v")
            if fewer:
                hit = settle(hit)
                forget(table)
                table, links = hit, hit.drop("v")
            walks.append(settle(hit.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("v") * F.col("share")).alias("v"))))
        if at:
            reached, total = walks[-1].agg(F.count("*"), F.coalesce(F.sum("v"), F.lit(0.0))).first()
            fewer, at = reached < 0.75 * at, reached
        sums.append(total if at else 0.0)
        lost = sum(base[i - 1 - k] * damping**k * (sums[k] - sums[k + 1]) for k in range(i))
        base.append((1 - damping + damping * lost) / n)
    forget(table)
    parts = [v.select("id", (F.col("v") * F.lit(base[iterations - k] * damping**k)).alias("s")) for k, v in enumerate(walks, 1) if k <= iterations]
    ranks = nodes.select("id").distinct()
    if not parts:
        return ranks.select("id", F.lit(base[-1]).alias("rank"))
    return ranks.join(reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("s").alias("s")), "id", "left").select("id", (F.lit(base[-1]) + F.coalesce("s", F.lit(0.0))).alias("rank"))


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest number that is linked with each of 0 to n - 1."""
    up = np.arange(n)
    while True:
        u, v = up[u], up[v]
        apart = u != v
        if not apart.any():
            return up
        u, v = u[apart], v[apart]
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(far := up[up], up):
            up = far


def _local(edges: DataFrame) -> DataFrame:
    """id, part, head of the ends in each chunk of edges(src, dst): the number of what is linked there; head at its smallest id."""
    rows, size = CHUNK, CHUNK_BYTES

    def run(batches):
        held, n, nbytes, at = [], 0, 0, TaskContext.get().partitionId() << 33
        for b in chain(batches, [None]):
            if b is not None:
                held.append(b)
                n, nbytes = n + b.num_rows, nbytes + b.nbytes
            if n and (b is None or n >= rows or nbytes >= size):
                ends = pa.chunked_array([x.column(i) for i in (0, 1) for x in held]).combine_chunks().dictionary_encode()
                order = pc.array_sort_indices(ends.dictionary)
                rank = np.empty(len(order), np.int64)
                rank[order.to_numpy()] = np.arange(len(order))
                ends, ids = rank[ends.indices.to_numpy()], ends.dictionary.take(order)
                up = _roots(len(ids), ends[:n], ends[n:])
                out = pa.table({"id": ids, "part": at + up, "head": up == np.arange(len(up))})
                held, n, nbytes, at = [], 0, 0, at + len(up)
                yield from out.to_batches(max_chunksize=1 << 16)

    return edges.mapInArrow(run, f"id {edges.schema[0].dataType.simpleString()}, part long, head boolean")


def _meet(left: DataFrame, right: DataFrame, key: str, size: int) -> DataFrame:
    """``left``, of ``size`` rows, and what ``right`` has at each key once; keys of over ``HOT`` rows, which are few, meet theirs in a broadcast."""
    many = [r[0] for r in left.groupBy(key).count().where(F.col("count") > HOT).collect()] if size > HOT else []  # one key in a million rows at most
    if not many:
        return left.join(right, key, "left")
    hot = F.coalesce(F.col(key).isin(many), F.lit(False))
    return left.where(~hot).join(right, key, "left").union(left.where(hot).join(F.broadcast(right.where(F.col(key).isin(many))), key, "left"))


def _named(local: DataFrame, links: DataFrame) -> DataFrame:
    """part and component, the smallest id of it and of all parts linked with it, of the parts of ``_local``; settled. ``links`` has a and b."""
    links = settle(links.distinct())
    n = links.count()
    # one task joins few links; its numbers are below zero, as those of parts are not
    roots = _local(links.repartition(1)).select("id", (-1 - F.col("part")).alias("c")) if n <= CHUNK else _linked(links, n)
    heads = settle(local.where("head").select("part", F.col("id").alias("name")).join(roots.withColumnRenamed("id", "part"), "part", "left").select("part", "name", F.coalesce("c", "part").alias("root")))
    forget(links, *([roots] if n > CHUNK else []))
    named = settle(_meet(heads, heads.groupBy("root").agg(F.min("name").alias("component")), "root", heads.count()).select("part", "component"))
    forget(heads)
    return named


def _linked(links: DataFrame, n: int) -> DataFrame:
    """id and c, the smallest id that is linked with it, of the ends of ``n`` links(a, b); settled.

    Links are joined into parts again as long as that leaves half of them at most, then by rounds.
    """
    of = Window.partitionBy("id").orderBy("part")
    local = settle(_local(links))
    met = settle(local.select("id", "part", F.lead("part").over(of).alias("next"), F.row_number().over(of).alias("n")))
    more = met.where("next is not null").select(F.col("part").alias("a"), F.col("next").alias("b"))
    if more.distinct().count() > n // 2:
        forget(local, met)
        return _spread(links)
    named = _named(local, more)
    found = met.where("n = 1").select("id", "part")
    out = settle(_meet(found, named, "part", found.count()).select("id", F.col("component").alias("c")))
    forget(local, met, named)
    return out


def _spread(links: DataFrame) -> DataFrame:
    """id and c, the smallest id that is linked with it, of the ends of links(a, b); settled.

    Labels go along the links and to the ids that carry the old label, then jump to their label's label, so rounds
    grow with the logarithm of the longest path.
    """
    both = settle(links.union(links.select("b", "a")).distinct().toDF("u", "v"))
    labels = settle(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("c")))
    before, size = labels, labels.count()
    while True:
        ends = both.join(labels.toDF("u", "cu"), "u").join(labels.toDF("v", "cv"), "v").where("cv < cu")
        told = ends.select(F.explode(F.array("u", "cu")).alias("id"), "cv").groupBy("id").agg(F.min("cv").alias("m"))
        hooked = labels.join(told, "id", "left").select("id", F.least("c", "m").alias("c"), F.col("m").isNotNull().alias("moved"))
        jumped = _meet(hooked, labels.toDF("c", "up"), "c", size)
        after = settle(jumped.select("id", F.least("c", "up").alias("c"), (F.col("moved") | F.coalesce(F.col("up") < F.col("c"), F.lit(False))).alias("moved")))
        forget(before)
        before, labels = after, after.select("id", "c")
        if after.where("moved").isEmpty():
            forget(both)
            return after


def _labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component and copies (how many rows of the nodes have this id).

    Each task joins its edges into parts first, so that only their ends are dealt out by id, once; there the parts that
    share an end are linked, and met with the nodes. What is left is a graph of parts, which are numbers. Ends that are no
    nodes join nothing: where that shuffle finds any, their edges are dropped and it runs again.
    """
    pairs, of = edges.where("src <> dst").select("src", "dst"), Window.partitionBy("id").orderBy("part")
    while True:
        local = settle(_local(pairs))
        ends = nodes.select("id", F.lit(-1).cast("long").alias("part")).union(local.select("id", "part"))
        ends = ends.select("id", "part", F.lead("part").over(of).alias("next"), F.lag("part").over(of).alias("last"), F.row_number().over(of).alias("copies"))
        node, ghost = F.expr("part < 0 and (next is null or next >= 0)"), F.expr("part >= 0 and last is null")
        met = settle(ends.where(node | ghost | F.expr("part >= 0 and next is not null")).select(F.when(node | ghost, F.col("id")).alias("id"), "part", "next", "copies"))
        ghosts = met.where("part >= 0 and id is not null").select("id")
        if ghosts.isEmpty():
            break
        forget(local)
        pairs = pairs.join(ghosts.toDF("src"), "src", "left_anti").join(ghosts.toDF("dst"), "dst", "left_anti").select("src", "dst")
    named = _named(local, met.where("part >= 0").select(F.col("part").alias("a"), F.col("next").alias("b")))
    forget(local)
    found, size = met.where("part < 0").select("id", F.col("next").alias("part"), "copies"), named.count()
    found = found.join(F.broadcast(named), "part", "left") if size <= SMALL else _meet(found, named, "part", found.count())
    return found.select("id", F.coalesce("component", "id").alias("component"), "copies")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component, the smallest id that is weakly connected with it. Parallel edges make no difference."""
    return _labelled(nodes, edges).select("id", "component")


def clusters(nodes: DataFrame, edges: DataFrame, limit: int = 20, samples: int = 5) -> DataFrame:
    """component, size and the first labels of the largest components."""
    of = _labelled(nodes, edges).where("id is not null")
    sizes = of.groupBy("component").agg(F.sum("copies").alias("size")).orderBy(F.desc("size"), "component").limit(limit)
    by = Window.partitionBy("component").orderBy("id")
    first = of.join(F.broadcast(sizes), "component").withColumn("n", F.row_number().over(by)).where(F.col("n") <= samples).select("component", "size", "id")
    ranked = nodes.select("id", "label").join(F.broadcast(first), "id").withColumn("n", F.row_number().over(by)).where(F.col("n") <= samples)
    return ranked.groupBy("component", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]).alias("labels"))


def subtype_closure(pairs: DataFrame) -> DataFrame:
    """sub, super: the reflexive and transitive closure of pairs(sub, super), safe on cycles."""
    names = pairs.select(F.explode(F.array("sub", "super")).alias("sub")).distinct()
    known = settle(names.select("sub", F.col("sub").alias("super")))
    fresh = known
    while True:
        step = fresh.join(pairs.select(F.col("sub").alias("super"), F.col("super").alias("next")), "super").select("sub", F.col("next").alias("super")).distinct()
        fresh = settle(step.join(known, ["sub", "super"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = settle(known.union(fresh))


def bundle(nodes: DataFrame, edges: DataFrame, limit: int = 50, iterations: int = 100, tolerance: float | None = 1e-4, by: str = "id") -> DataFrame:
    """The nodes by PageRank in their own subgraph times confidence, then by the column ``by``, the first ``limit``, with rank, position and total.

    Each edge id counts once. Edges without ids are taken as they come, best with few ends that are no nodes.
    """
    nodes = steady(nodes)
    ranks = pagerank(nodes, induced(nodes, edges) if "id" in edges.columns else edges, iterations, tolerance=tolerance)
    scored = nodes.join(ranks, "id").withColumn("score", F.round(F.col("rank") * F.col("confidence"), 12))
    total = nodes.agg(F.count("*").alias("total"))
    top = scored.orderBy(F.desc("score"), by).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), by)))
    return top.crossJoin(F.broadcast(total))


def topological_order(modules: DataFrame) -> DataFrame:
    """path, depth, position of modules(id, path, parent_id): children before parents, within a depth by path; cycles last."""
    depth = settle(modules.where("parent_id is null").select("id", "path", F.lit(0).alias("depth")))
    frontier, d = depth, 0
    while not frontier.isEmpty():
        d += 1
        frontier = settle(modules.join(frontier.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").join(depth, "id", "left_anti").select("id", "path", F.lit(d).alias("depth")))
        depth = depth.union(frontier)
    every = settle(modules.select("id", "path").join(depth.select("id", "depth"), "id", "left").select("path", F.coalesce("depth", F.lit(-1)).alias("depth")))
    # numbered within a depth; the depths, which are few, tell where each begins
    sizes = every.groupBy("depth").agg(F.count("*").alias("n"))
    starts = sizes.select("depth", (F.sum("n").over(Window.orderBy(F.desc("depth"))) - F.col("n")).alias("before"))
    within = every.withColumn("n", F.row_number().over(Window.partitionBy("depth").orderBy("path")))
    return within.join(F.broadcast(starts), "depth").select("path", "depth", (F.col("n") + F.col("before")).cast("int").alias("position"))
