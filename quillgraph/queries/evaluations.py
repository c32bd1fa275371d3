"""Joins, projections and judgements that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.operators import evaluation as ev
from quillgraph.operators import graph as g
from quillgraph.operators import modules as m
from quillgraph.operators import vectors as v
from quillgraph.plans.derived import SQL, edges, nodes, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.replace("GRAPH", SQL)
        return f

    return add


@query("select distinct 'f' || l_partkey as file from lineitem where l_partkey not in (select p_partkey from part where p_size > 10)")
def index_integrity_gate(spark, d):
    gold = table(spark, d, "lineitem").select(F.concat(F.lit("f"), "l_partkey").alias("file"))
    return ev.missing_files(gold, table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("f"), "p_partkey").alias("path")))


@query("with f as (select distinct l_orderkey as run_id, l_partkey as fact_id from lineitem), w as (select l_orderkey as run_id, l_partkey as fact_id, bool_or(l_returnflag = 'R') as hit from lineitem where l_linenumber <= 3 group by all) select f.run_id, round(avg(cast(coalesce(hit, false) as int)), 8) as accuracy from f left join w using (run_id, fact_id) group by f.run_id")
def judge_accuracy(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("fact_id"), "l_linenumber", "l_returnflag")
    verdicts = line.where("l_linenumber <= 3").groupBy("run_id", "fact_id").agg(F.bool_or(F.col("l_returnflag") == "R").alias("hit"))
    return ev.judged(line.select("run_id", "fact_id").distinct(), verdicts).select("run_id", F.round("accuracy", 8).alias("accuracy"))


@query("with q as (select p_partkey as k, row_number() over (partition by p_brand order by 'q' || p_partkey) as n from part) select 'q' || k as question_id, arm, cast(r as int) as repeat_index from q, (values ('WITH'), ('WITHOUT')) a(arm), range(3) t(r) where n <= 3")
def run_planner(spark, d):
    questions = table(spark, d, "part").select(F.concat(F.lit("q"), "p_partkey").alias("id"), F.col("p_brand").alias("repo_id"))
    return ev.plan_runs(questions, ["WITH", "WITHOUT"], 3, 3)


@query("select p_partkey, cast(p_size + 3 as int) as n from part")
def tool_use_counts(spark, d):
    counts = F.create_map(F.lit("graph_search"), F.col("p_size"), F.lit("graph_node"), F.lit(3), F.lit("shell"), F.lit(100))
    return table(spark, d, "part").select("p_partkey", ev.tool_calls(counts, "graph_").alias("n"))


@query("select p_partkey, case when contains(p_name, 'red') then 'symbol' when contains(p_type, 'red') then 'module' when contains(p_brand, 'red') then 'edge' else 'miss' end as grade from part")
def eval_grading(spark, d):
    rows = table(spark, d, "part").withColumn("want", F.lit("red")).withColumn("none", F.lit(None).cast("string"))
    return ev.grade(rows, "want", "p_name", "p_type", "p_brand", "none").select("p_partkey", "grade")


@query("""with r as (select l_orderkey as q, l_partkey % 20 as f, row_number() over (partition by l_orderkey order by min(l_partkey), l_partkey % 20) as rk from lineitem group by l_orderkey, l_partkey % 20), w as (select o_orderkey as q, o_custkey % 20 as f from orders),
s as (select w.q, count(*) filter (where rk <= 5) / 5 as p, count(*) filter (where rk <= 5) / 1 as rc, coalesce(1 / min(rk), 0) as m from w left join r on r.q = w.q and r.f = w.f group by w.q)
select o_orderpriority as category, round(avg(p), 6) as precision, round(avg(rc), 6) as recall, round(avg(m), 6) as mrr from s join orders on o_orderkey = q group by o_orderpriority""")
def retrieval_stats(spark, d):
    line = table(spark, d, "lineitem").select(F.lit("graph").alias("ranker"), F.col("l_orderkey").alias("qid"), (F.col("l_partkey") % 20).alias("file"), F.col("l_partkey").alias("position"))
    o = table(spark, d, "orders")
    want, questions = o.select(F.col("o_orderkey").alias("qid"), (F.col("o_custkey") % 20).alias("file")), o.select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("category"))
    return ev.retrieval(line, want, questions, (5,)).select("category", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr")])


@query("with GRAPH select id, label, type from nodes where confidence >= 0.5 order by id limit 500")
def capped_nodes(spark, d):
    return nodes(spark, d).where("confidence >= 0.5").orderBy("id").limit(500).select("id", "label", "type")


@query("with GRAPH select e.id, coalesce(n.label, e.dst) as other from edges e left join nodes n on n.id = e.dst where e.type = 'contains'")
def edge_labels(spark, d):
    return edges(spark, d).where("type = 'contains'").join(nodes(spark, d).select(F.col("id").alias("dst"), "label"), "dst", "left").select("id", F.coalesce("label", "dst").alias("other"))


@query("with GRAPH, x as (select seed, id, type, other, row_number() over (partition by seed order by o, type, other) as n from (select src as seed, 0 as o, id, type, dst as other from edges union all select dst, 1, id, type, src from edges)) select seed, cast(n as int) as n, id from x where n <= 20")
def edge_views(spark, d):
    e = edges(spark, d)
    ends = e.select(F.col("src").alias("seed"), F.lit(0).alias("o"), "id", "type", F.col("dst").alias("other")).union(e.select("dst", F.lit(1), "id", "type", "src"))
    from pyspark.sql import Window

    return ends.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("o", "type", "other"))).where("n <= 20").select("seed", "n", "id")


@query("select doc_id, case when n_chars % 5 = 0 then true when n_chars % 5 = 1 then true when sha256(text) <> sha256(case when n_chars % 5 = 2 then text || '!' else text end) then true else false end as needed from documents")
def embedding_needed(spark, d):
    model = F.when(F.col("n_chars") % 5 == 0, None).when(F.col("n_chars") % 5 == 1, "old").otherwise("new")
    kept = F.sha2(F.when(F.col("n_chars") % 5 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)
    return table(spark, d, "documents").select("doc_id", v.needs_embedding(model, F.lit(64), kept, "new", 64, F.sha2("text", 256)).alias("needed"))


@query("select p_partkey, 'app.' || replace(p_brand, '#', '') || '.' || p_type as fqn, p_type as bytes from part")
def fqn_and_slices(spark, d):
    chain = F.expr("concat(replace(p_brand, '#', ''), '.', p_type, '(int, List)')")
    return table(spark, d, "part").select("p_partkey", t.fqn(F.lit("app"), chain).alias("fqn"), t.utf8_slice(F.concat(F.lit("é"), "p_type"), F.lit(3), F.lit(100)).alias("bytes"))


@query("select p_partkey, 'B' || p_partkey as declared_by, case when p_size > 5 then true else false end as symbol from part")
def declaring_types(spark, d):
    ident = F.concat(F.lit("a/F.java#B"), "p_partkey", F.lit(".run(x.Y,int)"))
    return table(spark, d, "part").select("p_partkey", t.declaring_type(ident).alias("declared_by"), t.is_symbol(ident, F.when(F.col("p_size") > 5, "Method").otherwise("Module")).alias("symbol"))


@query("with o as (select p_brand || '/' || p_type as owner, p_partkey, p_name from part), f as (select * from (select *, row_number() over (partition by p_name order by p_partkey) as n from o) where n = 1) select owner, count(*) as symbols from f group by owner")
def symbols_by_module(spark, d):
    part = table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("module"), F.concat_ws("/", "p_brand", "p_type", F.concat(F.lit("P"), "p_partkey")).alias("path"), "p_name", "p_partkey")
    first = m.first_per(part, "p_name", "p_partkey")
    tree = m.build_tree(part.select(F.col("module").alias("path")))
    owned = first.join(m.owners(first.select("path").distinct(), tree), "path")
    return owned.groupBy(F.substring("owner", 8, 1000).alias("owner")).agg(F.count("*").alias("symbols"))
