"""Benchmark statistics over events and line items in the place of benchmark runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import stats as s
from quillgraph.plans.derived import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _runs(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.col("event_type").alias("question"), F.when(F.col("user_id") % 2 == 0, "WITH").otherwise("WITHOUT").alias("arm"), F.concat(F.lit("repo"), F.col("user_id") % 4).alias("repo"), "value", (F.col("event_id") % 100).cast("double").alias("tokens"))


_RUNS = "r as (select event_id, event_type as question, case when user_id % 2 = 0 then 'WITH' else 'WITHOUT' end as arm, 'repo' || user_id % 4 as repo, value, (event_id % 100)::double as tokens from events)"


@query(f"with {_RUNS} select question, arm, round(median(value), 6) as median, round(min(value), 6) as min, round(max(value), 6) as max, count(value) as n from r where value is not null group by question, arm")
def metric_summary(spark, d):
    got = s.summarize(_runs(spark, d), "value", "question", "arm")
    return got.select("question", "arm", *[F.round(c, 6).alias(c) for c in ("median", "min", "max")], "n")


@query(f"with {_RUNS}, l as (select question, repo, arm, 'value' as metric, value as v from r union all select question, repo, arm, 'tokens', tokens from r) select question, repo, arm, metric, round(median(v), 6) as median, round(min(v), 6) as min, round(max(v), 6) as max, count(v) as n from l where v is not null group by grouping sets ((question, arm, metric), (repo, arm, metric), (arm, metric))")
def arm_summary(spark, d):
    got = s.summaries(_runs(spark, d), ["value", "tokens"], [["question", "arm"], ["repo", "arm"], ["arm"]])
    return got.select("question", "repo", "arm", "metric", *[F.round(c, 6).alias(c) for c in ("median", "min", "max")], "n")


@query(f"with {_RUNS} select arm, round(median(tokens), 6) as median, count(*) as n from r where question in ('click', 'view', 'purchase') group by arm")
def headline(spark, d):
    got = s.summarize(_runs(spark, d).where(F.col("question").isin("click", "view", "purchase")), "tokens", "arm")
    return got.select("arm", F.round("median", 6).alias("median"), "n")


@query(f"with {_RUNS}, m as (select question, median(value) filter (where arm = 'WITH') as a, median(value) filter (where arm = 'WITHOUT') as b from r group by question) select question, case when b - a is null then 'InsufficientData' when b - a <= 0 then 'NotAmortizing' else 'Amortizing' end as verdict from m")
def break_even(spark, d):
    m = _runs(spark, d).groupBy("question").agg(F.median(F.when(F.col("arm") == "WITH", F.col("value"))).alias("a"), F.median(F.when(F.col("arm") == "WITHOUT", F.col("value"))).alias("b"))
    v = s.break_even(F.col("a"), F.col("b"), F.lit(10.0))
    return m.select("question", F.when(v.isin("InsufficientData", "NotAmortizing"), v).otherwise("Amortizing").alias("verdict"))


@query("with x as (select avg(cast((l_quantity > 25) = (l_tax > 0.03) as int)) as o, avg(cast(l_quantity > 25 as int)) as a, avg(cast(l_tax > 0.03 as int)) as b, count(*) as n from lineitem) select n, round(o, 8) as observed, round(a * b + (1 - a) * (1 - b), 8) as expected, round((o - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 8) as kappa from x")
def kappa(spark, d):
    k = s.kappa(table(spark, d, "lineitem").select((F.col("l_quantity") > 25).alias("a"), (F.col("l_tax") > 0.03).alias("b")), "a", "b")
    return k.select("n", *[F.round(c, 8).alias(c) for c in ("observed", "expected", "kappa")])


@query("select c_custkey from (select c_custkey, row_number() over (order by sha256(cast(c_custkey as varchar))) as r, count(*) over () as n from customer) where r <= ceil(n * 0.2)")
def kappa_subsample(spark, d):
    return s.subsample(table(spark, d, "customer"), "c_custkey")


_SETS = "with a as (select l_orderkey as k, list_distinct(list('src/F' || l_partkey % 40 || '.java:' || l_linenumber)) as got from lineitem where l_linenumber <= 3 group by l_orderkey), b as (select l_orderkey as k, list_distinct(list('src/F' || l_partkey % 40 || '.java:' || l_linenumber)) as want from lineitem where l_linenumber >= 2 group by l_orderkey), c as (select k, got, want, len(list_intersect(got, want)) as hit from a join b using (k)) select k, round(hit / len(got), 8) as precision, round(hit / len(want), 8) as recall, round(case when hit = 0 then 0 else 2.0 * hit / (len(got) + len(want)) end, 8) as f1 from c"


@query(_SETS)
def set_f1(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.concat(F.lit("src/F"), F.col("l_partkey") % 40, F.lit(".java:"), "l_linenumber").alias("e"))
    said = line.where("l_linenumber <= 3").groupBy("k").agg(F.concat(F.lit("Found: `./"), F.array_join(F.collect_list("e"), "`, `./"), F.lit("`.")).alias("answer"))
    want = line.where("l_linenumber >= 2").groupBy("k").agg(F.collect_set("e").alias("want"))
    got = s.set_scores(said.select("k", s.answer_set(F.col("answer")).alias("got")).join(want, "k"), "got", "want")
    return got.select("k", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query("""with r as (select l_orderkey as q, l_partkey % 50 as f, min(l_linenumber * 1000 + l_partkey % 50) as p from lineitem group by all), o as (select q, f, row_number() over (partition by q order by p, f) as rk from r),
w as (select distinct o_orderkey as q, o_custkey % 50 as f from orders union select o_orderkey, (o_custkey + 7) % 50 from orders), h as (select o.q, count(*) filter (where rk <= 5) as hits, min(rk) as first from o join w on w.q = o.q and w.f = o.f group by o.q),
a as (select q from r union select q from w), z as (select q, count(*) as n from w group by q)
select a.q as qid, round(coalesce(hits, 0) / 5, 8) as precision, round(case when coalesce(n, 0) = 0 then 1 else coalesce(hits, 0) / n end, 8) as recall, round(coalesce(1 / first, 0), 8) as mrr from a left join h using (q) left join z using (q)""")
def precision_recall_mrr(spark, d):
    ranked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_partkey") % 50).alias("file"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 50).alias("position"))
    o = table(spark, d, "orders")
    want = o.select(F.col("o_orderkey").alias("qid"), (F.col("o_custkey") % 50).alias("file")).union(o.select("o_orderkey", (F.col("o_custkey") + 7) % 50))
    got = s.ranking_metrics(ranked, want, 5)
    return got.select("qid", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "mrr")])


@query("with c as (select case when p_size % 10 < 7 then 'GRAPH_HEAVY' when p_size % 10 < 9 then 'NEUTRAL' else 'OTHER' end as category from part), t as (select * from (values ('GRAPH_HEAVY', 0.6::double), ('NEUTRAL', 0.25), ('NEGATIVE_CONTROL', 0.15)) t(category, target)), n as (select (select count(*) from c where c.category = t.category) as n, t.*, (select count(*) from c) as total from t) select category, n, round(n / total, 6) as ratio, round(abs(n / total - target), 6) as deviation, n = 0 as missing, abs(n / total - target) <= 0.2 as within from n")
def category_audit(spark, d):
    c = F.when(F.col("p_size") % 10 < 7, "GRAPH_HEAVY").when(F.col("p_size") % 10 < 9, "NEUTRAL").otherwise("OTHER")
    got = s.audit_categories(table(spark, d, "part").select(c.alias("category")))
    return got.select("category", "n", F.round("ratio", 6).alias("ratio"), F.round("deviation", 6).alias("deviation"), "missing", "within")


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row) as in_window from events")
def rate_window(spark, d):
    return s.rate_window(table(spark, d, "events"), "ts", "user_id", 3600).select("event_id", "in_window")


@query(r"with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id as file, count(*) as n from l where regexp_matches(line, '(^|[^0-9A-Za-z_])(thnd|reanti)($|[^0-9A-Za-z_])') group by doc_id")
def ripgrep_rank(spark, d):
    l = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.explode(F.split("text", "\n", -1)).alias("line"))
    return s.file_ranking(l, ["thnd", "reanti"])
