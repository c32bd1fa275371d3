"""Identifier splitting, search, scores, budgets and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.operators import search as s
from quillgraph.operators import vectors as v
from quillgraph.plans.derived import SQL, nodes, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.replace("GRAPH", SQL)
        return f

    return add


_IDENT = "replace(p_name, ' ', '') || 'HTTP' || p_brand || '_' || p_type || p_size || 'Base64x'"
_IDENT_SPARK = "concat(replace(p_name, ' ', ''), 'HTTP', p_brand, '_', p_type, p_size, 'Base64x')"


@query(rf"""with x as (select p_partkey, {_IDENT} as s from part),
y as (select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g') as s from x)
select p_partkey, array_to_string([w for w in regexp_split_to_array(s, '[^A-Za-z0-9]+') if w <> ''], '|') as words from y""")
def identifier_split(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(t.split_identifier(F.expr(_IDENT_SPARK)), "|").alias("words"))


@query(r"with x as (select doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) as w from documents) select doc_id, count(distinct w) as n from x group by doc_id")
def fts_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(t.search_terms(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query(f"with x as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as w from documents) select doc_id, count(distinct w) as n from x where length(w) >= 3 and w not in ({', '.join(repr(w) for w in t.STOPWORDS)}) group by doc_id")
def explore_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(t.question_tokens(F.col("text"))).cast("long").alias("n")).where("n > 0")


def _hits(words: list[str]) -> str:
    return " + ".join(f"cast(contains(lower(q), '{w}') as int)" for w in words)


_Q = "p_name || case p_size % 4 when 0 then ' calls of the function' when 1 then ' explain the concept' when 2 then ' class paper study' else '' end"


@query(f"with x as (select p_partkey, {_Q} as q from part), y as (select p_partkey, {_hits(t.DEVELOPMENT)} as a, {_hits(t.RESEARCH)} as b from x) select p_partkey, case when a > b then 'DEVELOPER' when b > a then 'RESEARCHER' else 'GENERAL' end as intent from y")
def intent_classify(spark, d):
    q = F.expr("concat(p_name, case p_size % 4 when 0 then ' calls of the function' when 1 then ' explain the concept' when 2 then ' class paper study' else '' end)")
    return table(spark, d, "part").select("p_partkey", t.intent(q).alias("intent"))


_BM25 = r"""with x as (select doc_id as id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents),
tot as (select count(*) as n, avg(len(w)) as avgdl from x),
p as (select id, any_value(source) as source, any_value(len(w)) as dl, term, count(*) as tf from (select id, source, w, unnest(w) as term from x) where term in ('onenth', 'thnd', 'the', 'reanti') group by id, term),
df as (select term, count(*) as df from p group by term),
s as (select id, source, round(sum((case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from p join df using (term), tot group by id, source)
"""


def _bm25(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    scored = s.bm25(*s.matches(docs, F.col("text"), [(0, w) for w in ("onenth", "thnd", "the", "reanti")]))
    return scored.select("id", F.round("score", 6).alias("score"))


@query(_BM25 + "select id, score from s")
def bm25_search(spark, d):
    return _bm25(spark, d)


@query(_BM25 + "select id, score from s where source = 'src1' order by score desc, id limit 10")
def bm25_filtered(spark, d):
    own = table(spark, d, "documents").where("source = 'src1'").select(F.col("doc_id").alias("id"))
    return _bm25(spark, d).join(own, "id", "left_semi").orderBy(F.desc("score"), "id").limit(10)


@query("with GRAPH select id from nodes where contains(lower(label), 'plie') order by id limit 30")
def like_fallback(spark, d):
    return s.search(nodes(spark, d), "plie", limit=30).select("id")


@query("with GRAPH select id from nodes where type = 'part' and confidence >= 0.5 order by id limit 20")
def blank_search(spark, d):
    return s.search(nodes(spark, d), "  ", ["part"], 0.5).select("id")


@query("select p_partkey, cast((3 * cast(contains(lower(p_name), 'red') as int) + 2 * cast(contains(lower(p_type), 'red') as int) + cast(contains(lower(p_brand), 'red') as int)) + (3 * cast(contains(lower(p_name), 'and') as int) + 2 * cast(contains(lower(p_type), 'and') as int) + cast(contains(lower(p_brand), 'and') as int)) as int) as score from part")
def module_token_score(spark, d):
    tokens = F.array(F.lit("red"), F.lit("and"))
    return table(spark, d, "part").select("p_partkey", t.module_score(tokens, F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("score"))


@query("select p_partkey, 0.98 + 5 * (cast(contains(lower(p_name), 'red') as int) + cast(contains(lower(p_name), 'blue') as int)) + 2 * cast(p_size < 10 as int) as score from part order by score desc, p_partkey limit 40")
def symbol_score(spark, d):
    tokens = F.array(F.lit("red"), F.lit("blue"))
    scored = table(spark, d, "part").select("p_partkey", t.symbol_score(F.lit(0.98), tokens, F.col("p_name"), F.col("p_size") < 10).alias("score"))
    return scored.orderBy(F.desc("score"), "p_partkey").limit(40)


@query("""with x as (select source, doc_id, cast(greatest(1, floor(length(text) / 4)) as bigint) as cost from documents),
y as (select *, sum(cost) over w as s from x window w as (partition by source order by doc_id)),
z as (select *, max(cast(s > 15000 as int)) over (partition by source order by doc_id) as o from y)
select source, doc_id, o = 0 as full, cast(sum(case when o = 0 then cost else 10 end) over (partition by source order by doc_id) as bigint) as used from z""")
def token_budget_pack(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", t.token_cost(F.col("text")).alias("cost"), F.lit(10).cast("long").alias("brief"))
    return t.pack_budget(rows, 15_000, "source", "doc_id", "cost", "brief").select("source", "doc_id", "full", "used")


_COS = "with q as (select embedding as e from embeddings where vec_id = 0), s as (select vec_id, round(list_cosine_similarity(embedding::double[], e::double[]), 6) as score from embeddings, q)"


@query(_COS + " select vec_id, score from s where score >= 0.40 order by score desc, vec_id limit 10")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = list(e.where("vec_id = 0").first().embedding)
    return v.top_similar(e, q).select("vec_id", F.round("score", 6).alias("score"))


@query(_COS + " select vec_id, score from s where score >= 0.1")
def cosine_floor(spark, d):
    e = table(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))
    return e.crossJoin(q).select("vec_id", F.round(t.cosine(F.col("embedding"), F.col("q")), 6).alias("score")).where("score >= 0.1")


@query(r"select doc_id, case when len(l) >= 3 then array_to_string(l[3:5], chr(10)) end as span from (select doc_id, string_split(text, chr(10)) as l from documents)")
def verbatim_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", t.slice_lines(F.col("text"), F.lit(3), F.lit(5)).alias("span"))


@query("select vec_id, true as same from embeddings")
def vector_codec(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", (v.decode_vector(v.encode_vector("embedding")) == F.col("embedding")).alias("same"))
