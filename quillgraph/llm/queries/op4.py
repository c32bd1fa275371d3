"""op4: near-duplicate classes of all documents, on two-word shingles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import read
from quillgraph.llm.neardup import classes


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(read(spark, sf_dir, "documents").select("doc_id", "text"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


QUERIES = {"op4_near_dedup": op4_near_dedup}

ORACLES = {
    "op4_near_dedup": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as both from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
l as (select a, b from p join n as na on na.doc_id = a join n as nb on nb.doc_id = b where 100 * p.both >= 80 * (na.n + nb.n - p.both)),
e as (select a, b from l union all select b, a from l),
r(id, seen) as (select a, a from e union select r.id, e.b from r join e on r.seen = e.a),
c as (select id, min(seen) as c from r group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.c, d.doc_id) as component_id, coalesce(c.c, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join c on c.id = d.doc_id""",
}
