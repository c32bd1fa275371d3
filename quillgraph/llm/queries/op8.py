"""op8: benchmark decontamination of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import read
from quillgraph.llm.decontam import annotate


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op8_decontaminate": op8_decontaminate}

ORACLES = {
    "op8_decontaminate": r"""
with d as (
  select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
win as (
  select distinct item, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as s
  from (select item, w, least(len(w), 10) as n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from win),
place as (
  select k, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as s
  from (select k, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes where len(w) >= n)),
hit as (select place.k, place.n, place.i, win.item from place join win on place.n = win.n and place.s = win.s),
pos as (select k, count(distinct p) as n_hit from (select distinct k, unnest(generate_series(i, i + n - 1)) as p from hit) group by k),
its as (select k, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by k)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(pos.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(its.n_items, 0) as bigint) as n_items, sha256(coalesce(its.items, '')) as items_sha256,
  coalesce(pos.n_hit, 0) > 0 as contaminated
from d left join pos on d.k = pos.k left join its on d.k = its.k""",
}
