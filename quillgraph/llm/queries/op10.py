"""op10: chat formatting of all conversations, read back from the formatted strings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.chat import format_turns, from_records, loss_text, read_back
from quillgraph.llm.common import read

TRICKY = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # the added conversation comes in another layout; each record's fingerprint tells how it is read
    said = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(TRICKY).alias("content")) for r in ("user", "assistant")])
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), said.alias("messages"))
    out = format_turns(from_records(table.unionByName(more, allowMissingColumns=True)))
    turns, loss = read_back(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES = {"op10_chat_format": op10_chat_format}

ORACLES = {
    "op10_chat_format": r"""
with c as (
  select cast(conv_id as bigint) as conv_id, cast(turn as bigint) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(20 + length(regexp_replace(role, '<(\\*)(/?(?:turn|said)>)', '<\\\1\2', 'g')) + length(regexp_replace(text, '<(\\*)(/?(?:turn|said)>)', '<\\\1\2', 'g'))) as bigint) as formatted_chars
from c group by conv_id""",
}
