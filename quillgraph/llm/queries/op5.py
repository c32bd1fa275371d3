"""op5: personal data in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import read
from quillgraph.llm.pii import KINDS, as_text, fit, propose, select_spans
from quillgraph.llm.common import cut

BASE = KINDS[:4]


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only ids and candidates are written, not the texts
    proposed = cut(propose(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_candidates"))
    found = select_spans(proposed, fit(proposed)).withColumn("base", F.expr("filter(pii, s -> s.base)"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("pii")).alias("spans"))


QUERIES = {"op5_pii": op5_pii}

ORACLES: dict[str, str] = {}
