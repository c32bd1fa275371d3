"""op1: quality of all documents by compression."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import held_out, read
from quillgraph.llm.quality import fit, score

THRESHOLD = 0.3


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"), ~held_out("doc_id", 5))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        held_out("doc_id", 5).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op1_quality": op1_quality}

ORACLES: dict[str, str] = {}
