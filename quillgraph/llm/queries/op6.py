"""op6: tokens of every line of all documents."""

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import read
from quillgraph.llm.tokens import attribute


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_token_counts": op6_token_counts}

ORACLES: dict[str, str] = {}
