"""op7: language-model scores of all documents."""

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import held_out, read
from quillgraph.llm.ppm import score


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out("doc_id", 10))


QUERIES = {"op7_lm_score": op7_lm_score}

ORACLES: dict[str, str] = {}
