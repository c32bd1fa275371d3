"""op3: all documents in the order of a mixture of their sources."""

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import read
from quillgraph.llm.mixing import mix


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


QUERIES = {"op3_source_mix": op3_source_mix}

ORACLES: dict[str, str] = {}
