"""op2: nearest neighbours of every hundredth embedding among all."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.ann import search
from quillgraph.llm.common import read


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10)


QUERIES = {"op2_nearest": op2_nearest}

ORACLES: dict[str, str] = {}
