"""op9: verdicts on all pages' urls."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import read
from quillgraph.llm.urls import judge, page_text

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), RULES, texts=pages.select(page_text(F.col("html")).alias("text")))


QUERIES = {"op9_url_filter": op9_url_filter}

ORACLES: dict[str, str] = {}
