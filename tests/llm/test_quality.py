import math
import random
import zlib

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from quillgraph.llm import quality
from quillgraph.llm.quality import fit, score
from quillgraph.llm.queries.op1 import op1_quality


def prose(rng):
    return " ".join(rng.choice("the of and river stone light under house every morning walked slowly paper green".split()) for _ in range(120)) + "."


def junk(rng):
    return " | ".join(rng.choice(["BUY!!", "$$$", "free%%%", "click###", "now***"]) for _ in range(120))


@pytest.fixture
def labelled(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng) if i % 2 else junk(rng), i % 2) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_texts_are_told_apart(labelled):
    docs, labels = labelled
    model = fit(docs, labels, F.col("doc_id") < 160)
    rows = score(docs.where("doc_id >= 160"), model).collect()
    right = sum((r.score >= 0.5) == bool(r.doc_id % 2) for r in rows)
    assert right >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_null_empty_long_repeated_and_clashing(labelled, spark):
    docs, labels = labelled
    model = fit(docs, labels, F.lit(True))
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "word " * 200_000, "x")], "doc_id long, text string, score string")
    rows = score(odd, model).collect()
    assert len(rows) == 4 and all(isinstance(r.score, float) and 0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows[:3]}) == 1


def test_one_class_only_and_empty(labelled, spark):
    docs, labels = labelled
    model = fit(docs, labels.where("quality = 1"), F.lit(True))
    assert model.score("anything") == pytest.approx(121 / 122)
    assert fit(docs.where("false"), labels.where("false"), F.lit(True)).score(None) == 0.5
    assert score(docs.where("false"), model).count() == 0


def test_the_blocks_of_a_dictionary_are_a_parameter():
    texts = [bytes([65 + i]) * 512 for i in range(6)]  # too little to train on: the dictionary is its blocks
    assert {n: len(quality._dictionary(texts, n)) for n in (1, 4, None)} == {1: 512, 4: 2048, None: 3072}


def test_scores_as_brute_force(labelled, spark):
    docs, labels = labelled
    model = fit(docs, labels, F.lit(True))
    more = docs.union(spark.createDataFrame([(900, "é" * 3000), (901, "a mixed | BUY!! of river stone " * 999)], docs.schema))
    for r in score(more, model).collect():
        sizes, data = [], r.text.encode()
        for raw in (model.good, model.bad):
            press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(press.compress(data[i : i + 512])) for i in range(0, len(data), 512)))
        a, b, c = model.curve
        margin = a + b * (sizes[1] - sizes[0]) / len(data) + c * (sizes[1] - sizes[0]) / max(sizes)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, margin)))), rel=1e-9)


def test_long_labelled_texts_take_part(spark):
    rng = random.Random(5)
    rows = [(i, (prose(rng) if i % 2 else junk(rng)) * 60, i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"), F.lit(True))
    assert model.score(prose(rng)) > 0.5 > model.score(junk(rng))


def test_the_query_learns_from_no_row_that_is_held_out(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    labels = spark.read.parquet(f"{source}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    first, second = ({r.doc_id: r for r in op1_quality(spark, d).collect()} for d in (source, str(tmp_path)))
    assert first == second
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in first.values())
    assert len(first) == duckdb.sql(f"select count(*) from '{source}/documents.parquet'").fetchall()[0][0]
