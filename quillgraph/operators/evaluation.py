"""Questions, judgements and retrieval: loading, planning, grading and their aggregates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators.stats import TARGETS, ranking_metrics

QUESTION = "id string, repo_id string, text string, category string, gold_facts array<struct<id:string,statement:string,evidence:string>>, expected_set array<string>"
RUN = """id string, question_id string, arm string, repeat_index int, input_tokens bigint, output_tokens bigint, tool_call_count int, file_read_count int,
    wall_clock_millis bigint, cost_usd double, final_answer string, hit_ceiling boolean, contaminated boolean, cli_invocation_attempts int, tool_name_counts map<string,int>"""


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON or YAML file {questions: [...]}; all that is wrong is told at once. YAML needs the module ``yaml``."""
    with open(path) as file:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ModuleNotFoundError as e:
                raise ValueError(f"{path}: YAML needs the module yaml; JSON is read without it") from e
            listed = yaml.safe_load(file)["questions"]
        else:
            listed = json.load(file)["questions"]
    wrong, seen = [], set()
    for i, q in enumerate(listed):
        name = q.get("id") or f"number {i + 1}"
        if not q.get("id") or q["id"] in seen:
            wrong.append(f"{name}: no id, or one that is taken")
        seen.add(q.get("id"))
        if q.get("category") not in TARGETS:
            wrong.append(f"{name}: unknown category {q.get('category')}")
        facts = q.get("gold_facts") or []
        if not q.get("expected_set") and not 3 <= len(facts) <= 6:
            wrong.append(f"{name}: {len(facts)} gold facts instead of 3 to 6")
        for f in facts:
            place, _, line = str(f.get("evidence", "")).rpartition(":")
            if not place or not line.isdigit() or int(line) < 1:
                wrong.append(f"{name}: evidence {f.get('evidence')!r} is not file:line")
    if wrong:
        raise ValueError("; ".join(wrong))
    return spark.createDataFrame([(q["id"], q.get("repo_id"), q.get("text"), q["category"], [(f.get("id"), f.get("statement"), f["evidence"]) for f in q.get("gold_facts") or []], q.get("expected_set")) for q in listed], QUESTION)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path, multiLine=True)


def plan_runs(questions: DataFrame, arms: list[str], repeats: int, per_repo: int | None = None) -> DataFrame:
    """question id, arm and repeat of every run; ``per_repo``: the first questions of each repository by id only."""
    chosen = questions
    if per_repo is not None:
        chosen = questions.withColumn("_n", F.row_number().over(Window.partitionBy("repo_id").orderBy("id"))).where(F.col("_n") <= per_repo)
    every = chosen.select(F.col("id").alias("question_id"), F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm"))
    return every.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_index"))


def missing_files(gold: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Files that gold facts name and the index does not hold."""
    return gold.select("file").distinct().join(artifacts.select(F.col("path").alias("file")), "file", "left_anti")


def evidence(entities: DataFrame, provenance: DataFrame) -> DataFrame:
    """The rows of provenance (entity_id, ...) of entities(id)."""
    return provenance.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")


def judged(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """run_id, accuracy of facts(run_id, fact_id) with verdicts(run_id, fact_id, hit); no verdict is a miss."""
    both = facts.join(verdicts, ["run_id", "fact_id"], "left")
    return both.groupBy("run_id").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(False)).cast("int")), F.lit(0.0)).alias("accuracy"))


def tool_calls(counts: Column, prefix: str) -> Column:
    """Sum of a map's counts whose names begin with ``prefix``."""
    return F.aggregate(F.map_values(F.map_filter(counts, lambda k, v: k.startswith(prefix))), F.lit(0), lambda a, x: a + x)


def grade(rows: DataFrame, expected: str, label: str, module: str, edge: str, blast: str) -> DataFrame:
    """Adds ``grade``: the first of symbol, module, edge, blast_radius whose path holds the expected fragment, or miss."""
    hit = F.lit("miss")
    for name, column in reversed([("symbol", label), ("module", module), ("edge", edge), ("blast_radius", blast)]):
        hit = F.when(F.coalesce(F.contains(F.col(column), F.col(expected)), F.lit(False)), name).otherwise(hit)
    return rows.withColumn("grade", hit)


def retrieval(rankings: DataFrame, expected: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """k, ranker, category, means of precision, recall and mrr of rankings(ranker, qid, file, position).

    A question that a ranker has no ranking for scores 0 with it.
    """
    out = None
    rankers = [r.ranker for r in rankings.select("ranker").distinct().orderBy("ranker").collect()]
    for k in ks:
        for name in rankers:
            own = ranking_metrics(rankings.where(F.col("ranker") == name).select("qid", "file", "position"), expected, k)
            mean = own.join(questions, "qid").groupBy("category").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "mrr")])
            mean = mean.select(F.lit(k).alias("k"), F.lit(name).alias("ranker"), "category", "precision", "recall", "mrr")
            out = mean if out is None else out.union(mean)
    return out
