"""A Markdown report of benchmark runs: what each arm spent and how right it was, and what may not be read into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import stats

#: Metric columns of runs, their names and how they are shown.
METRICS = [
    ("total_tokens", "Total tokens", "{:,.0f}"), ("input_tokens", "Input tokens", "{:,.0f}"), ("output_tokens", "Output tokens", "{:,.0f}"), ("tool_call_count", "Tool calls", "{:,.1f}"),
    ("file_read_count", "File reads", "{:,.1f}"), ("wall_clock_seconds", "Wall clock, s", "{:,.1f}"), ("cost_usd", "Cost, USD", "{:.4f}"), ("accuracy", "Accuracy", "{:.1%}"),
]
NEGATIVE = "NEGATIVE_CONTROL"


def report(runs: DataFrame, questions: DataFrame, synthetic: bool, judged: bool, ingest_cost: float | None = None, kappa: DataFrame | None = None, retrieval: DataFrame | None = None) -> str:
    """Of runs(question_id, arm, the metrics but total tokens and seconds, wall_clock_millis, contaminated, hit_ceiling) and questions(id, repo_id, category).

    Contaminated runs and those that hit the ceiling are counted, but not summarised. Only summaries come to the driver.
    """
    total = F.col("input_tokens") + F.col("output_tokens")
    rows = runs.join(F.broadcast(questions.select(F.col("id").alias("question_id"), "repo_id", "category")), "question_id")
    rows = rows.withColumn("total_tokens", total).withColumn("wall_clock_seconds", F.col("wall_clock_millis") / 1000).withColumn("negative", F.col("category") == NEGATIVE)
    kept = rows.where("not coalesce(contaminated, false) and not coalesce(hit_ceiling, false)")
    out = ["# Benchmarks", ""]
    if synthetic:
        out += ["> **SYNTHETIC RESULT, not a measurement.** No real agent made these runs.", ""]
    if not judged:
        out += ["> **UNSCORED RESULT.** Judging did not finish: accuracy is missing, not zero.", ""]
    summary = stats.summaries(kept, [m for m, _, _ in METRICS], [["negative", "arm"], ["negative", "arm", "repo_id"]]).collect()
    counts = rows.groupBy("negative", "arm").agg(F.count("*").alias("n"), F.count_if(F.coalesce("contaminated", F.lit(False))).alias("contaminated"), F.count_if(F.coalesce("hit_ceiling", F.lit(False))).alias("ceiling")).collect()
    arms = sorted({r.arm for r in counts})
    whole = {(r.negative, r.arm, r.repo_id, r.metric): r for r in summary}

    def table(negative: bool, repo: str | None) -> list[str]:
        lines = [f"| Metric | {' | '.join(arms)} |", "|---" * (len(arms) + 1) + "|"]
        for metric, name, shape in METRICS:
            cells = [whole.get((negative, arm, repo, metric)) for arm in arms]
            lines.append(f"| {name} | " + " | ".join("no data" if c is None else f"{shape.format(c.median)} ({shape.format(c.min)} to {shape.format(c.max)}, n={c.n})" for c in cells) + " |")
        return [*lines, ""]

    out += ["## Headline", "", "Medians with ranges; negative controls are apart.", "", *table(False, None)]
    for repo in sorted({r.repo_id for r in summary if r.repo_id is not None and not r.negative}):
        out += [f"## Repository {repo}", "", *table(False, repo)]
    out += ["## Negative controls", "", *table(True, None), "## Runs left out", "", "| Arm | Runs | Contaminated | Ceiling |", "|---|---|---|---|"]
    for arm in arms:
        own = [c for c in counts if c.arm == arm]
        out.append(f"| {arm} | {sum(c.n for c in own)} | {sum(c.contaminated for c in own)} | {sum(c.ceiling for c in own)} |")
    out += ["", "## Judge", ""]
    told = kappa.first() if kappa is not None else None
    out += [f"kappa {told.kappa:.3f} over {told.n} pairs" if told and told.n else "Not validated.", "", "## Break-even", ""]
    cost = [whole.get((False, arm, None, "cost_usd")) for arm in arms]
    if ingest_cost is None or len(arms) != 2 or None in cost:
        out.append("Not enough data.")
    else:
        spark = runs.sparkSession
        # the first arm by name is that with tools
        even = spark.range(1).select(stats.break_even(F.lit(cost[0].median), F.lit(cost[1].median), F.lit(float(ingest_cost)))).first()[0]
        out.append({"NotAmortizing": "The tools cost more: no number of questions pays for the index.", "InsufficientData": "Not enough data."}.get(even, f"The index pays after {even} questions."))
    if retrieval is not None:
        ks = [c for c in retrieval.columns if c not in ("section", "name", "ranker", "measured")]
        out += ["", "## Retrieval", "", f"| Part | Ranker | Measured | {' | '.join(ks)} |", "|---" * (3 + len(ks)) + "|"]
        for r in retrieval.orderBy("section", "name", "ranker").collect():
            out.append(f"| {r.section}{' ' + r.name if r.name else ''} | {r.ranker} | {r.measured} | " + " | ".join(f"{r[k]:.3f}" for k in ks) + " |")
    return "\n".join(out) + "\n"
