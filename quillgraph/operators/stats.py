"""Benchmark statistics: summaries, agreement, precision and recall, budgets over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Target shares of the question categories, and how far a share may be off.
TARGETS = {"GRAPH_HEAVY": 0.60, "NEUTRAL": 0.25, "NEGATIVE_CONTROL": 0.15}
TOLERANCE = 0.20
#: Windows in a stretch of time.
STRETCH = 64


def summarize(rows: DataFrame, metric: str, *by: str) -> DataFrame:
    """median, min, max and n of a metric; null metrics do not count."""
    m = F.col(metric).cast("double")
    return rows.where(m.isNotNull()).groupBy(*by).agg(F.median(m).alias("median"), F.min(m).alias("min"), F.max(m).alias("max"), F.count("*").alias("n"))


def summaries(rows: DataFrame, metrics: list[str], sets: list[list[str]]) -> DataFrame:
    """One pass over all metrics and grouping sets: metric, the grouping columns (null outside their set), set, summary."""
    keys = sorted({k for s in sets for k in s})
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")
    long = rows.select(*keys, each).select(*keys, F.col("m.metric"), F.col("m.value").alias("value")).where("value is not null")
    named = long.groupingSets([[F.col(k) for k in s] + [F.col("metric")] for s in sets], *keys, "metric")
    return named.agg(F.grouping_id().alias("set"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))


def break_even(cost_with: Column, cost_without: Column, ingest_cost: Column) -> Column:
    saving = cost_without - cost_with
    return F.when(saving.isNull() | ingest_cost.isNull(), "InsufficientData").when(saving <= 0, "NotAmortizing").otherwise(F.format_string("%.4f", ingest_cost / saving))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed, expected, kappa of two boolean verdicts; 1 where chance alone agrees."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    got = pairs.agg(F.count("*").alias("n"), F.avg((x == y).cast("int")).alias("observed"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    got = got.withColumn("expected", F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb")))
    return got.select("n", "observed", "expected", F.when(F.col("expected") >= 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def subsample(ids: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """The first ceil(n * share) distinct ids by the SHA-256 of their text."""
    distinct = ids.select(key).distinct().withColumn("_h", F.sha2(F.col(key).cast("string"), 256))
    n = distinct.count()
    return distinct.orderBy("_h").limit(-int(-n * share // 1)).select(key)


#: An element of an answer is a source file and a line.
ELEMENT = r"[\w./-]+\.(?:java|kt|ts|tsx|js|jsx|go):\d+"


def answer_set(answer: Column) -> Column:
    """Distinct path:line elements of an answer, without leading ./"""
    found = F.regexp_extract_all(answer, F.lit(ELEMENT), F.lit(0))
    return F.array_distinct(F.transform(found, lambda e: F.regexp_replace(e, r"^\./", "")))


def set_scores(rows: DataFrame, returned: str, expected: str) -> DataFrame:
    """Adds precision, recall, f1 of two arrays of distinct elements; all null where nothing could be parsed."""
    hit, got, want = F.size(F.array_intersect(returned, expected)), F.size(returned), F.size(expected)
    p, r = F.when(got > 0, hit / got), F.when(got > 0, F.when(want > 0, hit / want).otherwise(0.0))
    return rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def ranking_metrics(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """qid, precision, recall, mrr at ``k`` of ranked(qid, file, position) and expected(qid, file).

    A file counts at its first position. Precision is over k; nothing expected: recall is 1; a question without a
    ranking scores 0.
    """
    first = ranked.groupBy("qid", "file").agg(F.min("position").alias("at"))
    order = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at", "file")))
    want = expected.distinct().withColumn("wanted", F.lit(1))
    hit = order.join(want, ["qid", "file"]).groupBy("qid").agg(F.count(F.when(F.col("rank") <= k, 1)).alias("hits"), F.min("rank").alias("first"))
    sizes = want.groupBy("qid").agg(F.count("*").alias("size"))
    asked = ranked.select("qid").union(expected.select("qid")).distinct().join(sizes, "qid", "left").join(hit, "qid", "left")
    hits = F.coalesce("hits", F.lit(0))
    return asked.select("qid", (hits / k).alias("precision"), F.when(F.coalesce("size", F.lit(0)) == 0, 1.0).otherwise(hits / F.col("size")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def audit_categories(questions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """category, n, ratio, deviation, missing, within against the target shares."""
    spark = questions.sparkSession
    target = spark.createDataFrame(list(TARGETS.items()), "category string, target double")
    total = questions.agg(F.count("*").alias("total"))
    got = F.broadcast(target).join(questions.groupBy("category").agg(F.count("*").alias("n")), "category", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    ratio = F.when(F.col("total") == 0, 0.0).otherwise(n / F.col("total"))
    return got.select("category", n.cast("long").alias("n"), ratio.alias("ratio"), F.abs(ratio - F.col("target")).alias("deviation"), ((n == 0) & (F.col("total") > 0)).alias("missing"), ((F.col("total") > 0) & (F.abs(ratio - F.col("target")) <= tolerance)).alias("within"))


def rate_window(events: DataFrame, ts: str, key: str, seconds: int = 60) -> DataFrame:
    """Adds ``in_window``: events of the key in the ``seconds`` up to each event, itself included.

    Time is cut into stretches of ``STRETCH`` windows, so that a busy key is many tasks' work; an event is also seen by the next
    stretch if its window may reach there. Events without a time count as one stretch.
    """
    span = seconds * 1_000_000
    at = events.withColumn("_s", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_own", F.floor(F.col("_s") / (span * STRETCH)))
    near = (F.floor((F.col("_s") + span) / (span * STRETCH)) > F.col("_own")) & F.col("_s").isNotNull()
    both = at.withColumn("_seen", F.explode(F.when(near, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    within = Window.partitionBy(key, "_seen").orderBy("_s").rangeBetween(-span, 0)
    return both.withColumn("in_window", F.count("*").over(within)).where(F.col("_own").eqNullSafe(F.col("_seen"))).drop("_s", "_own", "_seen")


def file_ranking(lines: DataFrame, tokens: list[str]) -> DataFrame:
    """file, n: files by how many of their lines(file, line) hold a token as a whole word, then by name."""
    import re

    words = "|".join(re.escape(t) for t in tokens)
    return lines.where(F.col("line").rlike(rf"(?<!\w)(?:{words})(?!\w)")).groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file")


#: What a question's search words look like, and abbreviations that are none.
QUOTED = r"[\"`]([^\"`]{2,})[\"`]"
CODE_WORD = r"[A-Za-z_][A-Za-z0-9_./-]*"
NUMBER = r"(?<![\w.])\d{2,}(?![\w.])"
ABBREVIATIONS = ["e.g", "i.e", "etc"]
LEAST_LENGTH = 3


def derive_tokens(question: Column) -> Column:
    """Search words of a question, each once: quoted phrases, code-shaped words, numbers of two digits or more.

    A word stands for itself, for the segments of its path, and for the parts of these between dots. It is code-shaped
    if it has an underscore, dot, slash or a capital after its first character.
    """
    phrases = F.filter(F.transform(F.regexp_extract_all(question, F.lit(QUOTED), F.lit(1)), F.trim), lambda p: F.length(p) >= LEAST_LENGTH)

    def bare(w: Column, ends: str) -> Column:
        return F.regexp_replace(w, f"^[{ends}]+|[{ends}]+$", "")

    def parts(segment: Column) -> Column:
        return F.concat(F.array(segment), F.transform(F.split(segment, r"\."), lambda p: bare(p, "-")))

    words = F.transform(F.regexp_extract_all(question, F.lit(CODE_WORD), F.lit(0)), lambda w: bare(w, "./-"))
    each = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.flatten(F.transform(F.split(w, "/"), lambda g: parts(bare(g, "-")))))))
    shaped = F.filter(each, lambda w: (F.length(w) >= LEAST_LENGTH) & ~F.lower(w).isin(ABBREVIATIONS) & w.rlike(r"[_./]|^.+\p{Lu}"))
    return F.array_distinct(F.concat(phrases, shaped, F.regexp_extract_all(question, F.lit(NUMBER), F.lit(0))))


def retrieval_summary(scores: DataFrame, ks: list[str]) -> DataFrame:
    """section, name, ranker, measured, and the means of ``ks`` of scores(repo, category, ranker, ...): a row for each measured side.

    Sections: headline (all but the negative controls), negative, category and repo. A question that a ranker did not
    measure has no row and is not in its means.
    """
    negative = F.col("category") == "NEGATIVE_CONTROL"
    place = F.array(
        F.struct(F.when(negative, "negative").otherwise("headline").alias("section"), F.lit("").alias("name")),
        F.struct(F.lit("category").alias("section"), F.col("category").alias("name")),
        F.struct(F.lit("repo").alias("section"), F.col("repo").alias("name")),
    )
    each = scores.select(F.explode(place).alias("at"), "ranker", *ks)
    return each.groupBy("at.section", "at.name", "ranker").agg(F.count("*").alias("measured"), *[F.avg(k).alias(k) for k in ks])
