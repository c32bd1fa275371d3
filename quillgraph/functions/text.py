"""Text expressions: identifier splitting, search terms, intents, scores, token budgets, paths and ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.iterate import settle

#: Words of a question that ask for code or for documents, and words that no question searches for.
DEVELOPMENT = [
    "caller", "callers", "call", "calls", "depend", "dependency", "dependencies", "import", "imports", "function", "method", "class",
    "test", "tests", "implements", "interface", "extend", "extends", "override", "package", "module", "api", "route",
]
RESEARCH = ["concept", "claim", "methodology", "dataset", "experiment", "result", "hypothesis", "finding", "citation", "reference", "paper", "study", "evidence"]
STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "do", "does", "did", "how", "what", "where", "when", "why", "who", "which", "to", "of",
    "in", "on", "for", "and", "or", "with", "this", "that", "it", "its", "be", "as", "at", "by", "from",
]


def split_identifier(s: Column) -> Column:
    """Words of an identifier: at separators, and between lower and upper case, an acronym and a word, letters and digits."""
    parts = F.regexp_replace(s, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.filter(F.split(parts, r"[^A-Za-z0-9]+"), lambda w: w != "")


def search_terms(s: Column) -> Column:
    """Distinct runs of letters, digits and underscores, in order, case kept."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def question_tokens(s: Column) -> Column:
    """Distinct lower-case words of three letters or more that are no stopwords."""
    words = F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)))


def intent(s: Column) -> Column:
    def hits(words: list[str]) -> Column:
        return reduce(lambda a, b: a + b, (F.contains(F.lower(s), F.lit(w)).cast("int") for w in words))

    dev, res = hits(DEVELOPMENT), hits(RESEARCH)
    return F.when(dev > res, "DEVELOPER").when(res > dev, "RESEARCHER").otherwise("GENERAL")


def module_score(tokens: Column, name: Column, path: Column, description: Column) -> Column:
    """3 for each token in the name, 2 in the path, 1 in the description."""
    each = F.transform(tokens, lambda t: 3 * F.contains(F.lower(name), t).cast("int") + 2 * F.contains(F.lower(path), t).cast("int") + F.coalesce(F.contains(F.lower(description), t).cast("int"), F.lit(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def symbol_score(confidence: Column, tokens: Column, label: Column, in_module: Column) -> Column:
    hits = F.size(F.filter(tokens, lambda t: F.contains(F.lower(label), t)))
    return confidence + 5 * hits + 2 * F.coalesce(in_module, F.lit(False)).cast("int")


def is_symbol(node_id: Column, kind: Column) -> Column:
    return F.contains(node_id, F.lit("#")) & (kind != "Module")


def file_of(node_id: Column) -> Column:
    return F.substring_index(node_id, "#", 1)


def scope_of(node_id: Column) -> Column:
    """Scope chain of a declaration id, as an array; empty for file ids."""
    return F.when(F.contains(node_id, F.lit("#")), F.split(F.regexp_extract(node_id, "#(.*)$", 1), r"\.")).otherwise(F.array().cast("array<string>"))


def declaring_type(node_id: Column) -> Column:
    """The segment before the last one of the scope chain, without parameters; null if there is none."""
    parts = F.split(F.substring_index(F.regexp_extract(node_id, "#(.*)$", 1), "(", 1), r"\.")
    return F.when(F.contains(node_id, F.lit("#")) & (F.size(parts) >= 2), F.get(parts, F.size(parts) - 2))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def basename_of(path: Column) -> Column:
    """File name without directory and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def token_cost(s: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(s) / 4)).cast("long")


def running_sum(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` from the group's first row to this one by ``order``; ties by ``order`` share no fixed order.

    Rows are dealt by ranges of group and order, settled, and summed within each range; the ranges' own sums, which are few,
    tell what came before. So a group of any size is the work of many tasks.
    """
    # written before they are summed twice: ranges come from a sample
    dealt = settle(rows.repartitionByRange(F.col(group), F.col(order)).withColumn("_range", F.spark_partition_id()).withColumn("_value", value))
    sums = dealt.groupBy(group, "_range").agg(F.sum("_value").alias("_all"))
    before = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), (F.sum("_all").over(Window.partitionBy(group).orderBy("_range")) - F.col("_all")).alias("_before"))
    within = dealt.withColumn("_here", F.sum("_value").over(Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    joined = within.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn(name, F.col("_here") + F.col("_before")).drop("_range", "_value", "_here", "_before", "_group", "_of")


def pack_budget(rows: DataFrame, budget: int, group: str, order: str, cost: str, brief: str) -> DataFrame:
    """Adds ``full``, false from the first row on whose full cost does not fit, and ``used``, the running cost (brief rows cost ``brief``).

    Costs are not negative.
    """
    summed = running_sum(rows, group, order, F.col(cost), "_sum").withColumn("full", F.col("_sum") <= budget).drop("_sum")
    return running_sum(summed, group, order, F.when(F.col("full"), F.col(cost)).otherwise(F.col(brief)), "used")


def slice_lines(content: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, cut to the text); null without a start, or one outside the text. An earlier end counts as start."""
    lines = F.split(content, "\n", -1)
    last = F.least(F.greatest(F.coalesce(end, start), start), F.size(lines))
    return F.when((start >= 1) & (start <= F.size(lines)), F.array_join(F.slice(lines, start.cast("int"), (last - start + 1).cast("int")), "\n"))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def fqn(prefix: Column, chain: Column) -> Column:
    """prefix.name.chain without parameters."""
    return F.concat_ws(".", F.when(prefix != "", prefix), F.regexp_replace(chain, r"\([^)]*\)", ""))


def utf8_slice(s: Column, start: Column, length: Column) -> Column:
    """A slice by bytes, not characters."""
    return F.decode(F.substring(F.encode(s, "UTF-8"), start, length), "UTF-8")
