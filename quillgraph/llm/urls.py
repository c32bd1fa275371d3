"""URL filter: rules by host and path, else host word segmentation and multinomial naive Bayes.

Host names are split at everything but letters and digits, and each part is cut into words by unigram Viterbi:
the cut whose words have the greatest product of probabilities, where an unknown stretch costs more with every
character. Words of the model are all letter runs of two to ``LONGEST`` letters of the urls' paths and of page texts or
any other text column, less names with dots and urls: a host's own label would be a word that no cut can beat. Host words and path tokens then go through multinomial naive Bayes with add-one counts,
learnt from the urls that a rule judges: the rules are the labels. Every word, label and token counts, whatever their
number: the most frequent are broadcast, the others meet the rows in shuffle joins, in which none is frequent.

Defined results
  null url or one without "://": host and path are empty. A rule fits its host and all its subdomains where the
  path begins with the rule's path; the rule with the longest host, then path, wins; equal rules: the first one.
  no rule fits: rule null, verdict of the model; with labels of one kind only, that verdict; with none, allow.
  ties of the model: allow. Repeated ids or rows: one row each. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import cut, small_batches
from quillgraph.llm.ppm import _most

#: How many of the most frequent words, host labels and tokens are broadcast; the result is the same for any number.
WORDS = 50_000
LABELS = 100_000
TOKENS = 200_000
LONGEST = 20

#: Labels that say nothing of a site.
PLAIN = {"www", "m"}


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits, or null."""
    first = {(h, p): v for v, h, p in reversed(rules)}
    ordered = sorted(first, key=lambda r: (-len(r[0]), -len(r[1]), r))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(first[h, p]).alias("verdict"))) for h, p in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


class Segmenter:
    """Unigram Viterbi over the words' counts."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """total: of all words' counts, if ``counts`` is a part."""
        self.total = total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total) + 1
        self.longest = LONGEST

    def split(self, name: str, more: dict[str, int] | None = None) -> list[str]:
        """``more``: counts of words that are not in the list."""
        rare = {w: -math.log(n / self.total) for w, n in more.items()} if more else {}
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, start = best[end - 1] + self.unknown + 2.0, end - 1
            for a in range(max(0, end - self.longest), end):
                c = self.cost.get(name[a:end])
                if c is None and rare:
                    c = rare.get(name[a:end])
                if c is not None and best[a] + c < cost:
                    cost, start = best[a] + c, a
            best.append(cost)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        out.reverse()
        return out


class Bayes:
    """Multinomial naive Bayes of tokens; ``counts`` maps a token to its counts under allow and block."""

    def __init__(self, counts: dict[str, tuple[int, int]], totals: tuple[int, int], priors: tuple[int, int], kinds: int):
        self.priors = priors
        self.n = n = [t + kinds + 1 for t in totals]
        self.weight = {t: math.log((b + 1) / n[1]) - math.log((a + 1) / n[0]) for t, (a, b) in counts.items()}
        self.other = math.log(n[0] / n[1])
        self.start = math.log(priors[1] / priors[0]) if all(priors) else 0.0

    def verdict(self, tokens: list[str]) -> str:
        if not all(self.priors):
            return "block" if self.priors[1] else "allow"
        return "block" if self.start + sum(self.weight.get(t, self.other) for t in tokens) > 0 else "allow"


def path_tokens(path: str) -> list[str]:
    parts = re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", path)
    return ["p:" + (re.sub(r"\d", "0", part) if part.isascii() else part).lower() for part in parts if part]


def _labels(host: Column) -> Column:
    """The host's parts that say something of a site."""
    plain = F.array(F.lit(""), *[F.lit(p) for p in sorted(PLAIN)])
    return F.filter(F.split(host, r"[^0-9a-z\x{80}-\x{10ffff}]+"), lambda p: ~F.array_contains(plain, p))


def _cuts(labels: DataFrame, said: DataFrame, words: int) -> DataFrame:
    """label, n, words: the cut of each of ``labels`` (label, n) by the words of ``said``."""
    spark = labels.sparkSession
    runs = said.select(F.explode(F.regexp_extract_all(F.lower("said"), F.lit(r"\p{L}{2,}"), 0)).alias("w"))
    vocabulary = cut(runs.groupBy("w").agg(F.count("*").alias("n")))
    total, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = _most(vocabulary, words).toArrow()
    known = dict(zip(head["w"].to_pylist(), head["n"].to_pylist(), strict=True))
    given = labels.withColumn("more", F.expr("cast(array() as array<struct<w:string,n:bigint>>)"))
    if len(known) < kinds:
        rare = vocabulary.join(F.broadcast(spark.createDataFrame(head.select(["w"])) if known else vocabulary.select("w").where("false")), "w", "left_anti").where(F.length("w") <= LONGEST)
        inner = F.expr(f"explode(flatten(transform(sequence(1, greatest(length(label) - 1, 1)), i -> transform(sequence(2, greatest(least({LONGEST}, length(label) - i + 1), 2)), k -> substr(label, i, k)))))")
        met = labels.select("label", inner.alias("w")).distinct().join(rare, "w").groupBy("label").agg(F.collect_list(F.struct("w", "n")).alias("more"))
        given = labels.join(met, "label", "left").select("label", "n", "more")
    cutter = spark.sparkContext.broadcast(Segmenter(known, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [cutter.value.split(name, {m["w"]: m["n"] for m in more or ()}) for name, more in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.string()))], names=["label", "n", "words"])

    return given.mapInArrow(run, "label string, n long, words array<string>")


def page_text(html: Column) -> Column:
    """What a page says: no scripts, styles, comments, tags or entities."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;", " ")


def _no_hosts(text: Column) -> Column:
    """Without urls and names with dots."""
    return F.regexp_replace(text, r"[A-Za-z][A-Za-z0-9+.-]*://\S*|[\p{L}\p{N}_-]++(?:\.[\p{L}\p{N}_-]++)+", " ")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", texts: DataFrame | None = None, column: str = "text", words: int = WORDS, known: int = TOKENS, names: int = LABELS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row. ``texts``: where words come from beside the urls' paths.

    Broadcast are at most the ``words``, ``names`` and ``known`` most frequent words, host labels and tokens.
    """
    spark = pages.sparkSession
    small_batches(spark)
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = parts.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    said = parts.select(F.col("path").alias("said"))
    if texts is not None:
        said = said.union(texts.select(_no_hosts(F.col(column))))
    labels = parts.select(F.explode(_labels(F.col("host"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    cuts = cut(_cuts(labels, said, words))
    first = _most(cuts, names).toArrow()
    listed = spark.sparkContext.broadcast(dict(zip(first["label"].to_pylist(), first["words"].to_pylist(), strict=True)))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        of = listed.value
        for batch in batches:
            tokens, others = [], []
            for mine, path in zip(batch.column(5).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens.append(["h:" + w for name in mine for w in of.get(name, ())] + path_tokens(path))
                others.append([name for name in mine if name not in of])
            ids = pa.array(range(row, row + len(tokens)), pa.int64())
            row += len(tokens)
            yield pa.RecordBatch.from_arrays([ids, *batch.columns[:5], pa.array(tokens, pa.list_(pa.string())), pa.array(others, pa.list_(pa.string()))], names=["row", "page_id", "host", "path", "rule", "given", "tokens", "others"])

    text, many = T.StringType(), T.ArrayType(T.StringType())
    shape = [T.StructField("row", T.LongType()), parts.schema["page_id"], *[T.StructField(c, text) for c in ("host", "path", "rule", "given")]]
    rows = parts.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("given"), _labels(F.col("host")).alias("labels"))
    rows = cut(rows.mapInArrow(tokenise, T.StructType([*shape, T.StructField("tokens", many), T.StructField("others", many)])))
    if cuts.count() > len(first):
        rare = rows.select("row", F.explode("others").alias("label")).join(cuts.select("label", "words"), "label")
        rare = rare.groupBy("row").agg(F.flatten(F.collect_list("words")).alias("more"))
        whole = F.concat("tokens", F.coalesce(F.transform("more", lambda w: F.concat(F.lit("h:"), w)), F.array().cast("array<string>")))
        rows = cut(rows.join(rare, "row", "left").withColumn("tokens", whole).drop("more"))
    rows = rows.drop("others")

    allow, block = F.col("given") == "allow", F.col("given") == "block"
    counted = rows.select("given", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.count(F.when(allow, 1)).alias("a"), F.count(F.when(block, 1)).alias("b"))
    counted = cut(counted)
    every, kinds, a, b = counted.agg(F.count("*"), F.count(F.when(F.col("a") + F.col("b") > 0, 1)), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    top = _most(counted, known).toArrow()
    common = dict(zip(top["t"].to_pylist(), zip(top["a"].to_pylist(), top["b"].to_pylist(), strict=True), strict=True))
    bayes = Bayes(common, (a, b), tuple(rows.agg(F.count(F.when(allow, 1)), F.count(F.when(block, 1))).first()), kinds)
    model = spark.sparkContext.broadcast(bayes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.value.weight
        for batch in batches:
            sums, others = [], []
            for mine, given in zip(batch.column(6).to_pylist(), batch.column(5).to_pylist(), strict=True):
                mine = [] if given is not None else mine
                sums.append(math.fsum(weight[t] for t in mine if t in weight))
                others.append([t for t in mine if t not in weight])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sums, pa.float64()), pa.array(others, pa.list_(pa.string()))], names=["row", "page_id", "host", "path", "rule", "given", "sum", "others"])

    scored = rows.mapInArrow(run, T.StructType([*shape, T.StructField("sum", T.DoubleType()), T.StructField("others", many)]))
    evidence = F.col("sum")
    if every > len(common):
        scored = cut(scored)
        one = F.log((F.col("b") + 1) / F.lit(bayes.n[1])) - F.log((F.col("a") + 1) / F.lit(bayes.n[0]))
        rest = scored.select("row", F.explode("others").alias("t")).join(counted, "t").groupBy("row").agg(F.sum(one).alias("rest"))
        scored = scored.join(rest, "row", "left")
        evidence = evidence + F.coalesce("rest", F.lit(0.0))
    told = F.when(evidence + F.lit(bayes.start) > 0, "block").otherwise("allow") if all(bayes.priors) else F.lit(bayes.verdict([]))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", told).alias("verdict"))
