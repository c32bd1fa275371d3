"""Ranked full-text search: postings, BM25, and the fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import file_of, is_symbol, module_score, search_terms, split_identifier, symbol_score
from quillgraph.operators.iterate import settle

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def document_text(label: Column, *more: Column) -> Column:
    """What is indexed of a node: its label, the label's words if there are several, and further text."""
    words = split_identifier(label)
    return F.concat_ws(" ", label, F.when(F.size(words) > 1, F.array_join(words, " ")), *more)


#: Fixed value: what is a word of a document.
WORD = r"[\p{L}\p{N}_]+"


def indexed_text(nodes: DataFrame) -> Column:
    """The label, its words and, where the table has them, the properties."""
    return document_text(F.col("label"), *([F.col("properties")] if "properties" in nodes.columns else []))


def postings(nodes: DataFrame, text: Column) -> DataFrame:
    """id, term, tf, dl: lower-cased terms of each node. For an index that is stored, by term."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    said = nodes.select("id", words.alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return said.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def matches(nodes: DataFrame, text: Column, terms: list[tuple[int, str]]) -> tuple[DataFrame, int, float]:
    """id, qid, term, tf, dl where a node says one of ``terms`` (qid, term), and the number of nodes and their average length.

    One pass over the texts, without a shuffle: a node's words are counted against the terms where they are, only nodes
    that are hit are written, and the totals are observed on the way.
    """
    asked = F.array(*[F.struct(F.lit(q).alias("qid"), F.lit(t).alias("term")) for q, t in terms])
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def counted(w: Column) -> Column:
        each = F.transform(asked, lambda a: F.struct(a["qid"].alias("qid"), a["term"].alias("term"), F.size(F.filter(w, lambda x: x == a["term"])).cast("long").alias("tf")))
        return F.struct(F.size(w).alias("dl"), F.filter(each, lambda e: e["tf"] > 0).alias("hits"))

    seen = nodes.select("id", F.get(F.transform(F.array(words), counted), F.lit(0)).alias("s"))
    totals = Observation()
    hit = seen.observe(totals, F.count(F.lit(1)).alias("n"), F.sum("s.dl").alias("said")).where(F.size("s.hits") > 0)
    found = settle(hit.select("id", F.col("s.dl").alias("dl"), F.explode("s.hits").alias("h")).select("id", "h.qid", "h.term", "h.tf", "dl"))
    n, said = totals.get["n"], totals.get["said"] or 0
    return found, n, said / n if n else 0.0


def bm25(hits: DataFrame, n: int, avgdl: float) -> DataFrame:
    """qid, id, score of hits(id, qid, term, tf, dl) among ``n`` nodes of ``avgdl`` words on average."""
    df = hits.select("term", "id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term")  # as many rows as the question has terms
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    return scored.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def like_any(label: Column, terms: list[str]) -> Column:
    """Case-insensitive substring match of any term; % and _ of a term stand for themselves."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(label), F.lit(t.lower())) for t in terms), F.lit(False))


def search(nodes: DataFrame, question: str, types: list[str] | None = None, min_confidence: float = 0.0, limit: int = 20, text: Column | None = None, limit_first: bool = False) -> DataFrame:
    """id, score: the best nodes for the words of ``question``.

    Blank: nodes by id. No term: none. No full-text hit: labels that contain a term. Filters go before the limit, or
    after it with ``limit_first``.
    """
    spark = nodes.sparkSession
    body = text if text is not None else indexed_text(nodes)
    fits = F.col("confidence") >= min_confidence
    if types:
        fits &= F.col("type").isin(types)
    if not question.strip():
        return nodes.where(fits).select("id", F.lit(0.0).alias("score")).orderBy("id").limit(limit)
    terms = spark.range(1).select(search_terms(F.lit(question)).alias("t")).first().t
    if not terms:
        return nodes.where("false").select("id", F.lit(0.0).alias("score"))
    scored = bm25(*matches(nodes, body, [(0, t) for t in sorted({t.lower() for t in terms})])).select("id", F.round("score", 9).alias("score"))
    if limit_first:
        found = scored.orderBy(F.desc("score"), "id").limit(limit).join(nodes.where(fits), "id", "left_semi")
    else:
        found = scored.join(nodes.where(fits), "id", "left_semi")
    found = found.orderBy(F.desc("score"), "id").limit(limit)
    if found.isEmpty() and scored.isEmpty():
        return nodes.where(fits & like_any(F.col("label"), terms)).select("id", F.lit(0.0).alias("score")).orderBy("id").limit(limit)
    return found


def top_per_term(nodes: DataFrame, terms: list[str], per_term: int = 25, limit: int = 40) -> DataFrame:
    """Symbols found for single terms: the best ``per_term`` of each, then the first ``limit`` by term order and rank."""
    scored = bm25(*matches(nodes, indexed_text(nodes), [(i, t.lower()) for i, t in enumerate(terms)])).withColumn("score", F.round("score", 9))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("n") <= per_term)
    first = best.groupBy("id").agg(F.min(F.struct("qid", "n")).alias("seen"))
    return first.select("id", "seen.qid", "seen.n").orderBy("qid", "n").limit(limit)


def match_modules(modules: DataFrame, tokens: list[str], similar: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """id, name, path, description, score, method, rank: what ``similar`` (id, score) finds, then by the words of name, path and description.

    modules(id, name, path, description); ties by id.
    """
    score = module_score(F.array(*[F.lit(t) for t in tokens]).cast("array<string>"), F.col("name"), F.col("path"), F.col("description")).cast("double")
    found = modules.withColumn("score", score).withColumn("method", F.lit("keyword")).where("score > 0")
    if similar is not None:
        near = modules.join(similar, "id").withColumn("method", F.lit("embedding"))
        found = near.unionByName(found.join(similar.select("id"), "id", "left_anti"))
    top = found.orderBy(F.col("method"), F.desc("score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("method", F.desc("score"), "id")))


def match_symbols(nodes: DataFrame, tokens: list[str], module_paths: list[str], per_term: int = 25, limit: int = 40) -> DataFrame:
    """The symbols among the best ``per_term`` nodes of each token, with score and rank; a symbol in a matched module scores 2 more."""
    found = top_per_term(nodes, tokens, per_term, per_term * max(len(tokens), 1))
    own = nodes.join(F.broadcast(found.select("id")), "id", "left_semi").where(is_symbol(F.col("id"), F.col("type")))
    file = file_of(F.col("id"))
    held = reduce(lambda a, b: a | b, ((file == p) | file.startswith(p + "/") for p in module_paths if p), F.lit(False))
    scored = own.withColumn("score", symbol_score(F.col("confidence"), F.array(*[F.lit(t) for t in tokens]), F.col("label"), held))
    top = scored.orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def modules_by_meaning(nodes: DataFrame, question: str, similar: DataFrame | None, floor: float = 0.40, limit: int = 10) -> DataFrame:
    """id, score, method: modules by ``similar`` (id, score) at ``floor`` or above, or, if that finds none, by the words of the question."""
    own = nodes.where("type = 'CodeModule'")
    if similar is not None:
        near = similar.where(F.col("score") >= floor).join(own.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(limit)
        if not near.isEmpty():
            return near.select("id", "score", F.lit("embedding").alias("method"))
    return search(own, question, limit=limit).select("id", "score", F.lit("keyword").alias("method"))
