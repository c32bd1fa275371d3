"""Extractors over artifacts with text: Markdown, page text, SQL, package and build files, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING, CONCEPT, SECTION, DEPENDENCY, SQL_PATTERN = 0.95, 0.75, 0.80, 0.95, 0.85

#: The patterns of what is extracted.
HEADING_LINE = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
LINK = r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"
BOLD = r"\*\*([^*\n]+)\*\*"
CHECKBOX = r"^-\s+\[[ x]\]\s+.+"
REQUIREMENT = r"\b(MUST|SHALL|REQUIRED|SHOULD|RECOMMENDED)\b"
CITATION = r"\[\d+\]|\[[A-Z][a-z]+(?:\s+et\s+al\.?)?,\s*\d{4}\]"
CREATE_TABLE = r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?(\w+)[`\"]?"
FOREIGN_KEY = r"(?i)FOREIGN\s+KEY\s*\([^)]*\)\s*REFERENCES\s+[`\"]?(\w+)"
BUILD_DEPENDENCY = r"(?:implementation|api|testImplementation|runtimeOnly|compileOnly)\s*\(?[\"']([^\"']+)[\"']"
BUILD_PROJECT = r"project\([\"']:([^\"']+)[\"']\)"
FROM_LINE = r"(?m)^FROM\s+(\S+)"


def lines(docs: DataFrame) -> DataFrame:
    """artifact_id, idx (from 0), line."""
    return docs.select("artifact_id", F.posexplode(F.split("content", r"\r?\n", -1)).alias("idx", "line"))


def headings(docs: DataFrame) -> DataFrame:
    """artifact_id, idx, level, label, parent (label of the nearest earlier heading of a lower level, or null).

    The parent of level n is the last heading of a lower level; one running maximum a level finds it without a self-join.
    """
    found = lines(docs).select("artifact_id", "idx", F.regexp_extract("line", HEADING_LINE, 1).alias("marks"), F.regexp_extract("line", HEADING_LINE, 2).alias("label"))
    found = found.where("marks <> ''").select("artifact_id", "idx", F.length("marks").alias("level"), "label")
    before = Window.partitionBy("artifact_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    for n in range(2, 7):
        lower = F.max(F.when(F.col("level") < n, F.struct("idx", "label"))).over(before)
        found = found.withColumn(f"_p{n}", lower)
    parent = F.when(F.col("level") == 1, F.lit(None).cast("string"))
    for n in range(2, 7):
        parent = parent.when(F.col("level") == n, F.col(f"_p{n}")["label"])
    return found.select("artifact_id", "idx", "level", "label", parent.alias("parent"))


def links(docs: DataFrame) -> DataFrame:
    """artifact_id, destination of inline links that lead out of the document; each once."""
    out = docs.select("artifact_id", F.explode(F.regexp_extract_all("content", F.lit(LINK), F.lit(1))).alias("destination"))
    return out.where(~F.col("destination").startswith("#")).distinct()


def section_links(docs: DataFrame) -> DataFrame:
    """artifact_id, destination, label of the nearest heading above (null if there is none); each once."""
    out = _below(docs, F.nullif(F.regexp_extract("line", HEADING_LINE, 2), F.lit("")), LINK, 1, "destination")
    return out.where(~F.col("destination").startswith("#")).distinct()


def _below(docs: DataFrame, heading: Column, pattern: str, group: int, name: str) -> DataFrame:
    """artifact_id, what ``pattern`` finds, label of the nearest heading above or on its line."""
    rows = lines(docs).select("artifact_id", "idx", heading.alias("h"), F.regexp_extract_all("line", F.lit(pattern), F.lit(group)).alias("found"))
    rows = rows.where(F.col("h").isNotNull() | (F.size("found") > 0))  # other lines need no window
    above = F.last("h", ignorenulls=True).over(Window.partitionBy("artifact_id").orderBy("idx"))
    return rows.withColumn("label", above).select("artifact_id", F.explode("found").alias(name), "label")


def bold_concepts(docs: DataFrame) -> DataFrame:
    """artifact_id, label of strong passages of more than three characters and at least two words; each once."""
    out = docs.select("artifact_id", F.explode(F.regexp_extract_all("content", F.lit(BOLD), F.lit(1))).alias("label"))
    return out.where((F.length("label") > 3) & (F.size(F.split(F.trim("label"), r"\s+")) >= 2)).distinct()


def special_lines(docs: DataFrame) -> DataFrame:
    """artifact_id, idx, type, label of decisions, checkboxes and lines with a requirement word; the first kind that fits."""
    cut = F.trim("line")
    decision = cut.startswith("## Decision:") | cut.startswith("### Decision:")
    box = cut.rlike(CHECKBOX)
    must = cut.rlike(REQUIREMENT)
    kind = F.when(decision, "Decision").when(box | must, "Requirement")
    label = F.when(decision, F.trim(F.regexp_replace(cut, r"^[^:]*:", ""))).when(box, F.regexp_replace(cut, r"^-\s+\[[ x]\]\s+", "")).otherwise(F.left(cut, F.lit(120)))
    return lines(docs).select("artifact_id", "idx", kind.alias("type"), label.alias("label")).where("type is not null and label <> ''")


def looks_like_heading(line: Column) -> Column:
    """5 to 100 characters, up to ten words, over 60 % of them capitalised, no final stop or comma."""
    cut = F.trim(line)
    words = F.split(cut, r"\s+")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return F.length(cut).between(5, 100) & (F.size(words) <= 10) & (capital > 0.6 * F.size(words)) & ~cut.endswith(".") & ~cut.endswith(",")


def page_sections(docs: DataFrame) -> DataFrame:
    return lines(docs).where(looks_like_heading(F.col("line"))).select("artifact_id", "idx", F.trim("line").alias("label"))


def section_citations(docs: DataFrame) -> DataFrame:
    """artifact_id, citation, label of the nearest page heading above (null if there is none); each once."""
    heading = F.when(looks_like_heading(F.col("line")), F.trim("line"))
    return _below(docs, heading, CITATION, 0, "citation").distinct()


def citations(docs: DataFrame) -> DataFrame:
    """artifact_id, citation like [12] or [Name et al., 2020]; each once."""
    found = F.regexp_extract_all("content", F.lit(CITATION), F.lit(0))
    return docs.select("artifact_id", F.explode(found).alias("citation")).distinct()


def sql_tables(docs: DataFrame) -> DataFrame:
    return docs.select("artifact_id", F.explode(F.regexp_extract_all("content", F.lit(CREATE_TABLE), F.lit(1))).alias("table")).distinct()


def sql_columns(docs: DataFrame) -> DataFrame:
    """artifact_id, table, column, kind of simple CREATE TABLE statements; constraints are no columns."""
    body = F.regexp_extract_all("content", F.lit(CREATE_TABLE + r"\s*\(((?:[^();]|\([^()]*\))*)\)"), F.lit(0))
    each = docs.select("artifact_id", F.explode(body).alias("b"))
    each = each.select("artifact_id", F.regexp_extract("b", CREATE_TABLE, 1).alias("table"), F.regexp_replace("b", r"(?s)^[^(]*\(|\)$", "").alias("inner"))
    part = each.select("artifact_id", "table", F.posexplode(F.split("inner", r",(?![^(]*\))")).alias("pos", "p")).withColumn("p", F.trim(F.regexp_replace("p", r"\s+", " ")))
    kept = part.where(~F.col("p").rlike(r"(?i)^(primary|foreign|unique|constraint|check|key|index)\b") & (F.col("p") != ""))
    return kept.select("artifact_id", "table", F.regexp_extract("p", r"^[`\"]?(\w+)[`\"]?", 1).alias("column"), F.lower(F.regexp_extract("p", r"^\S+\s+(\w+)", 1)).alias("kind"))


def sql_foreign_keys(docs: DataFrame) -> DataFrame:
    """artifact_id, table, target of table-level foreign keys."""
    body = F.regexp_extract_all("content", F.lit(CREATE_TABLE + r"\s*\(((?:[^();]|\([^()]*\))*)\)"), F.lit(0))
    each = docs.select("artifact_id", F.explode(body).alias("b")).select("artifact_id", F.regexp_extract("b", CREATE_TABLE, 1).alias("table"), "b")
    return each.select("artifact_id", "table", F.explode(F.regexp_extract_all("b", F.lit(FOREIGN_KEY), F.lit(1))).alias("target")).distinct()


def package_json(docs: DataFrame) -> DataFrame:
    """artifact_id, kind (dependency or script), name of package.json files; what does not parse yields nothing."""
    shape = "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, scripts map<string,string>"
    p = docs.select("artifact_id", F.from_json("content", shape).alias("p"))
    pairs = [_named(k) for k in ("dependencies", "devDependencies", "peerDependencies", "scripts")]
    return p.select("artifact_id", F.explode(F.concat(*pairs)).alias("x")).select("artifact_id", "x.kind", "x.name").distinct()


def _named(key: str) -> Column:
    kind = "script" if key == "scripts" else "dependency"
    return F.transform(F.coalesce(F.map_keys(f"p.{key}"), F.array().cast("array<string>")), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def gradle(docs: DataFrame) -> DataFrame:
    """artifact_id, kind (dependency or project), name."""
    dep = F.regexp_extract_all("content", F.lit(BUILD_DEPENDENCY), F.lit(1))
    project = F.regexp_extract_all("content", F.lit(BUILD_PROJECT), F.lit(1))
    both = F.concat(F.transform(dep, lambda n: F.struct(F.lit("dependency").alias("kind"), F.replace(n, F.lit(":"), F.lit("_")).alias("name"))), F.transform(project, lambda n: F.struct(F.lit("project").alias("kind"), n.alias("name"))))
    return docs.select("artifact_id", F.explode(both).alias("x")).select("artifact_id", "x.kind", "x.name").distinct()


def dockerfile(docs: DataFrame) -> DataFrame:
    """artifact_id, image."""
    return docs.select("artifact_id", F.explode(F.regexp_extract_all("content", F.lit(FROM_LINE), F.lit(1))).alias("image")).distinct()


def compose_services(docs: DataFrame) -> DataFrame:
    """artifact_id, service: keys of the first level below ``services:`` of compose files."""
    rows = lines(docs).withColumn("top", F.regexp_extract("line", r"^([A-Za-z][\w-]*):", 1))
    inside = F.last(F.when(F.col("top") != "", F.col("top")), ignorenulls=True).over(Window.partitionBy("artifact_id").orderBy("idx"))
    rows = rows.withColumn("block", inside).where("block = 'services' and top = ''").withColumn("pad", F.length(F.regexp_extract("line", r"^( *)", 1))).withColumn("key", F.regexp_extract("line", r"^ +([\w.-]+):\s*$", 1)).where("key <> ''")
    least = F.min("pad").over(Window.partitionBy("artifact_id"))
    return rows.withColumn("least", least).where("pad = least").select("artifact_id", F.col("key").alias("service"))


def clamp(confidence: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(confidence, F.lit(low)), F.lit(high))
