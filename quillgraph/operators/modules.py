"""Modules: their tree, which one owns a path, their inventories and the state of their descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import directory_of

#: How build files name modules, and folders that hold none.
INCLUDE_CALL = r"(?s)include\s*\(([^)]*)\)"
INCLUDE_LINE = r"(?m)^\s*include\s+([\"'][^\"']+[\"'](?:\s*,\s*[\"'][^\"']+[\"'])*)\s*$"
GRADLE_PATH = r"[\"'](:[A-Za-z0-9_.\-:]*)[\"']"
PROJECT_NAME = [rf"\[{table}\](?:(?!\n\[)[\s\S])*?\bname\s*=\s*[\"']([^\"']+)[\"']" for table in ("project", r"tool\.poetry")]
NO_MODULES = [".git", "node_modules", ".venv", "venv", "__pycache__", "build", "dist", ".tox", ".gradle", ".idea", "target", "site-packages"]
SOURCES = ["gradle", "npm", "python", "config"]


def ancestors(path: Column) -> Column:
    """The path and all its prefixes at slashes, longest first, without the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _gradle(files: DataFrame) -> DataFrame:
    """Modules that the settings file at the root includes."""
    first = files.where(F.col("path").isin("settings.gradle.kts", "settings.gradle")).orderBy(F.desc("path")).limit(1)
    calls = F.concat(F.regexp_extract_all("content", F.lit(INCLUDE_CALL), F.lit(1)), F.regexp_extract_all("content", F.lit(INCLUDE_LINE), F.lit(1)))
    named = first.select(F.explode(F.flatten(F.transform(calls, lambda c: F.regexp_extract_all(c, F.lit(GRADLE_PATH), F.lit(1))))).alias("g"))
    return named.select(F.translate(F.regexp_replace("g", "^:", ""), ":", "/").alias("path"), F.substring_index("g", ":", -1).alias("name"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("source"))


def _npm(files: DataFrame) -> DataFrame:
    """Folders with a package.json that a workspace pattern of the root's names, by itself or as ``folder/*``."""
    listed = F.coalesce(F.from_json(F.get_json_object("content", "$.workspaces"), "array<string>"), F.from_json(F.get_json_object("content", "$.workspaces.packages"), "array<string>"))
    wanted = files.where("path = 'package.json'").select(F.explode(listed).alias("p")).where("p is not null")
    wanted = wanted.select(F.col("p").endswith("/*").alias("below"), F.regexp_replace("p", r"/\*$", "").alias("folder")).distinct()
    packages = files.where("path like '%/package.json'").select(directory_of(F.col("path")).alias("path"), F.get_json_object("content", "$.name").alias("name"))
    ways = F.array(F.struct(F.lit(False).alias("below"), F.col("path").alias("folder")), F.struct(F.lit(True).alias("below"), directory_of(F.col("path")).alias("folder")))
    found = packages.select("path", "name", F.explode(ways).alias("w")).select("path", "name", "w.*").join(F.broadcast(wanted), ["below", "folder"], "left_semi")
    return found.select("path", F.coalesce("name", F.substring_index("path", "/", -1)).alias("name"), F.lit(None).cast("string").alias("up"), F.lit(1).alias("source")).distinct()


def _python(files: DataFrame) -> DataFrame:
    """Folders whose pyproject.toml names a project, with the nearest such folder around them, the root included."""
    none = F.exists(F.split(directory_of(F.col("path")), "/"), lambda d: d.isin(NO_MODULES))
    name = F.coalesce(*[F.nullif(F.regexp_extract("content", p, 1), F.lit("")) for p in PROJECT_NAME])
    found = files.where((F.substring_index("path", "/", -1) == "pyproject.toml") & ~none).select(directory_of(F.col("path")).alias("path"), name.alias("name")).where("name is not null")
    around = F.filter(F.concat(ancestors(F.col("path")), F.array(F.lit(""))), lambda a: a != F.col("path"))
    up = found.select("path", F.explode(around).alias("up")).join(found.select(F.col("path").alias("up")), "up").groupBy("path").agg(F.max_by("up", F.length("up")).alias("up"))
    return found.join(up, "path", "left").select("path", "name", "up", F.lit(2).alias("source"))


def detect(files: DataFrame, roots: list[dict] | None = None) -> DataFrame:
    """id, path, name, build_system, parent_id of the modules that build files among files(path, content) declare.

    ``roots``: declared modules {path, name}, which stand in place of detected ones at the same path. Of several at one path the first
    by source stays: Gradle, npm, Python.
    """
    found = _gradle(files).unionByName(_npm(files)).unionByName(_python(files))
    if roots:
        spark = files.sparkSession
        given = [((r["path"].strip("/")), r.get("name") or r["path"].strip("/").rsplit("/", 1)[-1]) for r in roots]
        own = spark.createDataFrame(given, "path string, name string").select("path", "name", F.lit(None).cast("string").alias("up"), F.lit(3).alias("source"))
        found = found.join(F.broadcast(own.select("path")), "path", "left_anti").unionByName(own)
    first = found.groupBy("path").agg(F.min(F.struct("source", "name", "up")).alias("f")).select("path", "f.*")
    tree = build_tree(first.select("path", F.col("up").alias("known_parent")))
    system = F.get(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    return tree.join(first.select("path", "name", system.alias("build_system")), "path").select("id", "path", "name", "build_system", "parent_id")


def as_nodes(modules: DataFrame) -> DataFrame:
    """Graph nodes of ``detect``'s modules; what else is known of them is in ``properties``."""
    props = F.to_json(F.struct("path", F.col("build_system").alias("buildSystem"), F.col("parent_id").alias("parentId")))
    return modules.select("id", F.lit("CodeModule").alias("type"), F.col("name").alias("label"), F.lit(1.0).alias("confidence"), "path", props.alias("properties"))


def read_tree(nodes: DataFrame) -> DataFrame:
    """The modules of stored nodes, as ``detect`` gave them."""
    own = nodes.where("type = 'CodeModule'").withColumn("p", F.from_json("properties", "path string, buildSystem string, parentId string"))
    return own.select("id", F.col("p.path").alias("path"), F.col("label").alias("name"), F.col("p.buildSystem").alias("build_system"), F.col("p.parentId").alias("parent_id"))


def children(tree: DataFrame, module: str) -> DataFrame:
    return tree.where(F.col("parent_id") == module)


def build_tree(modules: DataFrame) -> DataFrame:
    """id, path, parent_id of modules(path): the parent is ``known_parent``, if there is such a column and that is a module, else the longest
    proper prefix at a slash that is one.
    """
    if "known_parent" in modules.columns:
        plain = build_tree(modules.select("path"))
        known = modules.where("known_parent is not null").select("path", "known_parent").join(modules.select(F.col("path").alias("known_parent")).distinct(), "known_parent", "left_semi").distinct()
        return plain.join(known, "path", "left").select("id", "path", F.coalesce(F.concat(F.lit("module:"), "known_parent"), "parent_id").alias("parent_id"))
    paths = modules.select("path").distinct()
    up = paths.where("path <> ''").select("path", F.explode(F.slice(ancestors(F.col("path")), 2, 1000)).alias("parent"))
    best = up.join(paths.select(F.col("path").alias("parent")), "parent").groupBy("path").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    named = paths.join(best, "path", "left")
    return named.select(F.concat(F.lit("module:"), "path").alias("id"), "path", F.when(F.col("parent").isNotNull(), F.concat(F.lit("module:"), "parent")).alias("parent_id"))


def owners(files: DataFrame, tree: DataFrame) -> DataFrame:
    """path, owner: the module of the longest path that holds the file.

    A root module (empty path) owns the rest only where every other module lies below it.
    """
    up = files.select("path", F.explode(ancestors(F.ltrim(F.col("path"), F.lit("/")))).alias("m"))
    best = up.join(tree.where("path <> ''").select(F.col("path").alias("m")), "m").groupBy("path").agg(F.max_by("m", F.length("m")).alias("m"))
    root = tree.agg(F.max((F.col("path") == "").cast("int")).alias("root"), F.max(((F.col("path") != "") & F.col("parent_id").isNull()).cast("int")).alias("other"))
    out = files.join(best, "path", "left").crossJoin(F.broadcast(root))
    return out.select("path", F.when(F.col("m").isNotNull(), F.concat(F.lit("module:"), "m")).when((F.col("root") == 1) & (F.col("other") == 0), "module:").alias("owner"))


def inventory_hash(symbols: DataFrame) -> DataFrame:
    """owner, hash of symbols(owner, file, name, kind): SHA-256 of the sorted lines."""
    listed = symbols.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("file", "name", "kind"))).alias("s"))
    return listed.select("owner", F.sha2(F.array_join(F.transform("s", lambda x: F.concat_ws("\t", x["file"], x["name"], x["kind"])), "\n"), 256).alias("hash"))


def description_state(has_content: Column, described: Column, old_hash: Column, new_hash: Column, regenerate: bool) -> Column:
    """What a run does to a module: generated, undescribed, regenerated, stale or current."""
    changed = ~old_hash.eqNullSafe(new_hash)
    return F.when(~described, F.when(has_content, "generated").otherwise("undescribed")).when(changed, "regenerated" if regenerate else "stale").otherwise("current")


def first_per(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
