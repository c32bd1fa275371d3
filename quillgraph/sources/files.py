"""Files as artifacts: discovery, types, secrets, checksums, increments."""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names and extensions that tell a file's type.
CODE = ["kt", "java", "py", "ts", "tsx", "js", "jsx", "go", "rs", "rb", "php", "cpp", "c", "h", "cs", "swift", "scala", "groovy"]
CONFIG_NAMES = ["dockerfile", ".dockerignore", ".gitignore", ".editorconfig", ".prettierrc", ".eslintrc"]
CONFIG_EXT = ["yml", "yaml", "toml", "ini", "cfg", "conf", "json", "xml", "properties"]
PACKAGE_NAMES = [
    "package.json", "pom.xml", "build.gradle", "build.gradle.kts", "cargo.toml", "requirements.txt", "go.mod", "go.sum", "pyproject.toml",
    "setup.py", "setup.cfg", "gemfile", "composer.json", "package-lock.json", "yarn.lock",
]
SQL_EXT, MARKDOWN_EXT, TEXT_EXT = ["sql", "ddl", "dml"], ["md", "mdx"], ["rst", "adoc", "txt"]
IMAGE_EXT, DIAGRAM_EXT = ["png", "jpg", "jpeg", "gif", "svg", "webp"], ["drawio", "excalidraw", "mermaid"]
SECRET_NAMES = [".env", ".env.local", ".env.production", ".env.staging"]
SECRET_EXT = ["key", "pem", "p12", "pfx", "cert", "crt"]
SECRET_NAME = r"secret|password|credentials|\.env(\..*)?$"

EXCLUDED = [".git/**", "node_modules/**", "build/**", "target/**", ".gradle/**"]
MAX_BYTES = 10 * 1024 * 1024

#: Folders that the driver lists itself before the executors walk what lies below.
LISTED = 64


@dataclass
class Config:
    """Settings of an index; unknown keys of a file are ignored."""

    exclude: list[str] = field(default_factory=lambda: list(EXCLUDED))
    max_file_bytes: int = MAX_BYTES
    use_gitignore: bool = True
    llm_enabled: bool = False
    debounce_ms: int = 500
    rescan_seconds: int = 30
    module_roots: list[dict] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Config:
        """The file's settings; the defaults where it is missing or does not parse."""
        try:
            with open(path) as file:
                given = json.load(file)
            return cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})
        except (OSError, ValueError, TypeError):
            return cls()


def name_of(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def extension_of(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")


def artifact_type(path: Column) -> Column:
    name = name_of(path)
    ext = extension_of(name)
    code = ext.isin(CODE)
    return (
        F.when(name.isin(PACKAGE_NAMES), "PackageFile")
        .when((name == "dockerfile") | name.startswith("dockerfile."), "ConfigFile")
        .when(name.isin(CONFIG_NAMES), "ConfigFile")
        .when(ext == "pdf", "PDF")
        .when(ext.isin(SQL_EXT), "DatabaseSchema")
        .when(ext.isin(MARKDOWN_EXT), "MarkdownFile")
        .when(ext.isin(TEXT_EXT), "Document")
        .when(ext.isin(IMAGE_EXT), "Image")
        .when(ext.isin(DIAGRAM_EXT), "Diagram")
        .when(code & (F.contains(name, F.lit("test")) | F.contains(name, F.lit("spec"))), "TestFile")
        .when(code, "CodeFile")
        .when(ext.isin(CONFIG_EXT), "ConfigFile")
        .otherwise("Document")
    )


def is_secret(path: Column) -> Column:
    """Credential files. Names of source code do not count, their extensions do."""
    name = name_of(path)
    ext = extension_of(name)
    return name.isin(SECRET_NAMES) | ext.isin(SECRET_EXT) | (~ext.isin(CODE) & name.rlike(SECRET_NAME))


def _excluded(relative: str, patterns: list[str]) -> bool:
    """Globs hold anywhere in the tree, those with a leading slash only as they stand."""
    for p in patterns:
        bare = p.rstrip("/").removesuffix("/**").removesuffix("/*")
        if p.startswith("/"):
            if fnmatch.fnmatchcase("/" + relative, bare):
                return True
        elif any(fnmatch.fnmatchcase(end, bare.removeprefix("**/")) for end in (relative, relative.rsplit("/", 1)[-1])):
            return True
    return False


def discover(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """path and size of the files to index below ``root``. Excluded directories are not entered; unreadable ones are skipped."""
    config = config or Config()
    patterns = list(config.exclude)
    if config.use_gitignore and os.path.isfile(f"{root}/.gitignore"):
        with open(f"{root}/.gitignore", errors="replace") as file:
            patterns += [line.strip() for line in file if line.strip() and not line.startswith("#")]
    base = os.path.abspath(root)
    # the driver lists some folders, the executors walk the others
    rows, queue = [], [""]
    for _ in range(LISTED):
        if not queue:
            break
        files, folders = _list(base, queue.pop(0), patterns, config.max_file_bytes)
        rows += files
        queue += folders
    found = spark.createDataFrame(rows, "path string, size long")
    if queue:

        def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for start in frame["folder"]:
                    left = [start]
                    while left:
                        files, folders = _list(base, left.pop(), patterns, config.max_file_bytes)
                        left += folders
                        if files:
                            yield pd.DataFrame(files, columns=["path", "size"])

        below = spark.createDataFrame([(q,) for q in queue], "folder string").repartition(min(len(queue), 4 * spark.sparkContext.defaultParallelism), "folder")
        found = found.union(below.mapInPandas(walk, "path string, size long"))
    return found.where(~is_secret(F.col("path")))


def _list(base: str, folder: str, patterns: list[str], most: int) -> tuple[list[tuple[str, int]], list[str]]:
    """Files (path, size) and folders directly in ``folder``, which is relative to ``base`` and ends with a slash unless empty."""
    files, folders = [], []
    try:
        entries = sorted(os.scandir(f"{base}/{folder}"), key=lambda e: e.name)
    except OSError:
        return files, folders
    for entry in entries:
        path = folder + entry.name
        try:
            if _excluded(path, patterns):
                continue
            if entry.is_dir(follow_symlinks=False):
                folders.append(path + "/")
            elif entry.is_file() and (size := entry.stat().st_size) <= most:
                files.append((path, size))
        except OSError:
            continue
    return files, folders


def read_files(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """Artifacts with their content: id, type, path, checksum, size, content.

    Spark's own file sources hide names that begin with ``.`` or ``_`` (``__init__.py``), so the tasks open the files
    themselves; on a cluster ``root`` lies on a file system that all machines mount. Files that cannot be read are left out.
    """
    base = os.path.abspath(root)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, size in zip(frame["path"], frame["size"], strict=True):
                try:
                    with open(f"{base}/{path}", "rb") as file:
                        yield pd.DataFrame({"path": [path], "size": [size], "raw": [file.read()]})
                except OSError:
                    continue

    chosen = discover(spark, root, config)
    raw = chosen.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(load, "path string, size long, raw binary")
    text = F.expr("try_validate_utf8(cast(raw as string))")
    return raw.select(F.col("path").alias("id"), artifact_type(F.col("path")).alias("type"), "path", F.sha2("raw", 256).alias("checksum"), "size", F.coalesce(text, F.expr("make_valid_utf8(cast(raw as string))")).alias("content"))


def read_text(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """path and content of the files that ``paths`` (path, below ``root``) names; those that cannot be read, or lie outside, are left out."""
    base = os.path.abspath(root)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                at = os.path.realpath(f"{base}/{path}")
                try:
                    if at.startswith(os.path.realpath(base) + os.sep):
                        with open(at, "rb") as file:
                            yield pd.DataFrame({"path": [path], "content": [file.read().decode("utf-8", "replace")]})
                except OSError:
                    continue

    return paths.select("path").distinct().mapInPandas(load, "path string, content string")


def changes(now: DataFrame, stored: DataFrame) -> DataFrame:
    """path and state of now(path, checksum) against stored(path, checksum): added, changed, same or removed."""
    both = now.select("path", F.col("checksum").alias("a")).join(stored.select("path", F.col("checksum").alias("b")), "path", "full")
    return both.select("path", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("state"))


def replace_artifacts(nodes: DataFrame, edges: DataFrame, provenance: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without what came from ``artifacts`` (column artifact_id). Calls edges stay: they are rebuilt as a whole."""
    gone = provenance.join(artifacts, "artifact_id", "left_semi").where("entity_kind = 'node'").select(F.col("entity_id").alias("id")).distinct()
    calls = edges.where("type = 'calls'")
    rest = edges.where("type <> 'calls'")
    for end in ("src", "dst"):
        rest = rest.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return nodes.join(gone, "id", "left_anti"), calls.unionByName(rest), provenance.join(artifacts, "artifact_id", "left_anti")


def parse_evidence(s: Column) -> Column:
    """struct(file, line) of ``file:line`` with a line above 0, else null."""
    line = F.regexp_extract(s, r"^(.+):(\d+)$", 2).try_cast("int")
    return F.when(line > 0, F.struct(F.regexp_extract(s, r"^(.+):(\d+)$", 1).alias("file"), line.alias("line")))
