"""Artifact types, secrets, increments and text extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.plans.derived import table
from quillgraph.sources import extract as x
from quillgraph.sources import files as f

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Names that the part keys turn into paths.
NAMES = ["README.md", "Dockerfile", "schema.sql", "UserTest.kt", "user_service.py", "app.yml", "pom.xml", ".env", "secrets.yml", "PasswordPolicy.java", "server.pem", "notes.txt", "paper.pdf", "logo.png", "flow.drawio", ".env.prod", "LICENSE", "db-credentials.json", "spec_helper.rb", "package.json"]


_PATHS = "paths as (select p_partkey as k, p_type || '/' || list_value(" + ", ".join(f"'{n}'" for n in NAMES) + f")[1 + p_partkey % {len(NAMES)}] as path from part), named as (select *, lower(split_part(path, '/', -1)) as n from paths), ext as (select *, case when contains(n, '.') then split_part(n, '.', -1) else '' end as e from named)"

_DOCS = """docs as (select p_partkey as artifact_id, concat_ws(chr(10), '# ' || p_brand, '## Decision: use ' || p_type, 'plain ' || p_name, '### ' || p_name, '**' || p_name || '** and **one**', '- [' || case when p_size % 2 = 0 then 'x' else ' ' end || '] size MUST be ' || p_size, 'It SHOULD weigh ' || p_size, 'see [doc](' || p_type || '/d.md) and [here](#top)', '## Part ' || p_size, '#### deep', 'CREATE TABLE IF NOT EXISTS t_' || p_size || ' (id int, name varchar(10));', 'cited in [' || p_size || '] and [Smith et al., 2020]') as content from part)"""


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql.replace("PATHS", _PATHS).replace("DOCS", _DOCS)
        return fn

    return add


def _paths(spark, d):
    names = F.array(*[F.lit(n) for n in NAMES])
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat("p_type", F.lit("/"), F.get(names, (F.col("p_partkey") % len(NAMES)).cast("int"))).alias("path"))


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"with PATHS select k, case when n in {_in(f.PACKAGE_NAMES)} then 'PackageFile' when n = 'dockerfile' or starts_with(n, 'dockerfile.') or n in {_in(f.CONFIG_NAMES)} then 'ConfigFile' when e = 'pdf' then 'PDF' when e in ('sql', 'ddl', 'dml') then 'DatabaseSchema' when e in ('md', 'mdx') then 'MarkdownFile' when e in ('rst', 'adoc', 'txt') then 'Document' when e in ('png', 'jpg', 'jpeg', 'gif', 'svg', 'webp') then 'Image' when e in ('drawio', 'excalidraw', 'mermaid') then 'Diagram' when e in {_in(f.CODE)} then case when contains(n, 'test') or contains(n, 'spec') then 'TestFile' else 'CodeFile' end when e in {_in(f.CONFIG_EXT)} then 'ConfigFile' else 'Document' end as type from ext")
def artifact_type_detect(spark, d):
    return _paths(spark, d).select("k", f.artifact_type(F.col("path")).alias("type"))


@query(rf"with PATHS select k, path from ext where n in {_in(f.SECRET_NAMES)} or e in {_in(f.SECRET_EXT)} or (e not in {_in(f.CODE)} and regexp_matches(n, 'secret|password|credentials|\.env(\..*)?$'))")
def secret_filter(spark, d):
    return _paths(spark, d).where(f.is_secret(F.col("path")))


@query("with PATHS select k, path as file, cast(k % 90 as int) as line from paths where k % 90 > 0")
def evidence_parse(spark, d):
    e = _paths(spark, d).select("k", f.parse_evidence(F.concat("path", F.lit(":"), F.col("k") % 90)).alias("e"))
    return e.where("e is not null").select("k", "e.file", "e.line")


def _snapshots(spark, d):
    docs = table(spark, d, "documents")
    now = docs.where("doc_id % 11 <> 0").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("checksum"))
    old = docs.where("doc_id % 13 <> 0").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("checksum"))
    return now, old


@query("select source || '/' || lang || '/' || doc_id as path, case when doc_id % 13 = 0 then 'added' when doc_id % 11 = 0 then 'removed' when doc_id % 7 = 0 then 'changed' else 'same' end as state from documents where not (doc_id % 11 = 0 and doc_id % 13 = 0)")
def incremental_changed(spark, d):
    return f.changes(*_snapshots(spark, d))


@query("select count(*) as skipped from documents where doc_id % 11 <> 0 and doc_id % 13 <> 0 and doc_id % 7 <> 0")
def incremental_skip(spark, d):
    return f.changes(*_snapshots(spark, d)).where("state = 'same'").agg(F.count("*").alias("skipped"))


@query("""select 'nodes' as what, count(*) as n from part where p_brand <> 'Brand#1'
union all select 'edges', (select count(*) from part where p_size % 2 = 0) + (select count(*) from part where p_size % 2 = 1 and p_brand <> 'Brand#1')
union all select 'provenance', count(*) from part where p_brand <> 'Brand#1'""")
def artifact_replace(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), "p_brand", "p_size")
    edges = part.select(F.concat(F.lit("e"), "id").alias("id"), F.col("id").alias("src"), F.lit("root").alias("dst"), F.when(F.col("p_size") % 2 == 0, "calls").otherwise("contains").alias("type"))
    prov = part.select(F.col("p_brand").alias("artifact_id"), F.col("id").alias("entity_id"), F.lit("node").alias("entity_kind"))
    gone = spark.createDataFrame([("Brand#1",)], "artifact_id string")
    n, e, p = f.replace_artifacts(part.select("id"), edges, prov, gone)
    count = [t.agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), "n") for w, t in (("nodes", n), ("edges", e), ("provenance", p))]
    return count[0].union(count[1]).union(count[2])


def _docs(spark, d):
    body = F.expr("""concat_ws('\n', concat('# ', p_brand), concat('## Decision: use ', p_type), concat('plain ', p_name), concat('### ', p_name), concat('**', p_name, '** and **one**'),
        concat('- [', case when p_size % 2 = 0 then 'x' else ' ' end, '] size MUST be ', p_size), concat('It SHOULD weigh ', p_size), concat('see [doc](', p_type, '/d.md) and [here](#top)'), concat('## Part ', p_size), '#### deep',
        concat('CREATE TABLE IF NOT EXISTS t_', p_size, ' (id int, name varchar(10));'), concat('cited in [', p_size, '] and [Smith et al., 2020]'))""")
    return table(spark, d, "part").select(F.col("p_partkey").alias("artifact_id"), body.alias("content"))


@query(r"""with DOCS, l as (select artifact_id, unnest(string_split(content, chr(10))) as line, unnest(range(len(string_split(content, chr(10))))) as idx from docs),
h as (select artifact_id, cast(idx as int) as idx, length(regexp_extract(line, '^(#{1,6})\s+(.*)$', 1)) as level, trim(regexp_extract(line, '^(#{1,6})\s+(.*)$', 2)) as label from l where regexp_matches(line, '^#{1,6}\s+'))
select a.artifact_id, a.idx, cast(a.level as int) as level, a.label, (select arg_max(b.label, b.idx) from h b where b.artifact_id = a.artifact_id and b.idx < a.idx and b.level < a.level) as parent from h a""")
def markdown_headings(spark, d):
    return x.headings(_docs(spark, d))


@query(r"with DOCS, b as (select artifact_id, unnest(regexp_extract_all(content, '\*\*([^*\n]+)\*\*', 1)) as label from docs) select distinct artifact_id, label from b where length(label) > 3 and len(string_split(trim(label), ' ')) >= 2")
def bold_concepts(spark, d):
    return x.bold_concepts(_docs(spark, d))


@query(r"with DOCS, b as (select artifact_id, unnest(regexp_extract_all(content, '\[[^\]]*\]\(([^)]+)\)', 1)) as destination from docs) select distinct artifact_id, destination from b where not starts_with(destination, '#')")
def markdown_links(spark, d):
    return x.links(_docs(spark, d))


@query(r"""with DOCS, l as (select artifact_id, unnest(string_split(content, chr(10))) as line, unnest(range(len(string_split(content, chr(10))))) as idx from docs)
select artifact_id, cast(idx as int) as idx, case when regexp_matches(line, '^###? Decision:') then 'Decision' else 'Requirement' end as type, case when regexp_matches(line, '^###? Decision:') then trim(regexp_replace(line, '^[^:]*:', '')) else regexp_replace(line, '^-\s+\[[ x]\]\s+', '') end as label from l where regexp_matches(line, '^###? Decision:|^-\s+\[[ x]\]\s+.+|\b(MUST|SHALL|REQUIRED|SHOULD|RECOMMENDED)\b')""")
def requirement_lines(spark, d):
    return x.special_lines(_docs(spark, d))


@query(r"""with DOCS select artifact_id, 't_' || p_size as "table" from docs join part on p_partkey = artifact_id""")
def sql_ddl_tables(spark, d):
    return x.sql_tables(_docs(spark, d))


@query(r"""with DOCS select artifact_id, 't_' || p_size as "table", c.column, c.kind from docs join part on p_partkey = artifact_id, (values ('id', 'int'), ('name', 'varchar')) c("column", kind)""")
def sql_ddl_columns(spark, d):
    return x.sql_columns(_docs(spark, d))


@query("with DOCS select artifact_id, '[' || p_size || ']' as citation from docs join part on p_partkey = artifact_id union all select artifact_id, '[Smith et al., 2020]' from docs")
def citation_extract(spark, d):
    return x.citations(_docs(spark, d))


@query(r"""with l as (select doc_id as artifact_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as idx from documents),
t as (select artifact_id, cast(idx as int) as idx, trim(line, ' ') as label from l), w as (select *, regexp_split_to_array(label, '\s+') as w from t)
select artifact_id, idx, label from w where length(label) between 5 and 100 and len(w) <= 10 and len([y for y in w if regexp_matches(y, '^\p{Lu}')]) > 0.6 * len(w) and not regexp_matches(label, '[.,]$')""")
def heading_heuristic(spark, d):
    docs = table(spark, d, "documents")
    return x.page_sections(docs.select(F.col("doc_id").alias("artifact_id"), F.col("text").alias("content")))


@query("select p_partkey, greatest(0.65, least(0.85, p_size / 50.0))::double as confidence from part")
def llm_clamp(spark, d):
    return table(spark, d, "part").select("p_partkey", x.clamp(F.col("p_size") / 50, 0.65, 0.85).alias("confidence"))
