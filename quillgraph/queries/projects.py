"""Build files, modules, symbols, evidence and summaries over files that the star schema stands for."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import evaluation as ev
from quillgraph.operators import modules as m
from quillgraph.operators import resolve as r
from quillgraph.operators import search as s
from quillgraph.operators import stats
from quillgraph.plans.derived import SQL, edges, table
from quillgraph.sources import extract as x
from quillgraph.sources import grammars

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.replace("with GRAPH ", f"with {SQL} ")
        return f

    return add


def _files(spark, d, content: str) -> DataFrame:
    """A file for each part, of the SQL expression ``content``."""
    return table(spark, d, "part").select(F.concat(F.lit("a"), "p_partkey").alias("artifact_id"), F.expr(content).alias("content"))


@query("select 'a' || p_partkey as artifact_id, 'dependency' as kind, 'lib' || p_size as name from part union all select 'a' || p_partkey, 'dependency', 'peer' from part where p_size <> 7 union all select 'a' || p_partkey, 'script', 'run' || (p_partkey % 7) from part")
def package_json(spark, d):
    peers = "if(p_size <> 7, ', \"peerDependencies\": {\"peer\": \"^1\"}', '')"
    return x.package_json(_files(spark, d, f"""concat('{{"dependencies": {{"lib', p_size, '": "1"}}, "scripts": {{"run', p_partkey % 7, '": "x"}}', {peers}, '}}')"""))


@query("select 'a' || p_partkey as artifact_id, 'dependency' as kind, 'g_lib' || p_size || '_1' as name from part union all select 'a' || p_partkey, 'project', 'core' || (p_partkey % 5) from part")
def gradle_build(spark, d):
    return x.gradle(_files(spark, d, """concat('dependencies {\\n implementation("g:lib', p_size, ':1")\\n api project(":core', p_partkey % 5, '")\\n}')"""))


@query("select distinct 'a' || p_partkey as artifact_id, unnest(['img' || p_size || ':1', 'img' || (p_size % 3) || ':1']) as image from part")
def dockerfile_images(spark, d):
    return x.dockerfile(_files(spark, d, "concat('FROM img', p_size, ':1 AS b\\nRUN FROM x\\nFROM img', p_size % 3, ':1\\n')"))


@query("select 'a' || p_partkey as artifact_id, unnest(['svc' || p_size, 'db']) as service from part")
def compose_services(spark, d):
    return x.compose_services(_files(spark, d, "concat('version: 3\\nservices:\\n  svc', p_size, ':\\n    image: x\\n    ports:\\n  db:\\n    image: y\\nvolumes:\\n  data:\\n')"))


@query("select 'a' || p_partkey as artifact_id, 'u' || p_size as destination, case when p_size > 9 then 'T' || p_partkey end as label from part union all select 'a' || p_partkey, 'v', 'S' from part")
def section_links(spark, d):
    return x.section_links(_files(spark, d, "concat(if(p_size > 9, concat('# T', p_partkey, '\\n'), ''), 'text [a](u', p_size, ') [b](#here)\\n## S\\n[b](v) and [c](v)')"))


@query("select 'a' || p_partkey as artifact_id, '[' || p_size || ']' as citation, 'Related Work ' || chr(cast(65 + p_partkey % 3 as int)) as label from part union all select 'a' || p_partkey, '[Doe et al., 2020]', null from part")
def section_citations(spark, d):
    return x.section_citations(_files(spark, d, "concat('as [Doe et al., 2020] says\\nRelated Work ', chr(65 + p_partkey % 3), '\\nand [', p_size, '] too, [', p_size, ']')"))


def _project(spark, d) -> DataFrame:
    """A project of three build systems: Gradle modules of regions and nations, npm packages of suppliers, Python ones of nations and customers."""
    names = table(spark, d, "nation").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("':r"), "n_regionkey", F.lit(":n"), "n_nationkey", F.lit("'")))), ", ").alias("n"))
    regions = table(spark, d, "region").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("':r"), "r_regionkey", F.lit("'")))), ", ").alias("r"))
    settings = names.crossJoin(regions).select(F.lit("settings.gradle").alias("path"), F.concat(F.lit("include("), "n", F.lit(")\n  include "), "r", F.lit("\n")).alias("content"))
    top = spark.createDataFrame([("package.json", '{"workspaces": {"packages": ["packages/*", "tools/one"]}}'), ("build/x/pyproject.toml", '[project]\nname = "no"')], "path string, content string")
    npm = table(spark, d, "supplier").select(F.concat(F.lit("packages/s"), "s_suppkey", F.lit("/package.json")).alias("path"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"name": "@x/'), "s_suppkey", F.lit('"}'))).otherwise("{}").alias("content"))
    nations = table(spark, d, "nation").select(F.concat(F.lit("py/n"), "n_nationkey", F.lit("/pyproject.toml")).alias("path"), F.concat(F.lit("[tool.poetry]\nversion = '1'\nname = 'n"), "n_nationkey", F.lit("'\n")).alias("content"))
    people = table(spark, d, "customer").select(F.concat(F.lit("py/n"), "c_nationkey", F.lit("/c"), "c_custkey", F.lit("/pyproject.toml")).alias("path"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('[project]\nname = "c'), "c_custkey", F.lit('"\n'))).otherwise("[build-system]\nname = 'x'\n").alias("content"))
    return settings.union(top).union(npm).union(nations).union(people)


_MODULES = """mods as (
  select 'r' || r_regionkey as path, 'r' || r_regionkey as name, 'gradle' as build_system, null as parent_id from region
  union all select 'r' || n_regionkey || '/n' || n_nationkey, 'n' || n_nationkey, 'gradle', 'module:r' || n_regionkey from nation
  union all select 'packages/s' || s_suppkey, case when s_suppkey % 2 = 0 then '@x/' || s_suppkey else 's' || s_suppkey end, 'npm', null from supplier
  union all select 'py/n' || n_nationkey, 'n' || n_nationkey, 'python', null from nation
  union all select 'py/n' || c_nationkey || '/c' || c_custkey, 'c' || c_custkey, 'python', 'module:py/n' || c_nationkey from customer where c_custkey % 3 = 0)"""


@query(f"with {_MODULES} select 'module:' || path as id, path, name, build_system, parent_id from mods")
def module_detect(spark, d):
    return m.detect(_project(spark, d))


@query(f"with {_MODULES} select 'module:' || path as id, path, case when path = 'py/n3' then 'three' else name end as name, case when path = 'py/n3' then 'config' else build_system end as build_system, parent_id from mods union all select 'module:ios', 'ios', 'ios', 'config', null")
def module_roots(spark, d):
    return m.detect(_project(spark, d), [{"path": "/ios/"}, {"path": "py/n3", "name": "three"}])


@query(f"with {_MODULES} select 'module:' || path as id, path, name, build_system, parent_id from mods")
def module_tree_read(spark, d):
    return m.read_tree(m.as_nodes(m.detect(_project(spark, d))))


@query(f"with {_MODULES} select path, name from mods where parent_id = 'module:py/n3'")
def module_children(spark, d):
    return m.children(m.detect(_project(spark, d)), "module:py/n3").select("path", "name")


_TOKENS = ["cold", "bolt", "promo"]
_SCORE = " + ".join(f"3 * cast(contains(lower(p_name), '{t}') as int) + 2 * cast(contains(lower(p_brand || '/' || p_type), '{t}') as int) + coalesce(cast(contains(lower(nullif(p_brand, 'x')), '{t}') as int), 0)" for t in _TOKENS)


@query(f"select id, score, method from (select 'module:' || p_partkey as id, cast({_SCORE} as double) as score, 'keyword' as method from part) where score > 0 order by score desc, id limit 5")
def match_modules(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("module:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type").alias("path"), F.col("p_brand").alias("description"))
    return s.match_modules(part, _TOKENS).select("id", "score", "method")


_SYMBOLS = r"""with x as (select 'src/' || replace(p_brand, '#', '') || '/F.java#m' || p_partkey as id, p_name as label, p_size / 50 as confidence, regexp_extract_all(lower(p_name), '[a-z0-9]+') as w0 from part),
y as (select *, case when len(w0) > 1 then list_concat(w0, w0) else w0 end as w from x),
tot as (select count(*) as n, avg(len(w)) as avgdl from y),
p as (select id, any_value(len(w)) as dl, term, count(*) as tf from (select id, w, unnest(w) as term from y) where term in (TERMS) group by id, term),
df as (select term, count(*) as df from p group by term),
sc as (select id, term, round((case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9) as score from p join df using (term), tot),
best as (select id from (select id, row_number() over (partition by term order by score desc, id) as n from sc) where n <= 25 group by id)
select id, round(confidence + HITS + case when id like 'src/Brand1%' then 2 else 0 end, 6) as score from y where id in (from best) order by score desc, id limit 40"""


@query(_SYMBOLS.replace("TERMS", "'small', 'bolt'").replace("HITS", "5 * cast(contains(lower(label), 'small') as int) + 5 * cast(contains(lower(label), 'bolt') as int)"))
def match_symbols(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("src/"), F.translate("p_brand", "#", ""), F.lit("/F.java#m"), "p_partkey").alias("id"), F.lit("Method").alias("type"), F.col("p_name").alias("label"), (F.col("p_size") / 50).alias("confidence"))
    paths = [p.path for p in table(spark, d, "part").where("p_brand like 'Brand#1%'").select(F.concat(F.lit("src/"), F.translate("p_brand", "#", "")).alias("path")).distinct().collect()]
    return s.match_symbols(part, ["small", "bolt"], paths).select("id", F.round("score", 6).alias("score"))


@query("select p_partkey, p_name || '|' || 'src/' || replace(p_brand, '#', '') || '/runAll.java' || '|' || 'runAll.java' || '|' || 'runAll' || '|' || 'MAX_' || p_size || '|' || cast(1000 + p_size as varchar) as tokens from part")
def ripgrep_tokens(spark, d):
    asked = F.expr("concat('where is `', p_name, '` read by src/', replace(p_brand, '#', ''), '/runAll.java, e.g. MAX_', p_size, ' or ', 1000 + p_size, ' of 7?')")
    # the brand is code-shaped only where it has a capital beyond its first letter, which it has not
    return table(spark, d, "part").select("p_partkey", F.array_join(stats.derive_tokens(asked), "|").alias("tokens"))


@query("select 'part:' || l_partkey as entity_id, 'order:' || l_orderkey as artifact_id, cast(l_linenumber as int) as line from lineitem join part on p_partkey = l_partkey where p_size > 40")
def evidence_join(spark, d):
    line = table(spark, d, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("entity_id"), F.concat(F.lit("order:"), "l_orderkey").alias("artifact_id"), F.col("l_linenumber").cast("int").alias("line"))
    return ev.evidence(table(spark, d, "part").where("p_size > 40").select(F.concat(F.lit("part:"), "p_partkey").alias("id")), line)


@query("select 'p' || min(p_partkey) as id, any_value(p_brand) as type, lower(p_type) as label, max(p_size) / 50 as confidence from (select p_brand, p_type, p_size, p_partkey + 1000000 as p_partkey from part) group by p_brand, lower(p_type)")
def entity_confidence(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey") + 1000000).alias("id"), F.col("p_brand").alias("type"), F.concat(F.lit(" "), F.when(F.col("p_size") > 20, F.upper("p_type")).otherwise(F.lower("p_type"))).alias("label"), (F.col("p_size") / 50).alias("confidence"))
    return r.merged_nodes(part).select("id", "type", F.lower(F.trim("label")).alias("label"), "confidence")


@query("select distinct 'p' || (select min(q.p_partkey) + 1000000 from part q where q.p_type = p.p_type) as entity_id, p_brand as artifact_id, cast(p_size as int) as line, p_name as text_span from part p")
def entity_provenance(spark, d):
    part = table(spark, d, "part")
    ident = F.concat(F.lit("p"), F.col("p_partkey") + 1000000)
    merged = r.merge_entities(part.select(ident.alias("id"), F.lit("T").alias("type"), F.col("p_type").alias("label")))
    return r.merged_provenance(part.select(ident.alias("entity_id"), F.col("p_brand").alias("artifact_id"), F.col("p_size").cast("int").alias("line"), F.col("p_name").alias("text_span")), merged).select("entity_id", "artifact_id", "line", "text_span")


@query("with GRAPH select type, round(avg(confidence), 8) as confidence from edges group by type union all select 'none', 0")
def average_confidence(spark, d):
    e = edges(spark, d)
    none = e.where("false").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence")).select(F.lit("none").alias("type"), "confidence")
    return e.groupBy("type").agg(F.round(F.avg("confidence"), 8).alias("confidence")).union(none)


_CATEGORY = "case p_partkey % 4 when 0 then 'NEGATIVE_CONTROL' when 1 then 'NEUTRAL' else 'GRAPH_HEAVY' end"


@query(f"""with s as (select p_brand as repo, {_CATEGORY} as category, ranker, p_size / 50 * f as p5, 1 / p_size as mrr from part, (values ('graph', 1.0), ('ripgrep', 0.5)) t(ranker, f) where ranker = 'ripgrep' or p_size > 5),
e as (select case when category = 'NEGATIVE_CONTROL' then 'negative' else 'headline' end as section, '' as name, * from s union all select 'category', category, * from s union all select 'repo', repo, * from s)
select section, name, ranker, count(*) as measured, round(avg(p5), 8) as p5, round(avg(mrr), 8) as mrr from e group by section, name, ranker""")
def retrieval_summary(spark, d):
    sides = F.explode(F.array(F.struct(F.lit("graph").alias("ranker"), F.lit(1.0).alias("f")), F.struct(F.lit("ripgrep").alias("ranker"), F.lit(0.5).alias("f")))).alias("t")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("repo"), F.expr(_CATEGORY).alias("category"), "p_size", sides)
    scores = rows.where("t.ranker = 'ripgrep' or p_size > 5").select("repo", "category", "t.ranker", (F.col("p_size") / 50 * F.col("t.f")).alias("p5"), (1 / F.col("p_size")).alias("mrr"))
    out = stats.retrieval_summary(scores, ["p5", "mrr"])
    return out.select("section", "name", "ranker", "measured", F.round("p5", 8).alias("p5"), F.round("mrr", 8).alias("mrr"))


def _grammar(extension: str, source: str, nodes: str, calls: str):
    """A query and its SQL: nodes and calls of a file for each part, with ``{k}`` for its key. ``nodes``: scope=type; ``calls``: scope>name."""

    def run(spark, d):
        made = "concat(" + ", ".join(repr(x) if i % 2 == 0 else "p_partkey" for i, x in enumerate(re.split(r"(\{k\})", source))) + ")"
        files = table(spark, d, "part").select(F.concat(F.lit("src/F"), "p_partkey", F.lit(f".{extension}")).alias("path"), F.expr(made).alias("content"))
        rows = grammars.extract(files).withColumn("said", F.when(F.col("tag") == "node", F.concat_ws("=", "id", "type")).when(F.col("tag") == "ref", F.concat_ws(">", "src", "label")))
        return rows.where("tag in ('node', 'ref')").select("said").distinct()

    names = ", ".join("'src/F{k}.%s" % extension + ("#" if not n.startswith("=") else "") + n + "'" for n in nodes.split() + calls.split())
    listed = re.sub(r"\{k\}", "' || p_partkey || '", names)
    return run, f"select distinct unnest([{listed}]) as said from part"


for _name, _parts in {
    "grammar_java": ("java", "package app;\nimport lib.Help;\npublic class P{k} extends Base implements Api {\n  private Help help;\n  enum Kind { A, B }\n  public int run{k}(String a, List<String> b) {\n    return help.go{k}(a);\n  }\n}\n", "=File import:lib.Help=Module P{k}=Class P{k}.help=Field P{k}.Kind=Enum P{k}.Kind.A=Field P{k}.Kind.B=Field P{k}.run{k}(String,List)=Method", "P{k}.run{k}(String,List)>go{k}"),
    "grammar_python": ("py", "from lib import help{k}\nimport os\nLIMIT = 3\nclass P{k}(Base):\n    def run(self):\n        return help{k}(self)\n\ndef main() -> int:\n    return P{k}().run()\n", "=File import:lib.help{k}=Module import:os=Module LIMIT=Constant P{k}=Class P{k}.run=Method main=Function", "P{k}.run>help{k} main>P{k} main>run"),
    "grammar_typescript": ("ts", "import { help } from './lib';\nexport interface Api{k} { go(): void }\nexport class P{k} implements Api{k} {\n  go(): void { help(); }\n}\nexport type T{k} = string;\nexport const run{k} = (a: number) => { return help(a); };\nfunction main{k}(x: string): number { return run{k}(1); }\n", "=File import:./lib=Module Api{k}=Interface Api{k}.go()=Method P{k}=Class P{k}.go()=Method T{k}=TypeAlias run{k}=Function main{k}(string)=Function", "P{k}.go()>help run{k}>help main{k}(string)>run{k}"),
    "grammar_kotlin": ("kt", "package app\nimport lib.help\ninterface Api{k}\nclass P{k}(val a: Int) : Api{k} {\n  val size = 3\n  fun run(b: String): Int { return help{k}(b) }\n}\nfun main() { start{k}() }\n", "=File import:lib.help=Module Api{k}=Interface P{k}=Class P{k}.a=Property P{k}.size=Property P{k}.run(String)=Method main()=Function", "P{k}.run(String)>help{k} main()>start{k}"),
    "grammar_swift": ("swift", "import Lib\nprotocol Api{k} {}\nclass P{k}: Api{k} {\n  var size = 3\n  func run(b: String) -> Int { return help{k}(b) }\n}\nenum E{k} { case one, two }\n", "=File import:Lib=Module Api{k}=Protocol P{k}=Class P{k}.size=Property P{k}.run(String)=Method E{k}=Enum E{k}.one=Field E{k}.two=Field", "P{k}.run(String)>help{k}"),
    "grammar_objc": ("m", "@interface P{k} : Base\n@property (nonatomic) int size;\n- (int)run:(int)a with:(int)b;\n@end\n@implementation P{k}\n- (int)run:(int)a with:(int)b { return [self help{k}:a]; }\n@end\n", "=File P{k}=Class P{k}.size=Property P{k}.run:with:=Method", "P{k}.run:with:>help{k}:"),
}.items():
    QUERIES[_name], ORACLES[_name] = _grammar(*_parts)
