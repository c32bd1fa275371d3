"""Call-site resolution: candidates by name, narrowed by receiver, placed on a ladder of rungs, capped, and gathered as edges.

The order counts: filter, narrow, rung, cap. A rung over the cap never falls through to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import basename_of, declaring_type, directory_of, file_of, scope_of
from quillgraph.operators.iterate import settle

CALLABLE = ["Method", "Function", "Class"]
TYPES = ["Class", "Interface", "Enum", "Record"]
CAP = 3
#: Rung names with their confidence when one candidate is left and when several are.
RUNGS = [("local_scope", 0.97, 0.75), ("file_imports", 0.93, 0.65), ("same_directory", 0.87, 0.55), ("repo_unique_name", 0.80, 0.45)]
SIBLING = IMPLEMENTS = 0.98
#: Rows of a table of counts that is broadcast; a larger one is met by shuffle.
FEW = 100_000
#: Candidates by rung: all, and those declared by the receiver's type.
COUNTS = [f"{kind}{k}" for k in range(len(RUNGS)) for kind in "ao"]


def candidates(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs(ref_id, name, referrer, path, line, receiver_type) with the ids of callable nodes of that label."""
    # what ids tell is worked out once for each node and reference, not for each pair
    ident = F.col("id")
    calls = nodes.where(F.col("type").isin(CALLABLE)).select(
        F.col("label").alias("name"),
        ident.alias("candidate"),
        declaring_type(ident).alias("_declared_by"),
        file_of(ident).alias("_file"),
        basename_of(file_of(ident)).alias("_base"),
        directory_of(file_of(ident)).alias("_dir"),
        scope_of(ident).alias("_theirs"),
    )
    told = refs.withColumn("_mine", scope_of(F.col("referrer"))).withColumn("_near", directory_of(F.col("path")))
    return told.join(calls, "name")


def narrow(cands: DataFrame) -> DataFrame:
    """Candidates declared by the receiver's type; all of them where none is, or where there is one only."""
    by = Window.partitionBy("ref_id")
    fits = F.coalesce(F.col("_declared_by") == F.col("receiver_type"), F.lit(False))
    marked = cands.withColumn("_fits", fits).withColumn("_any", F.max("_fits").over(by)).withColumn("_n", F.count("*").over(by))
    return marked.where("_fits or not _any or _n = 1").drop("_fits", "_any", "_n")


def with_rung(cands: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Adds ``rung`` (0 to 3). imports(path, token): words of what a file imports."""
    mine, theirs = F.col("_mine"), F.col("_theirs")
    inside = (F.size(theirs) > F.size(mine)) & (F.slice(theirs, F.lit(1), F.greatest(F.size(mine), F.lit(1))) == mine)
    up, their_up = (F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))) for s in (mine, theirs))
    local = (F.col("_file") == F.col("path")) & (F.size(mine) > 0) & (F.size(theirs) > 0) & (inside | ((F.size(up) > 0) & (up == their_up)))
    local = (F.col("candidate") == F.col("referrer")) | local
    out = cands
    if imports is not None:
        told = imports.select("path", F.col("token").alias("_base"), F.lit(True).alias("_imported")).where("_base <> ''").distinct()
        out = out.join(told, ["path", "_base"], "left")
    else:
        out = out.withColumn("_imported", F.lit(None).cast("boolean"))
    rung = F.when(local, 0).when(F.col("_imported"), 1).when(F.col("_dir") == F.col("_near"), 2).otherwise(3)
    return out.withColumn("rung", rung).drop("_base", "_imported", "_file", "_dir", "_near", "_mine", "_theirs", "_declared_by")


def _callables(nodes: DataFrame) -> DataFrame:
    """Callable nodes with the keys by which they are counted."""
    ident = F.col("id")
    return nodes.where(F.col("type").isin(CALLABLE) & F.col("label").isNotNull()).select(
        F.col("label").alias("name"), ident.alias("candidate"), declaring_type(ident).alias("_by"), file_of(ident).alias("_file"),
        basename_of(file_of(ident)).alias("_base"), directory_of(file_of(ident)).alias("_dir"), scope_of(ident).alias("_theirs"),
    )


def _counted(calls: DataFrame, name: str, *keys: str) -> DataFrame:
    """Rows of ``calls`` by keys, to be joined: in a broadcast where they are few, so that references, which are many, are not dealt out for it."""
    counts = calls.where(F.col("_by").isNotNull()) if "_by" in keys else calls
    counts = settle(counts.groupBy(*keys).agg(F.count("*").alias(name)))
    return F.broadcast(counts) if counts.count() <= FEW else counts


def candidate_counts(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, n: the rows of ``candidates`` by name, as the product of both sides' counts."""
    theirs = _callables(nodes).groupBy("name").agg(F.count("*").alias("_theirs"))
    return refs.groupBy("name").agg(F.count("*").alias("n")).join(theirs, "name").select("name", (F.col("n") * F.col("_theirs")).alias("n"))


def narrow_counts(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref_id, n: the rows of ``narrow(candidates(...))`` by reference, from counts by name and declaring type."""
    calls = _callables(nodes)
    told = refs.select("ref_id", "name", F.col("receiver_type").alias("_by")).join(_counted(calls, "_all", "name"), "name").join(_counted(calls, "_own", "name", "_by"), ["name", "_by"], "left")
    each = told.groupBy("ref_id").agg(F.sum("_all").alias("_all"), F.sum("_own").alias("_own"))
    return each.select("ref_id", F.coalesce("_own", "_all").alias("n"))


def lowest_rungs(refs: DataFrame, nodes: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """ref_id, rung, n: the lowest rung of each reference in ``with_rung(narrow(candidates(...)), imports)``, and the rows that it has there.

    Candidates are counted by name, directory and imported file, each by declaring type too; only those of the
    reference's own file and the referrer itself are listed. Counts of a rung include lower rungs, which are empty where it is the lowest.
    """
    calls = settle(_callables(nodes))
    keep = ["ref_id", "name", "_by"]
    told = refs.select("ref_id", "name", F.col("receiver_type").alias("_by"), "referrer", "path")
    wide = told.select(*keep, directory_of(F.col("path")).alias("_dir")).join(_counted(calls, "a3", "name"), "name").join(_counted(calls, "o3", "name", "_by"), ["name", "_by"], "left")
    wide = wide.join(_counted(calls, "a2", "name", "_dir"), ["name", "_dir"], "left").join(_counted(calls, "o2", "name", "_dir", "_by"), ["name", "_dir", "_by"], "left")
    # files that declare or import something are met once: by path, and by the referrer's file where that is another
    files = calls.select(F.col("_file").alias("path"), F.lit(None).cast("string").alias("_base")).distinct()
    if imports is not None:
        files = files.unionByName(imports.select("path", F.col("token").alias("_base")).where("_base <> ''").distinct())
    source = file_of(F.col("referrer"))
    at = F.when(source.eqNullSafe(F.col("path")), F.array("path")).otherwise(F.array(F.col("path"), source))
    met = settle(told.withColumn("_at", F.explode(at)).join(files.withColumnRenamed("path", "_at"), "_at"))
    via = met.where("_base is not null and _at = path").join(_counted(calls, "a1", "name", "_base"), ["name", "_base"]).join(_counted(calls, "o1", "name", "_base", "_by"), ["name", "_base", "_by"], "left")
    # the same file, and the referrer where that is elsewhere
    mine, theirs = F.col("_mine"), F.col("_theirs")
    inside = (F.size(theirs) > F.size(mine)) & (F.slice(theirs, F.lit(1), F.greatest(F.size(mine), F.lit(1))) == mine)
    up, their_up = (F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))) for c in (mine, theirs))
    local = (F.size(mine) > 0) & (F.size(theirs) > 0) & (inside | ((F.size(up) > 0) & (up == their_up)))
    itself = F.coalesce(F.col("candidate") == F.col("referrer"), F.lit(False))
    named = calls.select("name", "candidate", F.col("_by").alias("_theirs_by"), F.col("_file").alias("_at"), "_theirs")
    there = met.where("_base is null").withColumn("_mine", scope_of(F.col("referrer"))).join(named, ["name", "_at"]).where(itself | (local & (F.col("_at") == F.col("path"))))
    fits = F.when(F.col("_theirs_by") == F.col("_by"), F.lit(1).cast("long"))
    listed = there.select("ref_id", F.lit(1).cast("long").alias("a0"), fits.alias("o0"))
    every = listed
    for part in (via, wide):
        every = every.unionByName(part.select("ref_id", *[c for c in part.columns if c in COUNTS]), allowMissingColumns=True)
    sums = every.groupBy("ref_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    rung = lambda kind: F.coalesce(*[F.when(F.col(f"{kind}{k}") > 0, F.struct(F.lit(k).alias("rung"), F.col(f"{kind}{k}").alias("n"))) for k in range(len(RUNGS))])
    return sums.select("ref_id", F.when(F.col("o3") > 0, rung("o")).otherwise(rung("a")).alias("l")).select("ref_id", "l.rung", "l.n")


def choose(cands: DataFrame, cap: int = CAP) -> DataFrame:
    """Candidates of each reference's lowest rung, with ``confidence``; none where these are more than ``cap``."""
    low = cands.withColumn("_low", F.min("rung").over(Window.partitionBy("ref_id"))).where("rung = _low").drop("_low")
    n = low.withColumn("n", F.count("*").over(Window.partitionBy("ref_id"))).where(F.col("n") <= cap)
    conf = F.lit(None).cast("double")
    name = F.lit(None).cast("string")
    for k, (rung, one, many) in enumerate(RUNGS):
        conf = F.when(F.col("rung") == k, F.when(F.col("n") == 1, one).otherwise(many)).otherwise(conf)
        name = F.when(F.col("rung") == k, rung).otherwise(name)
    return n.withColumn("confidence", conf).withColumn("rung_name", name)


def calls_edges(chosen: DataFrame) -> DataFrame:
    """id, src, dst, rung, confidence, lines: an edge for each pair; the first reference (by ref_id) names the rung."""
    first = F.struct("ref_id", "rung_name", "confidence")
    grouped = chosen.groupBy(F.col("referrer").alias("src"), F.col("candidate").alias("dst")).agg(F.min(first).alias("f"), F.sort_array(F.collect_set("line")).alias("lines"))
    return grouped.select(F.concat_ws(":", F.lit("calls"), "src", "dst").alias("id"), "src", "dst", F.col("f.rung_name").alias("rung"), F.col("f.confidence").alias("confidence"), "lines")


def resolve(refs: DataFrame, nodes: DataFrame, imports: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """Calls edges, as ``calls_edges(choose(with_rung(narrow(candidates(...)))))``, without listing all candidates of a name.

    Candidates are listed rung by rung, and on the two wide rungs only where a table of counts says that they are within
    the cap; a name with a million declarations is counted once, not joined to each of its references. ``path`` is the
    file of ``referrer``.
    """
    ident = F.col("id")
    calls = nodes.where(F.col("type").isin(CALLABLE)).select(
        F.col("label").alias("name"), ident.alias("candidate"), declaring_type(ident).alias("_by"), file_of(ident).alias("_file"),
        basename_of(file_of(ident)).alias("_base"), directory_of(file_of(ident)).alias("_dir"), scope_of(ident).alias("_theirs"),
    )
    calls = settle(calls)

    def counted(*keys: str) -> tuple[DataFrame, DataFrame]:
        """Candidates by keys, and by keys and declaring type."""
        return calls.groupBy(*keys).agg(F.count("*").alias("_all")), calls.where("_by is not null").groupBy(*keys, "_by").agg(F.count("*").alias("_own"))

    by_name, by_type = counted("name")
    told = refs.withColumn("_mine", scope_of(F.col("referrer"))).withColumn("_dir", directory_of(F.col("path"))).withColumn("_by", F.col("receiver_type"))
    told = told.join(by_name, "name").join(by_type, ["name", "_by"], "left").withColumn("_some", F.coalesce("_own", "_all")).withColumn("_narrow", F.col("_own").isNotNull()).drop("_all", "_own")
    told = settle(told)
    fits = ~F.col("_narrow") | F.coalesce(F.col("theirs_by") == F.col("_by"), F.lit(False))
    named = calls.withColumnRenamed("_by", "theirs_by").withColumnRenamed("_dir", "_their_dir")
    keep = ["ref_id", "referrer", "line", "candidate"]

    # rung 0: the same file
    mine, theirs = F.col("_mine"), F.col("_theirs")
    inside = (F.size(theirs) > F.size(mine)) & (F.slice(theirs, F.lit(1), F.greatest(F.size(mine), F.lit(1))) == mine)
    up, their_up = (F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))) for c in (mine, theirs))
    local = (F.col("candidate") == F.col("referrer")) | ((F.size(mine) > 0) & (F.size(theirs) > 0) & (inside | ((F.size(up) > 0) & (up == their_up))))
    found = [settle(told.join(named.withColumnRenamed("_file", "path"), ["name", "path"]).where(fits & local).select(*keep))]
    left = told.join(found[0].select("ref_id"), "ref_id", "left_anti")
    # rung 1: files that the referrer's file imports
    if imports is not None:
        tokens = imports.select("path", F.col("token").alias("_base")).where("_base <> ''").distinct()
        # counted first: a common file name with a common declaration is not listed for each reference
        base_all, base_own = counted("name", "_base")
        via = left.join(tokens, "path").join(base_all, ["name", "_base"]).join(base_own, ["name", "_base", "_by"], "left")
        via = via.groupBy("ref_id").agg(F.sum(F.when(F.col("_narrow"), F.coalesce("_own", F.lit(0))).otherwise(F.col("_all"))).alias("_via")).where("_via > 0")
        via = settle(via)
        few = left.join(via.where(F.col("_via") <= cap).select("ref_id"), "ref_id", "left_semi")
        found.append(few.join(tokens, "path").join(named, ["name", "_base"]).where(fits).select(*keep))
        left = left.join(via.select("ref_id"), "ref_id", "left_anti")
    else:
        found.append(None)
    # rung 2: the same directory; rung 3: anywhere
    dir_all, dir_own = counted("name", "_dir")
    left = settle(left.join(dir_all, ["name", "_dir"], "left").join(dir_own, ["name", "_dir", "_by"], "left").withColumn("_near", F.coalesce(F.when(F.col("_narrow"), F.col("_own")).otherwise(F.col("_all")), F.lit(0))))
    near = named.withColumnRenamed("_their_dir", "_dir")
    found.append(left.where(F.col("_near").between(1, cap)).join(near, ["name", "_dir"]).where(fits).select(*keep))
    few_names = by_name.where(F.col("_all") <= cap).select("name")
    wide = left.where((F.col("_near") == 0) & (F.col("_some") <= cap))
    any_type = wide.where("not _narrow").join(named.join(few_names, "name", "left_semi"), "name").select(*keep)
    own_type = wide.where("_narrow").join(named.select("name", F.col("theirs_by").alias("_by"), "candidate"), ["name", "_by"]).select(*keep)
    found.append(any_type.union(own_type))
    rungs = [f.withColumn("rung", F.lit(k)) for k, f in enumerate(found) if f is not None]
    every = rungs[0]
    for f in rungs[1:]:
        every = every.union(f)
    return calls_edges(choose(every, cap))


def implements_edges(nodes: DataFrame) -> DataFrame:
    """src, dst of nodes(id, type, label, supertypes) whose supertypes name a type."""
    names = nodes.where(F.col("type").isin(TYPES)).select(F.col("label").alias("super"), F.col("id").alias("dst"))
    return nodes.select(F.col("id").alias("src"), F.explode("supertypes").alias("super")).join(names, "super").where("src <> dst").select("src", "dst").distinct()


def common_return(cands: DataFrame, closure: DataFrame) -> DataFrame:
    """ref_id, common of cands(ref_id, candidate, returns): the type that all candidates' returns are subtypes of.

    Null unless every candidate returns something; the first such type by candidate. closure(sub, super) holds reflexively.
    """
    every = cands.groupBy("ref_id").agg((F.count("returns") == F.count("*")).alias("all"), F.count_distinct("returns").alias("kinds"))
    kinds = cands.where("returns is not null").groupBy("ref_id", "returns").agg(F.min("candidate").alias("first"))
    pairs = kinds.join(kinds.select("ref_id", F.col("returns").alias("sub")), "ref_id").join(closure.select("sub", F.col("super").alias("returns")), ["sub", "returns"], "left_semi")
    reflexive = kinds.select("ref_id", "returns", "first", F.col("returns").alias("sub"))
    covered = pairs.select("ref_id", "returns", "first", "sub").union(reflexive).distinct().groupBy("ref_id", "returns", "first").agg(F.count("*").alias("covers"))
    best = covered.join(every, "ref_id").where("covers = kinds").groupBy("ref_id").agg(F.min_by("returns", "first").alias("r"))
    return every.join(best, "ref_id", "left").select("ref_id", F.when(F.col("all"), F.col("r")).alias("common"))


def siblings(nodes: DataFrame) -> DataFrame:
    """src, dst: the smallest id of each name fqn with several nodes, and the others."""
    some = nodes.where("fqn is not null and trim(fqn) <> ''")
    first = some.groupBy("fqn").agg(F.min("id").alias("src"), F.count("*").alias("n")).where("n > 1")
    return some.join(first, "fqn").where("id <> src").select("src", F.col("id").alias("dst"))


def _entity(label: str = "label") -> Column:
    return F.concat(F.col("type"), F.lit(":"), F.lower(F.trim(label)))


def merge_entities(nodes: DataFrame) -> DataFrame:
    """canonical, id: nodes of one type and label (lower-case, trimmed) are one; the first by id stands for them."""
    keyed = nodes.select("id", _entity().alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("id").alias("canonical")), "key").select("canonical", "id")


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """id, type, label, confidence of the entities: the first node by id, with the largest confidence of all that are one with it."""
    best = nodes.groupBy(_entity().alias("key")).agg(F.min_by(F.struct("id", "type", "label"), "id").alias("n"), F.max("confidence").alias("confidence"))
    return best.select("n.id", "n.type", "n.label", "confidence")


def merged_provenance(provenance: DataFrame, merged: DataFrame) -> DataFrame:
    """``provenance`` (entity_id, artifact_id, line, text_span) under canonical ids; one row an artifact, line and span of each."""
    named = provenance.join(merged.withColumnRenamed("id", "entity_id"), "entity_id").drop("entity_id").withColumnRenamed("canonical", "entity_id")
    keys = ["entity_id", "artifact_id", "line", "text_span"]
    others = [F.min(c).alias(c) for c in named.columns if c not in keys]
    return named.groupBy(*keys).agg(*others) if others else named.select(keys).distinct()


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities, and the edges between them, of all parts' nodes and edges."""
    return merged_nodes(nodes), remap_edges(edges, merge_entities(nodes))


def remap_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """src, dst, type between canonical nodes, each once; no self-links, no unknown ends."""
    out = edges.join(merged.select(F.col("id").alias("src"), F.col("canonical").alias("s")), "src").join(merged.select(F.col("id").alias("dst"), F.col("canonical").alias("t")), "dst")
    return out.where("s <> t").select(F.col("s").alias("src"), F.col("t").alias("dst"), "type").distinct()


def rung_distribution(calls: DataFrame, files: DataFrame) -> DataFrame:
    """language, rung, n of calls(src, rung) with files(path, language)."""
    named = calls.withColumn("path", file_of(F.col("src"))).join(files, "path", "left")
    return named.groupBy(F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("rung", F.lit("unrecorded")).alias("rung")).agg(F.count("*").alias("n"))
