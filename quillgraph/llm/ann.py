"""Approximate nearest neighbours with a hierarchical k-means tree, best bin first.

The tree's upper part is fitted on the driver on a bounded sample of ``sample`` vectors (the smallest by their ids' hash), has
at most ``max_leaves`` leaves and is broadcast. An upper leaf of more than ``2 * LEAF`` rows gets a lower tree of its own,
fitted in the executors on ``sample`` of its vectors at most, so that leaves have about ``LEAF`` vectors up to
some 2 ** 30 vectors; beyond, leaves grow with the rows. Lower trees lie in a table by upper leaf and meet rows and queries in joins.

Every vector descends to a leaf. A query keeps a priority queue of branches by the distance to their centres: in the
upper tree, which gives the upper leaves to look into, then in each of their trees; of the leaves that these queues give, the
nearest are visited. How many upper leaves and leaves is calibrated: the true neighbours of ``trials`` vectors that no tree was fitted
on (where there are such) among all rows, found by brute force in one linear pass, tell which turn their leaves have, and the
numbers widen until the share ``recall`` of them is found.

Equal vectors are searched once, and of equal vectors only the k + 1 smallest ids can be among k neighbours, so no leaf
is large because of copies. Leaves of many different vectors are dealt into blocks of ``block`` rows.

Defined results
  vectors that are null, empty, zero, or hold null or non-finite components take no part. Vectors of several lengths:
  each is compared with those of its own length only, the lengths in turn.
  ties: smaller ids first. Fewer than k candidates: all. Repeated rows of one id and vector count once.
  empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, regroup, small_batches

BRANCH, LEAF, MAX_LEAVES = 8, 64, 4096
SAMPLE, TRIALS, RECALL = 16_384, 200, 0.97
BLOCK = 4096
HOLD = 200_000
#: Rows of an upper leaf that one task gives their leaves.
DEAL = 65_536
#: Rows of bounded size that are worked on at once.
BATCH = 2048


class Tree:
    """Nodes as arrays: ``kids[node]`` is (first, last) of its children, a leaf has none; ``leaf[node]`` numbers the leaves."""

    def __init__(self, x: np.ndarray, leaves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        centres, kids, leaf = [x.mean(0)], [None], [-1]
        work = [(0, np.arange(len(x)), leaves)]
        count = 0
        while work:
            node, at, want = work.pop()
            part = self._split(x[at], min(BRANCH, want), rng) if want > 1 and len(at) > BRANCH else None
            if part is None or part.max() == 0:
                leaf[node] = count
                count += 1
                continue
            kids[node] = (len(centres), len(centres) + int(part.max()) + 1)
            for k in range(int(part.max()) + 1):
                own = at[part == k]
                work.append((len(centres), own, max(1, round(want * len(own) / len(at)))))
                centres.append(x[own].mean(0))
                kids.append(None)
                leaf.append(-1)
        self.centres, self.kids, self.leaf, self.leaves = np.array(centres), kids, np.array(leaf), count

    @staticmethod
    def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        """Lloyd's k-means; part numbers without gaps."""
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(10):
            own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        return np.unique(((c * c).sum(1) - 2 * x @ c.T).argmin(1), return_inverse=True)[1]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), np.int64)
        work = [0] if self.kids[0] else []
        while work:
            n = work.pop()
            at = np.flatnonzero(node == n)
            if not len(at):
                continue
            a, b = self.kids[n]
            c = self.centres[a:b]
            node[at] = a + ((c * c).sum(1) - 2 * x[at] @ c.T).argmin(1)
            work += [j for j in range(a, b) if self.kids[j]]
        return self.leaf[node]

    def visits(self, q: np.ndarray) -> Iterator[tuple[int, float]]:
        """Leaves, best bin first, with the squared distances of their centres."""
        queue = [(0.0, 0)]
        while queue:
            far, n = heapq.heappop(queue)
            if self.kids[n]:
                a, b = self.kids[n]
                for d, j in zip(((self.centres[a:b] - q) ** 2).sum(1).tolist(), range(a, b), strict=True):
                    heapq.heappush(queue, (d, j))
            else:
                yield int(self.leaf[n]), far


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """[q, x] Euclidean distances by differences, in double precision."""
    out = np.empty((len(q), len(x)))
    for i in range(0, len(q), 8):
        out[i : i + 8] = np.sqrt(((q[i : i + 8, None] - x[None]) ** 2).sum(2))
    return out


def _best(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest by distance, then id."""
    if len(d) > k:
        at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        at = np.arange(len(d))
    return at[np.lexsort((ids[at], d[at]))[:k]]


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, recall: float = RECALL, sample: int = SAMPLE, trials: int = TRIALS, max_leaves: int = MAX_LEAVES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for each row for which ``is_query`` holds, without itself."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(usable(F.col("v")))
    # zero has one sign, so that equal vectors are equal keys
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    out = None
    for r in rows.groupBy(F.size("v").alias("size")).agg(F.bool_or("q").alias("asked")).orderBy("size").collect():
        if r.asked:
            part = _search(rows.where(F.size("v") == r["size"]), k, recall, sample, trials, max_leaves, block)
            out = part if out is None else out.union(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search(rows: DataFrame, k: int, recall: float, sample: int, trials: int, max_leaves: int, block: int) -> DataFrame:
    distinct = cut(rows.select("id", "v").distinct().withColumn("n", F.row_number().over(_by("v", "id"))).where(F.col("n") <= k + 1).drop("n"))
    queries = cut(rows.where("q").groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
    # trial vectors are the last by hash; no tree is fitted on them unless they are a good part of all
    total = distinct.count()
    trial = _by_hash(distinct, total, trials, last=True)
    points, names = _matrix(trial["v"].combine_chunks()), trial["id"].to_numpy()
    index = Index(distinct, total, sample, max_leaves, k, names.tolist())
    tops, visits = _calibrate(index, k, recall, points, names)
    found = _meet(index, index.leaves_of(queries, tops, visits).join(queries, "id"), k, block)
    # each query of the vector drops itself
    keys = queries.select(F.col("id").alias("key"), "v")
    asking = rows.where("q").select(F.col("id").alias("query_id"), "v").distinct().join(keys, "v").select("query_id", "key")
    pairs = asking.join(found.select("key", F.col("id").alias("vec_id"), F.col("d").alias("score")), "key").where("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(_by("query_id", "score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _by_hash(rows: DataFrame, total: int, n: int, last: bool = False) -> pa.Table:
    """id, v of the first (or last) ``n`` rows by their ids' hash. Only rows under a limit that holds twice as many are ordered and sent."""
    h, span = F.xxhash64("id"), 2 * n + 1000
    named = rows.withColumn("h", F.bitwise_not(h) if last else h)
    wide = 2**64 * span // max(total, 1) - 2**63
    for some in (named.where(F.col("h") < wide) if wide < 2**63 else None, named):
        if some is not None:
            found = some.orderBy("h", "id").limit(n).select("id", "v").toArrow()
            if len(found) == n:
                break
    return found


class Index:
    """Vectors by leaf. ``rows``: id, v, top, sub; ``sizes``: top, sub, n; ``below``: top, tree, n of each sub, for upper leaves that have a tree."""

    def __init__(self, distinct: DataFrame, total: int, sample: int, max_leaves: int, k: int, trials: list[int]):
        spark = distinct.sparkSession
        self.k, self.total = k, total
        new = ~F.col("id").isin(trials) if self.total > 4 * len(trials) else F.lit(True)
        own = _by_hash(distinct.where(new), self.total, sample)
        self.tree = Tree(_matrix(own["v"].combine_chunks()), min(max_leaves, -(-self.total // LEAF)))
        shared = spark.sparkContext.broadcast(self.tree)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in regroup(batches, BATCH):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.assign(_matrix(b.column(1))), pa.int32())], names=["id", "v", "top"])

        upper = cut(distinct.mapInArrow(assign, "id long, v array<double>, top int"))
        self.filled = dict(map(tuple, upper.groupBy("top").count().collect()))
        large = {top: n for top, n in self.filled.items() if n > 2 * LEAF}
        self.deal = None
        if not large:
            self.rows, self.below = upper.withColumn("sub", F.lit(-1)), None
            self.sizes = self.rows.groupBy("top", "sub").agg(F.count("*").alias("n"))
            return
        # at most max_leaves rows
        self.deal = F.broadcast(spark.createDataFrame([(top, n, -(-n // DEAL)) for top, n in sorted(large.items())], "top int, n long, deals int"))
        of = upper.join(self.deal, "top")
        taken = of.where(new).withColumn("h", F.xxhash64("id", F.lit(1))).withColumn("at", F.row_number().over(_by("top", "h", "id"))).where(F.col("at") <= sample)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, n, held = None, 0, []

            def made() -> pa.RecordBatch:
                x = np.concatenate(held)
                tree = pickle.dumps(Tree(x, min(-(-n // LEAF), max(len(x) // 2, 1))))
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([tree], pa.binary())], names=["top", "tree"])

            for b in batches:
                tops, x, sizes = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
                edges = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1], True])
                for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if int(tops[s]) != now:
                        if held:
                            yield made()
                        now, n, held = int(tops[s]), int(sizes[s]), []
                    held.append(x[s:e])
            if held:
                yield made()

        trees = cut(taken.select("top", "v", "n", "at").repartition("top").sortWithinPartitions("top", "at").select("top", "v", "n").mapInArrow(fit, "top int, tree binary"))
        small = upper.join(self.deal.select("top"), "top", "left_anti").select("id", "v", "top", F.lit(-1).alias("sub"))
        lower = self._through(trees, of.select("id", "v", "top"), _descend, "id long, v array<double>, top int, sub int")
        self.rows = cut(small.unionByName(lower))
        self.sizes = cut(self.rows.groupBy("top", "sub").agg(F.count("*").alias("n")))
        counts = self.sizes.where("sub >= 0").groupBy("top").agg(F.map_from_entries(F.collect_list(F.struct("sub", "n"))).alias("filled"))
        self.below = cut(trees.join(counts, "top"))

    def _through(self, trees: DataFrame, rows: DataFrame, work, schema: str) -> DataFrame:
        """``work`` over rows (id, v, top) beside the tree of their upper leaf, which is copied to as many tasks as it has deals."""
        empty = F.lit(None).cast("map<int,bigint>")
        filled = F.col("filled") if "filled" in trees.columns else empty
        copies = trees.join(self.deal, "top").select("top", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), "tree", filled.alias("filled"))
        dealt = rows.join(self.deal, "top").select("top", F.pmod(F.xxhash64("id"), "deals").cast("int").alias("deal"), F.lit(1).alias("asks"), "id", "v", F.lit(None).cast("binary").alias("tree"), empty.alias("filled"))
        met = copies.unionByName(dealt).repartition("top", "deal").sortWithinPartitions("top", "deal", "asks")
        return met.select("top", "asks", "id", "v", "tree", "filled").mapInArrow(work, schema)

    def leaves_of(self, queries: DataFrame, tops: int, visits: int) -> DataFrame:
        """id, top, sub, turn: the leaves that each of queries(id, v) visits, with their turn. Vectors do not go through the ranking."""
        spark = queries.sparkSession
        plan = spark.sparkContext.broadcast((self.tree, self.filled))
        k = self.k

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, filled = plan.value
            for b in batches:
                chosen = []
                for q in _matrix(b.column(1)):
                    mine, rows = [], 0
                    for n, (top, far) in enumerate(tree.visits(q), 1):
                        if top in filled:
                            mine.append({"top": top, "far": far, "n": filled[top]})
                            rows += filled[top]
                        if n >= tops and rows > k:
                            break
                    chosen.append(mine)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chosen, pa.list_(pa.struct([("top", pa.int32()), ("far", pa.float64()), ("n", pa.int64())])))], names=["id", "v", "tops"])

        asked = queries.select("id", "v").mapInArrow(walk, "id long, v array<double>, tops array<struct<top:int,far:double,n:bigint>>").select("id", "v", F.explode("tops").alias("t"))
        direct = asked.select("id", F.col("t.top").alias("top"), F.lit(-1).alias("sub"), F.col("t.far").alias("far"), F.col("t.n").alias("n"))
        if self.below is not None:
            into = self._through(self.below, asked.select("id", "v", F.col("t.top").alias("top")), lambda b: _look(b, visits, k), "id long, top int, sub int, far double, n long")
            direct = direct.join(self.deal.select("top"), "top", "left_anti").select("id", "top", "sub", "far", "n").unionByName(into)
        order = Window.partitionBy("id").orderBy("far", "top", "sub")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = direct.withColumn("turn", F.row_number().over(order)).withColumn("rows", before)
        return ranked.where((F.col("turn") <= visits) | (F.col("rows") <= k)).select("id", "top", "sub", "turn")


def _with_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tree, dict, pa.RecordBatch]]:
    """Rows (top, asks, id, v, tree, filled) in order: the tree before them, its leaves' sizes, and the rows that ask."""
    tree, filled = None, {}
    for b in batches:
        asks = b.column(1).to_numpy()
        at = 0
        for i in [*np.flatnonzero(asks == 0).tolist(), len(b)]:
            if i > at:
                yield tree, filled, b.slice(at, i - at)
            if i < len(b):
                tree, filled = pickle.loads(b.column(4)[i].as_py()), dict(b.column(5)[i].as_py() or ())
            at = i + 1


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tree, _, b in _with_trees(batches):
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(0), pa.array(tree.assign(_matrix(b.column(3))), pa.int32())], names=["id", "v", "top", "sub"])


def _look(batches: Iterator[pa.RecordBatch], visits: int, k: int) -> Iterator[pa.RecordBatch]:
    """The first leaves of the lower tree for each row: ``visits``, or as many as hold more than ``k`` vectors."""
    for tree, filled, b in _with_trees(batches):
        which, subs, fars, sizes = [], [], [], []
        for i, q in enumerate(_matrix(b.column(3))):
            rows = seen = 0
            for sub, far in tree.visits(q):
                if sub in filled:
                    which.append(i)
                    subs.append(sub)
                    fars.append(far)
                    sizes.append(filled[sub])
                    rows, seen = rows + filled[sub], seen + 1
                if seen >= visits and rows > k:
                    break
        at = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(2).take(at), b.column(0).take(at), pa.array(subs, pa.int32()), pa.array(fars, pa.float64()), pa.array(sizes, pa.int64())], names=["id", "top", "sub", "far", "n"])


def _calibrate(index: Index, k: int, recall: float, points: np.ndarray, names: np.ndarray) -> tuple[int, int]:
    """How many upper leaves and leaves to visit so that ``recall`` of the trial vectors' true neighbours are found."""
    spark = index.rows.sparkSession
    trial = spark.sparkContext.broadcast((points, names))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = trial.value
        held: list = [None] * len(q)
        for b in regroup(batches, BATCH):
            x, at = _matrix(b.column(1)), b.column(0).to_numpy()
            place = np.column_stack([b.column(2).to_numpy(), b.column(3).to_numpy()])
            for i, d in enumerate(distances(x, q)):
                d[at == names[i]] = np.inf
                best = _best(at, d, k)
                now = (at[best], d[best], place[best])
                now = now if held[i] is None else tuple(map(np.concatenate, zip(held[i], now, strict=True)))
                best = _best(now[0], now[1], k)
                held[i] = tuple(c[best] for c in now)
        for i, h in enumerate(held):
            if h is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[0]), names[i], np.int64)), pa.array(h[0]), pa.array(h[1]), pa.array(h[2][:, 0], pa.int32()), pa.array(h[2][:, 1], pa.int32())], names=["q", "id", "d", "top", "sub"])

    near = index.rows.select("id", "v", "top", "sub").mapInArrow(brute, "q long, id long, d double, top int, sub int").where("d < double('infinity')").withColumn("n", F.row_number().over(_by("q", "d", "id"))).where(F.col("n") <= k)
    near = near.select("q", "top", "sub").collect()  # trials times k rows
    if not near:
        return 1, 1
    turn_of = {int(n): {top: t for t, (top, _) in enumerate(index.tree.visits(x), 1)} for n, x in zip(names.tolist(), points, strict=True)}
    tops = _quantile([turn_of[r.q][r.top] for r in near], (1 + recall) / 2)
    ask = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(names.tolist(), points, strict=True)], "id long, v array<double>")
    # of the leaves that are visited, which grow with the rows, only those of true neighbours reach the driver: trials times k at most
    wanted = F.broadcast(spark.createDataFrame(sorted({(r.q, r.top, r.sub) for r in near}), "id long, top int, sub int"))
    visits = 2 * tops
    while True:
        seen = {(r.id, r.top, r.sub): r.turn for r in index.leaves_of(ask, tops, visits).join(wanted, ["id", "top", "sub"]).collect()}
        turns = [seen.get((r.q, r.top, r.sub), np.inf) for r in near]
        if (need := _quantile(turns, recall)) < np.inf:
            return tops, int(need)
        tops, visits = min(2 * tops, index.tree.leaves), 2 * visits


def _quantile(values: list, share: float):
    """The smallest of the values below or at which the share of them lies."""
    return sorted(values)[min(len(values), int(np.ceil(share * len(values)))) - 1]


def _meet(index: Index, asked: DataFrame, k: int, block: int) -> DataFrame:
    """key, id, d: the k + 1 nearest vectors of the leaves that each query visits. Both meet by leaf and block."""
    split = index.sizes.where(F.col("n") > block).select("top", "sub", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    split = F.broadcast(split) if split.count() <= 1_000_000 else split
    many = F.coalesce("blocks", F.lit(1))
    there = index.rows.join(split, ["top", "sub"], "left").select("top", "sub", F.pmod(F.xxhash64("id"), many).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "v")
    queries = asked.join(split, ["top", "sub"], "left").select("top", "sub", F.explode(F.sequence(F.lit(0), many - 1)).alias("block"), F.lit(1).alias("asks"), "id", "v")
    met = there.union(queries).repartition("top", "sub", "block").sortWithinPartitions("top", "sub", "block", "asks", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, x = None, [], []
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def tell() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.fromiter(held, np.int64), [len(h[0]) for h in held.values()])), pa.array(np.concatenate([h[0] for h in held.values()])), pa.array(np.concatenate([h[1] for h in held.values()]))],
                names=["key", "id", "d"],
            )
            held.clear()
            return made

        for b in regroup(batches, BATCH):
            top, sub, blk, asks, names = (b.column(i).to_numpy() for i in range(5))
            v = _matrix(b.column(5))
            edges = np.flatnonzero(np.r_[True, (top[1:] != top[:-1]) | (sub[1:] != sub[:-1]) | (blk[1:] != blk[:-1]) | (asks[1:] != asks[:-1]), True])
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (top[s], sub[s], blk[s]) != place:
                    place, ids, x = (top[s], sub[s], blk[s]), [], []
                if not asks[s]:
                    ids.append(names[s:e])
                    x.append(v[s:e])
                elif ids:
                    at, near = np.concatenate(ids), np.concatenate(x)
                    for key, d in zip(names[s:e].tolist(), distances(near, v[s:e]), strict=True):
                        best = _best(at, d, k + 1)
                        now = (at[best], d[best])
                        if key in held:
                            now = tuple(map(np.concatenate, zip(held[key], now, strict=True)))
                            best = _best(*now, k + 1)
                            now = (now[0][best], now[1][best])
                        held[key] = now
                    if len(held) > HOLD // (k + 1):
                        yield tell()
        if held:
            yield tell()

    found = met.mapInArrow(meet, "key long, id long, d double")
    return found.withColumn("n", F.row_number().over(_by("key", "d", "id"))).where(F.col("n") <= k + 1)


def _by(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)
