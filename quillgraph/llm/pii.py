"""Personal data by candidate gradient boosting. DataFrame functions only: no Python runs on the executors.

1. Generators of high recall propose spans, which may overlap: the base patterns, national phone numbers, written-out
   e-mail addresses, named secrets, access keys, long mixed tokens, and numbers of other kinds (dates, amounts, counters).
2. Each candidate gets a weak label from evidence that no feature tells: a base match by the rule beyond its pattern (parts
   up to 255, checksum, number of digits), a secret by its name and its digits, a key by its fixed head; numbers of
   other kinds are false. National numbers, written-out addresses and mixed tokens have no label of their own: what the
   trees learn of the labelled candidates' format and context judges them. A candidate within a true one is true.
3. Format and context become a few small bins; neither the rule that labels nor the generator is among them. The
   candidates of all texts are counted by bins and label. The table of counts has at most ``BINS_LIMIT`` rows, whatever
   the input; boosted trees are fitted on one half of it, and on the other half each kind's threshold, between the lowest score
   at which ``PRECISION`` of the labels above it are true and the next (a kind without true labels there: that of all kinds).
4. The trees, as one SQL expression, score the candidates. Base spans always stay; others join where their score
   reaches their kind's threshold and no base span covers them.

Offsets are code points, ends exclusive. Java's regular expressions run without nested backtracking: possessive
groups, and a lookbehind or the end of the last match before a run.

Defined results
  null text: as empty, no spans (redaction leaves it null). Very long texts: whole; finding n matches takes time n to the power of 1.5,
  choosing among a text's own candidates the square of their number.
  no true label at all: base spans alone. Repeated ids and rows: one row each.
  columns named like an added one are replaced; others stay.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, without

KINDS = ["email", "ip", "card", "phone", "secret"]
PRECISION = 0.98
TREES, DEPTH, RATE = 20, 3, 0.3
#: What precedes a candidate, in code points, and counts as its context.
CONTEXT = 24

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Generator: kind, is it a base pattern, pattern. A run is tried from its start or from where the last match ended.
GENERATORS: list[tuple[str, bool, str]] = [
    ("email", True, rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    ("ip", True, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("phone", False, r"(?<![0-9A-Za-z+.-])(?:\([2-9][0-9]{2}\)[\x20]?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"),
    ("email", False, rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+[\x20]?(?:\(at\)|\[at\])[\x20]?{_LABEL}{{1,63}}+[\x20]?(?:\(dot\)|\[dot\]|\.)[\x20]?[A-Za-z]{{2,24}}+"),
    ("secret", False, r"(?i)(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?[\x20]{0,2}[=:][\x20]{0,2}[\"']?[^\s\"']{6,}+[\"']?"),
    ("secret", False, r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|sk-)[A-Za-z0-9]{16,}+"),
    ("secret", False, r"(?<![A-Za-z0-9])(?=[A-Za-z]*+(?:[0-9]++[A-Za-z]++){2}[0-9])[A-Za-z0-9]{20,}+"),
    ("phone", False, r"(?<![0-9A-Za-z+])(?<![0-9][./:,-])(?<![0-9)][\x20])(?![0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]))[0-9]{1,4}+(?:[./:,-][0-9]{1,4}+){1,2}+(?![./:,-]?[0-9A-Za-z])"),
    ("phone", False, r"(?<![0-9A-Za-z+.,:/-])(?<![0-9)][\x20])[0-9]{5,9}+(?![\x20.,:/-]?[0-9A-Za-z])"),
]
#: Generators without a rule of their own, and those of numbers that are no personal data.
NATIONAL, WRITTEN, NAMED, KEY, MIXED, PARTED, COUNTER = 4, 5, 6, 7, 8, 9, 10
#: What precedes the value of a named secret.
_NAME = r"^[A-Za-z_-]+[\"']?[\x20]{0,2}[=:][\x20]{0,2}[\"']?"
#: Words whose presence before a candidate speaks for it.
HINTS = "mail|phone|tel|call|fax|mobile|host|server|card|visa|pass|pwd|token|secret|key|login|account"

#: Bins of each feature; their product bounds the table of counts.
FEATURES = {"what": len(KINDS), "length": 6, "digits": 4, "parts": 4, "joint": 5, "case": 4, "hint": 2, "lead": 4, "glued": 2}
#: By label (or none) and fold.
BINS_LIMIT = 6 * math.prod(FEATURES.values())

_SPAN = f"array<struct<kind:int,start:int,end:int,base:boolean,label:boolean,f:struct<{','.join(f'{f}:int' for f in FEATURES)}>>>"


def _pairs(text: Column, pattern: str) -> Column:
    """array<struct<gap, said>>: the leftmost matches that do not overlap, each with the length of what lies before it."""
    said = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), said, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("said")))
    shape = "array<struct<gap:int,said:string>>"
    return F.when(text.rlike(pattern), F.filter(pairs, lambda p: p["said"].isNotNull())).otherwise(F.array().cast(shape)).cast(shape)


def _placed(pairs: Column) -> Column:
    """array<struct<start, end, said>> of the matches in ``pairs``.

    Ends are running sums over the stretches before and in the matches. They are taken in blocks of the root of their number, and
    the blocks' own starts by another running sum, as each step of a running sum copies its array.
    """

    def running(items: Column, first: Column) -> Column:
        done = F.aggregate(
            items,
            F.struct(first.alias("at"), F.array().cast("array<struct<start:int,end:int,said:string>>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.length(x["said"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["said"])).alias("end"), x["said"].alias("said")))).alias("out"),
            ),
        )
        return done["out"]

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["said"])))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.flatten(F.transform(F.filter(F.arrays_zip(parts.alias("b"), starts.alias("s")), lambda z: z["b"].isNotNull()), lambda z: running(z["b"], z["s"])))

    size = F.greatest(F.ceil(F.sqrt(F.size(pairs))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(pairs) - 1, F.lit(0)) / size).cast("int")), lambda n: F.slice(pairs, n * size + 1, size))
    return F.get(F.transform(F.array(blocks), joined), F.lit(0))  # as a lambda's variable, the blocks are worked out once


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    each = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.when(i % 2 == 1, F.substr(turned, i, F.lit(1)).cast("int")).otherwise((F.substr(turned, i, F.lit(1)).cast("int") * 2) - F.when(F.substr(turned, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _follows_its_rule(source: Column, said: Column) -> Column:
    """The rule beyond the pattern; true where there is none."""
    digits = F.length(_digits(said))
    parts = F.transform(F.split(said, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    ip, card, phone = (F.lit([k for k, _, _ in GENERATORS].index(kind)) for kind in ("ip", "card", "phone"))
    rule = F.when(source == ip, small).when(source == card, digits.between(12, 19) & _luhn(_digits(said))).when(source == phone, digits.between(9, 15))
    return rule.when(source.isin(NAMED, KEY), digits >= 2).otherwise(True)


def _candidates(text: Column) -> Column:
    found = F.array(*[_pairs(text, pattern) for _, _, pattern in GENERATORS])
    spans = F.transform(found, lambda p, k: F.transform(_placed(p), lambda m: F.struct(k.alias("source"), m["start"].alias("start"), m["end"].alias("end"), m["said"].alias("said"))))
    return F.transform(F.flatten(spans), lambda m: _described(text, m))


def _described(text: Column, m: Column) -> Column:
    """A match as a candidate: is it a base span, its weak label (null: none), and its bins."""
    source, start, end, whole = m["source"], m["start"], m["end"], m["said"]
    typed = F.regexp_replace(F.regexp_replace(whole, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    # the format is that of a secret's value, and of an address as it would be typed
    said = F.when(source == NAMED, F.regexp_replace(whole, _NAME + r"|[\"']$", "")).when(source == WRITTEN, typed).otherwise(whole)
    n, digits = F.greatest(F.length(said), F.lit(1)), F.length(_digits(said))
    around = F.substr(text, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT)) + (end - start) + 1)
    before = F.lower(F.substr(around, F.lit(1), F.least(start, F.lit(CONTEXT))))
    after, last = F.substr(around, F.least(start, F.lit(CONTEXT)) + (end - start) + 1, F.lit(1)), F.right(before, F.lit(1))
    kind = F.get(F.array(*[F.lit(KINDS.index(k)) for k, _, _ in GENERATORS]), source)
    base = F.get(F.array(*[F.lit(b) for _, b, _ in GENERATORS]), source)
    ok = _follows_its_rule(source, whole)
    label = F.when(source.isin(PARTED, COUNTER), False).when(~source.isin(NATIONAL, WRITTEN, MIXED), ok)
    gaps = F.regexp_replace(said, r"[^\x20().:/,-]", "")
    bins = {
        "what": kind,
        "length": F.when(n < 8, 0).when(n < 12, 1).when(n < 16, 2).when(n < 24, 3).when(n < 48, 4).otherwise(5),
        "digits": F.floor(digits * 3 / n),
        "parts": F.least(F.size(F.regexp_extract_all(said, F.lit(r"[^\x20().:/,-]+"), F.lit(0))) - 1, F.lit(3)),
        "joint": F.when(F.contains(said, F.lit("@")), 4).when(gaps.rlike(r"[:/,]"), 3).when(gaps.rlike(r"[\x20()-]"), 2).when(gaps != "", 1).otherwise(0),
        "case": said.rlike("[a-z]").cast("int") + 2 * said.rlike("[A-Z]").cast("int"),
        "hint": ((source == NAMED) | before.rlike(HINTS)).cast("int"),
        "lead": F.when(last == "", 0).when(last.rlike(r"\s"), 1).when(last.rlike(r"[\"'(<\[=:]"), 2).otherwise(3),
        "glued": (after.rlike("[A-Za-z0-9]") | last.rlike("[a-z0-9]")).cast("int"),
    }
    f = F.struct(*[v.cast("int").alias(k) for k, v in bins.items()])
    return F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), (base & ok).alias("base"), label.alias("label"), f.alias("f"))


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_candidates``. Every candidate has a digit, an @ or a named secret, and most texts have none."""
    body = F.coalesce(F.col(text), F.lit(""))
    some = body.rlike(r"[0-9@]|[(\[]at[)\]]") | body.rlike(GENERATORS[NAMED][2])
    rows = docs.withColumn("_candidates", F.when(some, _candidates(body)).otherwise(F.array().cast(_SPAN)).cast(_SPAN))
    # what lies in a true candidate is true itself, and a number in any other candidate is a part of it, not an example
    inside = "exists(__true, t -> t.start <= c.start and t.end >= c.end)"
    part = "exists(__wide, t -> t.start <= c.start and t.end >= c.end and t.end - t.start > c.end - c.start)"
    label = f"case when c.label then true when {inside} then true when not c.label and {part} then null else c.label end"
    shape = f"named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'base', c.base, 'label', {label}, 'f', c.f)"
    rows = rows.withColumn("__true", F.expr("filter(_candidates, c -> c.label)")).withColumn("__wide", F.expr("filter(_candidates, c -> c.label is null)"))
    return rows.withColumn("_candidates", F.expr(f"transform(_candidates, c -> {shape})").cast(_SPAN)).drop("__true", "__wide")


class Trees:
    """Boosted regression trees on bins. A tree is a value or (feature, bin, tree of lower or equal bins, tree of the others)."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int, int]]):
        """rows: bins, number of true, number of all."""
        true, every = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.start = math.log((true + 1) / (every - true + 1))
        self.trees: list = []
        margin = [self.start] * len(rows)
        for _ in range(TREES):
            p = [1 / (1 + math.exp(-m)) for m in margin]
            grad = [r[1] - r[2] * q for r, q in zip(rows, p, strict=True)]
            hess = [r[2] * q * (1 - q) for r, q in zip(rows, p, strict=True)]
            tree = self._grow(rows, grad, hess, list(range(len(rows))), DEPTH)
            self.trees.append(tree)
            margin = [m + self._walk(tree, r[0]) for m, r in zip(margin, rows, strict=True)]

    def _grow(self, rows: list, grad: list[float], hess: list[float], at: list[int], depth: int):
        g, h = sum(grad[i] for i in at), sum(hess[i] for i in at)
        best = (1e-6, None, None)
        if depth:
            for f, bins in enumerate(FEATURES.values()):
                gs, hs = [0.0] * bins, [0.0] * bins
                for i in at:
                    gs[rows[i][0][f]] += grad[i]
                    hs[rows[i][0][f]] += hess[i]
                gl = hl = 0.0
                for b in range(bins - 1):
                    gl, hl = gl + gs[b], hl + hs[b]
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, f, b)
        if best[1] is None:
            return RATE * g / (h + 1)
        _, f, b = best
        return (f, b, self._grow(rows, grad, hess, [i for i in at if rows[i][0][f] <= b], depth - 1), self._grow(rows, grad, hess, [i for i in at if rows[i][0][f] > b], depth - 1))

    @staticmethod
    def _walk(tree, bins: tuple[int, ...]) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if bins[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, bins: tuple[int, ...]) -> float:
        return self.start + sum(self._walk(t, bins) for t in self.trees)

    def sql(self, of: str) -> str:
        names = list(FEATURES)

        def say(tree) -> str:
            return f"if({of}.{names[tree[0]]} <= {tree[1]}, {say(tree[2])}, {say(tree[3])})" if isinstance(tree, tuple) else f"{tree!r}D"

        return " + ".join([f"{self.start!r}D", *map(say, self.trees)])


def fit(proposed: DataFrame) -> tuple[Trees | None, list[float]]:
    """The trees, and each kind's threshold (infinite where no score is precise enough)."""
    one = proposed.select(F.explode("_candidates").alias("c")).select("c.*").where("label is not null")
    fold = (F.xxhash64("start", "end", "f") % 2 == 0).alias("fold")
    table = one.select("label", "f.*", fold).groupBy("fold", "label", *FEATURES).count().collect()
    none = [math.inf] * len(KINDS)
    if not any(r.label for r in table):
        return None, none
    folds = {r.fold for r in table}
    counts: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for r in table:
        if r.fold or len(folds) == 1:
            n = counts[tuple(r[f] for f in FEATURES)]
            n[0] += r["count"] * r.label
            n[1] += r["count"]
    trees = Trees([(k, *v) for k, v in sorted(counts.items())])
    limits = []
    half = [(trees.score(tuple(r[f] for f in FEATURES)), r.label, r["count"], r.what) for r in table if not r.fold or len(folds) == 1]
    for kind in range(len(KINDS)):
        seen = [r for r in half if r[3] == kind]
        seen = sorted(seen if any(r[1] for r in seen) else half, reverse=True)
        limit, true, every = math.inf, 0, 0
        for k, (s, label, n, _) in enumerate(seen):
            true, every = true + n * label, every + n
            lower = seen[k + 1][0] if k + 1 < len(seen) else -math.inf
            if lower < s and true >= PRECISION * every:
                limit = (s + lower) / 2  # nothing labelled speaks against what lies between
        limits.append(max(limit, 0.0))  # a span that is likelier not to be personal is never added
    return trees, limits


def select_spans(proposed: DataFrame, model: tuple[Trees | None, list[float]]) -> DataFrame:
    """Replaces ``_candidates`` by ``pii``: array<struct<start, kind, end, base>>, by start, then kind."""
    trees, limits = model
    rows = proposed.withColumn("__base", F.expr("filter(_candidates, c -> c.base)"))
    more = "array()"
    if trees is not None:
        bar = " ".join(f"when {k} then {v!r}D" for k, v in enumerate(limits) if v < math.inf)
        if bar:
            more = f"""filter(_candidates, c -> not c.base and ({trees.sql('c.f')}) >= case c.kind {bar} else double('infinity') end
                and not exists(__base, b -> b.start <= c.start and b.end >= c.end))"""
    shape = "named_struct('start', c.start, 'kind', c.kind, 'end', c.end, 'base', c.base)"
    kind = "array<struct<start:int,kind:int,end:int,base:boolean>>"
    rows = rows.withColumn("__more", F.expr(f"cast({more} as {_SPAN})"))
    return rows.withColumn("pii", F.expr(f"cast(array_sort(array_distinct(transform(concat(__base, __more), c -> {shape}))) as {kind})")).drop("__base", "__more", "_candidates")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``, the chosen spans. The candidates of all rows are written once and used for fitting and choosing."""
    proposed = cut(propose(without(docs, ["pii", "_candidates"]), text))
    return select_spans(proposed, fit(proposed))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Puts ``<kind>`` in place of each run of overlapping spans, named after its first; drops ``pii``."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    body = F.col(text)
    done = F.aggregate(
        "pii",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(F.substr(body, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))).alias("parts")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(body, acc["at"] + 1)),
    )
    return found.withColumn(text, F.when(F.size("pii") > 0, done).otherwise(body)).drop("pii")
