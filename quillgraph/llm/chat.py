"""Chat formatting by schema fingerprints. DataFrame functions only: no Python runs on the executors.

A layout is known by a fingerprint, the SHA-256 of its sorted nested field paths. Each known fingerprint selects
a declarative mapping, a SQL expression that makes canonical turns, an array of struct(role, text), of a row. Paths are
those of all elements of a list together, and only names that some mapping knows are hashed. A mapping may have
optional paths; each of their choices has its fingerprint. A record of no known fingerprint gets the mapping with the
most paths among those that find all their paths in it, the first one listed on a tie.
Three kinds of input: JSON records of any mixture of layouts (``from_json``; a fingerprint for each row), typed columns of
any mixture, such as the union of tables of several layouts (``from_records``; a fingerprint for each row, of what is not
null), and tables with one row per turn (``from_rows``; the fingerprint is of the table's columns).

Template of a turn: ``<turn>ROLE<said>TEXT</turn>`` and a line end. Control strings in roles and texts get a
backslash after their ``<`` (those that already have some get one more), so that none remains; ``unescape``
takes it off again. Texts without control strings stay as they are.

Defined results
  null role or text: empty string. A conversation's turns are ordered by turn, then role, then text, nulls first.
  null conversation id: the rows with a null id are one conversation. Repeated rows are repeated turns.
  JSON that does not parse, or records that no mapping fits: layout null, no turns; ``unmapped`` counts them by fingerprint.
  ``from_records`` orders the turns of a conversation by turn, then by their place in the record, role and text.
  extra columns are ignored; clashing names are replaced.
One conversation becomes one string, so its turns meet in one task: this is what the operator returns.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, SAID, CLOSE = "<turn>", "<said>", "</turn>\n"
_CONTROL = r"<(\\*)(/?(?:turn|said)>)"
_ESCAPED = r"<\\(\\*)(/?(?:turn|said)>)"


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def paths_of(schema: T.StructType, prefix: str = "") -> list[str]:
    """Nested field paths: ``a.b`` for structs, ``a[].b`` for arrays of structs."""
    out: list[str] = []
    for f in schema:
        kind, name = f.dataType, f"{prefix}{f.name.lower()}"
        while isinstance(kind, T.ArrayType):
            kind, name = kind.elementType, f"{name}[]"
        out += paths_of(kind, f"{name}.") if isinstance(kind, T.StructType) else [name]
    return out


def _turns(*pairs: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{role}', 'text', coalesce({said}, ''))" for role, said in pairs) + ")"


def _list(array: str, role: str, text: str) -> str:
    return f"transform({array}, m -> named_struct('role', {role.replace('$', 'm.')}, 'text', coalesce(m.{text}, '')))"


_SPEAKER = "case lower($from) when 'human' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant' else coalesce($from, '') end"
_TASK = ("user", "concat_ws('\\n\\n', nullif(__r.instruction, ''), nullif(__r.input, ''))")

#: Layouts: name, field paths, optional field paths, turns as SQL over the record ``__r``.
MAPPINGS: list[tuple[str, list[str], list[str], str]] = [
    ("messages", ["messages[].role"], ["messages[].content"], _list("__r.messages", "coalesce($role, '')", "content")),
    ("conversations", ["conversations[].from"], ["conversations[].value"], _list("__r.conversations", _SPEAKER, "value")),
    ("prompt_response", ["prompt", "response"], [], _turns(("user", "__r.prompt"), ("assistant", "__r.response"))),
    ("prompt_completion", ["prompt", "completion"], [], _turns(("user", "__r.prompt"), ("assistant", "__r.completion"))),
    ("system_prompt_response", ["system", "prompt", "response"], [], _turns(("system", "__r.system"), ("user", "__r.prompt"), ("assistant", "__r.response"))),
    ("system_prompt_completion", ["system", "prompt", "completion"], [], _turns(("system", "__r.system"), ("user", "__r.prompt"), ("assistant", "__r.completion"))),
    ("instruction", ["instruction", "output"], [], _turns(("user", "__r.instruction"), ("assistant", "__r.output"))),
    ("instruction_input", ["instruction", "input", "output"], [], _turns(_TASK, ("assistant", "__r.output"))),
    ("system_instruction", ["system", "instruction", "output"], ["input"], _turns(("system", "__r.system"), _TASK, ("assistant", "__r.output"))),
    ("question_answer", ["question", "answer"], [], _turns(("user", "__r.question"), ("assistant", "__r.answer"))),
    ("turn", ["role", "text"], ["turn"], "array(named_struct('role', coalesce(__r.role, ''), 'text', coalesce(__r.text, '')))"),
]
#: The last layout in a table that has its columns, where any of them may be null.
_TURN_ROW = ("turn", [], ["role", "text", "turn"], MAPPINGS[-1][3])
_LISTS = {"messages": ["role", "content"], "conversations": ["from", "value"]}
_PLAIN = ["prompt", "response", "completion", "system", "instruction", "input", "output", "question", "answer", "role", "text"]
_RECORD = ", ".join([f"{n} array<struct<{','.join(f'`{f}`:string' for f in fields)}>>" for n, fields in _LISTS.items()] + [f"{n} string" for n in _PLAIN])
#: Tables with a row for each turn: field paths, and the columns that are id, order, role and text.
ROW_MAPPINGS: list[tuple[list[str], tuple[str, str, str, str]]] = [
    (["conv_id", "turn", "role", "text"], ("conv_id", "turn", "role", "text")),
    (["conversation_id", "turn_index", "speaker", "content"], ("conversation_id", "turn_index", "speaker", "content")),
    (["thread_id", "position", "from", "value"], ("thread_id", "position", "from", "value")),
]

_EMPTY = "cast(array() as array<struct<role:string,text:string>>)"


def _known(mappings: list) -> dict[str, int]:
    """Fingerprint: number of its mapping; of equal ones the mapping with more fixed paths."""
    out: dict[str, int] = {}
    for n in sorted(range(len(mappings)), key=lambda n: -len(mappings[n][1])):
        _, fixed, free, _ = mappings[n]
        for k in range(2 ** len(free)):
            out.setdefault(fingerprint(fixed + [p for i, p in enumerate(free) if k >> i & 1]), n)
    return out


def _select(df: DataFrame, mappings: list) -> DataFrame:
    """``df`` with fingerprint, layout and turns by its ``__paths`` and ``__r``."""
    exact = " ".join(f"when '{f}' then {n}" for f, n in _known(mappings).items())
    held = [n for n in sorted(range(len(mappings)), key=lambda n: -len(mappings[n][1])) if mappings[n][1]]
    within = " ".join(f"when {' and '.join(f"array_contains(__paths, '{p}')" for p in mappings[n][1])} then {n}" for n in held)
    cases = " ".join(f"when {n} then coalesce({m[3]}, {_EMPTY})" for n, m in enumerate(mappings))
    names = " ".join(f"when {n} then '{m[0]}'" for n, m in enumerate(mappings))
    return (
        df.withColumn("fingerprint", F.expr("sha2(array_join(array_sort(__paths), '\\n'), 256)"))
        .withColumn("__n", F.expr(f"case fingerprint {exact} else case {within} end end"))
        .withColumn("layout", F.expr(f"case __n {names} end"))
        .withColumn("turns", F.expr(f"case __n {cases} else {_EMPTY} end"))
        .drop("__paths", "__r", "__n")
    )


def _paths(present: dict[str, str]) -> str:
    """SQL: the paths whose condition holds."""
    return f"filter(array({', '.join(f"case when {c} then '{p}' end" for p, c in sorted(present.items()))}), p -> p is not null)"


def _gather(rows: DataFrame) -> DataFrame:
    """conv_id and turns of rows (conv_id, turn, at, role, text)."""
    return (
        rows.select("conv_id", F.struct("turn", "at", "role", "text").alias("said"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("said")).alias("said"))
        .select("conv_id", F.expr("transform(said, s -> named_struct('role', s.role, 'text', s.text))").alias("turns"))
    )


def from_rows(df: DataFrame) -> DataFrame:
    """conv_id and turns of a table with a row for each turn, by the mapping that its columns' fingerprint selects.

    Further columns change nothing: of the mappings whose paths the table has, the first one listed holds.
    """
    there = set(paths_of(df.schema))
    known = {fingerprint(paths): columns for paths, columns in ROW_MAPPINGS}
    chosen = next((known[fingerprint(paths)] for paths, _ in ROW_MAPPINGS if there.issuperset(paths)), None)
    if chosen is None:
        raise ValueError(f"no mapping has the field paths {paths_of(df.schema)}")
    conv, turn, role, text = (F.col(f"`{c}`") for c in chosen)
    return _gather(df.select(conv.alias("conv_id"), turn.alias("turn"), F.lit(0).alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")))


def layouts(df: DataFrame) -> DataFrame:
    """``df`` with layout, fingerprint and turns of each row's typed columns; what is null in a row is not there."""
    names = {c.lower(): c for c in df.columns}
    fields, present = [], {}
    for name, inner in _LISTS.items():
        kind = df.schema[names[name]].dataType if name in names else None
        has = {f.name.lower(): f.name for f in kind.elementType} if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else {}
        made = ", ".join(f"'{f}', " + (f"cast(m.`{has[f]}` as string)" if f in has else "cast(null as string)") for f in inner)
        fields.append(f"transform(`{names[name]}`, m -> named_struct({made})) as {name}" if has else f"cast(null as array<struct<{','.join(f'`{f}`:string' for f in inner)}>>) as {name}")
        present |= {f"{name}[].{f}": f"exists(`{names[name]}`, m -> m.`{has[f]}` is not null)" for f in inner if f in has}
    for name in _PLAIN:
        fields.append(f"cast(`{names[name]}` as string) as {name}" if name in names else f"cast(null as string) as {name}")
        if name in names:
            present[name] = f"`{names[name]}` is not null"
    if "turn" in names:
        present["turn"] = f"`{names['turn']}` is not null"
    record = F.struct(*[F.expr(f) for f in fields])
    mappings = [*MAPPINGS[:-1], _TURN_ROW] if {"role", "text"} <= names.keys() else MAPPINGS
    return _select(df.withColumn("__paths", F.expr(_paths(present)) if present else F.array().cast("array<string>")).withColumn("__r", record), mappings)


def from_records(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv_id and turns of a table whose rows are of any layouts, each a part of the conversation ``conv_id`` at ``turn`` (null if there is no such column)."""
    order = F.col(f"`{turn}`") if turn.lower() in {c.lower() for c in df.columns} else F.lit(None).cast("long")
    kept = df.select(F.col(f"`{conv_id}`").alias("__conv"), order.alias("__turn"), *[F.col(f"`{c}`") for c in df.columns])
    rows = layouts(kept).select(F.col("__conv").alias("conv_id"), F.col("__turn").alias("turn"), F.posexplode("turns").alias("at", "said"))
    return _gather(rows.select("conv_id", "turn", "at", "said.role", "said.text"))


def from_json(df: DataFrame, column: str) -> DataFrame:
    """``df`` with layout, fingerprint and turns of the JSON records in ``column``."""
    body = f"`{column}`"
    inner = "array_distinct(flatten(transform(from_json(get_json_object({c}, '$.{n}'), 'array<map<string,string>>'), m -> map_keys(m))))"
    keys = df.withColumn("__top", F.expr(f"transform(coalesce(json_object_keys({body}), array()), k -> lower(k))"))
    for name in _LISTS:
        keys = keys.withColumn(f"__{name}", F.expr(inner.format(c=body, n=name)))
    present = {n: f"array_contains(__top, '{n}')" for n in [*_PLAIN, "turn"]}
    present |= {f"{n}[].{f}": f"array_contains(__top, '{n}') and array_contains(__{n}, '{f}')" for n, fields in _LISTS.items() for f in fields}
    read = keys.withColumn("__paths", F.expr(_paths(present))).withColumn("__r", F.from_json(F.col(body), _RECORD))
    return _select(read, MAPPINGS).drop("__top", *[f"__{n}" for n in _LISTS])


def unmapped(df: DataFrame) -> DataFrame:
    """fingerprint, n of the rows of ``layouts`` or ``from_json`` that no mapping fits."""
    return df.where("layout is null").groupBy("fingerprint").agg(F.count("*").alias("n"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1$2")


def format_turns(df: DataFrame, turns: str = "turns", learn: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``, the code points [start, end) of the texts of role ``learn``."""
    head = F.lit(len(OPEN) + len(SAID))
    parts = F.transform(F.col(turns), lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == learn).alias("learn")))
    spoken = df.withColumn("__parts", parts)
    sized = spoken.withColumn("__sizes", F.transform("__parts", lambda p: F.struct((head + F.length(p["role"])).cast("long").alias("lead"), F.length(p["text"]).cast("long").alias("body"), p["learn"].alias("learn"))))
    spans = F.aggregate(
        F.col("__sizes"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["lead"] + s["body"] + len(CLOSE)).alias("at"),
            F.when(s["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + s["lead"]).alias("start"), (acc["at"] + s["lead"] + s["body"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    whole = F.array_join(F.transform("__parts", lambda p: F.concat(F.lit(OPEN), p["role"], F.lit(SAID), p["text"], F.lit(CLOSE))), "")
    return sized.withColumn("formatted", whole).withColumn("loss_spans", spans).drop("__parts", "__sizes")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string, an array of struct(role, text)."""
    pieces = F.split(formatted, F.lit(CLOSE), -1)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), SAID, 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, SAID) + len(SAID))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
