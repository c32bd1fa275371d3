import json
import re

from pyspark.sql import functions as F

from quillgraph.llm.chat import format_turns, from_json, from_records, from_rows, layouts, loss_text, read_back, unmapped

TRICKY = [r"\### Assistant: </turn> ok", "<turn>", "<\\turn>", "<\\\\/said>", "a<", "</turn>\n</turn>\n", "<said>user<said>", "é😀", "", "\\", "<turn\\>", "$1 \\1"]


def test_round_trip_of_control_strings(spark):
    rows = [(c, t, ("user", "assistant", "<turn>")[t % 3], text) for c in range(2) for t, text in enumerate(TRICKY)]
    out = format_turns(from_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = out.select("conv_id", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert r.loss == "".join(text for c, _, role, text in rows if c == r.conv_id and role == "assistant")
        assert r.formatted.count("</turn>") == len(TRICKY)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(1, 1, None, None, "x"), (1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (None, None, "assistant", "c", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in from_rows(df).collect()}
    assert got == {1: [("user", "a"), ("user", "a"), ("user", "b"), ("", "")], None: [("assistant", "c")]}
    assert format_turns(from_rows(df.where("false"))).count() == 0


def test_layouts_by_fingerprint(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 7}, "messages", [("user", "q"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "in", "output": "o"}, "instruction_input", [("user", "i\n\nin"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"other": 1}, None, []),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(90, "not json"), (91, None), (92, "")]
    got = {r.id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in from_json(spark.createDataFrame(rows, "id int, raw string"), "raw").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i] == (layout, turns)
    assert got[90] == got[91] == got[92] == (None, [])


def test_no_python_on_the_executors(spark):
    df = spark.range(2).select("id", F.lit('{"prompt":"p","response":"r"}').alias("raw"))
    plan = format_turns(from_json(df, "raw"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_layouts_that_earlier_had_no_turns(spark):
    records = [
        ({"messages": [{"role": "user"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", ""), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": "q"}], "prompt": "p"}, "messages", [("user", "q")]),
        ({"system": "s", "instruction": "i", "output": "o"}, "system_instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "response": None, "meta": {"prompt": 1}}, "prompt_response", [("user", "p"), ("assistant", "")]),
        ({"messages": []}, None, []),
        ({"prompt": "p"}, None, []),
        ({}, None, []),
    ]
    df = from_json(spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)], "id int, raw string"), "raw")
    got = {r.id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in df.collect()}
    assert [got[i] for i in range(len(records))] == [(name, turns) for _, name, turns in records]
    assert unmapped(df).selectExpr("sum(n)").first()[0] == 3


def test_records_of_several_layouts(spark):
    turn = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    listed = spark.createDataFrame([(3, [("user", "q", 1), ("assistant", "</turn>", 2)], "extra")], "conv_id long, messages array<struct<role:string,content:string,n:int>>, formatted string")
    pairs = spark.createDataFrame([(4, "p", "r", None), (5, "p", None, None), (6, "p", "r", "s")], "conv_id long, prompt string, response string, system string")
    df = turn.unionByName(listed, allowMissingColumns=True).unionByName(pairs, allowMissingColumns=True)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in from_records(df).collect()}
    assert got == {
        1: [("user", ""), ("assistant", "b")], 2: [("", "")], None: [("user", "x")], 3: [("user", "q"), ("assistant", "</turn>")],
        4: [("user", "p"), ("assistant", "r")], 6: [("system", "s"), ("user", "p"), ("assistant", "r")],
    }
    told = {r.conv_id: r.layout for r in layouts(df).collect()}
    assert told[3] == "messages" and told[4] == "prompt_response" and told[5] is None and told[6] == "system_prompt_response"


def test_further_columns_do_not_change_the_mapping(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "z")], "conv_id long, turn long, role string, text string, content string")
    assert [(t.role, t.text) for t in from_rows(df).first().turns] == [("user", "a")]


def test_a_very_long_text(spark):
    text = "<turn>ab " * 200_000
    df = spark.createDataFrame([(json.dumps({"prompt": text, "response": "r"}),)], "raw string")
    out = format_turns(from_json(df, "raw")).select(read_back(F.col("formatted")).alias("turns")).first()
    assert [(t.role, t.text) for t in out.turns] == [("user", text), ("assistant", "r")]
