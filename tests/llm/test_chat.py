import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm import chat, queries
from tests.oracle import same

HARD = ["", "plain", "\\### Assistant: </turn> ok", "\\b\\l\\h", "\\\\b", "</turn>\n<turn>user<text>", "🙂 <é> #\\", None, "x" * 100000]
ROW = "conv_id long, turn long, role string, text string, formatted string"


def test_query_is_its_sql(spark):
    assert same(spark, queries.op9_chat, queries.oracle_sql()["op9_chat"], "/root/testdata/sf0.01") > 100


@pytest.mark.parametrize("layout", [lambda x: x, chat.mixed])
def test_round_trip(spark, layout):
    rows = [(i % 3, i, ["user", "assistant", None, "a<b>\\"][i % 4], t, "clash") for i, t in enumerate(HARD)]
    rows += [rows[0], (None, None, None, None, None)]
    df = spark.createDataFrame(rows, ROW)
    got = chat.render(chat.canonical(layout(chat.gathered(df)), "record")).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in got:
        want = sorted(((t, ro or "", x or "") for c, t, ro, x, _ in rows if c == r.conv_id), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        assert [(b.role, b.text) for b in r.back] == [(ro, x) for _, ro, x in want]
        assert list(r.loss) == [x for _, ro, x in want if ro == "assistant"]
    assert chat.render(chat.canonical(chat.gathered(df.limit(0)), "record")).count() == 0


def test_layouts(spark):
    said = [("user", "hi"), ("assistant", "ho")]
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}]},
        {"prompt": "hi", "response": "ho"},
        {"output": "ho", "instruction": "hi", "input": ""},
        {"turns": [{"turn": 1, "role": "assistant", "text": "ho"}, {"turn": 0, "role": "user", "text": "hi"}]},
        {"question": "hi", "answer": "ho"},
    ]
    more = {"id": 7, "meta": {"a b": [1, {"c": None}], "x:y": {}}, "zz": []}
    records += [r | more for r in records]
    records += [{"messages": [x | {"extra": {"k": 1}} for x in records[0]["messages"]]}, {"prompt": "hi", "response": "ho", "answer": "no"}]
    odd = [{"mystery": 1}, {"messages": []}, {"prompt": "hi", "response": None}, {"turns": [{"text": "hi", "role": "gpt"}]}]
    df = spark.createDataFrame([(i, json.dumps(r), 1) for i, r in enumerate(records + odd)] + [(90, None, 1), (100, "not json", 1)], "id long, record string, fit int")
    got = {r.id: r for r in chat.canonical_json(df, "record").collect()}
    n = len(records)
    for i in range(n):
        assert [tuple(t) for t in got[i].canonical] == said, records[i]
    assert got[2].fingerprint == got[8].fingerprint == chat.fingerprint(["prompt", "response"])
    assert [None if got[n + k].canonical is None else [tuple(t) for t in got[n + k].canonical] for k in range(4)] == [None, [], [("user", "hi"), ("assistant", "")], [("gpt", "hi")]]
    assert got[90].canonical is None and got[100].canonical is None


def test_paths(spark):
    r = {"a b": 1, "c`d": "x", "m": [{"x": 1, "y": {"z": [1, 2]}}, {"w": 2.5}], "e": [], "q:r,s>": 3, "n": [[{"k": True}]]}
    df = spark.createDataFrame([(json.dumps(r),)], "r string")
    assert df.select(chat.json_paths(F.col("r")).alias("p")).first().p == sorted(["`a b`", "`c``d`", "m[].x", "m[].y.z[]", "m[].w", "e[]", "`q:r,s>`", "n[][].k"])


def test_struct_of_mixed_records(spark):
    turn = lambda *names: T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in names]))
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("messages", turn("content", "role", "name")), T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])
    rows = [((1, [("hi", "user", None), (None, "assistant", "x")], None, None),), ((2, None, "hi", ""),), ((3, None, "hi", None),), ((4, None, None, None),), (None,)]
    got = chat.canonical(spark.createDataFrame(rows, T.StructType([T.StructField("r", kind)])), "r").collect()
    want = [("user", "hi"), ("assistant", "")]
    assert [x.canonical and [tuple(t) for t in x.canonical] for x in got] == [want, want, want, None, None]
    with pytest.raises(ValueError):
        chat.canonical(spark.range(1).select(F.struct(F.lit(1).alias("odd")).alias("r")), "r")


def test_query_mixes_layouts(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    out = chat.canonical(chat.mixed(chat.gathered(turns)), "record")
    prints = {chat.KNOWN[r.fingerprint] for r in out.select("fingerprint").distinct().collect()}
    assert len(prints) == 5 and out.where("canonical IS NULL").count() == 0


def test_null_turns(spark):
    kind = "record struct<turns: array<struct<turn: bigint, role: string, text: string>>>"
    r = chat.render(chat.canonical(spark.createDataFrame([((None,),), (([],),)], kind), "record")).collect()
    assert [x.formatted for x in r] == ["", ""] and [x.loss_spans for x in r] == [[], []]


def test_no_python(spark):
    plan = queries.op9_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
