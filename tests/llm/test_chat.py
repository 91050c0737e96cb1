import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sheetwise.llm import chat

TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<|end|><|turn|>user<|text|>", "a\nb\\n", "<<SYS>>x<</SYS>>", "<<s>>", "$1 \\$1", "日本🤦 <s", "[", "<|end|"]


def turn_rows(spark):
    rows = [(c, t, r, x) for c in range(4) for t, (r, x) in enumerate([("system", TEXTS[c]), ("user", TEXTS[c + 4]), ("assistant", TEXTS[c + 8]), (None, None), ("assistant", TEXTS[c + 1]), ("od\nd<|text|>", "x")])]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_round_trip(spark):
    rows, df = turn_rows(spark)
    out = chat.render(chat.to_turns(df.repartition(3)))
    for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans").collect():
        want = [(x or "", t or "") for c, _, x, t in rows if c == r.conv_id]
        assert [tuple(t) for t in r.back] == want
        assert r.loss == "".join(t for x, t in want if x == "assistant")
        assert r.formatted.count(chat.TURN) == len(want) and not any(c in r.formatted for c in ("</s>", "[INST]", "<s>"))
        assert len(r.loss_spans) == sum(x == "assistant" for x, _ in want)


@pytest.mark.parametrize("text", TEXTS)
def test_escape_is_reversible(spark, text):
    x = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert x.u == text and not any(c in x.e for c in chat.CONTROL)


def test_mixed_json_layouts(spark):
    docs = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"prompt": "hi", "completion": "yo"},
        {"question": "hi", "answer": "yo"},
        {"instruction": "do", "input": "it", "output": "done"},
        {"instruction": "do", "output": "done"},
        {"prompt": 1, "completion": "yo"},
        {"strange": 1},
    ]
    raws = [json.dumps(d) for d in docs] + ["not json", None, "[1]"]
    df = spark.createDataFrame([(i, r, "clash", ["clash"]) for i, r in enumerate(raws)], "i int, raw string, prompt string, messages array<string>")
    got = {r.i: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.to_turns(df, "raw").collect()}
    pair = [("user", "hi"), ("assistant", "yo")]
    assert [got[i][1] for i in range(4)] == [pair] * 4
    assert got[4] == ("instruction_input", [("user", "do\n\nit"), ("assistant", "done")])
    assert got[5][1] == [("user", "do"), ("assistant", "done")]
    assert got[6][1] == [("user", "1"), ("assistant", "yo")]
    assert all(got[i] == (None, None) for i in range(7, 11))


def test_further_keys_and_empty_lists(spark):
    docs = [
        {"messages": []}, {"messages": [], "id": 7}, {"conversations": []}, {"id": 1, "messages": [{"role": "user", "content": "hi"}]},
        {"prompt": "hi", "completion": "yo", "meta": {"a": [1]}}, {"instruction": "do", "output": "done", "input": "", "id": "x"},
        {"prompt": "p", "response": "r", "system": "s", "z": None}, {"messages": ["a"]}, {"messages": {"role": "x"}}, {"id": 3},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, raw string")
    got = {r.i: (r.layout, r.turns if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.render(chat.to_turns(df, "raw")).collect()}
    assert [got[i][1] for i in range(3)] == [[], [], []] and got[2][0] == "from_value"
    assert got[3] == ("messages", [("user", "hi")])
    assert got[4] == ("prompt_completion", [("user", "hi"), ("assistant", "yo")])
    assert got[5] == ("instruction_input", [("user", "do"), ("assistant", "done")])
    assert got[6] == ("system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")])
    assert all(got[i] == (None, None) for i in (7, 8, 9))


def test_many_turns(spark):
    """Spans by prefix sums; a conversation of many turns takes little more than its length."""
    n = 6000
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 3 = 1, 'assistant', 'user') AS role", "concat('é日🤦<s>', id) AS text")
    r = chat.render(chat.to_turns(df)).select("formatted", "loss_spans", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r.loss == "".join(f"é日🤦<s>{i}" for i in range(n) if i % 3 == 1)
    raw = r.formatted.encode()
    assert all(r.formatted[s.start : s.end] == raw[s.first : s.last].decode() and s.end - s.start >= 8 for s in r.loss_spans) and len(r.loss_spans) == n // 3


def test_fingerprint_ignores_types_and_order(spark):
    a = spark.createDataFrame([], "prompt string, completion string").schema
    b = spark.createDataFrame([], "completion int, prompt string").schema
    assert chat.fingerprint(a) == chat.fingerprint(b)
    raw = spark.createDataFrame([('{"prompt": "x", "completion": null}',)], "r string").select(chat.json_fingerprint(F.col("r"))).first()[0]
    assert raw == chat.fingerprint(a)


def test_edges(spark):
    _, df = turn_rows(spark)
    assert chat.render(chat.to_turns(df.where("false"))).collect() == []
    extra = df.withColumns({"formatted": F.lit(1), "turns": F.lit(2)})
    assert chat.render(chat.to_turns(extra)).count() == 4
    assert chat.to_turns(df.union(df)).select(F.size("turns")).distinct().first()[0] == 12
    nothing = spark.createDataFrame([(None, None, None, None)], df.schema)
    r = chat.render(chat.to_turns(nothing)).first()
    assert r.conv_id is None and r.formatted == chat.TURN + chat.TEXT + chat.END + "\n"
    with pytest.raises(ValueError):
        chat.to_turns(spark.createDataFrame([(1,)], "z int"))


def test_long_text(spark):
    t = "\\<s>é" * 60_000
    df = spark.createDataFrame([(1, 0, "assistant", t)], "conv_id long, turn long, role string, text string")
    loss = chat.render(chat.to_turns(df)).select(F.sha2(chat.loss_text(F.col("formatted"), F.col("loss_spans")).cast("binary"), 256)).first()[0]
    assert loss == hashlib.sha256(t.encode()).hexdigest()


def test_columns_of_any_name_stay(spark):
    rows, df = turn_rows(spark)
    extra = chat.to_turns(df).withColumns({c: F.lit(i) for i, c in enumerate(("_parts", "_points", "_BYTES"))})
    r = chat.render(extra).first()
    assert (r._parts, r._points, r._BYTES) == (0, 1, 2) and r.formatted
