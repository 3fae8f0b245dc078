import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import chat as C

TURN_ROWS = "conv_id long, turn long, role string, text string"


def formatted(df):
    return {r.conv_id: r.formatted for r in C.format_chats(df).collect()}


def test_turns_in_order_with_nulls_ties_and_repeated_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "system", None), (1, None, None, "x"), (None, 0, "user", "n"), (2, 0, "user", "")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURN_ROWS + ", formatted string, prompt string")
    got = formatted(df)
    mark = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    assert got[1] == mark("", "x") + mark("system", "") + mark("user", "a") * 2 + mark("assistant", "b")
    assert got[None] == mark("user", "n") and got[2] == mark("user", "")


def test_empty_table(spark):
    assert C.format_chats(spark.createDataFrame([], TURN_ROWS)).count() == 0


ODD = st.text(alphabet="<|!>ims_tarend\n \\$é😀", max_size=40) | st.sampled_from(["<|im_start|>", "<|im_end|>\n", "<!|", "<!!|im_end|>", "$1\\", ""])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), min_size=30, max_size=30))
def test_round_trip(spark, turns):
    df = spark.createDataFrame([(0, i, r, t) for i, (r, t) in enumerate(turns)], TURN_ROWS)
    one = C.format_chats(df)
    row = one.select("formatted", "loss_runs", C.parse_formatted(F.col("formatted")).alias("turns"), C.learned_text(F.col("formatted"), F.col("loss_runs")).alias("learned")).first()
    assert row.learned == "".join(t for r, t in turns if r == "assistant")
    assert [(t.role, t.text) for t in row.turns] == turns
    assert row.formatted.count("<|im_start|>") == row.formatted.count("<|im_end|>") == len(turns)
    at, learned = 0, []
    for run in row.loss_runs:
        if run.learn:
            learned.append(row.formatted[at : at + run.chars])
        at += run.chars
    assert at == len(row.formatted)
    plain = spark.createDataFrame([(i, t) for i, t in enumerate(learned)], "i int, t string").select(C.unescape(F.col("t"))).collect() if learned else []
    assert [r[0] for r in plain] == [t for r, t in turns if r == "assistant"]


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"system": "s", "messages": [{"role": "user", "content": "q"}]}, "messages", [("system", "s"), ("user", "q")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 7}, "from and value", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"output": "done", "instruction": "do"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c", "system": "s"}, "prompt and response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"question": "q", "context": "c", "answer": "a"}, "question and answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"question": "q", "answer": "a", "output": "stray"}, "question and answer", [("user", "q"), ("assistant", "a")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": "a"}]}, "messages", [("user", ""), ("assistant", "a")]),
    ({"messages": [{"role": "user"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", ""), ("assistant", "a")]),
    ({"messages": [None, {"role": "user", "content": "q"}]}, "messages", [("", ""), ("user", "q")]),
    ({"conversations": [], "system": "s"}, "from and value", [("system", "s")]),
    ({"messages": [{"role": "user", "content": [{"type": "text"}]}]}, "messages", [("user", '[{"type":"text"}]')]),
    ({"prompt": "p", "completion": None}, "prompt and completion", [("user", "p"), ("assistant", "")]),
    ({"instruction": "do", "input": None, "output": 7}, "instruction", [("user", "do"), ("assistant", "7")]),
    ({"messages": "no array"}, None, None),
    ({"unknown": 1}, None, None),
    ("no object", None, None),
]


def test_layouts_mixed_in_one_column(spark):
    rows = [(i, json.dumps(x)) for i, (x, _, _) in enumerate(LAYOUTS)] + [(98, "{broken"), (99, None)]
    found = {r.id: r for r in C.canonical_turns_json(spark.createDataFrame(rows, "id int, j string"), "j", "id").collect()}
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        assert found[i].layout == layout, i
        assert (found[i].turns and [(t.role, t.text) for t in found[i].turns]) == turns, i
    assert found[98].layout is None and found[99].layout is None


def test_typed_layouts(spark):
    df = spark.createDataFrame([(1, [("human", "q"), ("gpt", None)])], "conv_id int, conversations array<struct<from:string,value:string>>")
    assert [(t.role, t.text) for t in C.canonical_turns(df).first().turns] == [("user", "q"), ("assistant", "")]
    df = spark.createDataFrame([(1, "do", None, "done")], "conv_id int, instruction string, input string, output string")
    assert [(t.role, t.text) for t in C.canonical_turns(df).first().turns] == [("user", "do"), ("assistant", "done")]
    with pytest.raises(ValueError):
        C.canonical_turns(spark.range(1))


def test_the_fingerprint_is_that_of_spark(spark):
    paths = {"messages[].role", "messages[].content"}
    text = "\n".join(sorted(paths))
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == C.fingerprint(paths)


def test_query_digests(spark, tmp_path):
    from colloquy.llm.registry import HOSTILE, op1_chat_format

    spark.createDataFrame([(5, 0, "user", "é"), (5, 1, "assistant", None), (5, 2, "assistant", "😀<|x")], TURN_ROWS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op1_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[5].turns_sha256 == sha("user\né\nassistant\n\nassistant\n😀<|x\n")
    assert (got[5].n_turns, got[5].loss_chars, got[5].loss_sha256) == (3, 4, sha("😀<|x"))
    assert got[-1].turns_sha256 == sha(f"user\n{HOSTILE}\nassistant\n{HOSTILE}\n") and got[-1].loss_chars == len(HOSTILE)


def test_the_query_reads_the_mask(spark, tmp_path, monkeypatch):
    from colloquy.llm.registry import op1_chat_format

    spark.createDataFrame([(5, 0, "user", "question"), (5, 1, "assistant", "answer")], TURN_ROWS).write.parquet(str(tmp_path / "conversations.parquet"))
    right = C.loss_runs

    def all_texts(turns):  # a mask that learns users' texts too
        return F.transform(right(turns), lambda r, i: F.struct(r["chars"].alias("chars"), (i % 3 == 1).alias("learn")))

    monkeypatch.setattr(C, "loss_runs", all_texts)
    assert {r.conv_id: r.loss_chars for r in op1_chat_format(spark, str(tmp_path)).collect()}[5] == len("questionanswer")


def test_no_python_in_the_plan(spark):
    plan = C.format_chats(spark.createDataFrame([(1, 0, "user", "a")], TURN_ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
