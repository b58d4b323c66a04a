"""Questions to clients that fail, are busy, or give something else than was asked for."""

import json
import os

from pyspark.sql import functions as F

from turnloom.operators import asking

FIELDS = {"same": "boolean", "who": ("left", "right"), "n": "bigint", "p": "double", "why": "string"}
GOOD = {"same": True, "who": "left", "n": 3, "p": 0.5, "why": "ü"}


def _client(log: str, replies: dict):
    """Each prompt's replies in turn, the last one again and again; calls are noted in a file, as clients live in workers."""

    def make():
        seen = {}

        def ask(prompt: str) -> str:
            with open(log, "a") as f:
                f.write(prompt + "\n")
            own = replies[prompt]
            k = seen[prompt] = seen.get(prompt, -1) + 1
            reply = own[min(k, len(own) - 1)]
            if reply == "busy":
                raise asking.Busy("429")
            if reply == "broken":
                raise ValueError("boom")
            return reply

        return ask

    return make


def _reply(text: str) -> str:
    return json.dumps({"output": [{"content": [{"type": "reasoning", "text": "hm"}]}, {"content": [{"type": "output_text", "text": text}]}]})


def test_faults_of_answers(spark):
    cases = {
        json.dumps(GOOD): None, "no json": "no JSON object", "[1]": "no JSON object", "null": "no JSON object", json.dumps(GOOD | {"more": 1}): "unasked: more", json.dumps({k: v for k, v in GOOD.items() if k != "n"}): "n is missing",
        json.dumps(GOOD | {"same": "true"}): "same is no boolean", json.dumps(GOOD | {"who": "up"}): "who is none of its choices", json.dumps(GOOD | {"n": 1.5}): "n is no bigint", json.dumps(GOOD | {"why": None}): "why is no string", json.dumps(GOOD | {"p": 2}): None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", asking.strict_fault(F.col("t"), FIELDS).alias("fault"))
    assert {r.t: r.fault for r in df.collect()} == cases


def test_texts_of_replies(spark):
    replies = {_reply("x"): "x", json.dumps({"output_text": "y"}): "y", "{}": None, "broken {": None, json.dumps({"output": [{"content": [{"text": "a"}, {"text": "b"}]}]}): "ab"}
    df = spark.createDataFrame([(t,) for t in replies], "t string").select("t", asking.reply_text(F.col("t")).alias("text"))
    assert {r.t: r.text for r in df.collect()} == replies


def test_retries_faults_and_cache(spark, tmp_path):
    log, cache = str(tmp_path / "log"), str(tmp_path / "cache")
    good = _reply(json.dumps(GOOD))
    replies = {"at once": [good], "third time": ["busy", "busy", good], "always busy": ["busy"], "broken": ["broken"], "bad json": [_reply("{")], "wrong type": [_reply(json.dumps(GOOD | {"same": 1}))]}
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*replies, "at once", None])], "id int, prompt string")
    ask = lambda replies: asking.strictly_asked(df, F.col("prompt"), FIELDS, _client(log, replies), cache, pause_s=0.01, rounds=2, partitions=2)
    got = {r.id: r for r in ask(replies).collect()}
    assert len(got) == 8 and {i: r.answer_error for i, r in got.items()} == {0: None, 1: None, 2: "busy: 429", 3: "ValueError: boom", 4: "no JSON object", 5: "same is no boolean", 6: None, 7: "no prompt"}
    assert got[6].answer.asDict() == GOOD and got[2].answer is None
    calls = open(log).read().split("\n")
    assert calls.count("at once") == 1 and calls.count("third time") == 3 and calls.count("always busy") == asking.ATTEMPTS and calls.count("broken") == 1
    os.remove(log)
    again = {r.id: r.answer_error for r in ask(dict.fromkeys(replies, [good])).collect()}
    assert again == {**dict.fromkeys(range(7)), 7: "no prompt"}
    assert sorted(set(open(log).read().split())) == sorted("always busy broken bad json wrong type".split())  # what was sound isn't asked again


def test_a_judge_of_a_client(spark, tmp_path):
    yes, no = (_reply(json.dumps({"answer": x})) for x in (True, False))
    judge = asking.strict_judge(_client(str(tmp_path / "log"), {"a": [yes], "b": [no], "c": ["broken"]}), str(tmp_path / "cache"), "same", F.col("left_text"))
    got = {r.left_text: (r.same, r.same_error) for r in judge(spark.createDataFrame([("a",), ("b",), ("c",)], "left_text string")).collect()}
    assert got == {"a": (True, None), "b": (False, None), "c": (False, "ValueError: boom")}
    assert asking.choice(("x", "y")) == {"choice": ("x", "y")}
