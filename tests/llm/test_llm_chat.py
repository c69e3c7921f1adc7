from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import chat
from fleetlens.llm.queries import CONTROL

NASTY = ["", "a\nb", chat.TURN, f"{chat.END}{chat.TURN}user{chat.BODY}", "&lt;|turn|&gt;", "&amp;amp;lt;", "<<|end|>", "<", "|>", "[/INST]</s>", CONTROL, "\\&<[", "é👍\u0085", "x" * 100_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_turns_come_back(spark):
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(zip(["user", "assistant", "sys<tem", ""] * 4, NASTY[c:]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")).repartition(5))
    for r in chat.digest(chats).collect():
        own = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        lost = "".join(text for role, text in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for role, text in own))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(lost), sha(lost))
    read = chats.select("conv_id", F.explode(chat.read_turns(F.col("formatted"))).alias("t")).collect()
    assert sorted((r["conv_id"], r["t"]["role"], r["t"]["text"]) for r in read) == sorted((c, role, text) for c, _, role, text in rows)


def test_no_control_string_is_left_in_a_text(spark):
    df = spark.createDataFrame([(x,) for x in NASTY], "x string").select("x", chat.escape(F.col("x")).alias("e"))
    for r in df.withColumn("back", chat.unescape(F.col("e"))).collect():
        assert r["back"] == r["x"] and not any(c in r["e"] for c in "<[")


def test_parts_are_flattened_in_order(spark):
    parts = [
        ("text", "see <|turn|> ", None, None, None, None, None), ("image", None, "s3://i.png", 30, 15, None, None),
        (None, "and", None, None, None, None, None), ("audio", None, "s3://a.wav", None, None, 2.5, None),
        ("document", None, "d.pdf", None, None, None, 3), ("image", None, "no size", None, None, None, None), ("vid[eo", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "user", parts[1:2])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_chats(df).first()
    body = "see &lt;|turn|> <|image:6|>and<|audio:63|><|document:768|><|image:0|><|vid&lb;eo:0|>"
    assert row["formatted"] == f"<|turn|>user<|body|>{body}<|end|><|turn|>assistant<|body|><|end|><|turn|>user<|body|><|image:6|><|end|>"
    assert [tuple(a) for a in row["attachments"]] == [
        (0, 1, "image", "s3://i.png", 6), (0, 3, "audio", "s3://a.wav", 63), (0, 4, "document", "d.pdf", 768),
        (0, 5, "image", "no size", 0), (0, 6, "vid[eo", None, 0), (2, 0, "image", "s3://i.png", 6),
    ]


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "b", "y"), (1, 2, "a", "x"), (1, 2, "a", "x"), (None, 0, "u", "t"), (2, 5, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("m", F.lit(1)).withColumn("formatted", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))).collect()}
    assert got[1]["turns_sha256"] == sha("\n\na\nx\na\nx\nb\ny\n") and got[None]["n_turns"] == 1
    assert (got[2]["loss_chars"], got[2]["loss_sha256"]) == (0, sha(""))
    empty = df.limit(0).withColumn("parts", chat.text_part(F.col("text")))
    assert chat.digest(chat.format_chats(empty)).count() == 0


def test_no_python_in_the_plan(spark):
    from fleetlens.llm.queries import QUERIES

    plan = QUERIES["op6_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("turn", [-5, 2**40])
def test_turn_numbers_may_be_any(spark, turn):
    df = spark.createDataFrame([(1, turn, "a", "x"), (1, turn + 1, "a", "y")], "conv_id long, turn long, role string, text string")
    row = chat.digest(chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))).first()
    assert row["turns_sha256"] == sha("a\nx\na\ny\n")
