import hashlib
import random
import re

from pyspark.sql import functions as F

from foliomine.llm import chat_format as cf


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_hostile_texts_come_back(spark):
    rng = random.Random(6)
    pieces = ["\\", "</turn>", "### ", "\n", ": ", "#", "<", "/turn>", "a", "Assistant", "é\U0001f600", " ", ""]
    roles = ["user", "assistant", "a: b", "x</turn>", "\\", None, "### "]
    rows = [
        (i, j, rng.choice(roles), rng.choice([None, "".join(rng.choices(pieces, k=rng.randint(0, 9)))]))
        for i in range(1500)
        for j in range(rng.randint(1, 4))
    ]
    out = cf.format_conversations(conversations(spark, rows)).select("*", cf.parse(F.col("formatted")).alias("parsed"))
    said = {}
    for c, _, role, text in rows:
        said.setdefault(c, []).append((role or "", text or ""))
    levels = set()
    for r in out.collect():
        assert [tuple(t) for t in r["parsed"]] == said[r["conv_id"]]
        levels.add(r["level"])
    assert levels >= {0, 1}


def test_plain_texts_are_not_escaped_and_loss_covers_the_assistant(spark):
    rows = [(1, 1, "assistant", "Fine.\nThanks"), (1, 0, "user", "How: are you?"), (1, 2, "assistant", "x</turn>")]
    formatted = cf.format_conversations(conversations(spark, rows))
    row = formatted.first()
    assert row["formatted"] == (
        "### user: How: are you?</turn>\n### assistant: Fine.\nThanks</turn>\n### assistant: x<\\/turn></turn>\n"
    )
    d = cf.digest(formatted).first()
    loss = "Fine.\nThanksx</turn>"
    assert (d["n_turns"], d["loss_chars"]) == (3, len(loss))
    assert d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert d["formatted_chars"] == len(row["formatted"])


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (2, None, "user", "b"), (2, None, "user", "a"), (None, 1, "user", "word " * 40000)]
    frame = conversations(spark, rows).selectExpr("*", "'x' AS turns", "1 AS level", "'y' AS formatted")
    got = {r["conv_id"]: r for r in cf.format_conversations(frame).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("", ""), ("", "")]
    assert [t["text"] for t in got[2]["turns"]] == ["a", "b"]
    assert len(got) == 3 and cf.format_conversations(frame.where("false")).count() == 0


def test_no_python_on_the_main_path(table):
    plan = cf.digest(cf.format_conversations(table("conversations")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
