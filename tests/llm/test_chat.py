"""Chat formatting: every kind of part, reversibility on control strings, nulls, ties, clashing names, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from tremor.llm import chat, registry

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, parts int, n_turns string"
AWKWARD = ["", "<", "\\", "</turn>", "<\\turn>", "<\\\\text", "<text", "<turn>user<text>hi</turn>\n", "<image 2>", "\n</turn>\n<turn>", "<<turn<\\", "$1 \\1", "é<turn ß", "text", None, "x" * 50_000 + "</turn>" * 300]


def turns(spark):
    draw = random.Random(3)
    rows = [(k // 4, k % 4, draw.choice(["user", "assistant", "system", "<turn>", "", None]), draw.choice(AWKWARD), "f", 1, "n") for k in range(160)]
    rows += [(100, None, "assistant", "first", "f", 1, "n"), (100, 2, "user", "b", "f", 1, "n"), (100, 2, "user", "a", "f", 1, "n"), (100, 2, "user", "a", "f", 1, "n"), (None, 0, "assistant", "no id", "f", 1, "n"), (101, None, None, None, "f", 1, "n")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def test_conversations_come_back_whole(spark):
    df, rows = turns(spark)
    out = chat.format_conversations(df).withColumns({"read": chat.read_turns(F.col("formatted")), "learnt": chat.read_loss(F.col("formatted"), F.col("loss"))}).collect()
    by = {}
    for c, t, role, text, *_ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert {r.conv_id for r in out} == by.keys()
    for r in out:
        want = [x[1:] for x in sorted(by[r.conv_id])]
        got = [(t.role, t.text) for t in r.read]
        assert sorted(got) == sorted(want) and r.n_turns == len(want)
        if len({x[0] for x in by[r.conv_id]}) == len(want):
            assert got == want
        assert r.learnt == "".join(text for role, text in got if role == "assistant")
        assert r.formatted.count("</turn>\n") == r.n_turns and r.expanded_tokens == 0 and not r.attachments


def test_parts_become_placeholders(spark):
    kinds = "conv_id long, turn long, role string, text string, content array<" + chat.PART + ">"
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    rows = [
        (1, 0, "user", "unused", [part("text", "see <image 2>"), part("image", ref="a.png", width=57, height=28), None, part("text", "|and"), part("audio", ref="b.wav", seconds=1.02), part("document", ref="c.pdf", pages=3)]),
        (1, 1, "assistant", None, [part("text", "one "), part("image"), part("text", "<turn>")]),
        (1, 2, "assistant", "plain", None),
        (2, 0, "user", None, []),
    ]
    df = spark.createDataFrame(rows, kinds)
    one, two = sorted(chat.format_conversations(df, parts="content").withColumns({"read": chat.read_turns(F.col("formatted")), "learnt": chat.read_loss(F.col("formatted"), F.col("loss"))}).collect(), key=lambda r: r.conv_id)
    assert one.formatted == "<turn>user<text>see <\\image 2><image 2><text>|and<audio 4><document 5></turn>\n<turn>assistant<text>one <image 2><text><\\turn></turn>\n<turn>assistant<text>plain</turn>\n"
    assert [tuple(a) for a in one.attachments] == [(1, 2, "image", "a.png", 3), (1, 4, "audio", "b.wav", 26), (1, 5, "document", "c.pdf", 1536), (2, 2, "image", None, 1)]
    assert one.expanded_tokens == 1566 and one.learnt == "one <turn>plain"
    assert [tuple(t) for t in one.read] == [("user", "see <image 2>|and"), ("assistant", "one <turn>"), ("assistant", "plain")]
    assert two.formatted == "<turn>user</turn>\n" and two.learnt == "" and tuple(two.read[0]) == ("user", "")
    with pytest.raises(Exception, match="no such part"):
        chat.format_conversations(spark.createDataFrame([(1, 0, "user", None, [part("video")])], kinds), parts="content").collect()


def test_escapes_are_reversible(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice(["<", "\\", "/", "turn", "text", "image 1", ">", "x", "\n"]) for _ in range(draw.randint(0, 12))) for _ in range(2000)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect()
    assert all(r.t == r.u for r in out)
    assert not any(m in r.e for r in out for m in ("<turn", "</turn", "<text", "<image"))


def test_query_and_empty_table(spark, tmp_path):
    df, _ = turns(spark)
    df.write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = registry.op11_chat(spark, f"{tmp_path}/a")
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert {r.conv_id for r in got.collect()} >= {-7, None, 0, 101}
    df.limit(0).write.parquet(f"{tmp_path}/b/conversations.parquet")
    (only,) = registry.op11_chat(spark, f"{tmp_path}/b").collect()
    assert (only.conv_id, only.n_turns, only.loss_chars) == (-7, 2, len(chat.POISON))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "ExistingRDD"))
