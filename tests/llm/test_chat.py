"""Formatting and reading back conversations: an exact round trip, and spans and counts by hand."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cantera.llm import chat
from cantera.session import shared_folder

SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def part(kind, text=None, reference=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, reference, width, height, seconds, pages)


def test_parts_become_ordered_placeholders(spark):
    pages = [("page <|image 9|> one", [("p1.png", 56, 29)]), (None, None)]
    message = [
        part("text", "see # this: "),
        part("image", reference="a.png", width=57, height=28),
        part("document", reference="d.pdf", pages=pages),
        part("audio", reference="s.wav", seconds=1.01),
        part("video", reference="v.mp4"),
        part("text", "</turn>"),
    ]
    row = chat.format_turns(spark.createDataFrame([(1, 0, "assistant", message)], SCHEMA)).first()
    body = "see \\# this: <|image 1|><|document 2|>page <\\|image 9|> one<|image 4|><|audio 6|><|other 7|><\\/turn>"
    assert row.formatted == f"### assistant:\n{body}\n</turn>\n"
    assert row.formatted[row.loss_start : row.loss_end] == body
    assert [tuple(a) for a in row.attachments] == [
        (1, "image", "a.png", 3), (2, "document", "d.pdf", 8), (4, "image", "p1.png", 4), (6, "audio", "s.wav", 26), (7, "other", "v.mp4", 0),
    ]
    assert row.expanded_tokens == 41
    assert chat.read_turn(row.formatted) == ("assistant", "see # this: page <|image 9|> one</turn>")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\#</turn>|:\n ne1é", max_size=30))
def test_escapes_undo(text):
    written = text
    for plain, mark in chat.ESCAPES:
        written = written.replace(plain, mark)
    assert chat.plain(written) == text and "</turn>" not in written and "### " not in written


def test_round_trip_of_odd_turns(spark):
    texts = [None, "", "\\", "\\n", "</turn>", "<|image 1|>", "### user:\nhi\n</turn>\n", "#" * 7, "🙂 \\### Assistant: </turn> ok", "é" * 100_000]
    roles = ["user", "assistant", None, "", "a:\nb", "assistant", "sys\\tem", "### x:", "assistant", "assistant"]
    rows = [(1, i, role, text) for i, (role, text) in enumerate(zip(roles, texts))] + [(None, None, "user", "x"), (None, 0, "assistant", "y"), (2, 0, "user", "z"), (2, 0, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    odd = turns.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"), *[F.lit("7").alias(c) for c in ("key", "items", "head", "body", "formatted", "text")])
    written = chat.format_turns(odd)
    assert written.columns == ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"]
    result = {r.conv_id: r for r in chat.read_back(written).collect()}
    assert set(result) == {1, 2, None} and result[2].n_turns == 2 and result[None].loss_chars == 1
    whole = "".join(f"{role or ''}\n{text or ''}\n" for role, text in zip(roles, texts))
    learned = "".join(t or "" for r, t in zip(roles, texts) if r == "assistant")
    assert result[1].n_turns == 10 and result[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert result[1].loss_chars == len(learned) and result[1].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    sizes = {r.conv_id: r.n for r in written.groupBy("conv_id").agg(F.sum(F.char_length("formatted")).alias("n")).collect()}
    assert {k: r.formatted_chars for k, r in result.items()} == sizes
    assert chat.read_back(chat.format_turns(odd.limit(0))).count() == 0


def test_null_parts_and_messages(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, "user", []), (1, 2, "user", [part("text"), part(None), part("image"), part("document")])], SCHEMA)
    found = [r.formatted for r in chat.format_turns(rows).orderBy("turn").collect()]
    assert [f[len("### user:\n") : -len(chat.END)] for f in found] == ["", "", "<|other 1|><|image 2|><|document 3|>"]


def test_one_conversation_may_hold_most_turns(spark):
    """Its turns are read as a stream: nothing but a digest is held, and formatting shuffles nothing."""
    shared_folder(spark)
    turns = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text")
    )
    written = chat.format_turns(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    assert "Exchange" not in written._jdf.queryExecution().executedPlan().toString()
    row = chat.read_back(written).where("conv_id = 5").first()
    assert row.n_turns == 20_000
    texts = [i for i in range(30_000) if i % 3]
    assert row.turns_sha256 == hashlib.sha256("".join(f"user\n{i}\n" for i in texts).encode()).hexdigest()


@pytest.mark.parametrize("bad", ["", "x", "### user:\nhi", "### user:\na\n</turn>\n### user:\nb\n</turn>\n"])
def test_what_is_no_turn(bad):
    with pytest.raises(ValueError):
        chat.read_turn(bad)
