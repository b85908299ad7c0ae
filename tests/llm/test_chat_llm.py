"""Chat formatting: parts, escaping, loss mask and reading back."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracegrove.llm import chat

SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>, extra string, formatted string"


def text(t):
    return ("text", t, None, None, None, None, None)


def formatted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = chat.format_conversations(df)
    turns = chat.read_turns(F.col("formatted"))
    return {r.conv_id: r for r in out.select("*", turns.alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("lost")).collect()}


def test_texts_come_back_whatever_they_hold(spark):
    nasty = ["<|turn|>x<|body|>", "&lt;|end|&gt;", "a\\&amp;<", "|end|>", "", "é\n<|part:image|>", "</s>[INST] ok [/INST]", "$1\\E<"]
    rows = [(1, k, "assistant" if k % 2 else "user", [text(t)], "x", "y") for k, t in enumerate(nasty)]
    got = formatted(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [(r[2], n) for r, n in zip(rows, nasty, strict=True)]
    assert got.lost == "".join(nasty[1::2])
    assert len(got.loss_spans) == 4


def test_parts_become_ordered_placeholders(spark):
    image = ("image", None, "s3://i", 56, 29, None, None)
    audio = ("audio", None, "a.wav", None, None, 2.0, None)
    paper = ("document", None, "d.pdf", None, None, None, 3)
    odd = ("<video", None, "v", None, None, None, None)
    rows = [(1, 1, "assistant", [text("a<"), text("|end|>"), odd], None, None), (1, 0, "user", [image, text("see"), audio, paper], None, None)]
    got = formatted(spark, rows)[1]
    assert got.turns[0].text == "<|part:image|>see<|part:audio|><|part:document|>"
    assert got.turns[1].text.startswith("a<|end|><|part:")
    assert [(a.ordinal, a.turn_no, a.kind, a.ref, a.n_tokens) for a in got.attachments] == [
        (1, 1, "image", "s3://i", 4),
        (2, 1, "audio", "a.wav", 50),
        (3, 1, "document", "d.pdf", 768),
        (4, 2, "<video", "v", 1),
    ]
    assert got.attachment_tokens == 823


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(None, None, None, None, None, None), (2, 0, "user", [text("b")], None, None), (2, 0, "user", [text("a")], None, None), (2, 0, "user", [text("a")], None, None)]
    got = formatted(spark, rows)
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert [t.text for t in got[2].turns] == ["a", "a", "b"]
    assert got[2].lost == "" and got[2].loss_spans == []
    assert formatted(spark, []) == {}


def test_a_very_long_text_is_kept_whole(spark):
    long = "<&x" * 200_000
    got = formatted(spark, [(1, 0, "assistant", [text(long)], None, None)])[1]
    assert got.turns[0].text == long and got.lost == long


def test_templates_must_be_told_apart():
    with pytest.raises(ValueError):
        chat.ChatTemplate(turn="[INST]")
    with pytest.raises(ValueError):
        chat.ChatTemplate(turn="<|a", body="<|a|>")
