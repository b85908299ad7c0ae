from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tracegrove.functions import hashing as H
from tracegrove.functions import text as X
from tracegrove.functions import tokens as K


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_example_is_cut_on_the_right(spark):
    tokens, mask = K.example(F.col("p"), F.col("c"), 4)
    r = one(spark, "p array<int>, c array<int>", ([1, 2], [3, 4, 5]), tokens.alias("t"), mask.alias("m"))
    assert (r.t, r.m) == ([1, 2, 3, 4], [0, 0, 1, 1])


def test_shift(spark):
    a, b, w = K.shift_for_training(F.col("t"), F.col("m"), F.lit(0.5), F.lit(-1.0))
    r = one(spark, "t array<int>, m array<tinyint>", ([1, 2, 3], [0, 1, 0]), a, b, w)
    assert tuple(r) == ([1, 2], [2, 3], [-0.5, 0.0])


@pytest.mark.parametrize("mask", [[], [1], [0, 0, 1, 1, 0], [1, 0, 1]])
def test_segments_and_back(spark, mask):
    tokens = list(range(10, 10 + len(mask)))
    seg = K.segments(F.col("t"), F.col("m"))
    df = spark.createDataFrame([(tokens, mask)], "t array<int>, m array<tinyint>").select(seg.alias("s"))
    got = df.first().s
    starts = [i for i in range(len(mask)) if i == 0 or mask[i] != mask[i - 1]]
    assert [s.pos for s in got] == starts
    assert all((s.type == "unmasked") == (mask[s.pos] == 1) for s in got)
    t, m = K.tokens_and_mask(F.col("s"))
    back = df.select(t.alias("t"), m.alias("m")).first()
    assert (back.t or [], back.m or []) == (tokens, mask)


def test_unknown_segment_type_fails(spark):
    df = spark.createDataFrame([([("other", 0, [1])],)], "s array<struct<type:string,pos:int,tokens:array<int>>>")
    with pytest.raises(Exception, match="unknown segment type"):
        df.select(K.tokens_and_mask(F.col("s"))[1]).collect()


@pytest.mark.parametrize(
    ("a", "b", "d"), [([1, 2], [3, 2], 0), ([1, 2, 3], [1, 9, 3], 1), ([1, 2], [1, 2, 3], 2), ([], [1], 0), ([1], [1], 1)]
)
def test_divergence(spark, a, b, d):
    assert one(spark, "a array<int>, b array<int>", (a, b), K.first_divergence(F.col("a"), F.col("b")))[0] == d


def test_jaccard_and_perplexity(spark):
    r = one(
        spark,
        "a array<int>, b array<int>, l array<double>, m array<tinyint>, z array<tinyint>",
        ([], [], [-1.0, -3.0, -5.0], [0, 1, 1], [0, 0, 0]),
        K.jaccard(F.col("a"), F.col("b")),
        K.perplexity(F.col("l"), F.col("m")),
        K.perplexity(F.col("l"), F.col("z")),
        K.mean_old_logp(F.col("l")),
    )
    assert r[0] == 1.0 and r[1] == pytest.approx(math.exp(4)) and math.isinf(r[2]) and r[3] == pytest.approx(-3.0)


def test_keep_head_and_tail(spark):
    r = one(spark, "a array<int>", (list(range(10)),), K.keep_head_and_tail(F.col("a"), 6, 2))
    assert r[0] == [0, 1, 2, 3, 8, 9]


def test_answer_span_falls_back_to_the_tail(spark):
    text = r"a b \boxed{1} c"
    offsets = [(0, 1), (2, 3), (100, 101), (100, 101)]
    w = K.weight_answer_span(F.col("w"), F.col("o"), F.lit(text), fallback_tail=2)
    r = one(spark, "w array<double>, o array<struct<lo:int,hi:int>>", ([1.0, 0.0, 0.2, 2.0], offsets), w)
    assert r[0] == [1.0, 0.0, 1.0, 4.0]


def test_hashes(spark):
    r = one(spark, "k string", ("a",), H.sha_mod(F.col("k"), 100), H.unit_interval(F.col("k")), H.short_id(F.lit("x"), F.lit(3)))
    digest = hashlib.sha256(b"a").digest()
    assert r[0] == int.from_bytes(digest, "big") % 100 == 99
    assert r[1] == int.from_bytes(digest[:8], "big") / 2**64
    assert r[2] == hashlib.sha256(b"x_3").hexdigest()[:8]


def test_byte_pieces(spark):
    pieces = ["a", "<0xE2>", "<0x89>", "<0xA0>", "b", "<0xE2>", "c", "<0xC3><0xA9>"]
    assert one(spark, "p array<string>", (pieces,), X.join_vocab_pieces(F.col("p")))[0] == "a\u2260b\ufffdc\u00e9"


@pytest.mark.parametrize(("n", "roman"), [(1, "I"), (4, "IV"), (1994, "MCMXCIV"), (3888, "MMMDCCCLXXXVIII"), (0, ""), (4100, "MMMMC")])
def test_roman(spark, n, roman):
    assert one(spark, "n bigint", (n,), X.to_roman(F.col("n")))[0] == roman


def test_equation_prompt(spark):
    text = "x Below are a few examples:\n12+3 = 15\nnoise\n4 = 5 = 6\nNow, determine the result for: 12+34 \nrest"
    r = one(spark, "t string", (text,), X.parse_equation_prompt(F.col("t")).alias("q")).q
    assert r.question == "12+34"
    assert [tuple(e) for e in r.examples] == [("12+3", "15"), ("4", "5 = 6")]
    assert one(spark, "t string", ("nothing",), X.parse_equation_prompt(F.col("t")))[0] is None


def test_hf_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"a": 0, "b": 1, "[UNK]": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "tok.json")
    tok.save(path)
    df = spark.createDataFrame([("a b c",), (None,), ("b",)], "t string")
    got = [r[0] for r in df.select(K.hf_tokenizer(path)(F.col("t"))).collect()]
    assert got == [[0, 1, 2], [], [1]]
