from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracegrove.functions import answers as A

# stored, predicted, asymmetric, symmetric, without the binary rule
CASES = [
    ("10011000", "10011000", True, True, True),
    ("10011000", "10011001", False, False, True),
    ("24.64", "24.6401", True, True, True),
    ("XLVII", "xlvii", True, True, True),
    ("11011", "00011011", False, False, True),
    ("0.0", "0.009", True, False, False),
    ("0.0", "0.000001", True, True, True),
    ("0", "0.0", False, False, True),
    ("1_000", "1000", True, True, True),
    ("1d", "1", False, False, False),
    ("1d", "1D", True, True, True),
    ("inf", "inf", False, True, True),
    ("nan", "nan", False, False, False),
    ("-nan", "5", False, False, False),
    (" 5 ", "5.04", True, True, True),
    ("100", "101.005", False, False, True),
    ("200", "202", True, True, True),
    ("200", "202.01", False, True, True),
    ("", "", True, True, True),
    ("a", "", False, False, False),
]


def test_graders(spark):
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CASES)], "i int, s string, p string")
    s, p = F.col("s"), F.col("p")
    rows = df.select(
        "i",
        A.answers_match(s, p).alias("a"),
        A.answers_match(s, p, mode=A.SYMMETRIC).alias("b"),
        A.answers_match(s, p, mode=A.SYMMETRIC, binary_exact=False).alias("c"),
    ).collect()
    for r in rows:
        assert (r.a, r.b, r.c) == CASES[r.i][2:], CASES[r.i]


def test_unknown_mode():
    with pytest.raises(ValueError):
        A.answers_match(None, None, mode="other")


@pytest.mark.parametrize(
    ("text", "boxed", "final"),
    [
        (r"The answer is \boxed{42}", "42", "42"),
        ("The final answer is: 3.14", "", "3.14"),
        ("Just a number 100 in text", "", "100"),
        (None, "", "NOT_FOUND"),
        ("", "", "NOT_FOUND"),
        (r"\boxed{ } then \boxed{7}", "7", "7"),
        (r"\boxed{7} then \boxed{ }", "7", "7"),
        (r"\boxed{}", "", ""),
        ("open \\boxed{a\nb", "a\nb", "a\nb"),
        (r"\boxed{f{x}}", "f{x", "f{x"),
        ("final answer: x y \nno 5", "", "x y"),
        ("words\n  only words  \n\n", "", "only words"),
    ],
)
def test_extraction(spark, text, boxed, final):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(A.extract_answer(F.col("t")).alias("a"), A.extract_final_answer(F.col("t")).alias("f")).first()
    assert (r.a, r.f) == (boxed, final)


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        (r"so \boxed{1} and \boxed{2} end", r"so \boxed{1} and"),
        (r"so \boxed{1} and \boxed{ } end", "so"),
        (r"only \boxed{ } twice \boxed{} end", r"only \boxed{ } twice"),
        ("plain  \n", "plain"),
        ("a \\boxed{1}\n</think>\nb \\boxed{2}", "a"),
        (r"nested \boxed{ \boxed{5} }", "nested"),
    ],
)
def test_cut_before_final_box(spark, text, cut):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(A.cut_before_final_box(F.col("t"))).first()[0] == cut


def test_correctness_definitions(spark):
    rows = [
        (1, 0.0, r"\boxed{5}", "5", None),
        (2, 1.0, "no box", "5", "5"),
        (3, 1.0, r"\boxed{6}", "5", None),
        (4, 0.0, r"\boxed{6}", "5", ""),
        (5, None, r"\boxed{6}", "", None),
    ]
    df = spark.createDataFrame(rows, "i int, reward double, text string, answer string, pred string")
    c = [F.col(x) for x in ("reward", "text", "answer", "pred")]
    got = df.select(
        A.strictly_correct(*c), A.leniently_correct(*c), A.wrong_attempt(*c), A.wrong_attempt(*c, need_answer=True)
    ).collect()
    assert [tuple(r) for r in got] == [
        (False, True, False, False),
        (False, True, False, False),
        (False, True, False, False),
        (False, False, True, True),
        (False, False, True, False),
    ]
