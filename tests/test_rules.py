from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracegrove.functions import text
from tracegrove.operators import rules, synth


def value(rule, x):
    family, i, j = rule
    a = x >> (7 - i) & 1 if i is not None else 0
    b = x >> (7 - j) & 1 if j is not None else 0
    if family.endswith("-NOT"):
        b = 1 - b
    table = {"I": a, "NOT": 1 - a, "0": 0, "1": 1, "XOR": a ^ b, "OR": a | b, "AND": a & b}
    return table[family.removesuffix("-NOT")]


def brute_force(pairs):
    vector = []
    for bit in range(8):
        fit = next((r for r in rules.bit_rules() if all(value(r, x) == y >> (7 - bit) & 1 for x, y in pairs)), None)
        if fit is None:
            return None
        vector.append(fit)
    return vector


def bits(n):
    return format(n, "08b")


@pytest.fixture(scope="module")
def problems():
    rng = random.Random(11)
    out = {}
    for p in range(12):
        xs = rng.sample(range(256), 8)
        step = rng.choice([1, 2, 3])
        f = [lambda x: (x << step | x >> (8 - step)) & 255, lambda x: x ^ 90, lambda x: x & x << 1 & 255, lambda x: rng.randrange(256)][p % 4]
        out[f"p{p}"] = [(x, f(x)) for x in xs]
    out["clash"] = [(1, 2), (1, 3)]
    return out


def test_bit_rules(spark, problems):
    assert len(rules.bit_rules()) == 354
    rows = [(p, f" {bits(x)} ", bits(y)) for p, pairs in problems.items() for x, y in pairs]
    rows += [("short", "0101", "01010101"), ("short", bits(3), bits(3))]
    df = spark.createDataFrame(rows, "problem_id string, input_value string, output_value string").repartition(5)
    want = {p: v for p, pairs in problems.items() if (v := brute_force(pairs)) is not None}
    got = {r.problem_id: [tuple(x) for x in r.vector] for r in rules.infer_bit_rules(df).collect()}
    assert got == want and "p0" in got and "clash" not in got
    packed = df.filter("problem_id <> 'short'").groupBy("problem_id").agg(F.collect_list(F.struct(F.trim("input_value").alias("input_value"), "output_value")).alias("e"))
    in_row = {r.problem_id: r.v and [tuple(x) for x in r.v] for r in packed.select("problem_id", rules.rules_of_examples(F.col("e")).alias("v")).collect()}
    assert {p: v for p, v in in_row.items() if v} == want
    questions = spark.createDataFrame([(p, bits(77)) for p in want], "problem_id string, question string")
    solved = {r.problem_id: r.solution for r in rules.solve_bits(df, questions).collect()}
    assert solved == {p: "".join(str(value(r, 77)) for r in v) for p, v in want.items()}


def test_generated_bit_problems_verify(spark, problems):
    rows = [(p, bits(x), bits(y)) for p, pairs in problems.items() for x, y in pairs]
    df = spark.createDataFrame(rows, "problem_id string, input_value string, output_value string")
    vectors = rules.infer_bit_rules(df)
    made = synth.evolve_bit_problems(vectors, ["add_operand", "longer_chain", "nest_op"]).collect()
    assert made
    for r in made:
        xs = [e.input_value for e in r.examples]
        assert len(set(xs)) == 8 and r.question not in xs
        again = brute_force([(int(e.input_value, 2), int(e.output_value, 2)) for e in r.examples])
        assert "".join(str(value(v, int(r.question, 2))) for v in again) == r.answer
    again = synth.evolve_bit_problems(vectors.repartition(9), ["add_operand", "longer_chain", "nest_op"]).collect()
    assert sorted(r.prompt for r in made) == sorted(r.prompt for r in again)


def test_family_vectors(spark):
    df = spark.createDataFrame([(f, 9) for f in rules.BIT_FAMILIES], "family string, wrong_rollouts bigint")
    made = synth.weakness_problems(df, top_k=10, per_family=3).collect()
    assert {r.family for r in made} == set(rules.BIT_FAMILIES)
    assert all(len([r for r in made if r.family == f]) == 3 for f in rules.BIT_FAMILIES)
    assert all({x.family for x in r.vector} == {r.family} for r in made)


def solve(spark, examples, question):
    rows = [("p", i, *e) for i, e in enumerate(examples)]
    eq = spark.createDataFrame(rows, "problem_id string, row_no bigint, a string, op string, b string, output_value string")
    q = spark.createDataFrame([("p", *question)], "problem_id string, a string, op string, b string")
    return rules.solve_equations(eq, q).first()


@pytest.mark.parametrize(
    ("examples", "question", "rule", "answer"),
    [
        ([("12", "+", "34", "46"), ("10", "+", "20", "30")], ("11", "+", "22"), "addition", "33"),
        # Reversed operands and result come first: 21 + 43 = 64, read backwards 46.
        ([("12", "+", "34", "46")], ("19", "+", "91"), "addition", "011"),
        ([("12", "*", "34", "1234")], ("56", "*", "78"), "reverse concatenation", "5678"),
        ([("30", "/", "12", "18"), ("12", "/", "30", "18/")], ("11", "/", "20"), "subtraction (a-b)", "9/"),
        ([("30", "@", "12", "18"), ("12", "@", "30", "18-")], ("11", "@", "20"), "subtraction (a-b)", "9@"),
        ([("12", "+", "34", "46"), ("10", "+", "20", "30")], ("40", "?", "15"), "absolute difference", "25"),
    ],
)
def test_equations(spark, examples, question, rule, answer):
    r = solve(spark, examples, question)
    assert (r.rule_name, r.solution) == (rule, answer)


def test_unexplained_equation(spark):
    assert solve(spark, [("12", "+", "34", "999999")], ("11", "+", "22")) is None


@pytest.mark.parametrize(
    ("examples", "question", "answer", "rule"),
    [
        ([("12+34", "46")], "1+2", "3", "addition"),
        ([("12+34", "46")], "1+2", "4", None),
        ([("ab+cd", "cdab")], "xy+zw", "zwxy", None),
        ([("12@34", "5")], "1", "3", None),
    ],
)
def test_consistency_gate(spark, examples, question, answer, rule):
    df = spark.createDataFrame([(examples, question, answer)], "e array<struct<input_value:string,output_value:string>>, q string, a string")
    assert df.select(rules.consistent_rule(F.col("e"), F.col("q"), F.col("a"))).first()[0] == rule


def test_linear(spark):
    ex = spark.createDataFrame([("p", "2.0", "5.0009"), ("p", "4", "10.4"), ("p", "0", "9"), ("p", "x", "1")], "problem_id string, input_value string, output_value string")
    q = spark.createDataFrame([("p", "3.21")], "problem_id string, question string")
    r = rules.solve_linear(ex, q).first()
    assert (r.factor, r.answer) == (2.5, 8.025)
    fall = spark.createDataFrame([("p", "2.0", "19.62"), ("p", "0", "1")], "problem_id string, input_value string, output_value string")
    r = rules.solve_linear(fall, q, squared=True).first()
    assert (r.factor, r.answer) == (4.905, 50.541)


def test_cipher(spark):
    ex = spark.createDataFrame(
        [("p", 0, "bcd b", "abc a"), ("p", 1, "b b", "x"), ("p", 2, "bb", "abc"), ("p", 3, "b", "z")],
        "problem_id string, row_no bigint, input_value string, output_value string",
    )
    maps = rules.substitution_maps(ex)
    assert maps.first().mapping == {"b": "a", "c": "b", "d": "c"}
    words = spark.createDataFrame([("cab",), ("bade",), ("base",), ("dad",), ("ode",)], "word string")
    q = spark.createDataFrame([("p", "dbc"), ("p", "cbef"), ("p", "cbef gef"), ("p", "zzz")], "problem_id string, question string")
    got = {r.question: r.solution for r in rules.solve_cipher(q, maps, words).collect()}
    assert got == {"dbc": "cab", "cbef": "bade", "cbef gef": "bade ode", "zzz": None}


def test_cipher_with_a_large_dictionary(spark):
    ex = spark.createDataFrame([("p", 0, "bcd", "abc")], "problem_id string, row_no bigint, input_value string, output_value string")
    more = spark.range(100_001).selectExpr("'k' || translate(CAST(id AS STRING), '0123456789', 'qrstuvwxyz') AS word")
    words = more.union(spark.createDataFrame([("bade",), ("ode",), ("cab",), (None,)], "word string"))
    q = spark.createDataFrame([("p", "cbef gef cbef"), ("p", "dbc"), ("p", "gbbbbbbb cbef"), ("p", "")], "problem_id string, question string")
    got = {r.question: r.solution for r in rules.solve_cipher(q, rules.substitution_maps(ex), words).collect()}
    assert got == {"cbef gef cbef": "bade ode bade", "dbc": "cab", "gbbbbbbb cbef": None, "": ""}


def test_large_numbers_are_not_lost(spark):
    ex = spark.createDataFrame([("a", "200000000.0", "400000000.0"), ("b", "2", "8"), ("c", "300000000", "90000000000000000")], "problem_id string, input_value string, output_value string")
    q = spark.createDataFrame([("a", "123456789.5"), ("b", "2000000"), ("c", "1")], "problem_id string, question string")
    got = {r.problem_id: float(r.answer) for r in rules.solve_linear(ex, q).collect()}
    assert got["a"] == 246913579.0 and got["b"] == 8000000.0
    squared = {r.problem_id: float(r.answer) for r in rules.solve_linear(ex, q, squared=True).collect()}
    assert squared["b"] == 8000000000000.0 and squared["c"] == 1.0


def test_long_operands(spark):
    df = spark.createDataFrame([("123456789012", "987654321098")], "l string, r string")
    v = rules.operands(F.col("l"), F.col("r"))
    out = df.select(*[c.alias(n) for n, c in v.items()]).select(*[c.alias(k) for k, c in rules.numeric_results({n: F.col(n) for n in v}).items()]).first()
    a, b = 123456789012, 987654321098
    assert out["multiplication"] == str(a * b) and out["multiply-1"] == str(a * b - 1)
    assert out["addition"] == str(a + b) and out["reverse subtraction (b-a)"] == str(b - a)


def test_numbers_in_ids_stay_whole(spark):
    got = spark.createDataFrame([(7,), (100000,)], "n int").select(text.padded(F.col("n"), 5).alias("p")).collect()
    assert [r.p for r in got] == ["00007", "100000"]


def test_numeric_ops_move_their_rows_once(spark):
    """All ways of writing negative results share one aggregate; each wins where its flag says so."""
    rows = [
        # a - b with the minus behind, before, the operator behind, before, and plain numbers.
        ("behind", 1, "12", "#", "34", "22-"), ("behind", 2, "50", "#", "20", "30"),
        ("before", 1, "12", "#", "34", "-22"), ("before", 2, "50", "#", "20", "30"),
        ("op behind", 1, "12", "#", "34", "22#"), ("op behind", 2, "50", "#", "20", "30"),
        ("op before", 1, "12", "#", "34", "#22"), ("op before", 2, "50", "#", "20", "30"),
        ("plain", 1, "12", "#", "34", "46"), ("plain", 2, "50", "#", "20", "70"),
        ("minus", 1, "12", "-", "34", "-22"), ("minus", 2, "50", "-", "20", "30"),
        ("none", 1, "12", "#", "34", "x"), ("none", 2, "50", "#", "20", "30"),
    ]
    df = spark.createDataFrame(rows, "problem_id string, row_no long, a string, op string, b string, output_value string")
    for parts in (1, 5):
        found = rules.infer_numeric_ops(df.repartition(parts))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") - plan.count("RoundRobin") - plan.count("REPARTITION") <= 1 and "Join" not in plan
        got = {r.problem_id: r for r in found.collect()}
        assert {k: r.fmt for k, r in got.items()} == {
            "behind": "neg_suffix", "before": "neg_prefix", "op behind": "neg_suffix", "op before": "neg_prefix",
            "plain": "num", "none": "num",
            "minus": "neg_prefix",
        }
        assert all(r.examples == 2 and r.first_row == 1 for r in got.values())
        assert got["plain"].rule_name == "addition" and got["none"].rule_name is None
        assert {got[k].rule_name for k in ("behind", "before", "op behind", "op before")} == {"subtraction (a-b)"}
