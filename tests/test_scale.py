"""Work is dealt over tasks however small the files of a table are, and is not done over and over."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracegrove.operators import mining, rollouts, rules, synth
from tracegrove.plans import source_queries
from tracegrove.plans import views as V
from tracegrove.sources import tables


@pytest.mark.parametrize(("name", "key"), [("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")])
def test_seed_tables_are_spread(spark, folder, name, key):
    spark.range(100).withColumnRenamed("id", key).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    assert V.table(spark, folder, name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_sampled_logprob_of_token_1000(spark, folder):
    part = spark.createDataFrame([(1, "t", 9.5, 3)], "p_partkey bigint, p_type string, p_retailprice double, p_size int")
    part.write.parquet(f"{folder}/part.parquet")
    lines = [(7, 1, k, n, 5.0, 10.0, 0.25, 0.5, "A", "F") for k in (999, 1000) for n in (1, 4, 5, 6, 7)]
    kinds = "bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(lines, f"l_orderkey {kinds}, l_returnflag string, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    got = {(r.row_sub // 16777216, r.row_no - 56): r.logprob for r in entry.RUNS["sampled_logprob"](spark, folder).collect()}
    want = {1: -0.5, 4: -0.25, 5: -0.25, 6: 0.0, 7: 0.0}
    assert got == {(k, n): v for k in (999, 1000) for n, v in want.items()}


def test_vectors_are_tried_as_they_are_verified(spark):
    rng = random.Random(3)
    table = rules.bit_rules()
    rows = [(f"p{k}", [table[rng.randrange(len(table))] for _ in range(8)], rng.randrange(3, 12)) for k in range(60)]
    df = spark.createDataFrame(rows, "problem_id string, vector array<struct<family:string,primary:int,secondary:int>>, n int")
    made = synth.bit_problems(df, F.col("n"), 5)
    again = rules.rules_of_examples(F.col("examples"))
    slow = F.coalesce(rules.apply_bit_rules(F.col("question"), again) == F.col("answer"), F.lit(False))
    tried = df.withColumn("tried", rules.rules_explained(F.col("vector"), *synth._walk(5, F.col("problem_id")), F.col("n")))
    both = synth.verify_bit_problems(made).withColumn("slow", slow).join(tried.select("problem_id", "tried"), "problem_id").collect()
    assert len(both) == 60 and {r.slow for r in both} == {True, False}
    assert all(r.verified == r.slow == r.tried for r in both)


def test_only_open_variants_are_tried_again(spark, monkeypatch):
    """The rounds choose what all attempts at once would."""
    vector = [("XOR", i, (i + 3) % 8) for i in range(8)]
    df = spark.createDataFrame([(f"p{k}", vector) for k in range(10)], "problem_id string, vector array<struct<family:string,primary:int,secondary:int>>")
    ops = ["add_operand", "nest_op"]
    rounds = sorted(synth.evolve_bit_problems(df, ops, attempts=20).collect())
    monkeypatch.setattr(synth, "ROUNDS", ())
    assert rounds and rounds == sorted(synth.evolve_bit_problems(df, ops, attempts=20).collect())


def test_files_grow_with_the_rows(spark, folder):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit("en").alias("lang"))
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        parts = source_queries._part_folders(spark, folder)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for _, path in parts:
        files = sorted(Path(path).glob("*.parquet"))
        spans = [spark.read.parquet(str(f)).agg(F.min("row_no"), F.max("row_no")).first() for f in files]
        assert len(files) > 6 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def counted(spark, column, keep=None):
    """(counter, column that counts the rows it is computed for)."""
    counter = spark.sparkContext.accumulator(0)

    def seen(value):
        if keep is None or keep in value:
            counter.add(1)
        return value

    return counter, F.udf(seen, "string")(column)


def test_a_walk_reads_its_rows_once(spark):
    """every round made the rows anew."""
    rows = spark.createDataFrame([("p", k, [k, k + 1]) for k in range(10)], "pid string, row_no int, ids array<int>")
    counter, pid = counted(spark, F.col("pid"))
    got = mining.greedy_diverse(rows.withColumn("pid", pid), key="pid", order=["row_no"], items="ids", k=3, threshold=0.1).collect()
    assert [r.row_no for r in sorted(got, key=lambda r: r.pick_no)] == [0, 2, 4] and counter.value == 10


def test_gold_fixes_are_tokenised_once_a_problem(spark):
    """the fix of a problem was cut into tokens again for each of its rollouts."""
    kinds = "problem_id string, category string, prompt_token_ids array<int>, text string, pred string, reward double, row_no int"
    rollouts = spark.createDataFrame([("p", "c", [1], f"try {k}, so \\boxed{{{k}}}", "", 0.0, k) for k in range(20)], kinds)
    gold = spark.createDataFrame([("p", "c", "we get \\boxed{99}", 0), ("q", "c", "none", 0)], "problem_id string, category string, completion_text string, row_no int")
    counter, _ = counted(spark, F.lit(""))

    @F.udf("array<string>")
    def pieces(text):
        if text is not None and text.startswith(" ## "):
            counter.add(1)
        return text.split(" ")

    got = mining.corrections(rollouts, gold, ["row_no"], ["row_no"], tokenizer=pieces, bridge=" ## ").collect()
    assert [(r.row_no, r.attempt) for r in got] == [(0, "try 0, so")] and counter.value == 1


def test_corrections_read_boxes_left_open_by_an_attempt(spark):
    """A box that the attempt opens and the fix closes counts as it would in the whole text."""
    kinds = "problem_id string, category string, prompt_token_ids array<int>, text string, pred string, reward double, row_no int"
    rollouts = spark.createDataFrame([("p", "c", [1], "a \\boxed{5 then \\boxed{6}", "6", 0.0, 1), ("p", "c", [1], "plain 7", "7", 0.0, 2)], kinds)
    gold = spark.createDataFrame([("p", "c", "so \\boxed{9}", 0)], "problem_id string, category string, completion_text string, row_no int")
    rollouts = rollouts.withColumn("prompt_token_ids", F.array(F.lit(1)))
    got = mining.corrections(rollouts, gold, ["row_no"], ["row_no"], bridge=" ## ").collect()
    assert len(got) == 1 and got[0].learning.startswith(" ## so \\boxed{9}")


def test_rules_are_inferred_once_for_the_answers(spark):
    """the rules of all problems were inferred twice."""
    counter, a = counted(spark, F.col("a"))
    examples = spark.createDataFrame([("p", k, str(10 + k), "+", "20", str(30 + k)) for k in range(9)], "problem_id string, row_no int, a string, op string, b string, output_value string")
    asked = spark.createDataFrame([("p", "11", "+", "22"), ("p", "11", "?", "22")], "problem_id string, a string, op string, b string")
    got = {r.op: r.solution for r in rules.solve_equations(examples.withColumn("a", a), asked).collect()}
    assert got == {"+": "33", "?": "11"} and counter.value == 9


def test_results_are_compared_as_longs(spark):
    """each result was written out as text for each comparison."""
    v = {n: F.col(n) for n in rules.OPERANDS}
    assert sum(r.is_long for r in rules.numeric_values(v).values()) == 25
    big = str(2**62)
    rows = [("long", 1, "12", "*", "12", "144"), ("wide", 1, big, "*", "4", str(2**64)), ("plus", 1, "12", "*", "12", "+144"), ("none", 1, "12", "*", "12", None)]
    rows += [("digits", 1, "12", "*", "34", "38"), ("reversed", 1, "12", "*", "34", "3412")]
    df = spark.createDataFrame(rows, "problem_id string, row_no int, a string, op string, b string, output_value string")
    got = {r.problem_id: r.rule_name for r in rules.infer_numeric_ops(df).collect()}
    assert got["long"] == "multiplication" and got["wide"] == "multiplication" and got["plus"] is None and got["none"] is None
    assert got["digits"] == "digit multiply" and got["reversed"] == "concatenation"


def test_segments_move_as_text(spark):
    """every word moved as an element of an array."""
    odd = [["a", "b c", "", "d"], ["x", None, "\x00", "é"], [""], ["p", "q", "r", "s"]]
    rows = spark.createDataFrame([(f"k{i}", t, [(j // 2) % 2 for j in range(len(t))]) for i, t in enumerate(odd)], "problem_id string, tokens array<string>, mask array<tinyint>")
    packed = tables._packed_segments(tables.segments_of(rows), True).select("problem_id", "_segment.*").collect()
    assert {(r.problem_id, r.text) for r in packed if r.tokens is None} == {("k0", "a\x00b c"), ("k0", "\x00d"), ("k2", ""), ("k3", "p\x00q"), ("k3", "r\x00s")}
    back = tables.rows_from_segments(tables.segments_of(rows))
    assert sorted((r.problem_id, r.tokens, r.mask) for r in back.collect()) == sorted((r.problem_id, r.tokens, r.mask) for r in rows.collect())


def test_detokenised_rows_move_once(spark):
    """the rows were moved once more to meet their texts."""
    rows = spark.createDataFrame([(1, [1, 2], "x"), (1, [2], "y"), (2, [], "z"), (3, None, "w"), (None, [1], "n"), (4, [None, 9], "u")], "k int, ids array<int>, other string")
    vocab = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "token_id int, token string")
    texts = tables.detokenise(rows, "ids", vocab, ["k"])
    got = sorted(((r.k, r.ids, r.other, r.text) for r in texts.collect()), key=lambda r: r[2])
    assert got == [(None, [1], "n", ""), (4, [None, 9], "u", "<unk:null><unk:9>"), (3, None, "w", ""), (1, [1, 2], "x", "aabb"), (1, [2], "y", "aabb"), (2, [], "z", "")]
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    short = tables.detokenise(rows, "ids", vocab, ["k"], keep_ids=False).select("k", "text").collect()
    assert sorted(short, key=str) == sorted(texts.select("k", "text").collect(), key=str)


def test_answers_are_extracted_once_for_grading(spark):
    """the answer of a text was extracted once for the prediction and again for the reward."""
    kinds = "problem_id string, answer string, prompt_token_ids array<int>, completions array<struct<token_ids:array<int>,text:string,logprobs:array<map<string,double>>>>"
    outputs = spark.createDataFrame([("p", "5", [1], [([1], "so \\boxed{5}", None), ([1], "so \\boxed{6}", None)])], kinds)
    graded = rollouts.records_from_outputs(outputs, "probe").select("sample_no", "pred", "reward")
    assert sorted(tuple(r) for r in graded.collect()) == [(0, "5", 1.0), (1, "6", 0.0)]
    assert graded._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def plain_line(kind, *own):
    """Symbols of a parallel row by hashlib; a null key is left out of the text."""

    def bits(*keys):
        return int(hashlib.sha256("|".join(str(k) for k in ("0", *keys) if k is not None).encode()).hexdigest()[:13], 16)

    if kind == "lstrip":
        size = 5 if bits("half", kind, *own) % 2 == 0 else 1 + bits("length", kind, *own) % 10
    else:
        size = 2 + bits("length", kind, *own) % 7
    return "".join(synth.SYMBOLS[bits(kind, *own, i) % len(synth.SYMBOLS)] for i in range(1, size + 1))


@pytest.mark.parametrize("kind", ["concatenation", "splitting", "lstrip"])
def test_parallel_rows_of_seeds_in_one_task(spark, kind):
    seeds = spark.createDataFrame([(k,) for k in (1, 1, -5, 10**15, None)], "problem_no bigint").coalesce(1)
    lines = synth.parallel_row_lines(seeds, kind)
    assert lines.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "lambdafunction" not in lines._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((str(r.problem_no), r.part, r.line_no, r.input_text, r.output_text) for r in lines.collect())
    want = []
    for k in (1, 1, -5, 10**15, None):
        for n in range(-3, 100):
            s = plain_line(kind, k, n)
            each, whole = "".join(f"\u3010{c}\u3011" for c in s), f"\u3010{s}\u3011"
            texts = {"concatenation": (each, whole), "splitting": (whole, each), "lstrip": (f"\u3010 {s}\u3011", whole)}[kind]
            want.append((str(k), "demo" if n < 0 else "row", n + 3 if n < 0 else n, *texts))
    assert got == sorted(want)


def test_characters_without_lambda(spark):
    from tracegrove.functions import text as X

    rows = spark.createDataFrame([("",), (None,), ("a b",), ("x\n\u3010\U0001f600",), ("  ",)], "c string").select(X.chars(F.col("c")).alias("c"), X.bracket_each(F.col("c")).alias("e"))
    assert "lambdafunction" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.c, r.e) for r in rows.collect()] == [
        ([], ""),
        (None, None),
        (["a", " ", "b"], "\u3010a\u3011\u3010 \u3011\u3010b\u3011"),
        (["x", "\n", "\u3010", "\U0001f600"], "\u3010x\u3011\u3010\n\u3011\u3010\u3010\u3011\u3010\U0001f600\u3011"),
        ([" ", " "], "\u3010 \u3011\u3010 \u3011"),
    ]
