"""A cross-section of the registered queries against their oracles on the smallest data."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracles import TABLES, table_of
from tracegrove.operators import mixing

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "correctness_flags",
    "mine_positives",
    "mine_weighted_negatives",
    "step_negatives",
    "merge_corpus",
    "merge_by_source",
    "mixture_resample",
    "accuracy_report",
    "review_state",
    "diff_percentiles",
    "decipher",
    "matching_sections",
    "stream_step_losses",
    "stream_graded_rollouts",
    "annealed_sample",
    "bucketed_gold_join",
    "category_volume_order",
    "evolve_equations",
    "infer_numeric_ops",
    "jsonl_round_trip",
    "merge_files_to_budget",
    "merge_summary_observed",
    "missing_gold",
    "row_problems",
    "seeded_shuffle",
    "stratified_batches",
    "yield_report",
]
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    res = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    assert table_of(df.columns, df.collect()) == table_of(names, res.fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_augmentation_above_the_limit_fails(spark):
    problems = spark.createDataFrame([("1", "c")], "id string, category string")
    prompts = spark.createDataFrame([("1", "p", "a")], "id string, prompt string, answer string")
    reasoning = spark.createDataFrame([("1", "x y \\boxed{b}\n\n")], "id string, text string")
    aug = spark.createDataFrame([("z", "c", "p", "1 2 3 4 5 6")], "id string, category string, prompt string, completion string")
    row = mixing.solver_corpus(problems, prompts, reasoning, limit=4).first()
    assert len(row.tokens) == len(row["mask"]) == 4
    assert mixing.solver_corpus(problems, prompts, reasoning, aug).count() == 2
    with pytest.raises(Exception, match="exceeds the token limit"):
        mixing.solver_corpus(problems, prompts, reasoning, aug, limit=4).select(F.size("tokens")).collect()
    for unrelated in (lambda d: d.select("problem_id").collect(), lambda d: d.count()):
        with pytest.raises(Exception, match="exceeds the token limit"):
            unrelated(mixing.solver_corpus(problems, prompts, reasoning, aug, limit=4))
