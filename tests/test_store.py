"""Partitioned and bucketed tables: what plans read and move."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tracegrove.operators import rollouts
from tracegrove.sources import store


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    names = [f"t_{uuid.uuid4().hex}" for _ in range(2)]
    rows = spark.range(2000).select(
        (F.col("id") % 97).cast("string").alias("problem_id"),
        F.col("id").alias("row_no"),
        F.when(F.col("id") % 3 == 0, "probe").otherwise("targeted").alias("stage"),
        (F.col("id") % 2).cast("double").alias("reward"),
    )
    gold = spark.range(90).select(F.col("id").cast("string").alias("problem_id"), F.concat(F.lit("g"), "id").alias("gold"))
    r = store.write_bucketed(rows, names[0], str(tmp_path / "rows"), ["problem_id"], ["stage"], 8)
    g = store.write_bucketed(gold, names[1], str(tmp_path / "gold"), ["problem_id"], buckets=8)
    yield rows, gold, r, g, names
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_stage_filter_reads_its_folder_only(tables):
    rows, _, r, _, _ = tables
    probe = r.filter("stage = 'probe'")
    assert "PartitionFilters: [isnotnull(stage" in plan_of(probe)
    assert all("stage=probe" in f for f in probe.inputFiles()) or probe.count() == rows.filter("stage = 'probe'").count()
    assert probe.count() == rows.filter("stage = 'probe'").count()


def test_joins_by_id_move_nothing(tables):
    rows, gold, r, g, _ = tables
    for how in ("inner", "left", "left_anti", "left_semi"):
        joined = r.join(g, "problem_id", how)
        assert "Exchange" not in plan_of(joined)
        assert joined.count() == rows.join(gold, "problem_id", how).count()
    done = rollouts.remaining_problems(g, r, "probe")
    assert "Exchange" not in plan_of(done)


def test_aggregates_by_id_move_nothing(tables):
    rows, gold, r, g, _ = tables
    counts = r.groupBy("problem_id").agg(F.sum("reward").alias("reward"))
    assert "Exchange" not in plan_of(counts)
    # A gold table of last duplicates, met with the rollouts: no row moves from the files to the result.
    last = r.groupBy("problem_id").agg(F.max_by("reward", "row_no").alias("last"))
    met = g.join(last, "problem_id").groupBy("problem_id", "gold").agg(F.max("last").alias("last"))
    assert "Exchange" not in plan_of(met)
    want = {x.problem_id: x["last"] for x in rows.groupBy("problem_id").agg(F.max_by("reward", "row_no").alias("last")).collect()}
    assert {x.problem_id: x["last"] for x in met.collect()} == {k: v for k, v in want.items() if int(k) < 90}


def test_another_session_opens_a_table(spark, tables, tmp_path):
    rows, gold, r, g, names = tables
    spark.sql(f"DROP TABLE {names[0]}")  # external: the files stay
    other = f"t_{uuid.uuid4().hex}"
    again = store.open_table(spark, other, str(tmp_path / "rows"), "problem_id string, row_no long, reward double, stage string", ["problem_id"], ["stage"], 8)
    try:
        assert again.count() == rows.count()
        assert "Exchange" not in plan_of(again.filter("stage = 'targeted'").join(g, "problem_id"))
        assert again.filter("stage = 'targeted'").join(g, "problem_id").count() == rows.filter("stage = 'targeted'").join(gold, "problem_id").count()
    finally:
        spark.sql(f"DROP TABLE {other}")
