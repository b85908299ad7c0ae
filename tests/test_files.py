"""Row numbers of files and merges that stop reading at the budget."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tracegrove.operators import mixing
from tracegrove.sources import budget
from tracegrove.sources import files as files_of
from tracegrove.sources import tables as S


def lines_in(tmp_path, sizes, rnd):
    want = []
    for k, n in enumerate(sizes):
        rows = [json.dumps({"n": len(want) + i, "pad": "x" * rnd.randrange(200)}) for i in range(n)]
        (tmp_path / f"{k:02}.jsonl").write_text("".join(r + "\n" for r in rows))
        want += range(len(want), len(want) + n)
    return want


@pytest.mark.parametrize("split", ["128m", "4k", "1k"])
def test_row_numbers_do_not_depend_on_the_split(spark, tmp_path, split):
    want = lines_in(tmp_path, [1, 700, 0, 3, 90, 1500], random.Random(1))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = S.read_numbered_jsonl(spark, str(tmp_path), spark.createDataFrame([], "n long, pad string").schema)
        got = sorted((r.n, r.row_no) for r in df.collect())
        assert df.rdd.getNumPartitions() >= {"128m": 1, "4k": 16, "1k": 100}[split]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(n, n) for n in want]


def test_blank_lines_and_odd_records_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"n": 1}\n   \n{"n": 3}\nnot json\n{"other": 5}')
    df = S.read_numbered_jsonl(spark, str(tmp_path), spark.createDataFrame([], "n long").schema)
    assert sorted((r.row_no, r.n) for r in df.collect()) == [(1, 1), (3, 3), (4, None), (5, None)]


def test_no_line_is_shuffled(spark, tmp_path):
    lines_in(tmp_path, [50, 60], random.Random(2))
    plan = S.numbered_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1


def part(spark, path, first, n, n_files, category="c", size=10):
    rows = [(f"{first + k}", category, [1] * size, [1] * size, 1.0, 1.0, k) for k in range(n)]
    df = spark.createDataFrame(rows, "problem_id string, category string, tokens array<int>, mask array<byte>, weight double, sign double, own long")
    budget.written_in_order(df, path, "own", n_files)


def read_of(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def test_files_behind_the_budget_are_not_read(spark, tmp_path):
    parts = [("S_one", str(tmp_path / "1")), ("N_two", str(tmp_path / "2"))]
    part(spark, parts[0][1], 0, 80, 8)
    part(spark, parts[1][1], 60, 80, 8)
    listed = budget.part_files(spark, parts)
    assert len(listed) == 16
    # 350 tokens are 35 rows: four files of ten rows.
    for n_tokens, n_files in ((350, 4), (399, 4), (400, 5), (5, 1), (800, 11), (10**6, 16), (0, 16)):
        needed = budget.files_within(spark, listed, n_tokens, dedup_ids=True)
        assert len(needed) == n_files, n_tokens
        got = budget.merge_files(spark, parts, n_tokens, dedup_ids=True)
        merged = budget.read_files(spark, listed)
        want = mixing.merge_corpus(merged, order=budget.FILE_ORDER, max_tokens=n_tokens, dedup_ids=True)
        key = lambda df: sorted((r.problem_id, r.part_index, r.file_no, r.row_no) for r in df.collect())
        assert key(got) == key(want)
        assert read_of(got) == {f.rsplit("/", 1)[1] for _, _, f in needed}


def test_broken_files_behind_the_budget_do_no_harm(spark, tmp_path):
    parts = [("S_one", str(tmp_path / "1"))]
    part(spark, parts[0][1], 0, 80, 8)
    for f, _ in files_of.files(spark, parts[0][1])[4:]:
        with open(f.removeprefix("file:"), "wb") as broken:
            broken.write(b"not parquet")
    assert budget.merge_files(spark, parts, 250).count() == 25
    with pytest.raises(Exception):
        budget.merge_files(spark, parts, 450).count()


def test_dropped_rows_cost_no_budget(spark, tmp_path):
    parts = [("S_one", str(tmp_path / "1")), ("N_two", str(tmp_path / "2"))]
    part(spark, parts[0][1], 0, 40, 4, category="a")
    part(spark, parts[1][1], 100, 40, 4, category="b")
    got = budget.merge_files(spark, parts, 150, drop_rules=["S:a"])
    assert [r.problem_id for r in got.orderBy("file_no", "row_no").collect()] == [f"{100 + k}" for k in range(15)]
    assert got.filter(F.col("part_index") == 0).count() == 0


def test_merge_summary_is_observed_while_writing(spark, tmp_path):
    parts = [("S_one", str(tmp_path / "1")), ("N_two", str(tmp_path / "2"))]
    part(spark, parts[0][1], 0, 60, 3, category="a")
    part(spark, parts[1][1], 40, 60, 2, category="b")
    merged = budget.read_files(spark, budget.part_files(spark, parts))
    merged = merged.withColumn("mask", F.when(F.col("problem_id") == "7", F.array().cast("array<tinyint>")).otherwise(F.col("mask")))
    merged = merged.withColumn("category", F.when(F.col("problem_id") == "99", F.lit(None)).otherwise(F.col("category")))
    counts = spark.createDataFrame([(str(k), k % 11) for k in range(0, 100, 2)], "problem_id string, pass_count bigint")
    options = dict(order=budget.FILE_ORDER, dedup_ids=True, max_tokens=750, drop_rules=["N:z"], pass_counts=counts)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs_of(name, run):
        sc.setJobGroup(name, name)
        try:
            return run(), len(tracker.getJobIdsForGroup(name))
        finally:
            sc._jsc.clearJobGroup()

    told, n_jobs = jobs_of("observed", lambda: mixing.write_merged(merged, str(tmp_path / "out"), sources=["S", "N"], categories=["a", "b"], **options))
    _, plain = jobs_of("plain", lambda: mixing.merge_corpus(merged, **options).write.parquet(str(tmp_path / "plain")))
    assert n_jobs == plain  # no job for the counters
    flagged = mixing.flag_merge(merged, **options)
    assert told["by_source"] == {r.source: {k: v for k, v in r.asDict().items() if k != "source"} for r in mixing.merge_by_source(flagged).collect()}
    want = {}
    for r in mixing.merge_by_category(flagged).collect():
        if r.category is not None:
            c = want.setdefault(r.category, {"tokens": 0, "unmasked": 0, "rows": {}, "row_share": {}})
            c["tokens"] += r.tokens
            c["unmasked"] += r.unmasked
            c["rows"][r.source], c["row_share"][r.source] = r.rows, r.row_share
    assert told["by_category"] == want
    histogram = {r.pass_count: r.rows for r in mixing.pass_count_histogram(flagged).collect()}
    assert told["pass_counts"] == {p: n for p, n in histogram.items() if p < 9} and sum(histogram.values()) == told["emitted"]
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == told["emitted"] == 75
    assert told["problems"] == mixing.row_problems(written).first().asDict() and told["problems"]["length_mismatch"] == 1


def test_nothing_to_merge(spark, tmp_path):
    part(spark, str(tmp_path / "1"), 0, 3, 1)
    merged = budget.read_files(spark, budget.part_files(spark, [("S", str(tmp_path / "1"))])).filter("false")
    told = mixing.write_merged(merged, str(tmp_path / "out"), sources=["S"], categories=[], order=budget.FILE_ORDER)
    assert told["read"] == told["emitted"] == 0 and told["by_source"] == {}


def test_sectioned_records_share_files(spark, tmp_path):
    rows = [(str(k), "c\u00e9", f"line one\nline {k}\n\n[completion] x", f"done\n{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "id string, category string, prompt string, completion string").repartition(3)
    path = str(tmp_path / "records")
    S.write_sectioned_records(df, path)
    assert len(files_of.files(spark, path)) <= 3
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in (before, "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            assert sorted(map(tuple, S.read_sectioned_records(spark, path).collect())) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(Exception, match="end of a record"):
        S.write_sectioned_records(df.limit(1).withColumn("prompt", F.lit("a\x1e\nb")), str(tmp_path / "bad"))
