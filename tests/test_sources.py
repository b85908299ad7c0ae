from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracegrove import schemas
from tracegrove.operators import reports
from tracegrove.operators.mixing import union_parts
from tracegrove.sources import tables as S
from tracegrove.streaming import jobs


def put(path: Path, *lines: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_jsonl_round_trip(spark, tmp_path):
    row = {"problem_id": "a", "category": "c", "tokens": [1, 2], "mask": [0, 1], "weight": 1.0, "sign": -1.0}
    path = put(tmp_path / "x.jsonl", json.dumps(row), "", json.dumps(row | {"problem_id": "b"}))
    df = S.read_jsonl(spark, path, schemas.CORPUS_ROW)
    assert [r.problem_id for r in S.with_row_no(df).orderBy("row_no").collect()] == ["a", "b"]
    assert reports.is_corpus_table(df) and not reports.is_corpus_table(df.withColumn("reward", F.lit(1.0)))
    out = str(tmp_path / "out")
    S.write_jsonl(df, out)
    S.write_jsonl(df, out, append=True)
    assert S.read_jsonl(spark, out, schemas.CORPUS_ROW).count() == 4
    S.write_table(df, str(tmp_path / "pq"), ["category"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_prompts_and_categories(spark, tmp_path):
    csv = tmp_path / "train.csv"
    csv.write_text('id,prompt,answer\n1,"two\nlines ""q""",5\n,blank,6\n2,plain,7\n')
    empty = put(tmp_path / "empty.jsonl")
    first = put(tmp_path / "a.jsonl", '{"id": "1", "category": "x"}', '{"id": "1", "category": "y"}', '{"id": "2"}')
    second = put(tmp_path / "b.jsonl", '{"problem_id": "1", "category": "z"}')
    missing = str(tmp_path / "none.jsonl")
    cats = S.category_map(spark, [missing, empty, first, second])
    assert {tuple(r) for r in cats.collect()} == {("1", "y")}
    merged = S.category_map(spark, [first, second], merge_all=True)
    assert {tuple(r) for r in merged.collect()} == {("1", "z")}
    assert S.category_map(spark, [missing]).count() == 0
    got = {tuple(r) for r in S.read_prompts(spark, str(csv), cats).collect()}
    assert got == {("1", 'two\nlines "q"', "5", "y"), ("2", "plain", "7", "unknown")}
    assert S.read_prompts(spark, str(csv), cats, "y").count() == 1
    other = tmp_path / "other.csv"
    other.write_text("problem_id,prompt,answer\n9,p,a\n")
    assert S.read_prompts(spark, str(other)).first().id == "9"


def test_problem_details_first_line(spark, tmp_path):
    for i in (1, 2):
        detail = {"id": str(i), "question": "q", "examples": [{"input_value": "a", "output_value": "b"}]}
        put(tmp_path / "problems" / f"{i}.jsonl", json.dumps(detail), json.dumps(detail | {"id": "ignored"}))
    got = S.read_problem_details(spark, str(tmp_path / "problems")).collect()
    assert {r.id for r in got} == {"1", "2"} and got[0].examples[0].output_value == "b"


def test_sectioned_text(spark, tmp_path):
    df = spark.createDataFrame([("ab", "spelling", "line 1\nline 2", "done\nmore")], "id string, category string, prompt string, completion string")
    text = S.sectioned_text(df).first().value
    put(tmp_path / "aug" / "ab.txt", text.rstrip("\n"))
    got = S.read_sectioned_text(spark, str(tmp_path / "aug")).first()
    assert tuple(got) == ("ab", "spelling", "line 1\nline 2", "done\nmore")
    S.write_sectioned_text(df, str(tmp_path / "written"))
    assert len(list((tmp_path / "written").glob("id=ab/*.txt"))) == 1


def test_segments_against_index(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "c", "x", [1, 2, 3], [0, 1, 1]), ("b", "c", "y", [4], [1])],
        "problem_id string, category string, answer string, tokens array<int>, mask array<tinyint>",
    )
    index = reports.corpus_index(rows)
    back = S.rows_from_segments(S.segments_of(rows), index)
    assert {(r.problem_id, tuple(r.tokens), tuple(r.mask)) for r in back.collect()} == {("a", (1, 2, 3), (0, 1, 1)), ("b", (4,), (1,))}
    wrong = index.withColumn("token_count", F.col("token_count") + 1)
    with pytest.raises(Exception, match="do not match the index"):
        S.rows_from_segments(S.segments_of(rows), wrong).collect()
    S.write_segments(rows, str(tmp_path / "seg"))
    again = spark.read.schema(schemas.SEGMENT).json(str(tmp_path / "seg"))
    assert again.count() == 3


def test_raw_runs(spark):
    raw = spark.createDataFrame(
        [("p", "r", i, 10 + i, lp) for i, lp in enumerate([None, -1.0, -0.5, -0.1])],
        "problem_id string, run string, token_no int, token_id int, logprob double",
    )
    r = S.split_raw_runs(raw.repartition(3)).first()
    assert (r.prompt_ids, r.generated_ids) == ([10], [11, 12, 13])
    r = S.split_raw_runs(raw, -1.0).first()
    assert (r.prompt_ids, r.generated_ids) == ([10, 11], [12, 13])


def test_detokenise(spark):
    vocab = spark.createDataFrame([(1, "a"), (2, "<0xC3>"), (3, "<0xA9>")], schemas.VOCAB)
    rows = spark.createDataFrame([(0, [1, 2, 3, 9]), (1, [])], "k int, ids array<int>")
    got = {r.k: r.text for r in S.detokenise(rows, "ids", vocab, ["k"]).collect()}
    assert got == {0: "a\u00e9<unk:9>", 1: ""}
    assert S.detokenise(rows, "ids", vocab, ["k"], unknown="[%d]").filter("k = 0").first().text == "a\u00e9[9]"


def test_parts(spark, tmp_path):
    row = {"problem_id": "a", "category": "c", "tokens": [1], "mask": [1], "weight": 1.0, "sign": 1.0}
    put(tmp_path / "corpus" / "parts" / "S_solver.jsonl", json.dumps(row))
    parts = S.read_parts(spark, ["S_solver"], str(tmp_path))
    assert [n for n, _ in parts] == ["S_solver"] and parts[0][1].count() == 1
    put(tmp_path / "other" / "S_solver.jsonl", json.dumps(row | {"problem_id": "b"}))
    both = S.read_parts(spark, ["S_solver", str(tmp_path / "other" / "S_solver.jsonl")], str(tmp_path))
    assert sorted(r.problem_id for r in union_parts(both).collect()) == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        S.resolve_part(spark, "nothing", str(tmp_path))


def test_wrong_rows_only_when_there_are_any(spark, tmp_path):
    df = spark.createDataFrame([(1, True)], "id int, correct boolean")
    assert not S.write_wrong_rows(df, str(tmp_path / "w1"))
    assert S.write_wrong_rows(df.union(df.withColumn("correct", F.lit(False))), str(tmp_path / "w2"))
    assert spark.read.parquet(str(tmp_path / "w2")).count() == 1


def output(pid, *texts):
    done = [{"token_ids": [1, 2], "text": t, "logprobs": [{"1": -0.5}, {"7": -1.0}]} for t in texts]
    return json.dumps({"problem_id": pid, "category": "c", "answer": "5", "prompt_token_ids": [9], "completions": done})


GRADED_KEYS = ["stage", "problem_id", "sample_no"]


def test_graded_stream_equals_batch(spark, tmp_path):
    landing, target = tmp_path / "in", str(tmp_path / "out")

    def run(checkpoint="cp"):
        rows = jobs.graded_stream(jobs.read_new_outputs(spark, str(landing)), "probe")
        jobs.append_new_rows(rows, target, str(tmp_path / checkpoint), GRADED_KEYS).awaitTermination()
        return sorted((r.problem_id, r.sample_no, r.reward) for r in jobs.read_appended(spark, target).collect())

    put(landing / "1.json", output("a", r"\boxed{5}", "none"), output("a", r"\boxed{5}", "none"))
    assert run() == [("a", 0, 1.0), ("a", 1, 0.0)]
    put(landing / "2.json", output("b", r"\boxed{6}"), output("a", r"\boxed{7}", "again"))
    want = [("a", 0, 1.0), ("a", 1, 0.0), ("b", 0, 0.0)]
    assert run() == want
    got = jobs.read_appended(spark, target)
    assert got.filter("problem_id = 'b'").first().old_logp == [0.0, -0.5, -1.0]
    # Neither a second run nor one that has lost its checkpoint adds a row, and no state is kept.
    assert run() == want
    assert run("new") == want
    assert not (tmp_path / "cp" / "state").exists() and not (tmp_path / "new" / "state").exists()


def test_a_repeated_micro_batch_replaces_its_rows(spark, tmp_path):
    landing, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), tmp_path / "cp"
    rows = lambda: jobs.graded_stream(jobs.read_new_outputs(spark, str(landing)), "probe")
    put(landing / "1.json", output("a", r"\boxed{5}"))
    jobs.append_new_rows(rows(), target, str(checkpoint), GRADED_KEYS).awaitTermination()
    # As after a crash between the write and the commit of a micro-batch.
    for name in ("0", ".0.crc"):
        (checkpoint / "commits" / name).unlink()
    jobs.append_new_rows(rows(), target, str(checkpoint), GRADED_KEYS).awaitTermination()
    assert [(r.problem_id, r.reward) for r in jobs.read_appended(spark, target).collect()] == [("a", 1.0)]


def test_step_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "log"
    line = lambda step, loss: json.dumps(
        {"epoch": 0, "step": step, "problem_id": "p", "segment": "s", "category": "c", "num_loss_tokens": 2, "total_loss": loss, "min_logprob": -loss}
    )
    target, state = str(tmp_path / "t"), str(tmp_path / "s")
    put(landing / "1.json", line(0, 1.0), line(1, 2.0))
    jobs.update_step_losses(jobs.read_new_log(spark, str(landing)), target, state).awaitTermination()
    put(landing / "2.json", line(1, 4.0), line(2, 3.0))
    jobs.update_step_losses(jobs.read_new_log(spark, str(landing)), target, state).awaitTermination()
    want = jobs.step_losses(spark.read.schema(schemas.LOG_INDEX).json(str(landing)))
    got = jobs.current_step_losses(spark, target)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert {(r.step, r.loss_per_token) for r in got.collect()} == {(0, 0.5), (1, 1.5), (2, 1.5)}


def test_step_losses_are_compacted(spark, tmp_path):
    """Twenty micro-batches: a read takes a snapshot and a few of them, and equals the batch."""
    landing, target, state = tmp_path / "log", str(tmp_path / "t"), str(tmp_path / "s")
    for k in range(20):
        rows = [{"epoch": 0, "step": s, "problem_id": "p", "segment": "s", "category": "c", "num_loss_tokens": 2, "total_loss": k + s / 4, "min_logprob": -k} for s in (k % 3, k)]
        put(landing / f"{k:02}.json", *map(json.dumps, rows))
    most = 0
    for stop in (7, 20):
        for k in range(20):
            path = landing / f"{k:02}.json"
            path.rename(path.with_suffix(".json" if k < stop else ".wait")) if path.exists() else (landing / f"{k:02}.wait").rename(path)
        log = jobs.read_new_log(spark, str(landing) + "/*.json", files_per_batch=1)
        jobs.update_step_losses(log, target, state, compact_every=4).awaitTermination()
        paths = jobs.state_paths(spark, target)
        most = max(most, len(paths))
        got = jobs.current_step_losses(spark, target)
        want = jobs.step_losses(spark.read.schema(schemas.LOG_INDEX).json([str(landing / f"{k:02}.json") for k in range(stop)]))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert most <= 4 and paths[0].endswith("snapshot=19") and len(paths) == 1
    (home,) = (tmp_path / "t").iterdir()
    # What has gone into a snapshot is gone, but for the snapshot before.
    assert sorted(p.name for p in home.iterdir()) == ["snapshot=15", "snapshot=19"]
    assert got.count() == 20 and not (tmp_path / "s" / "state").exists()
