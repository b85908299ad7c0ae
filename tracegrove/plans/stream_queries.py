"""Streaming jobs run over the driver tables as if their files had just landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder, tune
from ..streaming import jobs
from . import views as V
from .views import Query

QUERIES: dict[str, Query] = {}


def _finish(query) -> None:
    query.awaitTermination()


def _step_losses(spark, sf):
    schema = V.table(spark, sf, "events").schema
    events = jobs.read_new_parquet(tune(spark), sf, "events.parquet", schema)
    event = F.col("event_id")
    log = events.select(
        (event % 4).cast("int").alias("epoch"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).alias("step"),
        F.col("event_type").alias("category"),
        F.round(F.col("value") * 100).alias("total_loss"),
        (event % 50 + 1).alias("num_loss_tokens"),
        (-F.col("value") / 100).alias("min_logprob"),
    )
    target = shared_folder(spark, "step-losses")
    _finish(jobs.update_step_losses(log, target, shared_folder(spark, "step-losses-state")))
    out = jobs.current_step_losses(spark, target)
    return out.select(*jobs.STEP_KEYS, "loss", "tokens", F.round("min_logprob", 6).alias("min_logprob"), F.round("loss_per_token", 6).alias("loss_per_token"))


QUERIES["stream_step_losses"] = Query(
    _step_losses,
    """SELECT event_id % 4 AS epoch, epoch_us(ts) // 3600000000 AS step, event_type AS category, sum(round(value * 100)) AS loss,
      CAST(sum(event_id % 50 + 1) AS BIGINT) AS tokens, round(min(-value / 100), 6) AS min_logprob,
      round(sum(round(value * 100)) / sum(event_id % 50 + 1), 6) AS loss_per_token FROM events GROUP BY ALL""",
)


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]


def _graded(spark, sf):
    schema = V.table(spark, sf, "lineitem").schema
    lines = jobs.read_new_parquet(tune(spark), sf, "lineitem.parquet", schema)
    part = F.col("l_partkey").cast("string")
    ids = F.array(F.col("l_linenumber"), F.col("l_quantity").cast("int"))
    boxed = F.when(F.col("l_returnflag") == "A", part).when(F.col("l_returnflag") == "N", F.concat(part, F.lit(".5"))).otherwise("0.5")
    text = F.concat(F.lit("\\boxed{"), boxed, F.lit("}"))
    one = F.struct(ids.alias("token_ids"), text.alias("text"), F.lit(None).cast("array<map<string,double>>").alias("logprobs"))
    outputs = lines.select(
        *_LINE,
        part.alias("problem_id"),
        part.alias("answer"),
        F.col("l_linestatus").alias("category"),
        F.array(F.lit(1)).alias("prompt_token_ids"),
        F.array(one).alias("completions"),
    )
    keys = ["stage", *_LINE, "sample_no"]
    graded = jobs.graded_stream(outputs, "probe").select(*keys, "category", "problem_id", "pred", "reward")
    target = shared_folder(spark, "graded")
    # The second run has lost its checkpoint and reads all again; it must not add a row.
    for run in ("a", "b"):
        _finish(jobs.append_new_rows(graded, target, shared_folder(spark, f"graded-state-{run}"), keys))
    return jobs.read_appended(spark, target).groupBy("category", "problem_id").agg(
        F.count("*").alias("rows"), F.sum("reward").alias("reward"), F.max("pred").alias("last_pred")
    )


QUERIES["stream_graded_rollouts"] = Query(
    _graded,
    """SELECT l_linestatus AS category, CAST(l_partkey AS VARCHAR) AS problem_id, count(*) AS rows,
      sum(CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND NOT regexp_full_match(CAST(l_partkey AS VARCHAR), '[01]+') AND 0.5 / l_partkey <= 0.01) THEN 1.0 ELSE 0.0 END) AS reward,
      max(CASE l_returnflag WHEN 'A' THEN CAST(l_partkey AS VARCHAR) WHEN 'N' THEN l_partkey || '.5' ELSE '0.5' END) AS last_pred
      FROM lineitem GROUP BY ALL""",
)
