"""Incremental jobs over tables that grow file by file.

All use ``availableNow``: each run takes the files that are new since the last one, and the
result equals the batch job over all files. None keeps a state store: what a job has to remember is in
its target, written by ``foreachBatch`` into a folder per query and micro-batch. A repeated micro-batch
overwrites its own folder, a new checkpoint begins new folders.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import schemas
from ..operators.rollouts import records_from_outputs
from ..sources.files import delete, folders, has_file

#: Parts of a target by key; a micro-batch of few rows reads the keys of the parts it has rows for.
KEY_PARTS = 16
FEW_ROWS = 64


def read_new_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Generation outputs that land in a folder as JSON lines."""
    return spark.readStream.schema(schemas.GENERATION_OUTPUT).json(folder)


def read_new_log(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Training-log lines flushed to a folder as JSON lines."""
    reader = spark.readStream.schema(schemas.LOG_INDEX)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).json(folder)


def read_new_parquet(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """Rows of Parquet files of one name pattern that land in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a streaming query keeps in its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _each_batch(rows: DataFrame, checkpoint: str, write, mode: str = "append") -> StreamingQuery:
    stream = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return stream.foreachBatch(write).trigger(availableNow=True).start()


# --- graded rollouts -------------------------------------------------------------------------


def graded_stream(outputs: DataFrame, stage: str) -> DataFrame:
    """Graded rollouts of a stream of generation outputs."""
    return records_from_outputs(outputs, stage)


def _part_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_PARTS)).cast("int")


def append_new_rows(rows: DataFrame, target: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Append to a Parquet table the rows of a stream whose keys it does not have yet.

    Of rows with equal keys in one micro-batch the least one counts. The table itself tells what was seen, so
    nothing is kept besides it: a micro-batch meets the key columns of the table, of a few rows those of the
    parts that they fall into.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        row = F.struct(*rest)
        # Sorts begin with the hash, which differs where the first keys may all be equal.
        named = [F.xxhash64(*keys).alias("_hash"), *keys]
        both = batch.select(*named, row.alias("_row"), F.lit(False).alias("_old"))
        own = query_id(spark, checkpoint)
        if folders(spark, target):
            old = spark.read.parquet(target)
            mine = (F.col("query") == own) & (F.col("batch") == batch_id)
            few = batch.select(_part_of(keys).alias("key_part")).take(FEW_ROWS + 1)
            if len(few) <= FEW_ROWS:
                old = old.filter(F.col("key_part").isin(sorted({r.key_part for r in few})))
            none = F.lit(None).cast(both.schema["_row"].dataType)
            both = both.unionByName(old.filter(~mine).select(*named, none.alias("_row"), F.lit(True).alias("_old")))
        # Old keys meet new rows in the aggregate that finds the least row, which moves each once.
        one = both.groupBy("_hash", *keys).agg(F.min("_row").alias("_row"), F.bool_or("_old").alias("_old")).filter(~F.col("_old"))
        one = one.select(*keys, "_row.*").withColumn("key_part", _part_of(keys))
        one.select(*batch.columns, "key_part").repartition("key_part").write.mode("overwrite").partitionBy("key_part").parquet(f"{target}/query={own}/batch={batch_id}")

    return _each_batch(rows, checkpoint, write)


def read_appended(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a table that :func:`append_new_rows` keeps."""
    return spark.read.parquet(target).drop("query", "batch", "key_part")


# --- running losses --------------------------------------------------------------------------

STEP_KEYS = ["epoch", "step", "category"]
#: Micro-batches between two snapshots.
COMPACT_EVERY = 10


def _summed(rows: DataFrame, loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    return rows.groupBy(*STEP_KEYS).agg(F.sum(loss).alias("loss"), F.sum(tokens).alias("tokens"), F.min("min_logprob").alias("min_logprob"))


def _with_mean(sums: DataFrame) -> DataFrame:
    return sums.withColumn("loss_per_token", F.try_divide("loss", "tokens"))


def step_losses(log: DataFrame) -> DataFrame:
    """Loss sums by step and category."""
    return _with_mean(_summed(log, "total_loss", "num_loss_tokens"))


def update_step_losses(log: DataFrame, target: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep the loss sums by step and category of a growing log.

    Each micro-batch writes the sums of its own rows. After every ``compact_every`` of them they are added to a
    new snapshot of all sums; once that is whole, what went into it is deleted, but for the snapshot before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        home = f"{target}/query={query_id(spark, checkpoint)}"
        _summed(batch, "total_loss", "num_loss_tokens").write.mode("overwrite").parquet(f"{home}/delta={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            _compact(spark, home, batch_id)

    return _each_batch(log, checkpoint, write)


def _numbers(names: Sequence[str], kind: str) -> list[int]:
    return sorted(int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}="))


def _state(spark: SparkSession, home: str) -> tuple[int, list[str]]:
    """(micro-batch of the newest whole snapshot or -1, the folders that make up the sums)."""
    names = folders(spark, home)
    whole = [n for n in _numbers(names, "snapshot") if has_file(spark, f"{home}/snapshot={n}/_SUCCESS")]
    upto = whole[-1] if whole else -1
    later = [f"{home}/delta={n}" for n in _numbers(names, "delta") if n > upto]
    return upto, ([f"{home}/snapshot={upto}"] if whole else []) + later


def _compact(spark: SparkSession, home: str, batch_id: int) -> None:
    before, paths = _state(spark, home)
    if before < batch_id:
        _summed(spark.read.parquet(*paths)).write.mode("overwrite").parquet(f"{home}/snapshot={batch_id}")
    names = folders(spark, home)
    for n in _numbers(names, "delta"):
        if n <= batch_id:
            delete(spark, f"{home}/delta={n}")
    for n in _numbers(names, "snapshot"):
        if n < before:
            delete(spark, f"{home}/snapshot={n}")


def state_paths(spark: SparkSession, target: str) -> list[str]:
    """The folders a read of the sums takes: for each query a snapshot and fewer than ``compact_every`` others."""
    return [p for name in folders(spark, target) for p in _state(spark, f"{target}/{name}")[1]]


def current_step_losses(spark: SparkSession, target: str) -> DataFrame:
    """Sums of each step and category so far."""
    return _with_mean(_summed(spark.read.parquet(*state_paths(spark, target))))
