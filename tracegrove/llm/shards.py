"""Sharding by sampled splitters.

Records are ordered by (key hash, tie hash) and cut into fine ranges: a size-weighted sample of key
hashes gives the quantile boundaries, one aggregate gives every range's true size, and a range that came
out overfull (one hot key, or an unlucky sample) is subdivided by the tie hash. Ranges are small, so
running sums inside a range and the ranges' starts place every record on one line of bytes, which is cut
into equal shards. A key's records stay in one shard as long as they are a small part of it.

Only the fine ranges' totals (about one per ``range_rows`` records) and a sample of twenty keys per
range reach the driver.

Defined cases: a null key or text is the empty one; a null size is 0, and every record counts at least
one byte; equal keys are ordered by tie, equal ties by their place in the input; repeated rows are
records of their own; an empty table gives an empty result; other columns are kept, and helper columns
have names that start with two underscores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, uniform

SUB = 1 << 20


def splitters(keyed: DataFrame, n_ranges: int, per_range: int = 20) -> np.ndarray:
    """Quantile boundaries of ``__key`` from a sample drawn in proportion to ``__size``."""
    total = keyed.agg(F.sum("__size")).first()[0] or 0
    if not total:
        return np.zeros(0, np.int64)
    want = n_ranges * per_range
    weight = F.col("__size") * want / F.lit(float(total))
    sample = keyed.filter(uniform(F.lit(17), "__key", "__tie") < weight).select("__key", F.greatest(weight, F.lit(1.0)).alias("w"))
    got = sample.toPandas().sort_values("__key", kind="stable")
    share = got["w"].cumsum().to_numpy()
    cuts = np.searchsorted(share, share[-1] * np.arange(1, n_ranges) / n_ranges) if len(got) else np.zeros(0, int)
    return np.unique(got["__key"].to_numpy()[np.minimum(cuts, len(got) - 1)]) if len(got) else np.zeros(0, np.int64)


def with_range(keyed: DataFrame, cuts: np.ndarray, parts: dict[int, int]) -> DataFrame:
    """Adds ``__range``: the quantile range times SUB, plus the part of it that the tie hash picks."""
    n_parts = np.ones(len(cuts) + 1, np.int64)
    for k, n in parts.items():
        n_parts[k] = n

    @F.pandas_udf("long")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        r = np.searchsorted(cuts, key.to_numpy(), side="left")
        up = (tie.to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.int64)
        return pd.Series(r * SUB + ((up * n_parts[r]) >> 32))

    return keyed.withColumn("__range", place("__key", "__tie"))


def range_totals(df: DataFrame) -> pd.DataFrame:
    return df.groupBy("__range").agg(F.sum("__size").alias("size"), F.count("*").alias("rows")).toPandas().sort_values("__range")


def shard_records(
    df: DataFrame,
    key: str,
    tie: str,
    size: str,
    n_shards: int,
    range_rows: int = 1_000_000,
    together: float = 0.01,
) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1, near equal sizes) and ``slot`` (gapless from 0 in it).

    ``together``: the records of one key are not cut apart while they are at most this part of a shard.
    """
    tidy = df.drop("shard", "slot").withColumns(
        {
            "__key": F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))),
            "__tie": F.xxhash64(F.col(tie), F.monotonically_increasing_id()),
            "__size": F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(1)).cast("long"),
        }
    )
    keyed = settle(tidy)
    n_rows, total = keyed.agg(F.count("*"), F.sum("__size")).first()
    if not n_rows:
        return keyed.drop("__key", "__tie", "__size").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    n_ranges = max(8 * n_shards, -(-n_rows // range_rows))
    cuts = splitters(keyed, n_ranges)
    first = range_totals(with_range(keyed, cuts, {}))
    fair = max(1, total // n_ranges)
    over = first[first["size"] > 2 * fair]
    parts = {int(r) // SUB: min(SUB, int(-(-s // fair))) for r, s in zip(over["__range"], over["size"], strict=True)}
    ranged = with_range(keyed, cuts, parts)
    fine = range_totals(ranged)
    starts = fine.assign(__bytes_before=fine["size"].cumsum() - fine["size"], __rows_before=fine["rows"].cumsum() - fine["rows"])
    starts = keyed.sparkSession.createDataFrame(
        starts[["__range", "__bytes_before", "__rows_before"]], "__range long, __bytes_before long, __rows_before long"
    )
    line = Window.partitionBy("__range").orderBy("__key", "__tie")
    of_key = Window.partitionBy("__range", "__key")
    placed = (
        ranged.withColumns(
            {
                "__at": F.sum("__size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"),
                "__no": F.row_number().over(line).cast("long") - 1,
            }
        )
        .withColumns({"__key_size": F.sum("__size").over(of_key), "__key_at": F.min("__at").over(of_key)})
        # One row per fine range: bounded by the number of ranges.
        .join(F.broadcast(starts), "__range")
    )
    small = F.col("__key_size") <= F.lit(int(together * total / n_shards))
    at = F.col("__bytes_before") + F.when(small, F.col("__key_at")).otherwise(F.col("__at"))
    shard = F.least(F.lit(n_shards - 1), F.floor(at * n_shards / F.lit(total)).cast("int"))
    placed = settle(placed.withColumns({"shard": shard, "__no": F.col("__rows_before") + F.col("__no")}))
    heads = placed.groupBy("shard").agg(F.min("__no").alias("__head"))
    helpers = ["__range", "__key", "__tie", "__size", "__at", "__no", "__key_size", "__key_at", "__bytes_before", "__rows_before", "__head"]
    return placed.join(F.broadcast(heads), "shard").withColumn("slot", F.col("__no") - F.col("__head")).drop(*helpers)
