"""Exact values at several wanted ranks of groups of any size.

Equal values are counted first, and the distinct values of all groups are dealt into ranges at splitters that
Spark samples from the values themselves, so ranges are even however narrow or skewed the distribution is. The
exact weights of the ranges tell which of them hold the wanted ranks; only those are read again and sorted,
each for itself. A range is one partition, whatever the size of its group.

The ranges are kept as a table in the shared folder, because two runs of a sample need not agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder

_RANGE = ["_group", "_range"]
#: Relative error of the sketch that :func:`largest` begins with.
SKETCH = 10_000


def counted(df: DataFrame, value: str, group: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(_group, _value, _weight) with one row per group and distinct value. NULL and NaN values must be
    filtered before."""
    amount = F.lit(1).cast("bigint") if weight is None else weight
    key = F.struct(*group) if group else F.struct(F.lit(0).alias("all"))
    return df.groupBy(key.alias("_group"), F.col(value).alias("_value")).agg(F.sum(amount).alias("_weight"))


def ranged(values: DataFrame, ranges: int | None = None) -> DataFrame:
    """Distinct values with ``_range``, the number of their range; ranges follow the order of the values."""
    spark = values.sparkSession
    dealt = values.repartitionByRange(*([ranges] if ranges else []), "_group", "_value")
    path = shared_folder(spark, "ranges")
    dealt.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def _running(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The running weight up to each row and before it, within the key, and whether the row is the last."""
    inside = W.partitionBy(*key).orderBy(order)
    upto = F.sum("_weight").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    told = rows.withColumn("_upto", upto).withColumn("_before", F.lag("_upto").over(inside))
    return told.withColumn("_last", F.lead(order).over(inside).isNull())


def _holds() -> Column:
    """Is this the first row whose running weight reaches the rank, or else the last one?"""
    begins = F.col("_before").isNull() | (F.col("_before") < F.col("_rank"))
    return begins & (F.col("_last") | (F.col("_rank") <= F.col("_upto")))


def holding(rows: DataFrame, ranks: Mapping[str, Column]) -> DataFrame:
    """(_group, _range, name, _rank, total): the range of each wanted rank, and its rank in there.

    ``ranks`` by name: running weights to reach, as functions of the column ``total``.
    """
    sums = _running(rows.groupBy(*_RANGE).agg(F.sum("_weight").alias("_weight")), ["_group"], "_range")
    sums = sums.withColumn("total", F.sum("_weight").over(W.partitionBy("_group")))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), r.alias("_rank")) for n, r in ranks.items()]))
    wanted = sums.select("*", each.alias("_want")).select(*_RANGE, "_before", "_upto", "_last", "total", "_want.*")
    return wanted.filter(_holds()).select(*_RANGE, "name", (F.col("_rank") - F.coalesce("_before", F.lit(0))).alias("_rank"), "total")


def at_ranks(values: DataFrame, ranks: Mapping[str, Column], ranges: int | None = None) -> DataFrame:
    """(_group, total, one column per rank): the first value at which the running weight reaches the rank,
    or else the last value."""
    rows = ranged(values, ranges)
    wanted = holding(rows, ranks)
    held = rows.join(wanted.select(*_RANGE).distinct(), _RANGE, "left_semi")
    found = _running(held, _RANGE, "_value").join(wanted, _RANGE).filter(_holds())
    picks = [F.max(F.when(F.col("name") == n, F.col("_value"))).alias(n) for n in ranks]
    return found.groupBy("_group", "total").agg(*picks)


def largest(df: DataFrame, score: Column, n: int, ties: Sequence[str]) -> DataFrame:
    """The ``n`` rows of the largest scores, equal scores by ``ties`` (which make a row unique).

    A sketch brackets the n-th score, and what lies outside is only counted; the n-th score is then found among
    the scores inside. Rows are filtered by it, not sorted, but for those of exactly that score. NULL scores
    come last of all.
    """
    if n <= 0:
        return df.limit(0)
    scored = df.withColumn("_score", F.coalesce(-score, F.lit(float("inf"))))
    total = scored.count()
    if n >= total:
        return df
    # A rank is found at a sketch's error from it at most; the bracket is wider, and its counts are checked.
    margin = 3 / SKETCH + 2 / total
    at = [min(max(n / total + d, 0.0), 1.0) for d in (-margin, margin)]
    low, high = scored.agg(F.percentile_approx("_score", at, SKETCH).alias("b")).first().b
    low, high = (float("-inf"), float("inf")) if low is None else (low, high)
    below, upto = scored.agg(F.count_if(F.col("_score") < low), F.count_if(F.col("_score") <= high)).first()
    if not below < n <= upto:
        low, high, below = float("-inf"), float("inf"), 0
    inside = counted(scored.filter(F.col("_score").between(low, high)), "_score")
    limit = at_ranks(inside, {"_limit": F.lit(n - below).cast("bigint")}).first()._limit
    left = n - scored.filter(F.col("_score") < limit).count()
    at_limit = scored.filter(F.col("_score") == limit)
    for keys in ([F.pmod(F.xxhash64(*ties), F.lit(64))], []):
        at_limit = at_limit.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*ties))).filter(F.col("_at") <= left)
    return scored.filter(F.col("_score") < limit).unionByName(at_limit.drop("_at")).drop("_score")
