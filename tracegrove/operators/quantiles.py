"""Exact order statistics that never sort a group in one task.

Wanted ranks are found by :mod:`.selection`, whatever the distribution of the values. The lower median of many
small groups counts equal values and takes running counts over logarithmic value buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running_total
from .selection import at_ranks, counted

# Reported percentiles and CDF points.
PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]
CDF_POINTS = [-0.2, -0.1, -0.05, -0.01, -0.005, 0.0, 0.005, 0.01, 0.05, 0.1, 0.2]


def value_bucket(v: Column, resolution: int = 256, unit: float = 1e-6) -> Column:
    """Coarse place of a finite number on a signed logarithmic scale; never decreases in v."""
    x = v.cast("double")
    level = F.floor(F.log1p(F.abs(x) / unit) * resolution)
    return F.when(x < 0, -level).otherwise(level)


def cumulative(
    df: DataFrame, value: str, group: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """One row per (group, distinct value) with ``weight``, ``upto`` (inclusive running
    weight) and ``total`` (weight of the group). NULL and NaN values must be filtered before."""
    amount = F.lit(1).cast("bigint") if weight is None else weight
    counted = df.groupBy(*group, value).agg(F.sum(amount).alias("weight"))
    return running_total(
        counted,
        F.col("weight"),
        order=[value],
        bucket=[value_bucket(F.col(value))],
        partition=group,
        name="upto",
        total="total",
    )


def _at_rank(value: str, rank: Column) -> Column:
    """Aggregate: the value whose 0-based ranks include ``rank``."""
    holds = (F.col("upto") - F.col("weight") <= rank) & (rank < F.col("upto"))
    return F.max(F.when(holds, F.col(value)))


def nearest_rank(
    df: DataFrame, value: str, percents: Sequence[int] = PERCENTILES, group: Sequence[str] = (), prefix: str = "p"
) -> DataFrame:
    """Value at index ``min(int(n * p / 100), n - 1)`` of the sorted values, per percentile."""
    total = F.col("total")
    ranks = {f"{prefix}{p:02d}": F.least(F.floor(total * p / F.lit(100)), total - 1) + 1 for p in percents}
    return _by_group(at_ranks(counted(df, value, group), ranks), group, [F.col(n) for n in ranks])


def _by_group(found: DataFrame, group: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    return found.select(*[F.col(f"_group.{c}").alias(c) for c in group], *columns)


def linear_quantile(
    df: DataFrame, value: str, q: float, group: Sequence[str] = (), name: str = "quantile", weight: Column | None = None
) -> DataFrame:
    """Quantile with linear interpolation between the two nearest ranks (0.5: median)."""
    place = (F.col("total") - 1) * F.lit(q)
    found = at_ranks(counted(df, value, group, weight), {"_low": F.floor(place) + 1, "_high": F.ceil(place) + 1})
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (place - F.floor(place))
    return _by_group(found, group, [between.alias(name)])


def lower_median(df: DataFrame, value: str, group: Sequence[str], name: str = "median") -> DataFrame:
    """Middle value; of an even number of values the smaller middle one."""
    table = cumulative(df, value, group)
    return table.groupBy(*group).agg(_at_rank(value, F.floor((F.col("total") - 1) / F.lit(2))).alias(name))


def weighted_percentiles(
    df: DataFrame, value: str, weight: Column, percents: Sequence[int] = PERCENTILES, prefix: str = "p"
) -> DataFrame:
    """First value whose running weight reaches ``p`` percent of the total weight."""
    ranks = {f"{prefix}{p:02d}": F.col("total") * p / F.lit(100.0) for p in percents}
    return at_ranks(counted(df, value, weight=weight), ranks).select(*ranks)


def cdf_name(point: float, prefix: str) -> str:
    return f"{prefix}{point}".replace("-", "m").replace(".", "_")


def mid_rank_cdf(
    df: DataFrame, value: str, points: Sequence[float] = CDF_POINTS, weight: Column | None = None, prefix: str = "cdf_"
) -> DataFrame:
    """(weight below + weight at or below) / (2 * total) per point, in a single pass."""
    w = F.lit(1.0) if weight is None else weight
    v = F.col(value)
    picks = []
    for d in points:
        both = F.sum(F.when(v < d, w * 2).when(v == d, w).otherwise(F.lit(0.0)))
        picks.append(F.try_divide(both, F.sum(w) * 2).alias(cdf_name(d, prefix)))
    return df.agg(*picks)
