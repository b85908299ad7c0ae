"""Rank selection against sorted lists: narrow, skewed, tied and weighted values."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tracegrove.operators import quantiles as Q
from tracegrove.operators import selection as S


def test_a_million_values_in_a_hundredth(spark):
    """No range that is left to sort is large, though all values are close together."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select((F.lit(1.0) + F.lit(0.01) * F.pmod(F.col("id") * 7919, F.lit(n)) / n).alias("v"))
    values = S.counted(df, "v")
    ranks = {f"p{p}": F.floor(F.col("total") * p / F.lit(100)) + 1 for p in (1, 50, 99)}
    rows = S.ranged(values, 200)
    sizes = [r["count"] for r in rows.groupBy("_range").count().collect()]
    assert len(sizes) > 150 and sum(sizes) == n and max(sizes) < n / 50
    assert S.holding(rows, ranks).select("_range").distinct().count() == 3
    got = S.at_ranks(values, ranks, 200).first()
    assert [got[f"p{p}"] for p in (1, 50, 99)] == [1.0 + 0.01 * (n * p // 100) / n for p in (1, 50, 99)]
    assert got.total == n


def test_only_ranges_that_hold_a_rank_are_sorted(spark):
    df = spark.range(100_000).select((F.col("id") % 9973).alias("v"))
    found = S.at_ranks(S.counted(df, "v"), {"_low": F.lit(1), "_mid": F.floor(F.col("total") / 2)}, 32)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The rows that reach the window over values have passed the semi-join with the wanted ranges.
    window = plan.index("Window [sum(_weight")
    assert "LeftSemi" in plan[window:]


def draws(rnd, n):
    kinds = [lambda: rnd.gauss(0, 1), lambda: 1 + rnd.random() / 1e9, lambda: float(rnd.randrange(5)), lambda: math.exp(rnd.uniform(-30, 30)), lambda: -0.0, lambda: float("inf")]
    return [rnd.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("ranges,partitions", [(None, 1), (7, 4), (100, 3)])
def test_nearest_rank_by_group(spark, ranges, partitions):
    rnd = random.Random(ranges)
    groups = {"hot": draws(rnd, 3000), "one": [2.5], None: draws(rnd, 50), "same": [1.0] * 40, "two": [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(partitions)
    ranks = {f"p{p}": F.least(F.floor(F.col("total") * p / F.lit(100)), F.col("total") - 1) + 1 for p in Q.PERCENTILES}
    got = {r._group.g: r for r in S.at_ranks(S.counted(df, "v", ["g"]), ranks, ranges).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        assert [got[g][f"p{p}"] for p in Q.PERCENTILES] == [vs[min(len(vs) * p // 100, len(vs) - 1)] for p in Q.PERCENTILES]
        assert got[g].total == len(vs)


def test_linear_quantile_interpolates(spark):
    rnd = random.Random(4)
    groups = {k: [rnd.random() for _ in range(k)] for k in (1, 2, 3, 10, 1001)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double")
    for q in (0.0, 0.5, 0.8, 1.0):
        got = {r.g: r.quantile for r in Q.linear_quantile(df, "v", q, ["g"]).collect()}
        for g, vs in groups.items():
            vs, at = sorted(vs), (g - 1) * q
            low = vs[math.floor(at)]
            assert got[g] == pytest.approx(low + (vs[math.ceil(at)] - low) * (at - math.floor(at)))


def test_weighted_percentiles(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([rnd.random(), 0.5, 7.0]), float(rnd.randrange(4))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "v double, w double")
    got = Q.weighted_percentiles(df, "v", F.col("w")).first()
    total, upto, want = sum(w for _, w in rows), 0.0, {}
    for v, w in sorted(rows):
        upto += w
        for p in Q.PERCENTILES:
            if upto >= total * p / 100.0:
                want.setdefault(f"p{p:02d}", v)
    assert got.asDict() == want


def test_nothing_and_no_weight(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert Q.nearest_rank(df, "v", group=["g"]).collect() == []
    none = spark.createDataFrame([(3.0, 0.0), (1.0, 0.0)], "v double, w double")
    assert Q.weighted_percentiles(none, "v", F.col("w"), [50]).first().p50 == 1.0


def test_clashing_column_names(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 3.0, 6)], "total string, name double, _weight int")
    got = Q.nearest_rank(df, "name", [50], ["total"]).collect()
    assert [tuple(r) for r in got] == [("a", 3.0)]


@pytest.mark.parametrize("n", [0, 1, 7, 50, 10_000])
def test_largest(spark, n):
    rnd = random.Random(n)
    rows = [(k, rnd.choice([1.0, 2.0, 2.0, rnd.random() * 3, None])) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, s double").repartition(5)
    got = sorted(r.id for r in S.largest(df, F.col("s"), n, ["id"]).collect())
    want = sorted(rows, key=lambda r: (-r[1] if r[1] is not None else float("inf"), r[0]))[:n]
    assert got == sorted(k for k, _ in want)
