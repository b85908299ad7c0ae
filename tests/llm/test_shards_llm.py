"""Shards of near equal size, gapless slots, hot keys subdivided."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracegrove.llm import shards


def shard(spark, rows, n, **options):
    df = spark.createDataFrame(rows, "k string, t long, size long, slot string")
    return df, shards.shard_records(df, "k", "t", "size", n, **options).collect()


def check(rows, n):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(max(1, r.size or 0) for r in by.get(k, [])) for k in range(n)]
    biggest = max(max(1, r.size or 0) for r in rows)
    assert max(sizes) - min(sizes) <= 2 * biggest + 0.04 * sum(sizes) / n
    return sizes


def test_sizes_are_near_equal_with_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [(f"k{rnd.randrange(500)}" if i % 3 else "hot", i, rnd.randrange(10, 200), "s") for i in range(6000)]
    _, got = shard(spark, rows, 10, range_rows=100)
    assert len(got) == len(rows) and {r.t for r in got} == set(range(6000))
    check(got, 10)
    # A key that is a small part of a shard is not cut apart, but by a range's end inside a hot one.
    small = {}
    for r in got:
        if r.k != "hot":
            small.setdefault(r.k, set()).add(r.shard)
    assert sum(len(s) > 1 for s in small.values()) <= 20


def test_repeated_rows_nulls_and_one_key(spark):
    rows = [("same", 1, 50, None)] * 900 + [(None, None, None, "z")] * 100
    _, got = shard(spark, rows, 7)
    assert len(got) == 1000
    check(got, 7)


def test_few_rows_and_none(spark):
    _, got = shard(spark, [("a", 1, 5, None)], 4)
    assert [(r.shard, r.slot) for r in got] == [(0, 0)]
    df, got = shard(spark, [], 4)
    assert got == []
    assert set(shards.shard_records(df, "k", "t", "size", 4).columns) == {"k", "t", "size", "shard", "slot"}


def test_shards_do_not_depend_on_the_partitions(spark):
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("t"), (F.col("id") % 97 + 1).alias("size"))
    sizes = []
    for n in (1, 5):
        got = shards.shard_records(rows.repartition(n), "k", "t", "size", 8).collect()
        sizes.append(check(got, 8))
    assert len(sizes[0]) == len(sizes[1]) == 8
