"""Shards of the sampled splitters: shares of the bytes, slots, and every record once."""

from __future__ import annotations

import random

import pytest

from tracegrove.llm import shards


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 4), (3, 9)])
def test_shards_hold_equal_shares_of_the_bytes(spark, seed, partitions):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice([16, 17, 40, 400, 3000]), rnd.choice([rnd.randrange(10**6), 7])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, size long, key long").repartition(partitions)
    got = shards.shard_records(df, key="key", tie="doc_id", size="size", n_shards=40).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    total = sum(s for _, s, _ in rows)
    largest = max(s for _, s, _ in rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    assert set(by_shard) <= set(range(40))
    for own in by_shard.values():
        # A shard is as large as its share, but for the rows at its two ends.
        assert abs(sum(r.size for r in own) - total / 40) <= 2 * largest
        assert sorted(r.slot for r in own) == list(range(len(own)))
