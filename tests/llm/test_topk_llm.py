"""Exact top-k against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrove.llm import topk


def brute(rows, k):
    usable = [(i, np.floor(64 * np.array(v, float)).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in sorted({i: x for i, x in reversed(usable) if i % 5 == 0}.items()):
        scored = sorted((-int((v * c).sum() if len(v) else 0), i) for i, c in usable if i != q and len(c) == len(v))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def run(spark, rows, k, partitions=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, v array<float>, score string, rank int").repartition(partitions)
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, "vec_id", "v", F.col("vec_id") % 5 == 0, k).collect()}


@pytest.mark.parametrize("k", [1, 7])
def test_equals_brute_force(spark, k):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=8)]) for i in range(200)]
    assert run(spark, rows, k) == brute(rows, k)


def test_ties_nulls_lengths_and_few_candidates(spark):
    same = [0.5, 0.25]
    rows = [(i, same) for i in range(60)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan"), 1.0]), (103, [float("inf"), 1.0]), (None, same)]
    rows += [(105, [1.0, 2.0, 3.0]), (106, [1.0, 1.0, 1.0]), (110, []), (111, [])]
    assert run(spark, rows, 9) == brute(rows, 9)


def test_scores_beyond_single_precision(spark):
    rows = [(i, [float(2**18 + i), float(-(2**17)), 1.0 + i / 64]) for i in range(30)]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_empty(spark):
    assert run(spark, [], 3) == set()
    assert run(spark, [(1, [1.0])], 3) == set()


def test_small_chunks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 4)
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(50)]
    assert run(spark, rows, 5) == brute(rows, 5)
