"""Order-sensitive operators: brute force, hot keys, and the same result for any split."""

from __future__ import annotations

import random
import statistics
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tracegrove.operators import mining, mixing, ordering, quantiles, rollouts, trainlog


def skewed(n=600, seed=1):
    """Rows of which a third share one key."""
    rng = random.Random(seed)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 9)}", rng.randint(0, 50)) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return skewed()


@pytest.fixture(params=[1, 4, 16])
def table(request, spark, rows):
    df = spark.createDataFrame(rows, "row_no bigint, key string, value bigint")
    return df.repartition(request.param)


def test_running_total(table, rows):
    got = ordering.running_total(
        table, F.col("value"), order=["row_no"], bucket=[ordering.row_bucket("row_no", 50)], partition=["key"], total="all"
    )
    sums, want = {}, {}
    for i, k, v in sorted(rows):
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    assert {r.row_no: r.running for r in got.collect()} == want
    assert {(r.key, r["all"]) for r in got.select("key", "all").distinct().collect()} == set(sums.items())


def test_running_total_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "row_no bigint, key string")
    got = ordering.position(df, order=["row_no"], bucket=[ordering.row_bucket("row_no", 1)], partition=["key"])
    assert {(r.row_no, r.position) for r in got.collect()} == {(1, 1), (2, 2), (3, 1)}


def test_first_last_top(table, rows):
    by_key = {}
    for r in sorted(rows):
        by_key.setdefault(r[1], []).append(r)
    first = ordering.first_per_key(table, ["key"], ["row_no"]).select("row_no", "key", "value").collect()
    last = ordering.last_per_key(table, ["key"], ["row_no"]).select("row_no", "key", "value").collect()
    assert {tuple(r) for r in first} == {v[0] for v in by_key.values()}
    assert {tuple(r) for r in last} == {v[-1] for v in by_key.values()}
    top = ordering.top_per_group(table, ["key"], [F.desc("value"), F.asc("row_no")], 5)
    want = {(k, x[0], i + 1) for k, v in by_key.items() for i, x in enumerate(sorted(v, key=lambda x: (-x[2], x[0]))[:5])}
    assert {(r.key, r.row_no, r["rank"]) for r in top.collect()} == want


def test_quantiles(table, rows):
    values = {}
    for _, k, v in rows:
        values.setdefault(k, []).append(v)
    med = {r.key: r.m for r in quantiles.linear_quantile(table, "value", 0.5, ["key"], "m").collect()}
    low = {r.key: r.m for r in quantiles.lower_median(table, "value", ["key"], "m").collect()}
    assert med == {k: statistics.median(v) for k, v in values.items()}
    assert low == {k: statistics.median_low(v) for k, v in values.items()}
    everything = sorted(v for vs in values.values() for v in vs)
    got = quantiles.nearest_rank(table, "value").first()
    for p in quantiles.PERCENTILES:
        assert got[f"p{p:02d}"] == everything[min(int(len(everything) * p / 100), len(everything) - 1)]


def test_value_bucket_never_decreases(spark):
    values = sorted([random.Random(3).uniform(-1, 1) * 10.0**e for e in range(-9, 9) for _ in range(40)] + [0.0])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.value_bucket(F.col("v")).alias("b"))
    buckets = [r.b for r in df.orderBy("v").collect()]
    assert buckets == sorted(buckets)


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def greedy(items, k, thr, anchor=None):
    kept = [anchor] if anchor is not None else []
    picks = []
    for i, x in items:
        if len(kept) >= k:
            break
        if all(jaccard(x, y) < thr for y in kept):
            kept.append(x)
            picks.append(i)
    return picks


@pytest.mark.parametrize("parts", [1, 16])
@pytest.mark.parametrize(("k", "thr", "anchored"), [(3, 0.5, False), (2, 0.7, False), (4, 0.3, True), (1, 0.7, False)])
def test_greedy_diverse(spark, parts, k, thr, anchored):
    rng = random.Random(7)
    data = [(i, "hot" if i % 2 else f"p{i % 5}", [rng.randint(0, 6) for _ in range(rng.randint(0, 5))]) for i in range(120)]
    df = spark.createDataFrame(data, "row_no bigint, pid string, ids array<int>").repartition(parts)
    anchors = {"hot": [1, 2, 3]} if anchored else {}
    adf = spark.createDataFrame(list(anchors.items()), "pid string, ids array<int>") if anchored else None
    got = mining.greedy_diverse(df, key="pid", order=["row_no"], items="ids", k=k, threshold=thr, anchors=adf)
    groups = {}
    for i, p, x in data:
        groups.setdefault(p, []).append((i, x))
    want = {i for p, items in groups.items() for i in greedy(items, k, thr, anchors.get(p))}
    assert {r.row_no for r in got.collect()} == want


def test_exact_threshold_is_rejected(spark):
    rows = [(1, "p", list(range(7))), (2, "p", list(range(10)))]
    df = spark.createDataFrame(rows, "row_no bigint, pid string, ids array<int>")
    got = mining.greedy_diverse(df, key="pid", order=["row_no"], items="ids", k=2, threshold=0.7)
    assert [r.row_no for r in got.collect()] == [1]


def corpus(spark):
    """(part, id, category, tokens): ids repeat inside and across parts, the cap hits part two."""
    parts = {
        "A_one": [("x", "c1", 3), ("x", "c1", 2), ("y", "drop", 9), ("z", "c2", 1)],
        "B_two": [("x", "c1", 5), ("y", "c1", 4), ("w", "c2", 8), ("v", "c2", 1)],
        "C_three": [("y", "c1", 1), ("q", "c2", 1)],
    }
    out = {}
    for name, rows in parts.items():
        data = [(i, p, c, list(range(n)), [1] * n, 1.0, 1.0) for i, (p, c, n) in enumerate(rows)]
        out[name] = spark.createDataFrame(
            data, "row_no bigint, problem_id string, category string, tokens array<int>, mask array<tinyint>, weight double, sign double"
        )
    return out


@pytest.mark.parametrize("parts", [1, 16])
def test_merge(spark, parts):
    merged = mixing.union_parts(corpus(spark)).repartition(parts)
    counts = spark.createDataFrame([("x", 3), ("z", 8), ("y", 0)], "problem_id string, pass_count bigint")
    options = {"drop_rules": ["A:drop"], "dedup_ids": True, "max_tokens": 12, "pass_counts": counts, "boundary": 2.0, "zero": 0.5}
    rows = mixing.merge_corpus(merged, **options).collect()
    assert {(r.part_index, r.row_no, r.weight) for r in rows} == {(0, 0, 2.0), (0, 1, 2.0), (0, 3, 1.0), (1, 1, 0.5)}
    assert sum(r.n_tokens for r in rows) <= 12
    flagged = mixing.flag_merge(merged, **options)
    by_source = {r.source: (r.read_rows, r.emitted_rows, r.skipped_category, r.skipped_dedup) for r in mixing.merge_by_source(flagged).collect()}
    assert by_source == {"A": (4, 3, 1, 0), "B": (3, 1, 0, 1)}
    hist = {r.pass_count: r["rows"] for r in mixing.pass_count_histogram(flagged).collect()}
    assert hist == {3: 2, 8: 1, 0: 1}
    no_cap = mixing.merge_corpus(merged, drop_rules=["A:drop"], dedup_ids=True)
    assert {(r.part_index, r.row_no) for r in no_cap.collect()} == {(0, 0), (0, 1), (0, 3), (1, 1), (1, 2), (1, 3), (2, 1)}


def test_token_budget_cut(spark):
    merged = mixing.union_parts(corpus(spark))
    got = {(r.part_index, r.row_no) for r in mixing.token_budget_cut(merged, 14).collect()}
    assert got == {(0, 0), (0, 1), (0, 2)}
    assert mixing.token_budget_cut(merged, 0).count() == 10


def test_drop_rule_errors():
    assert mixing.parse_drop_rules(["a:x, y", "b:z"]) == [("a", "x"), ("a", "y"), ("b", "z")]
    for bad in ("nocolon", ":x"):
        with pytest.raises(ValueError):
            mixing.parse_drop_rules([bad])


def test_row_checks(spark):
    df = spark.createDataFrame(
        [("a", "c", [1, 2], [1], 1.0, 1.0), ("b", "c", [1], [0], 1.0, 1.0)],
        "problem_id string, category string, tokens array<int>, mask array<tinyint>, weight double, sign double",
    )
    r = mixing.row_problems(df).first()
    assert (r.length_mismatch, r.nothing_trained) == (1, 1)
    with pytest.raises(Exception, match="differ in length"):
        mixing.require_valid_rows(df).collect()
    with pytest.raises(KeyError):
        mixing.row_problems(df.drop("sign"))


def test_single_category_mixture(spark):
    df = spark.createDataFrame([("c", 5)], "category string, mass bigint")
    assert mixing.mixture_weights(df).first().category_weight == 1.0
    with pytest.raises(Exception, match="only one category"):
        mixing.mixture_weights(df, strict=True).collect()


@pytest.mark.parametrize("parts", [1, 16])
def test_batches(spark, parts):
    data = [(i, "abc"[i % 7 % 3]) for i in range(101)]
    df = spark.createDataFrame(data, "row_no bigint, category string").repartition(parts)
    dealt = trainlog.stratified_batches(df, 10, 3, ["row_no"]).collect()
    sizes, per = {}, {}
    for r in dealt:
        sizes[r.batch] = sizes.get(r.batch, 0) + 1
        per.setdefault(r.category, {}).setdefault(r.batch, 0)
        per[r.category][r.batch] += 1
    assert len(dealt) == 101 and len(sizes) == 11 and max(sizes.values()) - min(sizes.values()) <= 1
    for c in per.values():
        counts = [c.get(b, 0) for b in sizes]
        assert max(counts) - min(counts) <= 1
    steps = {r.row_no: r.step for r in trainlog.sequential_batches(df, 10, epochs=0.5).collect()}
    assert steps == {i: i // 10 for i in range(50)}


def test_review_state_equals_the_loop(spark):
    rng = random.Random(5)
    log = [(i, "p" if i % 2 else "q", i // 4, rng.uniform(0, 3), 1.0) for i in range(60)]
    df = spark.createDataFrame(log, "row_no bigint, problem_id string, step bigint, loss double, step_mean double").repartition(7)
    ema = {}
    for _, p, _, loss, _ in log:
        ema[p] = 0.9 * ema.get(p, 1.0) + 0.1 * loss
    got = {r.problem_id: r.ema for r in trainlog.review_state(df).collect()}
    assert got == pytest.approx(ema)


def test_replay_needs_every_row(spark):
    log = spark.createDataFrame([(0, 0, "a"), (1, 0, "b")], "row_no bigint, epoch int, problem_id string")
    corpus_rows = spark.createDataFrame([("a", 1)], "problem_id string, n int")
    with pytest.raises(Exception, match="missing in the corpus"):
        trainlog.replay_order(log, corpus_rows).collect()


def test_budget_equals_the_loop(spark):
    cats = [("numeral", 100, 5), ("cipher", 50, 32), ("cryptarithm_guess", 40, 4), ("other", 30, 9), ("bit_manipulation", 60, 64)]
    plan = spark.createDataFrame([(c, n, g, 0, 0) for c, n, g in cats], "category string, problems bigint, depth bigint, probe_n bigint, probe_tokens bigint")
    depth = {c: g for c, _, g in cats}
    count = {c: n for c, n, _ in cats}
    low = {c: 8 if c in rollouts.PREFERRED else 1 for c in depth}
    rank = {"numeral": 0, "cryptarithm_guess": 1, "other": 2, "cipher": 3, "bit_manipulation": 3}
    budget = 25000.0
    cost = lambda: sum(depth[c] * count[c] * 10.0 for c in depth)
    moved = True
    while cost() > budget and moved:
        moved = False
        for c in sorted(depth, key=lambda c: (rank[c], c)):
            if cost() <= budget:
                break
            if depth[c] > low[c]:
                depth[c] -= 1
                moved = True
    got = rollouts.fit_depths_to_budget(plan, budget, max_tokens=10).collect()
    assert {r.category: r.capped_depth for r in got} == depth
    assert depth["bit_manipulation"] < 64


def test_checks_survive_pruning(spark):
    log = spark.createDataFrame([(0, "a", 1), (0, "zz", 2)], "epoch int, problem_id string, row_no long")
    corpus = spark.createDataFrame([("a", 5)], "problem_id string, n int")
    bad = spark.createDataFrame([("a", [1, 2], [1])], "problem_id string, tokens array<int>, mask array<int>")
    for unrelated in (lambda d: d.count(), lambda d: d.select("problem_id").collect()):
        with pytest.raises(Exception, match="missing in the corpus"):
            unrelated(trainlog.replay_order(log, corpus))
        with pytest.raises(Exception, match="differ in length"):
            unrelated(mixing.require_valid_rows(bad))


def test_sampling_at_a_low_temperature(spark):
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate([1, 2, 3, 4, 5000])], "row_no long, length double")
    p = trainlog.annealed_probabilities(df, "length", 0.0, 1e-3, 1e-3)
    assert trainlog.weighted_sample(p, 3, 0, ["row_no"]).count() == 3


# --- keyed bijection -------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 10, 99, 1024, 4097, 30_011])
def test_shuffled_places_are_a_permutation(spark, n):
    place = ordering.shuffled_place(F.col("id"), F.lit(n), 5)
    got = [r[0] for r in spark.range(n).select(place).collect()]
    assert sorted(got) == list(range(n))
    if n >= 99:
        assert got != list(range(n)) and len(set(got[k + 1] - got[k] for k in range(n - 1))) > n / 10


def test_shuffled_places_equal_their_sql(spark):
    n = 5000
    got = [r[0] for r in spark.range(n).select(ordering.shuffled_place(F.col("id"), F.lit(n), 11)).collect()]
    sql = ordering.shuffled_place_sql("i", "n", 11)
    assert got == [r[0] for r in duckdb.sql(f"SELECT {sql} FROM (SELECT i, CAST({n} AS BIGINT) AS n FROM range({n}) t(i)) ORDER BY i").fetchall()]


@pytest.mark.parametrize("partitions", [1, 4])
def test_seeded_order_is_the_same_for_every_split(spark, partitions):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "row_no").repartition(partitions)
    got = {r.row_no: r.place for r in trainlog.seeded_order(df, 3).collect()}
    assert sorted(got.values()) == list(range(1000))
    assert got == {r.row_no: r.place for r in trainlog.seeded_order(df.repartition(7), 3).collect()}
    other = {r.row_no: r.place for r in trainlog.seeded_order(df, 4).collect()}
    assert sum(got[k] == other[k] for k in got) < 50


def test_batches_are_dealt_without_a_second_sort(spark):
    df = spark.range(500).select(F.col("id").alias("row_no"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("category"))
    dealt = trainlog.stratified_batches(df, 16, 1, ["row_no"])
    rows = dealt.collect()
    sizes = Counter(r.batch for r in rows)
    assert set(sizes) == set(range(32)) and max(sizes.values()) - min(sizes.values()) <= 1
    for b, n in sizes.items():
        assert sorted(r.place for r in rows if r.batch == b) == list(range(n))
    for c in "ab":
        counts = Counter(r.batch for r in rows if r.category == c)
        assert max(counts.values()) - min(counts[b] for b in sizes) <= 1
    plan = trainlog.stratified_batches(df, 16, 2, ["row_no"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 5  # for the ranks; 12 shuffles before
