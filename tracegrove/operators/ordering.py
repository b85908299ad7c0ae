"""Order-sensitive building blocks.

Spark tables have no file order, so every operator here names its order columns; together
they must be unique. None of them puts a whole group into one task:

* running totals work on *buckets*, coarse prefixes of the order. Bucket sums are
  pre-aggregated, a window runs over the buckets only, and a second window runs inside each
  bucket. With ``bucket = row_no div width`` a bucket holds at most ``width`` rows of a group.
* first/last per key are aggregates with map-side combine instead of windows.
* top-n per group takes the top n of hashed sub-groups first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 20


def order_key(order: Sequence[str]) -> Column:
    """One comparable value for a list of order columns."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def row_bucket(row_no: str, width: int = BUCKET_ROWS) -> Column:
    return F.floor(F.col(row_no) / F.lit(width))


def running_total(
    df: DataFrame,
    value: Column,
    *,
    order: Sequence[str],
    bucket: Sequence[Column],
    partition: Sequence[str] = (),
    name: str = "running",
    total: str | None = None,
) -> DataFrame:
    """Add the inclusive prefix sum of ``value`` within ``partition``, in ``order``.

    ``bucket`` must grow with ``order`` (an order-preserving coarse prefix). ``total``, when
    named, adds the sum over the whole partition.
    """
    spots = [f"_b{i}" for i in range(len(bucket))]
    # A struct key also matches NULLs inside it, so no row gets lost in the join.
    keyed = df.select("*", value.alias("_value"), F.struct(*partition, *[b.alias(s) for b, s in zip(bucket, spots)]).alias("_key"))
    sums = keyed.groupBy("_key").agg(F.sum("_value").alias("_sum"))
    group = [F.col(f"_key.{c}") for c in partition]
    before = W.partitionBy(*group).orderBy(*[F.col(f"_key.{s}") for s in spots])
    fields = [
        F.coalesce(F.sum("_sum").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset")
    ]
    if total:
        fields.append(F.sum("_sum").over(W.partitionBy(*group)).alias(total))
    offsets = sums.select("_key", *fields)
    inside = W.partitionBy("_key").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        keyed.join(offsets, "_key")
        .withColumn(name, F.col("_offset") + F.sum("_value").over(inside))
        .drop("_key", "_value", "_offset")
    )


def position(
    df: DataFrame,
    *,
    order: Sequence[str],
    bucket: Sequence[Column],
    partition: Sequence[str] = (),
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based place of each row within ``partition``."""
    one = F.lit(1).cast("bigint")
    return running_total(df, one, order=order, bucket=bucket, partition=partition, name=name, total=total)


# --- keyed bijection -------------------------------------------------------------------------

#: Rounds of the bijection, and how often a place outside is mapped on. Fewer than sqrt(n) of the places
#: mapped are outside, so the last step is never reached up to n = 4096 and by no row in practice beyond.
MIX_ROUNDS, MIX_STEPS, MIX_MASK = 6, 64, 2**31 - 1


def mix_keys(seed: int) -> list[tuple[int, int, int]]:
    """(multiplier, addend, second multiplier) of each round, from the seed: 31 bits, odd multipliers."""
    digests = [hashlib.sha256(f"{seed}|{r}".encode()).digest() for r in range(MIX_ROUNDS)]
    words = [[int.from_bytes(d[4 * i : 4 * i + 4], "big") >> 1 for i in range(3)] for d in digests]
    return [(m | 1, s, t | 1) for m, s, t in words]


def shuffled_place(place: Column, n: Column, seed: int) -> Column:
    """Where the row at a 0-based place of n goes: a bijection of 0 .. n - 1 drawn by the seed.

    A place is a pair of numbers below a = ceil(sqrt(n)) and b = ceil(n / a); every round adds a hash of one to
    the other. What lands outside n goes through the rounds again. No row has to know another one, so a shuffle
    costs neither a sort nor an exchange. n may be up to 2^40.
    """
    n = n.cast("bigint")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    b = F.ceil(n.cast("double") / a).cast("bigint")

    rounds = F.array(*[F.struct(F.lit(k % 2).alias("k"), F.lit(m).alias("m"), F.lit(s).alias("s"), F.lit(t).cast("bigint").alias("t")) for k, (m, s, t) in enumerate(mix_keys(seed))])

    def once(x: Column) -> Column:
        def step(p: Column, q: Column) -> Column:
            x = (F.when(q["k"] == 0, p["r"]).otherwise(p["l"]) * q["m"] + q["s"]).bitwiseAND(MIX_MASK)
            hashed = F.shiftright(x.bitwiseXOR(F.shiftright(x, 13)) * q["t"], 24)
            return F.struct(
                F.when(q["k"] == 0, (p["l"] + hashed) % a).otherwise(p["l"]).alias("l"),
                F.when(q["k"] == 0, p["r"]).otherwise((p["r"] + hashed) % b).alias("r"),
            )

        pair = F.struct((x % a).alias("l"), F.call_function("div", x, a).alias("r"))
        return F.aggregate(rounds, pair, step, lambda p: p["r"] * a + p["l"])

    def inside(x: Column) -> Column:
        again = F.aggregate(F.sequence(F.lit(1), F.lit(MIX_STEPS)), x, lambda y, _: F.when(y < n, y).otherwise(once(y)))
        return F.when(x < n, x).otherwise(again)

    return F.transform(F.array(once(place.cast("bigint"))), inside)[0]


def shuffled_place_sql(place: str, n: str, seed: int) -> str:
    """:func:`shuffled_place` as a DuckDB expression."""
    a = f"CAST(ceil(sqrt({n})) AS BIGINT)"
    b = f"CAST(ceil(CAST({n} AS DOUBLE) / {a}) AS BIGINT)"

    def once(x: str) -> str:
        pair = f"{{'l': {x} % {a}, 'r': {x} // {a}}}"
        for k, (m, s, t) in enumerate(mix_keys(seed)):
            x = f"(({'p.r' if k % 2 == 0 else 'p.l'} * {m} + {s}) & {MIX_MASK})"
            hashed = f"((xor({x}, {x} >> 13) * {t}) >> 24)"
            left, right = f"(p.l + {hashed}) % {a}", f"(p.r + {hashed}) % {b}"
            changed = f"{{'l': {left}, 'r': p.r}}" if k % 2 == 0 else f"{{'l': p.l, 'r': {right}}}"
            pair = f"list_transform([{pair}], lambda p: {changed})[1]"
        return f"list_transform([{pair}], lambda p: p.r * {a} + p.l)[1]"

    start = f"list_transform([{place}], lambda x: {once('x')})[1]"
    return f"list_reduce([{start}] || range({MIX_STEPS}), lambda y, k: CASE WHEN y < {n} THEN y ELSE {once('y')} END)"


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), order_key(order)).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest order per key."""
    return _one_per_key(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest order per key."""
    return _one_per_key(df, keys, order, F.max_by)


def top_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    *,
    limit: Column | None = None,
    rank: str = "rank",
    spread: int = 32,
) -> DataFrame:
    """Rows ranked at most ``n`` within their group, with the rank.

    ``limit`` may lower ``n`` row by row (for instance by category). A group may hold a large
    share of all rows, so it is ranked in two steps: first inside ``spread`` sub-groups of
    input tasks, where each task passes on its own top ``n`` only, then as a whole. Exact for
    every split, because a row of the overall top ``n`` is in the top ``n`` of any part.
    """
    within = F.col(rank) <= n
    if limit is not None:
        within = within & (F.col(rank) <= limit)
    ranked = df
    if spread > 1:
        local = W.partitionBy(*group, "_part").orderBy(*order)
        ranked = (
            df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(spread)))
            .withColumn(rank, F.row_number().over(local))
            .filter(within)
            .drop("_part", rank)
        )
    return ranked.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(within)
