"""Stable ids and uniform numbers from hashes, so that every rerun draws the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_interval(key: Column) -> Column:
    """First 64 bits of sha256(key) as a number in [0, 1)."""
    head = F.substring(F.sha2(key, 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def sha_mod(key: Column, modulus: int) -> Column:
    """sha256(key) as a 256-bit integer modulo ``modulus``, 32 bits at a time."""
    digest = F.sha2(key, 256)
    chunk = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"),
    )
    return F.aggregate(chunk, F.lit(0).cast("bigint"), lambda acc, c: (acc * 2**32 + c) % modulus)


def short_id(name: Column, i: Column) -> Column:
    """First 8 hex digits of sha256("<name>_<i>")."""
    return F.substring(F.sha2(F.concat_ws("_", name, i.cast("string")), 256), 1, 8)


def uniform(seed: int, *keys: Column) -> Column:
    """Seeded hash of the keys as a number in (0, 1); the top 53 bits of xxhash64."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (bits.cast("double") + 0.5) / float(2**53)


def pick_int(low: int, high: int, seed: int, *keys: Column) -> Column:
    """Seeded integer in [low, high]."""
    return (F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(high - low + 1))).cast("int")


def pick_from(options: list, seed: int, *keys: Column) -> Column:
    """Seeded choice out of a short list."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), pick_int(1, len(options), seed, *keys))


# --- draws that any SQL engine with sha256 repeats --------------------------------------------


def counter_bits(seed: int, *keys: Column) -> Column:
    """52 bits of sha256("seed|key|key..."), keys as text: a random number for each value of the counter."""
    return text_bits(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def text_bits(text: Column) -> Column:
    """:func:`counter_bits` of keys that are already joined to the text."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


def counter_uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from :func:`counter_bits`."""
    return (counter_bits(seed, *keys).cast("double") + 0.5) / float(2**52)


def counter_int(low: int, high: int, seed: int, *keys: Column) -> Column:
    """An integer in [low, high] from :func:`counter_bits`."""
    return (F.lit(low) + counter_bits(seed, *keys) % (high - low + 1)).cast("int")


def counter_pick(options: list, seed: int, *keys: Column) -> Column:
    """One of a short list from :func:`counter_bits`."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), counter_int(1, len(options), seed, *keys))


def counter_bits_sql(seed: int, *keys: str) -> str:
    """:func:`counter_bits` as DuckDB SQL."""
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST('0x' || substr(sha256({text}), 1, 13) AS BIGINT)"


def counter_uniform_sql(seed: int, *keys: str) -> str:
    return f"((CAST({counter_bits_sql(seed, *keys)} AS DOUBLE) + 0.5) / 4503599627370496.0)"


def counter_int_sql(low: int, high: int, seed: int, *keys: str) -> str:
    return f"({low} + {counter_bits_sql(seed, *keys)} % {high - low + 1})"
