"""Words of texts hashed in short runs, so that a Python worker stays small."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import SparkSession

from .common import U64, mixed

#: Texts are hashed in runs of about this many bytes, longer ones in pieces cut at a blank.
PIECE = 1 << 19
#: Texts that go to a Python worker at a time.
BATCH_ROWS = 1024


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: a polynomial of its bytes, by prefix sums over the run."""
    up, down = powers_of(_BASE, len(raw)), powers_of(_INVERSE, len(raw))
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(_CODES[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))
_CODES = mixed(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    """Powers 0, 1, ... of an odd number modulo 2^64, n of them at least."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + (PIECE >> 2)), base, U64)
        have[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(have)
    return have


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While texts are looked through, Arrow batches of few rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)
