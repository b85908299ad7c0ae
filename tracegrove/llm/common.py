"""Helpers shared by the operators of this subpackage: lineage cuts, Arrow batches, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import delete

U64 = np.uint64
#: Texts are hashed in runs of about this many bytes, so that the 8-byte arrays stay small.
RUN_BYTES = 2 << 20
_roots: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only where it is unset (tests on one machine) a
    temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if "local" not in _roots:
        _roots["local"] = tempfile.mkdtemp(prefix="checkpoint-")
    return _roots["local"]


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder all executors share, without its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """While queries run whose shuffles nothing reads again: the files go at each one's end, not when the driver
    happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in that folder: several times smaller than a checkpoint for narrow rows,
    and of known size, so that Spark broadcasts it only if it is small. Cleaned up with the folder, or
    before by ``passing``."""
    path = f"{shared_root(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    if (paths := _passing.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passing(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The step with its result stored and the tables deleted that it stored on the way."""

    @wraps(step)
    def run(*args, **options) -> DataFrame:
        mark = _passing.set(paths := [])
        try:
            out = stored(step(*args, **options))
        finally:
            _passing.reset(mark)
        for path in paths[:-1]:
            delete(out.sparkSession, path)
        if (outer := _passing.get()) is not None:
            outer.append(paths[-1])
        return out

    return run


def leaders(rows: DataFrame, key: str, member: str, *more: str) -> DataFrame:
    """(key, lead) with the most central member of every key, and what else is told of it: the one that
    meets the most others over all its keys. In a group of copies that is the text the others vary."""
    size = rows.groupBy(key).agg(F.count("*").alias("size"))
    degree = rows.join(size, key).groupBy(member).agg(F.sum("size").alias("degree"))
    best = F.max(F.struct("degree", member, *more)).alias("best")
    return rows.join(degree, member).groupBy(key).agg(best).select(key, "best.*").drop("degree").withColumnRenamed(member, "lead")


_ONES = np.array([bin(k).count("1") for k in range(256)], np.int64)


def sketch_of(own: np.ndarray, bits: int) -> bytes:
    """Parity of the number of a set's hashes at each of the bits. Sketches that differ in d bits mean
    sets that differ in d members at least."""
    at = (mixed(own) % U64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).tobytes()


def near_by_sketch(percent: int) -> Callable:
    """For mapInArrow over (a, b, size of a, size of b, sketch of a, sketch of b): the pairs whose sketches
    allow the similarity."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (4, 5))
            differ = _ONES[x ^ y].sum(axis=1)
            keep = 50 * (n - differ) * (100 + percent) >= 100 * percent * n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` followed by further fields."""
    return StructType(df.schema.fields + StructType.fromDDL(ddl).fields)


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the keys, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / float(2**53)


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large strings, null as the empty text."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts as one array, and the n + 1 offsets in it."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each; a longer text is a range of its own."""
    if not len(texts):
        return
    _, off = buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# --- hashes of byte spans --------------------------------------------------------------------


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit over all others."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_ODD = U64(0x9E3779B97F4A7C15)
_ODD_INVERSE = U64(pow(int(_ODD), -1, 2**64))
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd number and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n + 1:
        size = max(n + 1, RUN_BYTES + (RUN_BYTES >> 1))
        for key, base in (("up", _ODD), ("down", _ODD_INVERSE)):
            seq = np.full(size, base, dtype=np.uint64)
            seq[0] = 1
            _powers[key] = np.multiply.accumulate(seq)
    return _powers["up"], _powers["down"]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of raw[start:end] for every span; ``fold`` takes A-Z as a-z.

    One prefix sum of byte codes times powers of an odd number; a span's share of it, moved back to
    power 0 by the inverse, depends on its bytes alone.
    """
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_BYTE_FOLDED if fold else _BYTE)[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * U64(0xA24BAED4963EE407))


NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACES)] = False
#: ASCII letters and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
ALNUM = LETTERS.copy()
ALNUM[48:58] = True


def word_spans(raw: np.ndarray, off: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes of one kind, never across texts, and each text's first
    word: words first[i]:first[i + 1] are those of text i."""
    inside = kind[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = off[:-1]
    cut = cut[cut < len(raw)]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` words in a row (over the whole array; the caller cuts at texts)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * U64(0x9FB21C651E98DF25) + words[k : k + n]
    return mixed(out)


def sums_per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's stretch of ``values`` (rows), 0 where it has none."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


# --- fixed-size bit filters ------------------------------------------------------------------


def _packed_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        word, bits = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        yield pa.RecordBatch.from_pydict({"word": pa.array([word.astype(np.int32).tobytes()]), "bits": pa.array([bits.tobytes()])})


def bit_filter(df: DataFrame, column: str, log_bits: int) -> np.ndarray:
    """2^log_bits bits as bytes, with the bit of every value of a long column set.

    The values are or-ed into 64-bit words in Spark, so what reaches the driver is bounded by the filter.
    """
    at = F.col(column).bitwiseAND((1 << log_bits) - 1)
    words = df.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr("1L").alias("one"), at.bitwiseAND(63).cast("int").alias("bit"))
    words = words.select("word", F.call_function("shiftleft", F.col("one"), F.col("bit")).alias("mask"))
    with cleaned(df.sparkSession):
        got = words.groupBy("word").agg(F.bit_or("mask").alias("bits")).mapInArrow(_packed_words, "word binary, bits binary").collect()
    out = np.zeros(1 << (log_bits - 6), np.int64)
    for r in got:
        out[np.frombuffer(bytes(r["word"]), np.int32)] = np.frombuffer(bytes(r["bits"]), np.int64)
    return out.view(np.uint8)


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the (long) values may be in the filter: all that are, and few others."""
    at = values & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
