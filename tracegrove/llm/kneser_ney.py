"""Text quality by an interpolated modified Kneser-Ney model of trusted text.

The model is a trigram model over words as they are written: runs of letters and digits, runs of other
visible bytes, and every character from U+3000 on by itself, as scripts without blanks need it. A text ends
with an end token. Counts, contexts and continuation counts are tables keyed by 64-bit hashes of the n-grams,
sharded by their key, and grow with the trusted text. Words that no trusted text has are spelled: the lowest
order is interpolated with a Kneser-Ney 4-gram model over 64 byte symbols of the trusted vocabulary (each
symbol's probability is dealt evenly to its bytes). Only that table is bounded by the alphabet and broadcast.

A trigram's log-probability is written as a sum over the n-grams that end with it: what each adds to the
backed-off value of the shorter one, plus the back-off weight it has as a context; n-grams without count add
nothing. So a run of documents (about ``BATCH_BYTES``) asks for its distinct n-grams, packed by shard, the shards
look them up, and sums per document remain. A bit filter of the model's keys lets a run leave out most n-grams
that the model does not have; what it lets through in excess finds nothing in the shards. The model is built slice
by slice of the trigrams' middle words and asked in turns of documents, as either would need several times the
input's size on disk at once.

Half of the trusted documents, by a hash of their id, train the model; the other half gives every
language its threshold, a high quantile of their log-perplexities plus a margin. A language with fewer
than ``few`` of them takes the threshold of all. A document above its threshold is not kept.

Defined cases: a null or empty text has a null perplexity and is not kept; a null language takes the
threshold of all; without trusted text nothing is known, and every document with text is kept; repeated
rows and several labels of one id count once for trust; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import delete
from .common import ALNUM, NOT_SPACE, buffers, cleaned, mixed, runs, settle, shared_root, signed, span_hashes, stored, text_column

ORDER = 4
SYMBOLS = 64
CODES = SYMBOLS**ORDER
BEGIN = 63
#: Up to so many ids (16 bytes each) the trusted set is broadcast; a larger one is joined by shuffle.
BROADCAST_IDS = 4_000_000

_SYMBOL = np.full(256, 62, np.int32)
_SYMBOL[[9, 11, 12, 13, 32]] = 0
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[48:58] = 27
_SYMBOL[128:] = 28 + (np.arange(128) & 31)
_SYMBOL[10] = 60
_SYMBOL[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 61
#: Bytes that share each byte's symbol, as a logarithm.
_SHARED = np.log(np.bincount(_SYMBOL, minlength=SYMBOLS)[_SYMBOL])

BATCH_BYTES = 2 << 20
BATCH_DOCS = 1 << 16
FILTER_BITS = 27
#: Trigrams lie in 2^3 slices by their middle word, made in two turns; the model's shards have some 2^20 values.
SLICE_BITS, TURNS, LEAST_SHARD_BITS = 3, 2, 5
#: Turns at most in which documents ask for their n-grams.
MOST_TURNS = 16
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
VALUES = "shard long, keys binary, units binary, fine binary, wide binary"
#: Values are multiples of this, so that their sums do not depend on the order.
UNIT = 2.0**-24
#: Further bits of what is stored, as the values of a key are added up before they are rounded.
FINE = 16
START, END = np.uint64(0x5B0F3C1D2E4A6987), np.uint64(0xA1C3E5F708192B4D)
_KIND = np.where(ALNUM, 1, np.where(NOT_SPACE, 2, 0)).astype(np.int8)


def codes_of(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For every byte the 4-gram that ends with it; before a text stand three begin symbols."""
    s = _SYMBOL[raw]
    out = s.copy()
    lead = np.arange(len(s)) - np.repeat(off[:-1], np.diff(off))
    for k in range(1, ORDER):
        back = np.full_like(s, BEGIN)
        back[k:] = s[:-k] if len(s) > k else s[:0]
        back[lead < k] = BEGIN
        out += back << (6 * k)
    return out


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CODES, np.int64)
    for batch in it:
        texts = text_column(batch, "text")
        for i, j in runs(texts):
            np.add.at(total, codes_of(*buffers(texts[i:j])), 1)
    at = np.flatnonzero(total)
    for k in range(0, len(at), 1 << 18):
        part = at[k : k + (1 << 18)]
        yield pa.RecordBatch.from_pydict({"code": pa.array(part, pa.int32()), "n": pa.array(total[part], pa.int64())})


def gram_counts(docs: DataFrame) -> DataFrame:
    """(code, n) of all texts."""
    return docs.select("text").mapInArrow(_counted, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _classes(counts: DataFrame) -> list[int]:
    """How many counts are one, two, three and four."""
    seen = [F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    return [int(v or 0) for v in counts.agg(*seen).first()]


def _cuts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts of one, two, and three or more."""
    n1, n2, n3, n4 = (float(v) for v in (n1, n2, n3, n4))
    if min(n1, n2, n3) == 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    return _cuts(*_classes(counts))


def probabilities(trusted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(code, logp) of every wanted code under the model of the trusted counts."""
    level = {ORDER: trusted}
    for k in range(ORDER - 1, 0, -1):
        level[k] = settle(level[k + 1].groupBy((F.col("code") % SYMBOLS**k).alias("code")).agg(F.count("*").alias("n")))
    p = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(level[k])
        n = F.col("n")
        discount = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        context = F.floor(F.col("code") / SYMBOLS).cast("int")
        totals = level[k].groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(discount).alias("held"))
        asked = wanted.select((F.col("code") % SYMBOLS**k).cast("int").alias("code")).distinct() if k < ORDER else wanted.select("code")
        rows = asked.join(level[k].select(F.col("code").cast("int").alias("code"), "n"), "code", "left")
        rows = rows.withColumn("context", context).join(totals, "context", "left")
        own = F.greatest(F.coalesce(n, F.lit(0)) - F.when(n.isNull(), 0.0).otherwise(discount), F.lit(0.0))
        if p is None:
            lower = F.lit(1.0 / SYMBOLS)
        else:
            rows = rows.withColumn("suffix", (F.col("code") % SYMBOLS ** (k - 1)).cast("int")).join(p.select(F.col("code").alias("suffix"), F.col("p").alias("lower")), "suffix")
            lower = F.col("lower")
        value = F.when(F.col("total").isNull(), lower).otherwise((own + F.col("held") * lower) / F.col("total"))
        p = rows.select("code", value.alias("p"))
    return p.select("code", F.log("p").alias("logp"))


def _bundled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        code = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
        logp = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"code": pa.array([code.tobytes()], pa.binary()), "logp": pa.array([logp.tobytes()], pa.binary())})


@dataclass(frozen=True)
class Spelling:
    """Log-probabilities of the 4-grams of symbols in words."""

    code: np.ndarray
    logp: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(CODES, np.float32)
        out[self.code] = self.logp
        return out


@dataclass(frozen=True)
class Model:
    """``values``: (shard, keys, units, fine, wide) with the values of n-grams, bucketed by shard, the first ``bits`` bits of
    the key; a key may be there several times, and its values add up. ``seen``: bit filter of the keys; ``start``: what
    the contexts before a text add; ``unseen``: what every token adds besides its spelling."""

    values: DataFrame
    bits: int
    seen: np.ndarray
    spelling: Spelling
    start: float
    unseen: float


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash and text of every token, with an end token (of no bytes) after every text that is not empty."""
    kind = _KIND[raw]
    wide = raw >= 0xE3
    inner = wide.copy()
    inside = (raw & 0xC0) == 0x80
    for _ in range(3):
        inner[1:] |= inner[:-1] & inside[1:]
    kind[inner] = 3
    edge = wide.copy()
    edge[1:] |= kind[1:] != kind[:-1]
    edge[off[:-1][off[:-1] < len(raw)]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(raw))[: len(start)]
    start, end = start[kind[start] > 0], end[kind[start] > 0]
    text = np.searchsorted(off, start, side="right") - 1
    ends = np.flatnonzero(np.diff(off) > 0)
    order = np.argsort(np.concatenate([text, ends]), kind="stable")
    word = np.concatenate([span_hashes(raw, start, end, fold=False), np.full(len(ends), END)])
    stop = off[ends + 1]
    return np.concatenate([start, stop])[order], np.concatenate([end, stop])[order], word[order], np.concatenate([text, ends])[order]


def joined(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of the n-gram that continues the one of key ``left``."""
    return mixed(left * np.uint64(0x9FB21C651E98DF25) + word)


def grams(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every token: the one before it, and the keys of the bigram before it, its bigram and its trigram."""

    def back(k: int) -> np.ndarray:
        out = np.full(len(word), START)
        if len(word) > k:
            out[k:] = np.where(text[k:] == text[:-k], word[:-k], START)
        return out

    v, u = back(1), back(2)
    pair = joined(u, v)
    return v, pair, joined(v, word), joined(pair, word)


def spelling_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the spans as texts, a blank after each."""
    size = end - start + 1
    off = np.concatenate([[0], np.cumsum(size)])
    out = np.full(off[-1], 32, np.uint8)
    inside = np.ones(off[-1], bool)
    inside[off[1:] - 1] = False
    out[inside] = raw[np.repeat(start - off[:-1], size)[inside] + np.flatnonzero(inside)]
    return out, off


def spelled(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log-probability of every such text."""
    return np.add.reduceat(table[codes_of(raw, off)] - _SHARED[raw], off[:-1]) if len(off) > 1 else np.zeros(0)


def _spelled_codes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(CODES, bool)
    for batch in it:
        texts = text_column(batch, "text")
        for i, j in runs(texts):
            raw, off = buffers(texts[i:j])
            start, end, word, _ = tokens(raw, off)
            order, new = distinct(word)
            at = order[new]
            found[codes_of(*spelling_of(raw, start[at], end[at]))] = True
    yield pa.RecordBatch.from_pydict({"code": pa.array(np.flatnonzero(found), pa.int32())})


def _trigrams(turn: int) -> object:
    """Distinct trigrams of every run whose middle word falls to this turn."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = text_column(batch, "text")
            for i, j in runs(texts, BATCH_BYTES):
                raw, off = buffers(texts[i:j])
                _, _, word, text = tokens(raw, off)
                v, pair, _, trigram = grams(word, text)
                mine = np.flatnonzero(v >> np.uint64(64 - SLICE_BITS) & np.uint64(TURNS - 1) == turn)
                trigram = trigram[mine]
                order, new = distinct(trigram)
                cut = np.flatnonzero(new)
                at = mine[order[cut]]
                columns = [pa.array(signed(x[at]), pa.int64()) for x in (pair, v, word)]
                n = np.diff(np.append(cut, len(order)))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=["pair", "v", "w", "n"])

    return run


def _words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = np.zeros(0, np.uint64)
    for batch in it:
        texts = text_column(batch, "text")
        for i, j in runs(texts):
            raw, off = buffers(texts[i:j])
            start, end, word, _ = tokens(raw, off)
            order, new = distinct(word)
            word, at = word[order[new]], order[new]
            new = ~np.isin(word, known)
            word, at = word[new], at[new]
            if len(known) < 1 << 20:
                known = np.union1d(known, word)
            own = [raw[a:b].tobytes() + b" " for a, b in zip(start[at], end[at], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(word), pa.int64()), pa.array(own, pa.binary()).cast(pa.string())], names=["w", "text"])


def _spelled_words(state) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = state.value.table()
        for batch in it:
            raw, off = buffers(text_column(batch, "text"))
            base = spelled(raw, off, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.float64())], names=["w", "base"])

    return run


def vocabulary(docs: DataFrame) -> DataFrame:
    """(w, text) of every distinct word, a blank after each."""
    return docs.select("text").mapInArrow(_words, "w long, text string").groupBy("w").agg(F.first("text").alias("text"))


def spelling(words: DataFrame, docs: DataFrame) -> Spelling:
    """The spelling model of a vocabulary, for every 4-gram of symbols in words of ``docs``."""
    wanted = settle(docs.select("text").mapInArrow(_spelled_codes, "code int").distinct())
    table = probabilities(settle(gram_counts(words)), wanted).mapInArrow(_bundled, "code binary, logp binary").collect()
    got = [b"".join(bytes(r[c]) for r in table) for c in ("code", "logp")]
    return Spelling(np.frombuffer(got[0], np.int32), np.frombuffer(got[1], np.float32))


_WIDE = np.dtype([("at", "<u4"), ("units", "<i8")])


def _packed(bits: int) -> object:
    """Values (left, right, value) by shard: the key is that of ``left`` and ``right``, without ``right`` it is ``left``."""

    def blobs(key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(key)
        key, units = key[order], np.round(value[order] / UNIT * 2.0**FINE).astype(np.int64)
        shard = (key >> np.uint64(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, np.diff(shard) != 0))
        rows = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
            near = (units[a:b] >> FINE).astype(np.int32)
            at = np.flatnonzero(near != units[a:b] >> FINE)
            wide = np.empty(len(at), _WIDE)
            wide["at"], wide["units"] = at, units[a:b][at]
            rows.append((key[a:b].tobytes(), near.tobytes(), units[a:b].astype(np.uint16).tobytes(), wide.tobytes()))
        columns = [pa.array(x, pa.binary()) for x in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(shard[cut], pa.int64()), *columns], names=["shard", "keys", "units", "fine", "wide"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in it:
            left = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            alone = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            right = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            kept.append((np.where(alone, left, joined(left, right)), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)))
            n += len(left)
            if n >= 1 << 19:
                yield blobs(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                kept, n = [], 0
        if n:
            yield blobs(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    return run


def _bits_of(bits: int) -> object:
    """The part of the bit filter that a shard's keys set; a key's bit is told by its first ``FILTER_BITS`` bits."""

    def run(shard: pa.Table) -> pa.Table:
        no, size = shard.column("shard")[0].as_py(), 1 << max(0, FILTER_BITS - bits - 3)
        out = np.zeros(size * 8, bool)
        for x in shard.column("keys").to_pylist():
            out[(np.frombuffer(x, np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) - no * size * 8] = True
        return pa.table({"shard": pa.array([no], pa.int64()), "set": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    return run


def _filter(values: DataFrame, bits: int) -> np.ndarray:
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in values.select("shard", "keys").groupBy("shard").applyInArrow(_bits_of(bits), "shard long, set binary").collect():
        part = np.frombuffer(bytes(r["set"]), np.uint8)
        out[r["shard"] * len(part) : (r["shard"] + 1) * len(part)] = part
    return out


def _may(seen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the model: all that are, and few others."""
    at = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def distinct(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by value, and which of it begin a new value."""
    order = np.argsort(word)
    return order, np.append(True, np.diff(word[order]) != 0)[: len(word)]


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """While texts go to Python, Arrow batches of about one run each."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def _three(trusted: DataFrame) -> tuple[str, DataFrame]:
    """The trigrams (pair, v, w, n) of all texts, in folders by the first bits of the middle word. Made in turns, so
    that a part of them only is both shuffled and stored."""
    spark = trusted.sparkSession
    path = f"{shared_root(spark)}/llm-{uuid.uuid4().hex}"
    for turn in range(TURNS):
        rows = trusted.select("text").mapInArrow(_trigrams(turn), "pair long, v long, w long, n long")
        counts = rows.groupBy("pair", "v", "w").agg(F.sum("n").alias("n")).withColumn("slice", slice_of("v"))
        with cleaned(spark), short_batches(spark):
            counts.write.mode("append").partitionBy("slice").parquet(path)
    return path, spark.read.schema("pair long, v long, w long, n long, slice int").parquet(path)


def slice_of(word: str) -> Column:
    return F.shiftrightunsigned(F.col(word), 64 - SLICE_BITS).cast("int")


def learn(trusted: DataFrame, docs: DataFrame) -> Model:
    """The model of all trusted texts, which are among ``docs``, able to spell every word of these.

    All that a trigram needs but its last word hangs on its middle word. So the trigrams are worked up by slices of
    middle words, whose tables go before the next slice, and a slice's trigrams when its values are stored."""
    spark = trusted.sparkSession
    path, three = _three(trusted)
    total = three.count()
    n_slices = 1 << SLICE_BITS
    step = n_slices // min(n_slices, 1 << max(0, (total >> 20).bit_length()))
    slices = [range(k, k + step) for k in range(0, n_slices, step)]
    drop = lambda *tables: [delete(spark, x) for t in tables for x in {f.rsplit("/", 1)[0] for f in t.inputFiles()}]

    def threes(mine: range) -> DataFrame:
        return three.filter(F.col("slice").between(mine[0], mine[-1])).drop("slice")

    def twos(mine: range) -> DataFrame:
        return stored(threes(mine).groupBy("v", "w").agg(F.count("*").alias("n")))

    classes, ones = np.zeros(4, np.int64), []
    for mine in slices:
        two = twos(mine)
        classes += np.array(_classes(two))
        ones.append(stored(two.groupBy(F.col("w").alias("key")).agg(F.count("*").alias("n"))))
        drop(two)
    one = stored(reduce(DataFrame.unionByName, ones).groupBy("key").agg(F.sum("n").alias("n")))
    drop(*ones)
    with short_batches(spark):
        words = stored(vocabulary(trusted))
        letters = spelling(words, docs)
    state = spark.sparkContext.broadcast(letters)
    bases = words.mapInArrow(_spelled_words(state), "w long, base double").withColumnRenamed("w", "key")

    def weighed(level: DataFrame, cuts: tuple[float, float, float]) -> DataFrame:
        d1, d2, d3 = cuts
        return level.withColumn("held", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))

    def contexts(level: DataFrame, context: str) -> DataFrame:
        """(context, total, back) of every context, ``back`` the share of the shorter one."""
        sums = level.groupBy(F.col(context).alias("context")).agg(F.sum("n").alias("total"), F.sum("held").alias("held"))
        return stored(sums.select("context", "total", (F.col("held") / F.col("total")).alias("back")))

    def gained(rows: DataFrame, lower: str) -> DataFrame:
        """With ``p`` and what the n-gram adds to its logarithm over the backed-off value."""
        rows = rows.withColumn("p", (F.col("n") - F.col("held")) / F.col("total") + F.col("back") * F.exp(lower))
        return rows.withColumn("logp", F.log("p")).withColumn("gain", F.col("logp") - F.log("back") - F.col(lower))

    one = weighed(one, _discounts(one))
    all_one = one.agg(F.sum("n").alias("total"), F.sum("held").alias("held")).first()
    unseen = float(all_one.held) / all_one.total if all_one.total else 1.0
    rows = one.join(bases, "key").withColumns({"total": F.lit(float(all_one.total or 1)), "back": F.lit(unseen)})
    p1 = stored(gained(rows, "base").select("key", "logp", "gain"))
    drop(one, words)
    cuts2, cuts3 = _cuts(*classes.tolist()), _discounts(three)
    bits = min(FILTER_BITS - 3, max(LEAST_SHARD_BITS, (3 * total >> 20).bit_length()))
    name = f"llm_{uuid.uuid4().hex}"
    place = f"{shared_root(spark)}/{name}"
    none = F.lit(None).cast("long").alias("right")
    first = signed(np.array([START, joined(np.array([START]), np.array([START]))[0]]))
    start = 0.0
    for mine in slices:
        two, own = weighed(twos(mine), cuts2), weighed(threes(mine), cuts3)
        pairs, triples = contexts(two, "v"), contexts(own, "pair")
        rows = two.join(pairs.withColumnRenamed("context", "v"), "v").join(p1.select(F.col("key").alias("w"), F.col("logp").alias("lower")), "w")
        p2 = stored(gained(rows, "lower").select("v", "w", "logp", "gain"))
        rows = own.join(triples.withColumnRenamed("context", "pair"), "pair").join(p2.select("v", "w", F.col("logp").alias("lower")), ["v", "w"])
        back = pairs.select(F.col("context").alias("key"), F.log("back").alias("back"))
        in_slice = p1.filter(slice_of("key").between(mine[0], mine[-1])).join(back, "key", "left")
        values = [
            in_slice.select(F.col("key").alias("left"), none, (F.col("gain") + F.coalesce("back", F.lit(0.0))).alias("value")),
            p2.select(F.col("v").alias("left"), F.col("w").alias("right"), F.col("gain").alias("value")),
            triples.select(F.col("context").alias("left"), none, F.log("back").alias("value")),
            gained(rows, "lower").select(F.col("pair").alias("left"), F.col("w").alias("right"), F.col("gain").alias("value")),
        ]
        blobs = reduce(DataFrame.unionByName, values).mapInArrow(_packed(bits), VALUES)
        with cleaned(spark):
            blobs.repartition(1 << bits, "shard").write.mode("append").format("parquet").option("path", place).bucketBy(1 << bits, "shard").saveAsTable(name)
        for level, c in ((pairs, first[0]), (triples, first[1])):
            start += level.filter(F.col("context") == int(c)).agg(F.max(F.log("back"))).first()[0] or 0.0
        drop(two, pairs, triples, p2)
        for k in mine:
            delete(spark, f"{path}/slice={k}")
        three = spark.read.schema(three.schema).parquet(path)
    drop(p1)
    table = spark.table(name)
    return Model(table, bits, _filter(table, bits), letters, start, float(np.log(unseen)))


def _asked(state, bits: int, start: float, unseen: float) -> object:
    """Rows (shard, run, keys, times, own, given, n, base): of a run of documents, by shard, every n-gram that the model
    may have, how often it stands there, and the document of each time; and once for the run its documents, their
    number of tokens, and what they have apart from n-grams."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, letters = state.value
        table = letters.table()
        number = TaskContext.get().partitionId() << 24
        for batch in it:
            texts, given = text_column(batch, "__text"), batch.column(0)
            for i, j in ((k, min(j, k + BATCH_DOCS)) for i, j in runs(texts, BATCH_BYTES) for k in range(i, j, BATCH_DOCS)):
                raw, off = buffers(texts[i:j])
                begin, end, word, text = tokens(raw, off)
                order, new = distinct(word)
                at, back = order[new], np.empty(len(word), np.int64)
                back[order] = np.cumsum(new) - 1
                base = np.round((spelled(*spelling_of(raw, begin[at], end[at]), table) + unseen) / UNIT)[back] * UNIT
                n = np.bincount(text, minlength=j - i).astype(np.int64)
                total = np.bincount(text, weights=base, minlength=j - i) + round(start / UNIT) * UNIT
                _, _, bigram, trigram = grams(word, text)
                keys, own = np.concatenate([word, bigram, trigram]), np.tile(text, 3).astype(np.uint16)
                may = _may(seen, keys)
                keys, own = keys[may], own[may]
                order, new = distinct(keys)
                keys, own, new = keys[order], own[order], np.flatnonzero(new)
                times, keys = np.diff(np.append(new, len(keys))).astype(np.uint32), keys[new]
                shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
                cut = np.flatnonzero(np.append(True, np.diff(shard) != 0)[: len(shard)])
                ends, marks = np.append(cut, len(keys)).tolist(), np.append(new[cut], len(own)).tolist()
                none = [None] * len(cut)
                rows = {
                    "shard": pa.array([*shard[cut].tolist(), int(mixed(np.array([number], np.uint64))[0]) % (1 << bits)], pa.int64()),
                    "run": pa.array([number] * (len(cut) + 1), pa.int64()),
                    "keys": pa.array([*(keys[a:b].tobytes() for a, b in pairwise(ends)), None], pa.binary()),
                    "times": pa.array([*(times[a:b].tobytes() for a, b in pairwise(ends)), None], pa.binary()),
                    "own": pa.array([*(own[a:b].tobytes() for a, b in pairwise(marks)), None], pa.binary()),
                    "given": pa.concat_arrays([pa.nulls(len(cut), pa.list_(given.type)), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), given[i:j])]),
                    "n": pa.array([*none, n.tobytes()], pa.binary()),
                    "base": pa.array([*none, total.tobytes()], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(rows)
                number += 1

    return run


def _found(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Of one shard: for every run the sums of what its documents' n-grams find in the model. A run's own row stays."""
    whole = asked.column("keys").is_null()
    out = [asked.filter(whole).select(["run", "own", "given", "n", "base"]).append_column("sums", pa.nulls(pc.sum(whole).as_py() or 0, pa.binary()))]
    rows = asked.filter(pc.invert(whole)).select(["run", "keys", "times", "own"]).to_pylist()
    if rows and model.num_rows:
        units = []
        for near, fine, wide in zip(*(model.column(c).to_pylist() for c in ("units", "fine", "wide")), strict=True):
            x, far = (np.frombuffer(near, np.int32).astype(np.int64) << FINE) + np.frombuffer(fine, np.uint16), np.frombuffer(wide, _WIDE)
            x[far["at"]] = far["units"]
            units.append(x)
        keys, units = np.concatenate([np.frombuffer(x, np.uint64) for x in model.column("keys").to_pylist()]), np.concatenate(units)
        order = np.argsort(keys)
        keys, units = keys[order], units[order]
        first = np.flatnonzero(np.append(True, np.diff(keys) != 0))
        keys, units = keys[first], np.round(np.add.reduceat(units, first) / 2.0**FINE).astype(np.int64)
        told = []
        for r in rows:
            own, k = np.frombuffer(r["own"], np.uint16), np.frombuffer(r["keys"], np.uint64)
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            value = np.where(keys[at] == k, units[at], 0)
            n = int(own.max()) + 1
            sums = np.bincount(own, weights=np.repeat(value, np.frombuffer(r["times"], np.uint32)), minlength=n)
            some = np.flatnonzero(sums)
            told.append((r["run"], some.astype(np.uint16).tobytes(), sums[some].astype(np.int64).tobytes()))
        run, own, sums = zip(*told, strict=True)
        columns = {"run": pa.array(run, pa.int64()), "own": pa.array(own, pa.binary()), "sums": pa.array(sums, pa.binary())}
        columns |= {c: pa.nulls(len(run), asked.schema.field(c).type) for c in ("given", "n", "base")}
        out.append(pa.table(columns).select(out[0].column_names).cast(out[0].schema))
    return pa.concat_tables(out)


def _summed(rows: pa.Table) -> pa.Table:
    """(given, n_symbols, total) of the documents of a run."""
    own_row = rows.filter(rows.column("n").is_valid())
    given = own_row.column("given").combine_chunks().flatten()
    n, total = (np.frombuffer(own_row.column(c)[0].as_py(), kind) for c, kind in (("n", np.int64), ("base", np.float64)))
    units = np.zeros(len(n), np.int64)
    for own, sums in zip(*(rows.filter(rows.column("sums").is_valid()).column(c).to_pylist() for c in ("own", "sums")), strict=True):
        units[np.frombuffer(own, np.uint16)] += np.frombuffer(sums, np.int64)
    return pa.table({"given": given, "n_symbols": pa.array(n), "total": pa.array(total + units * UNIT)})


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity) of every row of ``docs``; the symbols are tokens, the end token among them.

    The documents ask in turns, so that what is shuffled at a time is a share of what they ask for. A turn is chosen by
    what a row holds, whatever task reads it."""
    parts, cores = docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    turns = max(1, min(MOST_TURNS, -(-parts // max(1, cores))))
    given = docs.select(F.struct("doc_id", "lang").alias("given"), F.col("text").alias("__text"))
    kind = given.schema["given"].dataType.simpleString()
    state = docs.sparkSession.sparkContext.broadcast((model.seen, model.spelling))
    scored = []
    for turn in range(turns):
        mine = given
        if turns > 1:
            mine = given.filter(F.pmod(F.xxhash64("given", "__text"), F.lit(turns)) == turn).coalesce(-(-parts // turns))
        fields = f"run long, {{}}own binary, given array<{kind}>, n binary, base binary"
        asked = mine.mapInArrow(_asked(state, model.bits, model.start, model.unseen), f"shard long, {fields.format('keys binary, times binary, ')}")
        found = asked.groupBy("shard").cogroup(model.values.groupBy("shard")).applyInArrow(_found, f"{fields.format('')}, sums binary")
        told = found.groupBy("run").applyInArrow(_summed, f"given {kind}, n_symbols long, total double")
        perplexity = F.when(F.col("n_symbols") > 0, F.exp(-F.col("total") / F.col("n_symbols"))).alias("perplexity")
        told = told.select("given.doc_id", "given.lang", "n_symbols", perplexity)
        with short_batches(docs.sparkSession):
            scored.append(stored(told))
    return reduce(DataFrame.unionByName, scored)


def classify(
    docs: DataFrame,
    trusted_ids: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quantile: float = 0.99,
    margin: float = 0.05,
    few: int = 50,
) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, keep) of every document.

    ``trusted_ids`` has one column, the ids of the trusted documents.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    ids = trusted_ids.toDF("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    small = ids.count() <= BROADCAST_IDS

    def of_trusted(half: int, rows: DataFrame = rows) -> DataFrame:
        mine = ids.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)) == half)
        return rows.join(F.broadcast(mine) if small else mine, "doc_id", "left_semi")

    scored = perplexities(rows, learn(of_trusted(0), rows))
    log_ppl = F.log("perplexity")
    held = of_trusted(1, scored).filter(F.col("perplexity").isNotNull())
    high = F.percentile_approx(log_ppl, quantile, 10_000)
    limits = held.groupBy("lang").agg(high.alias("high"), F.count("*").alias("n")).filter(F.col("lang").isNotNull() & (F.col("n") >= few))
    limits = settle(limits.select("lang", F.exp(F.col("high") + margin).alias("own")))
    overall = held.agg(F.exp(high + margin)).first()[0]
    everywhere = F.lit(float("inf") if overall is None else float(overall))
    # Each of these rows stands for ``few`` trusted documents of one language; the check bounds its size.
    hinted = F.broadcast(limits) if limits.count() <= BROADCAST_IDS else limits
    scored = scored.join(hinted, "lang", "left")
    threshold = F.coalesce("own", everywhere)
    return scored.select(
        "doc_id",
        "lang",
        "n_symbols",
        "perplexity",
        threshold.alias("threshold"),
        (F.col("perplexity").isNotNull() & (F.col("perplexity") <= threshold)).alias("keep"),
    )
