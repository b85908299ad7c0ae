"""Benchmark decontamination by greedy string tiling.

Words are compared in lower case. A Karp-Rabin hash of every ``min_match`` words in a row is a seed; a
fixed-size bit filter of the benchmark's seeds lets a document's other seeds go where it is read, and a
join on the seed leads to candidate pairs of document and item. A pair stays if the item words under any
common seed could reach the threshold. Tiling then marks the longest common run of unmarked words, again
and again, until none of ``min_match`` words is left; the part of the item under tiles is its coverage.
Tiles may come in any order, so reordered passages count in full. A document is contaminated if some item
is covered to the ``threshold``.

Equal texts are looked at once, known by two 64-bit hashes. Only documents with a common seed are
shuffled (their words' hashes, not their texts).

Defined cases: null and empty texts are clean, and null or empty items match nothing; an item of fewer
than ``min_match`` words is matched as one whole run; of several best items the smallest id is named;
repeated rows get the same verdict; an empty benchmark leaves all documents clean; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, buffers, runs, settle, shingle_hashes, signed, span_hashes, text_column, word_spans

#: Bits of the seed filter.
FILTER_BITS = 1 << 24
#: Up to so many contaminated texts (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def words_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of every text."""
    for i, j in runs(texts):
        raw, off = buffers(texts[i:j])
        start, end, first = word_spans(raw, off, ALNUM)
        h = span_hashes(raw, start, end)
        for d in range(j - i):
            yield h[first[d] : first[d + 1]]


def seeds_of(words: np.ndarray, width: int) -> np.ndarray:
    """Seeds of a text; seeds of another width never meet."""
    return signed(shingle_hashes(words, width) + np.uint64(width))


def _items(min_match: int) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for item, w in zip(batch.column(0).to_pylist(), words_of(text_column(batch, "text")), strict=True):
                if len(w) and item is not None:
                    width = min(min_match, len(w))
                    rows += [(item, len(w), w.tobytes(), width, int(s), k) for k, s in enumerate(seeds_of(w, width))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32()]
            names = ["item_id", "n_words", "item_words", "width", "seed", "item_at"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _hits(state, widths: list[int]) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(state.value, np.uint8)).astype(bool)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for batch in it:
            rows = []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), words_of(text_column(batch, "text")), strict=True)
            for h1, h2, w in keys:
                found = []
                for width in widths:
                    s = seeds_of(w, width)
                    found.append(np.unique(s[bits[s & (FILTER_BITS - 1)]]))
                own = np.concatenate(found) if found else np.zeros(0, np.int64)
                if len(own):
                    rows.append((h1, h2, w.tobytes(), own))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h1", "h2", "words", "seeds"])

    return run


def tiles(a: np.ndarray, b: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (place in a, place in b, length) of every tile."""
    k = min(min_match, len(a))
    if not k or len(b) < k:
        return []
    sa, sb = seeds_of(a, k), seeds_of(b, k)
    order = np.argsort(sb, kind="stable")
    lo, hi = np.searchsorted(sb[order], sa, "left"), np.searchsorted(sb[order], sa, "right")
    i = np.repeat(np.arange(len(sa)), hi - lo)
    if not len(i):
        return []
    j = order[np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)])]
    same = np.ones(len(i), bool)
    for step in range(k):  # equal hashes, equal words
        same &= a[i + step] == b[j + step]
    i, j = i[same], j[same]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    # Seeds that follow each other on one diagonal are one run.
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(i))) + k - 1
    heap = [(-int(n), int(i[s]), int(j[s])) for s, n in zip(at, length, strict=True)]
    heapq.heapify(heap)
    used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out = []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        free = ~(used_a[x : x + n] | used_b[y : y + n])
        if free.all():
            used_a[x : x + n] = used_b[y : y + n] = True
            out.append((x, y, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if e - s >= k:
                heapq.heappush(heap, (-int(e - s), x + int(s), y + int(s)))
    return out


def _tile(min_match: int) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            covered = [sum(n for _, _, n in tiles(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), min_match)) / (len(x) // 8) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)] + [pa.array(covered, pa.float64())], names=["h1", "h2", "item_id", "coverage"])

    return run


def text_keys(text: str) -> dict:
    """Two hashes that stand for a text."""
    own = F.coalesce(F.col(text), F.lit(""))
    return {"__h1": F.xxhash64(F.lit(1), own), "__h2": F.xxhash64(F.lit(2), own)}


def contaminated_texts(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = 4, threshold: float = 0.5
) -> DataFrame:
    """(h1, h2, item_id, coverage, n_items) of every text that covers an item to the threshold."""
    spark = docs.sparkSession
    given = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.lower(item_text).alias("text"))
    items = settle(given.mapInArrow(_items(min_match), "item_id long, n_words int, item_words binary, width int, seed long, item_at int"))
    bits = np.zeros(FILTER_BITS, bool)
    bits[items.select((F.col("seed").bitwiseAND(FILTER_BITS - 1)).cast("int").alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)] = True
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    state = spark.sparkContext.broadcast(np.packbits(bits).tobytes())
    keys = text_keys(text)
    rows = docs.select(keys["__h1"].alias("h1"), keys["__h2"].alias("h2"), F.lower(text).alias("text"))
    found = rows.mapInArrow(_hits(state, widths), "h1 long, h2 long, words binary, seeds array<long>")
    hits = settle(found.groupBy("h1", "h2").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds")))
    narrow = hits.select("h1", "h2", F.explode("seeds").alias("seed")).join(items.select("seed", "item_id", "n_words", "width", "item_at"), "seed")
    under = F.flatten(F.collect_set(F.sequence(F.col("item_at"), F.col("item_at") + F.col("width") - 1)))
    pairs = narrow.groupBy("h1", "h2", "item_id").agg(F.size(F.array_distinct(under)).alias("under"), F.first("n_words").alias("n_words"))
    pairs = pairs.filter(F.col("under") >= threshold * F.col("n_words")).select("h1", "h2", "item_id")
    whole = items.filter(F.col("item_at") == 0).select("item_id", "item_words")
    both = pairs.join(hits.select("h1", "h2", "words"), ["h1", "h2"]).join(whole, "item_id").select("h1", "h2", "item_id", "item_words", "words")
    covered = both.mapInArrow(_tile(min_match), "h1 long, h2 long, item_id long, coverage double").filter(F.col("coverage") >= threshold)
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("item")))
    out = covered.groupBy("h1", "h2").agg(best.alias("best"), F.countDistinct("item_id").alias("n_items"))
    return out.select("h1", "h2", (-F.col("best.item")).alias("item_id"), F.col("best.coverage").alias("coverage"), "n_items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` with its text's verdict (``contaminated``, ``item_id``, ``coverage``,
    ``n_items``), and the rows of ``docs`` that are clean."""
    names = ("contaminated", "item_id", "coverage", "n_items")
    bad = settle(contaminated_texts(docs, benchmark, text, **options).withColumnsRenamed({"h1": "__h1", "h2": "__h2"}))
    small = bad.count() <= BROADCAST_KEYS
    hinted = F.broadcast(bad) if small else bad
    keyed = docs.withColumns(text_keys(text))
    told = keyed.drop(*names).join(hinted, ["__h1", "__h2"], "left").withColumn("contaminated", F.col("coverage").isNotNull())
    clean = keyed.join(hinted.select("__h1", "__h2") if not small else F.broadcast(bad.select("__h1", "__h2")), ["__h1", "__h2"], "left_anti")
    return told.drop("__h1", "__h2"), clean.select(*docs.columns)
