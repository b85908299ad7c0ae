"""Fuzzy line deduplication by MinHash.

Lines are compared with A-Z as a-z by their sets of character shingles (``SHINGLE`` bytes). Equal lines
are one class. A class's signature has ``BANDS * ROWS`` minima. Short lines use one hash function for each
of them; long ones one-permutation hashing with optimal densification (every shingle is hashed once and
lands in one bin; an empty bin borrows from another one, chosen alike for all lines), and lines of a
middle length have both, so that lines of like length always meet. Classes that agree in a whole band are
candidates: at a similarity of 0.8 a pair shares one of the 9 bands of 4 with a probability of 0.991.
Candidates are compared exactly, and distributed union-find joins those of similarity ``PERCENT`` or
more. Of each component one line stays, the first by (document id, hash of text, line number).

As in the prefix join, a band's classes are first compared with the band's most central class, its lead; only
classes that are then still in different components are compared further. So a line with a million near
copies costs a million comparisons. In bands of more than ``FEW`` classes those apart meet by an exact filter
over what tells them from their lead (``LineDedup.apart``): many variants of one line that are not
similar enough differ from it in different ways, and no similar pair across components goes untested.

Only signatures' bands that occur twice are shuffled as rows, and only candidate lines' texts are.

Defined cases: a blank line always stays (it is layout, not a passage); a line shorter than a shingle is
one shingle; a null text has no lines and stays null; rows of one id and equal text are one document and get equal
results; null ids come first; a line of any length is used whole; an empty table gives an empty result;
columns other than the text are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, bit_filter, buffers, in_filter, leaders, mixed, near_by_sketch, passing, powers, runs, signed, span_hashes, stored, text_column
from .components import connected
from .words import small_batches

SHINGLE = 8
BANDS, ROWS = 9, 4
BINS = BANDS * ROWS
PERCENT = 80
SHARED_BITS, CLASS_BITS = 26, 24
#: Lines of fewer shingles than the second are short, of at least the first are long.
LONG, SHORT = 96, 160
SKETCH_BITS = 512
#: Bytes of sets that a task keeps while it compares.
KEPT_BYTES = 32 << 20
#: Texts are hashed so many bytes at a time, which a core's cache holds.
CACHE_BYTES = 1 << 18
#: Bands are counted by so many bytes of their hash, in parts by the last bits of these.
BAND_BITS, PART_BITS = 40, 12
#: A task deals out so many bands at a time.
DEALT_BANDS = 1 << 20
#: Of so many classes in a band those apart are compared pair by pair; of more, by what tells them from their lead.
FEW = 16
#: One of so many members tells which differences are frequent; the counts at which a key moves back in the order.
ORDER_SHARE, ORDER_LEVELS, ORDER_BITS = 8, (2, 6, 24, 96), 23
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_CODE[65:91] = _CODE[97:123]
_FACTOR = mixed(np.arange(2000, 2000 + BINS, dtype=np.uint64)) | np.uint64(1)


def line_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line that is not blank, its document and its line number."""
    breaks = np.flatnonzero(raw == 10)
    # Both are in order already, and the k-th end is the k-th line's.
    start = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, off[1:]]), kind="stable")
    count = np.diff(np.searchsorted(breaks, off)) + 1
    doc = np.repeat(np.arange(len(off) - 1), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    full = np.flatnonzero(end > start)
    start, end = start[full], end[full]
    seen = np.append(NOT_SPACE[raw], False).view(np.uint8)
    # Every other stretch is a line.
    keep = np.maximum.reduceat(seen, np.stack([start, end], axis=1).ravel())[::2] > 0 if len(full) else np.zeros(0, bool)
    full = full[keep]
    return start[keep], end[keep], doc[full], number[full]


def shingles(raw: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE bytes from every byte on."""
    n = len(raw) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODE[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[SHINGLE:] - total[:n]) * down[:n])


def minima(every: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """BINS minima of every line's shingles, each by a hash function of its own."""
    if not len(start):
        return np.zeros((0, BINS), np.uint64)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    h = every[np.repeat(start - first, count) + np.arange(count.sum())]
    out = np.empty((len(start), BINS), np.uint64)
    for k in range(BINS):
        # A product with an odd number reorders the hashes, which are well mixed already.
        out[:, k] = np.minimum.reduceat(h * _FACTOR[k], first)
    return out


def one_permutation(every: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """BINS minima of every line's shingles by one hash, empty bins filled from others."""
    lines = len(start)
    sig = np.full(lines * BINS, _NONE, np.uint64)
    at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    h = every[at]
    np.minimum.at(sig, np.repeat(np.arange(lines) * BINS, count) + (h % np.uint64(BINS)).astype(np.int64), h)
    sig = sig.reshape(lines, BINS)
    own = sig.copy()
    row, col = np.nonzero(sig == _NONE)
    step = np.uint64(0)
    while len(row):
        step += np.uint64(1)
        source = (mixed(col.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + step) % np.uint64(BINS)).astype(np.int64)
        own[row, col] = sig[row, source]
        still = own[row, col] == _NONE
        row, col = row[still], col[still]
    return own


def bands_of(sig: np.ndarray, kind: int) -> np.ndarray:
    """One 64-bit value for each band; the kinds of signature never meet."""
    value = np.tile(np.arange(100 * kind + 1, 100 * kind + BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        value = mixed(value * np.uint64(0x9FB21C651E98DF25) + sig[:, r::ROWS])
    return signed(value)


def line_bands(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, band) of every line's bands. A line shorter than a shingle is one shingle."""
    every = shingles(raw)
    n = end - start - SHINGLE + 1
    tiny, short, long = np.flatnonzero(n <= 0), np.flatnonzero((n > 0) & (n < SHORT)), np.flatnonzero(n >= LONG)
    whole = np.repeat(span_hashes(raw, start[tiny], end[tiny])[:, None], BINS, axis=1)
    parts = [
        (tiny, bands_of(whole, 0)),
        (short, bands_of(minima(every, start[short], n[short]), 1)),
        (long, bands_of(one_permutation(every, start[long], n[long]), 2)),
    ]
    return np.concatenate([np.repeat(at, BANDS) for at, _ in parts]), np.concatenate([b.ravel() for _, b in parts])


def _lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        texts = text_column(batch, "__text")
        keys = [batch.column(k) for k in range(2)]
        for i, j in runs(texts):
            parts = []
            for a, b in runs(texts[i:j], CACHE_BYTES):
                raw, off = buffers(texts[i + a : i + b])
                start, end, doc, number = line_spans(raw, off)
                parts.append((doc + i + a, number, signed(span_hashes(raw, start, end))))
            doc, number, cls = (np.concatenate(x) for x in zip(*parts, strict=True))
            take = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([k.take(take) for k in keys] + [pa.array(number, pa.int32()), pa.array(cls, pa.int64())], names=["doc_id", "text_hash", "line_no", "cls"])


def _held(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values are in the ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _bands(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0, np.int64)
    for batch in it:
        texts = text_column(batch, "__text")
        fresh = []
        for i, j in runs(texts):
            own, parts = np.zeros(0, np.int64), []
            for a, b in runs(texts[i:j], CACHE_BYTES):
                raw, off = buffers(texts[i + a : i + b])
                start, end, _, _ = line_spans(raw, off)
                cls, at = np.unique(signed(span_hashes(raw, start, end)), return_index=True)
                new = ~_held(seen, cls) & ~_held(own, cls)
                cls, at = cls[new], at[new]
                own = np.union1d(own, cls)
                line, bands = line_bands(raw, start[at], end[at])
                parts.append((cls, bands[np.argsort(line, kind="stable")], np.bincount(line, minlength=len(cls))))
            cls, bands, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            fresh.append(own)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(bands, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), lists], names=["cls", "bands"])
        seen = np.unique(np.concatenate([seen, *fresh]))


def _dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, bands) of lists of bands: those of one part, by what their hashes have beside it."""

    def rows(bands: np.ndarray) -> pa.RecordBatch:
        part = (bands & ((1 << PART_BITS) - 1)).astype(np.uint16)
        rest = ((bands & ((1 << BAND_BITS) - 1)) >> PART_BITS).astype(np.uint32)[np.argsort(part, kind="stable")]
        count = np.bincount(part, minlength=1 << PART_BITS)
        full = np.flatnonzero(count)
        ends = np.concatenate([[0], np.cumsum(count[full])]).astype(np.int32) * rest.itemsize
        lists = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(ends), pa.py_buffer(rest)])
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), lists], names=["part", "bands"])

    held, size = [], 0
    for batch in it:
        held.append(batch.column(0).flatten().to_numpy())
        size += len(held[-1])
        if size >= DEALT_BANDS:
            yield rows(np.concatenate(held))
            held, size = [], 0
    if size:
        yield rows(np.concatenate(held))


def _twice(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bands that occur twice, of rows (part, bands) in the order of parts."""

    def found(part: int, held: list[bytes]) -> np.ndarray:
        rest = np.sort(np.frombuffer(b"".join(held), np.uint32))
        return (np.unique(rest[1:][rest[1:] == rest[:-1]]).astype(np.int64) << PART_BITS) | part

    last, held = -1, []
    for batch in it:
        out = []
        for part, bands in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != last:
                out.append(found(last, held))
                last, held = part, []
            held.append(bands)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64())], names=["band"])
    yield pa.RecordBatch.from_arrays([pa.array(found(last, held), pa.int64())], names=["band"])


def _shared(state) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cls = np.repeat(batch.column(0).to_numpy(), np.diff(np.asarray(batch.column(1).offsets)))
            bands = batch.column(1).flatten().to_numpy()
            keep = in_filter(state.value, bands)
            yield pa.RecordBatch.from_pydict({"band": pa.array(bands[keep], pa.int64()), "cls": pa.array(cls[keep], pa.int64())})

    return run


def _texts(state) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in it:
            texts = text_column(batch, "__text")
            for i, j in runs(texts):
                known, parts = np.zeros(0, np.int64), []
                for a, b in runs(texts[i:j], CACHE_BYTES):
                    raw, off = buffers(texts[i + a : i + b])
                    start, end, _, _ = line_spans(raw, off)
                    cls = signed(span_hashes(raw, start, end))
                    may = np.flatnonzero(in_filter(state.value, cls))
                    found, at = np.unique(cls[may], return_index=True)
                    new = ~_held(seen, found) & ~_held(known, found)
                    found, at = found[new], may[at[new]]
                    known = np.union1d(known, found)
                    own = [raw[x:y].tobytes() for x, y in zip(start[at], end[at], strict=True)]
                    parts.append((found, own, *line_sketches(raw, start[at], end[at])))
                seen = np.union1d(seen, known)
                columns = [pa.array(np.concatenate([p[0] for p in parts]), pa.int64()), pa.array([x for p in parts for x in p[1]], pa.binary())]
                columns += [pa.array(np.concatenate([p[2] for p in parts]), pa.int64()), pa.array([x.tobytes() for p in parts for x in p[3]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["cls", "line", "n", "sketch"])

    return run


def line_set(line: bytes) -> np.ndarray:
    """The sorted distinct shingles of one line."""
    raw = np.frombuffer(line, np.uint8)
    every = shingles(raw)
    if not len(every):
        return span_hashes(raw, np.array([0]), np.array([len(raw)]))
    every.sort()
    new = np.empty(len(every), bool)
    new[0] = True
    np.not_equal(every[1:], every[:-1], out=new[1:])
    return every[new]


def line_sketches(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every line the size of its ``line_set`` and, as a row of bytes, that set's sketch."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros((0, SKETCH_BITS // 8), np.uint8)
    size = end - start
    first = np.cumsum(size) - size
    own = raw[np.repeat(start - first, size) + np.arange(size.sum())]
    count = np.maximum(size - SHINGLE + 1, 1)
    begin = np.cumsum(count) - count
    every = np.append(shingles(own), np.zeros(SHINGLE, np.uint64))
    every = every[np.repeat(first - begin, count) + np.arange(count.sum())]
    tiny = np.flatnonzero(size < SHINGLE)
    every[begin[tiny]] = span_hashes(own, first[tiny], first[tiny] + size[tiny])
    for a, b in zip(begin.tolist(), (begin + count).tolist(), strict=True):
        every[a:b].sort()
    new = np.append(True, every[1:] != every[:-1])
    new[begin] = True
    n = np.add.reduceat(new.astype(np.int64), begin)
    at = (mixed(every[new]) % np.uint64(SKETCH_BITS)).astype(np.int64) + np.repeat(np.arange(len(n)) * SKETCH_BITS, n)
    odd = np.bincount(at, minlength=len(n) * SKETCH_BITS) & 1
    return n, np.packbits(odd.astype(bool).reshape(len(n), SKETCH_BITS), axis=1)


def _compare(percent: int) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        kept = 0

        def of(cls: int, line: pa.Scalar) -> np.ndarray:
            nonlocal kept
            if cls not in known:
                if kept >= KEPT_BYTES:
                    known.clear()
                    kept = 0
                known[cls] = line_set(line.as_py())
                kept += known[cls].nbytes
            return known[cls]

        for batch in it:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = of(a, x), of(b, y)
                fits = 100 * len(x) >= percent * len(y) and 100 * len(y) >= percent * len(x)
                if fits:
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    fits = 100 * common >= percent * (len(x) + len(y) - common)
                keep.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _levels(state, keys: np.ndarray) -> np.ndarray:
    """How frequent each key is, by the filters it is in."""
    return sum((in_filter(bits, keys).astype(np.int64) for bits in state), np.zeros(len(keys), np.int64))


def _differences(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, int, int]]:
    """For (lead, cls, root, line, line of the lead): batch, row, keys of the shingles that only one of both lines
    has, and both sizes."""
    last, centre = None, np.zeros(0, np.uint64)
    for batch in it:
        for k, (lead, line) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3), strict=True)):
            if lead != last:
                last, centre = lead, line_set(batch.column(4)[k].as_py())
            own = line_set(line.as_py())
            salt = mixed(np.array([lead], np.int64).view(np.uint64))
            yield batch, k, signed(mixed(np.setxor1d(own, centre, assume_unique=True) ^ salt)), len(own), len(centre)


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Every batch with its rows."""
    group: list[tuple] = []
    for row in rows:
        if group and group[0][0] is not row[0]:
            yield group[0][0], group
            group = []
        group.append(row)
    if group:
        yield group[0][0], group


def _difference_keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, group in _grouped(_differences(it)):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys for _, _, keys, _, _ in group]), pa.int64())], names=["key"])


def _marks(state, percent: int) -> object:
    """Rows (key, place, cls, root, n, d, far, both) of the marks of a member; see ``LineDedup.apart``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = 100 - percent, 100 + percent
        for batch, group in _grouped(_differences(it)):
            parts = []
            for _, k, keys, n, centre in group:
                d = len(keys)
                far = q * d > p * (n + centre)
                # Before the first common key: with a partner far from the lead, and with any partner.
                inner = (q * d + p * (n - centre)) // (2 * q)
                # A partner has 100 / percent times as many shingles at most.
                wide = p * n // percent
                outer = min(wide, (wide + d) // 2) if far else inner
                keys = keys[np.lexsort((keys, _levels(state.value, keys)))][: max(inner, outer) + 1]
                at = np.arange(len(keys))
                parts.append((np.full(len(at), k), keys, at, np.full(len(at), n), np.full(len(at), d), np.full(len(at), far), at <= inner))
            if parts:
                row, key, place, n, d, far, both = (np.concatenate(x) for x in zip(*parts, strict=True))
                columns = [pa.array(key, pa.int64()), pa.array(place, pa.int32()), *(batch.column(c).take(pa.array(row)) for c in (1, 2))]
                columns += [pa.array(n, pa.int32()), pa.array(d, pa.int32()), pa.array(far, pa.bool_()), pa.array(both, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "place", "cls", "root", "n", "d", "far", "both"])

    return run


class LineDedup:
    """The deduplication of one table of documents."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> None:
        self.docs, self.doc_id, self.text = docs, doc_id, text
        self.percent = percent
        self.given = docs.select(F.col(text).alias("__text"))
        self.context = docs.sparkSession.sparkContext

    def key(self) -> list[Column]:
        return [F.col(self.doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(self.text), F.lit(""))).alias("text_hash")]

    def lines(self) -> DataFrame:
        """(doc_id, text_hash, line_no, cls) of every line that is not blank."""
        rows = self.docs.select(*self.key(), F.col(self.text).alias("__text"))
        return rows.mapInArrow(_lines, "doc_id long, text_hash long, line_no int, cls long")

    def texts(self, shared: DataFrame) -> DataFrame:
        """(cls, line, n, sketch) of all classes that share a band."""
        state = self.context.broadcast(bit_filter(shared, "cls", CLASS_BITS))
        found = self.given.mapInArrow(_texts(state), "cls long, line binary, n long, sketch binary")
        return stored(found.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("line", "n", "sketch")]))

    @passing
    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Those of the class pairs (a, b) that are similar enough."""
        told = pairs
        for c in ("a", "b"):
            told = told.join(texts.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
        told = told.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near_by_sketch(self.percent), "a long, b long")
        pairs = stored(told)
        x = texts.select(F.col("cls").alias("a"), F.col("line").alias("x"))
        y = texts.select(F.col("cls").alias("b"), F.col("line").alias("y"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        with small_batches(self.docs.sparkSession):  # rows have two lines each
            return stored(both.mapInArrow(_compare(self.percent), "a long, b long"))

    def apart(self, members: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs (a, b) of members (lead, cls, root) of one lead and different roots, all that are similar enough among them.

        By the triangle inequality two members resemble each other only if what tells them from the lead is
        much the same. Let D be the shingles that only one of member and lead has. D(x) and D(y) differ as
        x and y do, so with t the similarity wanted and s = (1 - t) / (1 + t) * (|x| + |y|) at most
        (s + |D(x)| - |D(y)|) / 2 keys of D(x) are missing from D(y). In one order of all keys, the rare ones
        first, the first common key therefore has so many keys before it at most in x, and likewise in y: each
        member's first keys are its marks. One of two members of different roots is far from the lead (less
        similar than t), which bounds the marks of the other. Nothing is estimated but the order.
        """
        spark = self.docs.sparkSession
        lines = texts.select("cls", "line")
        with small_batches(spark):
            given = members.join(lines, "cls").join(lines.toDF("lead", "centre"), "lead").select("lead", "cls", "root", "line", "centre")
            given = stored(given.sortWithinPartitions("lead"))
            some = given.filter(F.pmod(F.xxhash64("cls"), F.lit(ORDER_SHARE)) == 0)
            counts = stored(some.mapInArrow(_difference_keys, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
            state = self.context.broadcast([bit_filter(counts.filter(F.col("n") >= k), "key", ORDER_BITS) for k in ORDER_LEVELS])
            marks = stored(given.mapInArrow(_marks(state, self.percent), "key long, place int, cls long, root long, n int, d int, far boolean, both boolean"))
        x = marks.filter("both").select("key", *[F.col(c).alias(f"{c}1") for c in ("place", "cls", "root", "n", "d", "far")])
        y = marks.filter("far").select("key", *[F.col(c).alias(f"{c}2") for c in ("place", "cls", "root", "n", "d")])
        p, q = 100 - self.percent, 100 + self.percent
        apart, both = q * (F.col("d1") - F.col("d2")), p * (F.col("n1") + F.col("n2"))
        fits = (2 * q * F.col("place1") <= both + apart) & (2 * q * F.col("place2") <= both - apart)
        sizes = (100 * F.col("n1") >= self.percent * F.col("n2")) & (100 * F.col("n2") >= self.percent * F.col("n1"))
        once = ~F.col("far1") | (F.col("cls1") < F.col("cls2"))
        met = x.join(y, "key").filter((F.col("root1") != F.col("root2")) & sizes & fits & once)
        return met.select(F.least("cls1", "cls2").alias("a"), F.greatest("cls1", "cls2").alias("b")).distinct()

    @passing
    def roots(self) -> DataFrame:
        """(node, root) of every class that is linked to another."""
        bands = stored(self.given.mapInArrow(_bands, "cls long, bands array<long>"))
        # A class that several tasks have counts twice too; being alone in its band it drops out below. Five
        # bytes of a band are enough here: what the filter lets through in excess drops out as well.
        dealt = bands.select("bands").mapInArrow(_dealt, "part int, bands binary").repartition("part").sortWithinPartitions("part")
        state = self.context.broadcast(bit_filter(dealt.mapInArrow(_twice, "band long"), "band", SHARED_BITS))
        found = stored(bands.mapInArrow(_shared(state), "band long, cls long").distinct())
        several = found.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
        found = stored(found.join(several, "band"))
        shared = stored(found.join(leaders(found, "band", "cls").withColumnRenamed("lead", "b"), "band"))
        texts = self.texts(shared)
        star = stored(shared.filter(F.col("cls") != F.col("b")).select(F.col("cls").alias("a"), "b").distinct())
        links = self.verified(star, texts)
        roots = connected(links)
        own = shared.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        split = own.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("band")
        rows = own.join(split, "band").filter(F.col("cls") != F.col("b"))
        rows = stored(rows.select("band", F.col("b").alias("lead"), "cls", "root"))
        sizes = rows.groupBy("band").agg(F.count("*").alias("size"))
        few = sizes.filter(F.col("size") <= FEW).select("band")
        members = rows.join(few, "band").select("band", "cls", "root")
        x, y = (members.select("band", F.col("cls").alias(c), F.col("root").alias(r)) for c, r in (("a", "r1"), ("b", "r2")))
        direct = x.join(y, "band").filter(F.col("r1") < F.col("r2")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        many = rows.join(sizes.filter(F.col("size") > FEW).select("band"), "band").select("lead", "cls", "root").distinct()
        between = direct.unionByName(self.apart(many, texts)).distinct()
        tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        between = stored(between.join(tested, ["a", "b"], "left_anti"))
        if between.isEmpty():
            return roots
        # Only the components that the second links join need a second union-find.
        top = roots.select(F.col("node").alias("a"), F.col("root").alias("r"))
        more = self.verified(between, texts).join(top, "a", "left").join(top.select(F.col("a").alias("b"), F.col("r").alias("s")), "b", "left")
        joined = connected(more.select(F.coalesce("r", "a").alias("a"), F.coalesce("s", "b").alias("b"))).toDF("root", "top")
        all_nodes = roots.unionByName(joined.select(F.col("root").alias("node"), "root").join(roots, "node", "left_anti"))
        return all_nodes.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))

    def removed(self) -> DataFrame:
        """(doc_id, text_hash, removed): the numbers of the lines that go, for every document that has any."""
        lines = stored(self.lines())
        place = F.struct("doc_id", "text_hash", "line_no")
        classes = lines.groupBy("cls").agg(F.min(place).alias("first"), F.count("*").alias("n"))
        rooted = classes.join(self.roots().withColumnRenamed("node", "cls"), "cls", "left").filter((F.col("n") > 1) | F.col("root").isNotNull())
        rooted = stored(rooted.withColumn("root", F.coalesce("root", "cls")))
        firsts = rooted.groupBy("root").agg(F.min("first").alias("stays"))
        stays = rooted.join(firsts, "root").select("cls", "stays")
        gone = lines.join(stays, "cls").filter(~F.struct("doc_id", "text_hash", "line_no").eqNullSafe(F.col("stays")))
        return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("removed"))

    def deduplicated(self) -> DataFrame:
        """``docs`` with the text of the lines that stay, and ``n_lines`` and ``n_removed``."""
        gone = self.removed().select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"), F.col("removed").alias("__removed"))
        columns = [c for c in self.docs.columns if c not in ("n_lines", "n_removed")]
        key, text_hash = self.key()
        rows = self.docs.select(*columns, key.alias("__own_id"), text_hash.alias("__own_hash"))
        match = F.col("__own_id").eqNullSafe(F.col("__doc_id")) & (F.col("__own_hash") == F.col("__text_hash"))
        both = rows.join(gone, match, "left")
        text = F.col(self.text)
        parts = F.split(text, "\n", -1)
        cut = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__removed", i)), "\n")
        return both.select(
            *[F.when(F.col("__removed").isNull(), text).otherwise(cut).alias(c) if c == self.text else F.col(c) for c in columns],
            F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
            F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
        )
