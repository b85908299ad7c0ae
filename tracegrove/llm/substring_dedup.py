"""Substring deduplication by level-wise doubling.

Windows of words are judged at lengths that double: half the asked width first, then the width, then twice
it, and so on. A window of the next length is made from two windows of the length before (their hashes
give its hash) and only where those repeat; the doubling ends with the length at which nothing repeats.

Below and above the asked width it is enough to look at some windows: of all windows of one length inside
one of the next, the one with the least hash. What lies inside decides which that is, so two equal windows
choose the same one, and a repeated window of the next length always contains a chosen window that
repeats. At the asked width all windows that pass are judged, each by the smallest document it starts in.

Equal texts are one class first: of a group of copies one text is cut into windows. What repeats goes into
a bit filter of fixed size that spares the next length most of its windows; whether a window repeats is
always decided by an exact aggregate and join over 64-bit hashes, never by the filter. Only texts of
documents that lose words, told apart by another such filter, are shuffled.

Defined cases: words are runs without blanks, tabs and line ends, unchanged; a null text has none. A word
goes if a window that covers it also starts in a document with a smaller id, whatever is left of that
document. Rows of one id never take words from each other; a row without an id keeps all its words and
takes none from others; equal rows get equal results. Texts with fewer words than the width keep them. An
empty table gives an empty result; other columns are not read, whatever their names. A text of any length is
hashed in pieces and costs 8 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bit_filter, buffers, in_filter, mixed, runs, shingle_hashes, signed, stored, text_column, word_spans
from .words import PIECE, small_batches, word_hashes

WIDTH = 13
#: Filters have 8 to 16 bits a value, but 2^29 (64 MB) at most.
MAX_BITS = 29
#: Texts whose results are sent on together.
SENT = 1024
#: Windows are taken from so many words at a time.
BLOCK = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def lengths(width: int) -> Iterator[int]:
    """Half the width, the width, twice the width and so on; of an odd width the halves share a word."""
    yield (width + 1) // 2
    while True:
        yield width
        width *= 2


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes of the words of texts i to j - 1, first word of each)."""
    for i, j in runs(texts, PIECE):
        raw, off = buffers(texts[i:j])
        if len(raw) <= PIECE:
            start, end, first = word_spans(raw, off)
            yield i, j, word_hashes(raw, start, end), first
            continue
        parts, a = [], 0  # one long text
        while a < len(raw):
            b = min(a + PIECE, len(raw))
            if b < len(raw):
                while b < len(raw) and raw[b] not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
                    b += 1
            part = raw[a:b]
            start, end, _ = word_spans(part, np.array([0, len(part)]))
            parts.append(word_hashes(part, start, end))
            a = b
        words = np.concatenate(parts) if parts else np.zeros(0, U64)
        yield i, j, words, np.array([0, len(words)])


def blocks(texts: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(hashes, row, place in the row's text, words up to its end, number of starts) of words, in stretches of
    BLOCK words, each followed by ``most`` further ones at which no window starts but in which it may end."""
    for i, j, words, first in hashed_words(texts):
        row = np.repeat(np.arange(i, j), np.diff(first))
        place = np.arange(len(words)) - first[row - i]
        room = first[row - i + 1] - np.arange(len(words))
        for a in range(0, len(words), BLOCK):
            b = min(a + BLOCK + most, len(words))
            yield words[a:b], row[a:b], place[a:b], room[a:b], min(BLOCK, len(words) - a)


def doubled(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of windows made of a window and the one ``step`` words after it."""
    n = max(len(h) - step, 0)
    return mixed(h[:n] * U64(0xD1342543DE82EF95) + h[step:])


def least(h: np.ndarray, reach: int) -> np.ndarray:
    """The smallest of every ``reach`` hashes in a row."""
    size, m = 1, h
    while 2 * size <= reach:
        m = np.minimum(m[: max(len(m) - size, 0)], m[size:])
        size *= 2
    rest = reach - size
    return np.minimum(m[: max(len(m) - rest, 0)], m[rest:])


def least_at(h: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of every ``reach`` hashes in a row, and its place."""
    size, m, at = 1, h, np.arange(len(h))

    def of_two(m, at, step):
        n = max(len(m) - step, 0)
        right = m[step:] < m[:n]
        return np.where(right, m[step:], m[:n]), np.where(right, at[step:], at[:n])

    while 2 * size <= reach:
        m, at = of_two(m, at, size)
        size *= 2
    return of_two(m, at, reach - size) if reach > size else (m, at)


def _halves(width: int) -> object:
    """The chosen windows of half the width."""
    half = next(lengths(width))

    def pick(words, room, here):
        m = least(shingle_hashes(words, half), width - half + 1)[:here]
        ok = room[: len(m)] >= width
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (room[1 : len(m)] > room[: max(len(m) - 1, 0)])  # another window or text
        at = np.flatnonzero(ok & new)
        return at, m[at]

    return pick


def _windows(width: int, known) -> object:
    """All windows of the width whose chosen half repeats."""
    half = next(lengths(width))

    def pick(words, room, here):
        h = shingle_hashes(words, half)
        m = least(h, width - half + 1)[:here]
        at = np.flatnonzero((room[: len(m)] >= width) & in_filter(known.value, signed(m)))
        return at, doubled(h, width - half)[at]

    return pick


def _longer(width: int, known) -> object:
    """(window, chosen window of the length before, length) of the chosen windows of every length beyond the
    width in passages all of whose windows of the width repeat."""
    half = next(lengths(width))

    def pick(words, room, here):
        h = doubled(shingle_hashes(words, half), width - half)
        n = len(h)
        gap = np.flatnonzero((room[:n] < width) | ~in_filter(known.value, signed(h)))
        # Words from here on that repeated windows cover without a gap.
        cover = np.append(gap, n)[np.searchsorted(gap, np.arange(n))] + width - 1 - np.arange(n)
        at, of, parent, length = [], [], [], []
        size = width
        while n and cover.max() >= 4 * size:
            inner = least(h, size + 1)  # the chosen window of this length in each of the next
            h = doubled(h, size)
            size *= 2
            m, of_m = least_at(h, size + 1)
            place = np.flatnonzero(cover[: min(len(m), here)] >= 2 * size)
            if len(place):
                place = place[np.concatenate([[True], of_m[place[1:]] != of_m[place[:-1]]])]
            at.append(place), of.append(m[place]), parent.append(inner[of_m[place]]), length.append(np.full(len(place), size, np.int32))
        if not at:
            return np.zeros(0, int), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int32)
        return np.concatenate(at), np.concatenate(of), np.concatenate(parent), np.concatenate(length)

    return pick


def _scan(pick, most: int, copies, names: list[str]) -> object:
    """For mapInArrow over (id, text_hash, text): what ``pick`` finds, with the named of id, text_hash and
    place. Texts that may have copies are left out if their filter is given."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = _passing(batch, [(copies, False, "text_hash")])
            batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            for words, row, place, room, here in blocks(text_column(batch, "text"), most):
                at, *values = pick(words, room, here)
                columns = [pa.array(v if v.dtype == np.int32 else signed(v)) for v in values]
                for name in names:
                    columns.append(pa.array(place[at], pa.int32()) if name == "place" else batch.column(batch.schema.get_field_index(name)).take(pa.array(row[at])))
                yield pa.RecordBatch.from_arrays(columns, names=[f"w{k}" for k in range(len(values))] + names)

    return run


def _passing(batch: pa.RecordBatch, tests: list[tuple] | tuple) -> pa.RecordBatch:
    """Rows that pass tests of (filter, wanted answer, column); a filter of None passes all."""
    for known, inside, column in tests:
        if known is not None and batch.num_rows:
            values = batch.column(batch.schema.get_field_index(column)).to_numpy()
            batch = batch.filter(pa.array(in_filter(known.value, values) == inside, pa.bool_()))
    return batch


def _only(tests: list[tuple]) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield _passing(batch, tests)

    return run


def _stretches(width: int) -> object:
    """For mapInArrow over (id, text_hash, place, length) sorted by these: a row for each text with the
    words to remove, as 8-byte pairs (from, to), and the longest length found."""

    def done(key, pieces, longest):
        places = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        new = np.ones(len(places), bool)
        new[1:] = places[1:] > places[:-1] + width
        last = np.append(new[1:], True) if len(places) else new
        spans = np.stack([places[new], places[last] + width], axis=1).astype(np.int64)
        return (*key, spans.tobytes(), longest)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, longest, schema = None, [], 0, None
        for batch in it:
            if not batch.num_rows:
                continue
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), ("spans", pa.binary()), ("longest", pa.int64())])
            ids, texts = batch.column(0), batch.column(1).to_numpy()
            code = ids.dictionary_encode().indices.to_numpy()
            place, length = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cut = np.flatnonzero((code[1:] != code[:-1]) | (texts[1:] != texts[:-1])) + 1
            out = []
            for a, b in zip(np.append(0, cut), np.append(cut, len(code))):
                mine = (ids[int(a)].as_py(), int(texts[a]))
                if mine != key:
                    if key is not None:
                        out.append(done(key, pieces, longest))
                    key, pieces, longest = mine, [], 0
                pieces.append(place[a:b][length[a:b] == width].astype(np.int64))
                longest = max(longest, int(length[a:b].max()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(done(key, pieces, longest), schema)], schema=schema)

    return run


def left_over(text: str, spans: bytes | None) -> tuple[int, int, bytes]:
    """(number of words, of removed ones, the others joined by one space)."""
    words = text.encode("utf-8", "surrogatepass").split()  # at blanks, tabs and line ends only
    if not spans:
        return len(words), 0, b" ".join(words)
    kept, last = [], 0
    for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
        kept += words[last:a]
        last = b
    kept += words[last:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def _told(keys: list[str], with_text: bool, tests: list[tuple] | tuple = ()) -> object:
    """For mapInArrow over keys, text and perhaps spans and longest: what is left of each text that passes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SENT) for b in it for k in range(0, b.num_rows, SENT)):
            batch = _passing(batch, tests)
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            if "spans" not in columns:
                columns |= {"spans": pa.nulls(batch.num_rows), "longest": pa.array(np.zeros(batch.num_rows, np.int64))}
            out = [left_over(t or "", s) for t, s in zip(columns["text"].to_pylist(), columns["spans"].to_pylist())]
            n, gone, kept = zip(*out) if out else ((), (), ())
            told = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            told += [columns["longest"], pa.array([k.decode() for k in kept] if with_text else [None] * len(kept), pa.string())]
            yield pa.RecordBatch.from_arrays([columns[k] for k in keys] + told, names=keys + ["n_words", "n_removed", "kept_sha256", "longest", "kept"])

    return run


TOLD = "n_words long, n_removed long, kept_sha256 string, longest long, kept string"


class Doubling:
    """The repeated windows of a table's texts, found length by length.

    ``docs`` needs an id of any ordered type and a text. ``deduplicated()`` is the result.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH):
        if width < 2:
            raise ValueError("a window has two words at least")
        self.width, self.spark = width, docs.sparkSession
        whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
        self.rows = docs.select(F.col(id).alias("id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
        self.id_type = self.rows.schema["id"].dataType.simpleString()
        with small_batches(self.spark):
            self._copies()

    def _filter(self, rows: DataFrame, column: str):
        """The values of a column of a stored table as a broadcast bit filter, or none."""
        n = rows.count()
        return self.spark.sparkContext.broadcast(bit_filter(rows, column, min(max(20, (8 * n).bit_length()), MAX_BITS))) if n else None

    def _copies(self) -> None:
        """Of every group of equal texts, told by 128 bits, the rows with the smallest id; the others repeat
        them whole."""
        twin = F.xxhash64(F.lit(1), "text", F.octet_length("text")).alias("twin")
        narrow = self.rows.select("id", "text_hash", twin)
        classes = narrow.groupBy("text_hash", "twin").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        classes = stored(classes.filter("first_id < last_id").select("text_hash", "twin", "first_id"))
        self.copies = self._filter(classes, "text_hash")
        if self.copies is None:
            self.firsts = self.later = None
            return
        maybe = self.rows.mapInArrow(_only([(self.copies, True, "text_hash")]), self.rows.schema)
        maybe = maybe.withColumn("twin", twin).join(classes, ["text_hash", "twin"], "left")
        first = F.col("first_id").isNull() | F.col("id").isNull() | (F.col("id") == F.col("first_id"))
        self.firsts = stored(maybe.filter(first).select("id", "text_hash", "text", "twin", F.col("first_id").isNotNull().alias("has_copies")))
        later = narrow.join(classes, ["text_hash", "twin"])
        self.later = later.filter(F.col("id") > F.col("first_id")).select("id", "text_hash", "twin")

    def _rows(self, pick, most: int, names: list[str], values: str = "w0 long") -> DataFrame:
        kinds = {"id": self.id_type, "text_hash": "long", "place": "int"}
        ddl = ", ".join([values, *[f"{n} {kinds[n]}" for n in names]])
        one = self.rows.mapInArrow(_scan(pick, most, self.copies, names), ddl)
        return one if self.firsts is None else one.unionAll(self.firsts.select("id", "text_hash", "text").mapInArrow(_scan(pick, most, None, names), ddl))

    @staticmethod
    def _in_two(rows: DataFrame) -> DataFrame:
        """(w0, first_id) of the windows that stand in documents of different ids."""
        ends = rows.groupBy("w0").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        return ends.filter("first_id < last_id").select("w0", "first_id")

    def levels(self) -> DataFrame | None:
        """(id, text_hash, place, length): where windows stand that also start in a document with a smaller
        id. All those of the width, and of every doubled length that still repeats the chosen ones (no place).
        None if nothing repeats."""
        width, sizes = self.width, lengths(self.width)
        next(sizes), next(sizes)
        places = ["id", "text_hash", "place"]
        known = self._filter(stored(self._in_two(self._rows(_halves(width), width, ["id"])).select("w0")), "w0")
        if known is None:
            return None
        table = stored(self._in_two(self._rows(_windows(width, known), width, ["id"])))
        later = F.col("first_id") < F.col("id")
        found = self._rows(_windows(width, known), width, places).join(table, "w0").filter(later).select(*places, F.lit(width).alias("length"))
        known = self._filter(table, "w0")
        if known is None:
            return None
        longer = self._rows(_longer(width, known), BLOCK, ["id", "text_hash"], "w0 long, w1 long, w2 int")
        longer = stored(longer.withColumnsRenamed({"w1": "parent", "w2": "length"}))
        for size in sizes:
            rows = longer.filter(F.col("length") == size).join(table.select(F.col("w0").alias("parent")), "parent", "left_semi")
            table = stored(self._in_two(rows.select("w0", "id")))
            if table.isEmpty():
                return found
            more = rows.join(table, "w0").filter(later)
            found = found.unionAll(more.select("id", "text_hash", F.lit(-1).alias("place"), F.lit(size).alias("length")).distinct())
        return found

    def spans(self) -> DataFrame | None:
        """(id, text_hash, spans, longest) of the texts that lose words, but for copies of a whole text."""
        with small_batches(self.spark):
            found = self.levels()
            if found is None:
                return None
            ordered = found.repartition("id", "text_hash").sortWithinPartitions("id", "text_hash", "place")
            return stored(ordered.mapInArrow(_stretches(self.width), f"id {self.id_type}, text_hash long, spans binary, longest long"))

    def deduplicated(self, with_text: bool = False) -> DataFrame:
        """(id, n_words, n_removed, kept_sha256, longest), with ``kept``, the words left, if asked.

        ``longest`` is the greatest of the lengths found to repeat an earlier document: a repeated passage
        of twice a length is always found at it; 0 stands for none.
        """
        spans = self.spans()
        with small_batches(self.spark):
            losing = None if spans is None else self._filter(spans.select(F.xxhash64("id").alias("h")), "h")
            out = self._left(spans, losing, with_text)
            # Texts are left to the caller; without them the result is narrow, and made in small batches here.
            return out if with_text else stored(out)

    def _left(self, spans: DataFrame | None, losing, with_text: bool) -> DataFrame:
        schema = f"id {self.id_type}, {TOLD}"
        parts = [(self.rows, self.copies)] + ([] if self.firsts is None else [(self.firsts, None)])
        out = []
        for rows, copies in parts:
            rows = rows.select("id", "text_hash", "text", F.xxhash64("id").alias("h"))
            tests = [(copies, False, "text_hash"), (losing, False, "h")]
            out.append(rows.mapInArrow(_told(["id"], with_text, tests), schema))
            if losing is not None:
                tests[1] = (losing, True, "h")
                cut = rows.mapInArrow(_only(tests), rows.schema).join(spans, ["id", "text_hash"], "left")
                cut = cut.select("id", "text", "spans", F.coalesce("longest", F.expr("0L")).alias("longest"))
                out.append(cut.mapInArrow(_told(["id"], with_text), schema))
        if self.later is not None:
            out.append(self._of_copies(with_text).select(out[0].columns))
        return reduce(DataFrame.unionAll, out)

    def _of_copies(self, with_text: bool) -> DataFrame:
        """Texts of a window or more that repeat another whole lose all words, shorter ones none."""
        whole = self.firsts.filter("has_copies").select("text_hash", "twin", "text")
        whole = whole.mapInArrow(_told(["text_hash", "twin"], with_text), f"text_hash long, twin long, {TOLD}").dropDuplicates(["text_hash", "twin"])
        n, gone = F.col("n_words"), F.col("n_words") >= self.width
        longest = F.lit(self.width) * F.pow(F.lit(2.0), F.floor(F.log2(n / self.width))).cast("long")
        return self.later.join(whole, ["text_hash", "twin"]).select(
            "id",
            n,
            F.when(gone, n).otherwise(0).alias("n_removed"),
            F.when(gone, EMPTY).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
            F.when(gone, longest).otherwise(0).alias("longest"),
            F.when(gone & F.col("kept").isNotNull(), "").otherwise(F.col("kept")).alias("kept"),
        )
