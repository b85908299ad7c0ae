"""Phrase collocation mining over truncated suffix trees, partitioned by word prefixes.

The words of a text's pieces are suffixes of up to ``most`` words, one from every word. Their tree is
never built whole. Vertical partitioning gives every prefix of words a place: a first word if at most
``budget`` suffixes begin with it, else its continuations by one more word, and so on. Prefixes are dealt
into groups of about ``budget`` suffixes; each group's subtree is built in one task from its suffixes
alone, and counts are read from its leaf totals. A task takes a group's suffixes in order of their prefix
and builds the subtrees of whole prefixes, some 2^17 rows at a time, so its memory is bounded.

A suffix ends early where it can hold no frequent phrase: at the end of its piece, and where two words
next to each other are not frequent. Which words and word pairs are frequent is counted first; they become
bit filters of fixed size, which may let a rare pair through but hold back none. Equal suffixes of a run of
texts are sent once, with their number.

Everything is counted per group value (a language). A phrase's score is that of its worst cut into two
parts, in exact decimal arithmetic. A phrase that lies in a longer one of the same count is dropped.

Defined cases: A-Z counts as a-z; pieces end at . , ; : ! ? and line ends, words are runs without blanks
and tabs; a null text has no words, a null group is ``und``; ties are broken by count, then by the phrase in
byte order; equal rows count again each; groups without a frequent phrase give no row, an empty table none.
Other columns are not read, whatever their names. Long texts are taken whole, cut between pieces only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, U64, bit_filter, buffers, in_filter, mixed, runs, signed, stored, text_column
from .words import small_batches, word_hashes

MOST, AT_LEAST, TOP = 5, 100, 2000
#: Suffixes of a group, and rows a task builds subtrees of at a time (all of a prefix, the budget at most).
BUDGET, CHUNK = 1 << 19, 1 << 17
FILTER_BITS = 27
#: Slots of prefix hashes whose weights are told to the driver when groups are formed.
SLOTS = 1 << 16
#: Bytes of text whose equal words or suffixes are counted together.
RUN = 1 << 20
#: Parts that rank a group's phrases before the whole is ranked.
PARTS = 16
#: Characters that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"

_ENDS = np.zeros(256, bool)
_ENDS[list(ENDS)] = True
_WORD = NOT_SPACE & ~_ENDS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a run of texts: bytes, spans, hashes, and for each the number of words that follow in its
    piece."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, groups: np.ndarray):
        self.raw = _LOWER[raw]
        inside = _WORD[raw]
        bounds = np.zeros(len(raw) + 1, np.int8)
        if len(raw):
            bounds[1:-1] = inside[1:].astype(np.int8) - inside[:-1]
            bounds[0], bounds[-1] = inside[0], -int(inside[-1])
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(raw))]
        cut = np.unique(cut[inside[cut] & inside[cut - 1]])  # words that meet where one text ends
        self.start = np.sort(np.concatenate([np.flatnonzero(bounds == 1), cut]))
        self.end = np.sort(np.concatenate([np.flatnonzero(bounds == -1), cut]))
        n = len(self.start)
        text = np.searchsorted(off, self.start, side="right") - 1
        self.group = groups[text]
        self.hash = word_hashes(self.raw, self.start, self.end)
        # Equal words of different groups are different.
        self.key = mixed(self.hash + self.group.astype(U64) * U64(0x9E3779B97F4A7C15))
        piece = np.concatenate([[0], np.cumsum(_ENDS[raw])])[self.start] + text
        last = np.ones(n, bool)
        last[:-1] = piece[1:] != piece[:-1]
        stop = np.flatnonzero(last)
        self.after = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n) if n else np.zeros(0, int)

    def strings(self, at: np.ndarray, depth: np.ndarray) -> pa.Array:
        """Phrases of ``depth`` words from the words ``at``, joined by one space."""
        offsets = np.concatenate([[0], np.cumsum(depth)])
        each = np.repeat(at - offsets[:-1], depth) + np.arange(offsets[-1])
        size = self.end[each] - self.start[each]
        step = size + 1
        step[offsets[1:] - 1] -= 1  # no space after the last word
        put = np.concatenate([[0], np.cumsum(step)])
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        data = np.full(put[-1], 0x20, np.uint8)
        data[np.repeat(put[:-1], size) + inside] = self.raw[np.repeat(self.start[each], size) + inside]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(put[offsets].astype(np.int64)), pa.py_buffer(data)).cast(pa.string())

    def frequent_pairs(self, known) -> np.ndarray:
        """For every word whether it and the next one of its piece may be a frequent pair."""
        out = np.zeros(len(self.key), bool)
        at = np.flatnonzero(self.after > 0)
        out[at] = in_filter(known, signed(_phrase(self.key, at, 2)))
        return out


def _phrase(key: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the phrases of ``depth`` words from the words ``at``."""
    h = key[at]
    for k in range(1, depth):
        h = mixed(h * U64(0xD1342543DE82EF95) + key[at + k])
    return h


def _words_of(batch: pa.RecordBatch) -> Iterator[Words]:
    texts = text_column(batch, "text")
    groups = batch.column(1).dictionary_encode()
    names = groups.dictionary.to_pylist()
    # The same number for a group in every task.
    number = word_hashes(*_spans(pa.array(names, pa.large_string()))) if names else np.zeros(0, U64)
    code = groups.indices.to_numpy()
    for i, j in runs(texts, RUN):
        raw, off = buffers(texts[i:j])
        for a, b in _stretches(raw):
            words = Words(raw[a:b], off if b - a == len(raw) else np.array([0, b - a]), number[code[i:j]])
            words.names = dict(zip(number.tolist(), names))
            yield words


def _stretches(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a long text that end with a piece, a run or more of bytes each; others whole."""
    a = 0
    while len(raw) - a > 2 * RUN:
        ends = np.flatnonzero(_ENDS[raw[a + RUN : a + 2 * RUN]])
        if not len(ends):
            ends = np.flatnonzero(_ENDS[raw[a + 2 * RUN :]]) + RUN
        if not len(ends):
            break
        b = a + RUN + int(ends[0]) + 1
        yield a, b
        a = b
    yield a, len(raw)


def _spans(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, off = buffers(names)
    return raw, off[:-1], off[1:]


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct hash first stands, and how often it occurs."""
    _, at, n = np.unique(h, return_index=True, return_counts=True)
    return at, n


def _group_names(words: Words, at: np.ndarray) -> pa.Array:
    known, code = np.unique(words.group[at], return_inverse=True)
    return pa.array([words.names[k] for k in known.tolist()], pa.string()).take(pa.array(code))


def _word_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, word, n): words of each run with their number; a null word has the number of all."""
    for batch in it:
        for words in _words_of(batch):
            if not len(words.key):
                continue
            at, n = _counted(words.key)
            text = words.strings(at, np.ones(len(at), int))
            yield pa.RecordBatch.from_arrays([_group_names(words, at), text, pa.array(n, pa.int64()), pa.array(signed(words.key[at]))], names=["grp", "word", "n", "h"])
            at, n = _counted(words.group)
            none = pa.nulls(len(at))
            yield pa.RecordBatch.from_arrays([_group_names(words, at), none.cast(pa.string()), pa.array(n, pa.int64()), none.cast(pa.int64())], names=["grp", "word", "n", "h"])


def _prefix_counts(depth: int, pairs, heavy) -> object:
    """(h, parent, n): prefixes of two words that are both frequent, or of more words if all but the last have
    more suffixes than the budget (``heavy``); the parent is told only if it has."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for words in _words_of(batch):
                at = np.flatnonzero(words.after >= depth - 1)
                if depth == 2:
                    good = in_filter(pairs.value, signed(words.key))
                    at = at[good[at] & good[at + 1]]
                else:
                    at = at[words.frequent_pairs(pairs.value)[at]]
                    at = at[in_filter(heavy.value, signed(_phrase(words.key, at, depth - 1)))]
                h = _phrase(words.key, at, depth)
                first, n = _counted(h)
                parent = signed(_phrase(words.key, at[first], depth - 1))
                parent = pa.array(parent, mask=~in_filter(heavy.value, parent))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[first])), parent, pa.array(n, pa.int64())], names=["h", "parent", "n"])

    return run


def _suffixes(most: int, pairs, heavy, group_of_slot) -> object:
    """(part, prefix, depth, grp, suffix, n): truncated suffixes of two words or more, with the group and
    prefix of words they belong to."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for words in _words_of(batch):
                good = words.frequent_pairs(pairs.value)
                at = np.flatnonzero(good)
                length = np.full(len(at), 2)
                going = np.arange(len(at))
                for k in range(2, most):  # the word k places on belongs to it if every pair up to it is frequent
                    going = going[good[np.minimum(at[going] + k - 1, len(good) - 1)] & (words.after[at[going]] >= k)]
                    length[going] += 1
                h = np.zeros(len(at), U64)
                for k in range(2, most + 1):
                    some = np.flatnonzero(length == k)
                    h[some] = _phrase(words.key, at[some], k)
                first, n = _counted(h + length.astype(U64))
                at, length = at[first], length[first]
                prefix, depth = words.key[at], np.ones(len(at), np.int32)
                for k, known in enumerate(heavy, start=1):  # prefixes with too many suffixes take one more word
                    large = np.flatnonzero((depth == k) & in_filter(known.value, signed(prefix)))
                    depth[large] += 1
                    large = large[length[large] > k]
                    prefix[large] = _phrase(words.key, at[large], k + 1)
                part = group_of_slot.value[_slot(prefix)]
                columns = [pa.array(part, pa.int32()), pa.array(signed(prefix)), pa.array(depth), _group_names(words, at)]
                columns += [words.strings(at, length), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "prefix", "depth", "grp", "suffix", "n"])

    return run


def _slot(prefix: np.ndarray) -> np.ndarray:
    return (mixed(prefix) % U64(SLOTS)).astype(np.int64)


def _slots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n) from (h, n)."""
    for batch in it:
        slot = _slot(batch.column(0).to_numpy().view(U64))
        total = np.zeros(SLOTS, np.int64)
        np.add.at(total, slot, batch.column(1).to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["slot", "n"])


def subtree(groups: pa.Array, suffixes: pa.Array, n: np.ndarray, depth: np.ndarray, at_least: int) -> pa.RecordBatch:
    """(grp, phrase, words, a): the nodes of two words or more of the tree of some suffixes, with the sum of
    the leaves below. ``depth`` is the words of the prefix a suffix was dealt by: nodes above it are told with
    what this task has of them, the others only if they are frequent."""
    words = pc.split_pattern(suffixes, " ")
    offsets = words.offsets.to_numpy()
    code = words.flatten().dictionary_encode()
    code, total = code.indices.to_numpy().astype(np.int64), len(code.dictionary)
    length = np.diff(offsets)
    node = groups.dictionary_encode().indices.to_numpy().astype(np.int64)
    out, row = [], np.arange(len(length))
    for k in range(1, int(length.max(initial=0)) + 1):
        some = length[row] >= k
        row, node = row[some], node[some]
        _, first, node = np.unique(node * total + code[offsets[row] + k - 1], return_index=True, return_inverse=True)
        if k == 1:
            continue
        a = np.zeros(len(first), np.int64)
        np.add.at(a, node, n[row])
        at = row[first]
        told = (a >= at_least) | (depth[at] > k)
        at, a = at[told], a[told]
        stop = offsets[at] + k
        phrases = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(stop - offsets[at])]), pa.int32()), _taken(words, offsets[at], k))
        out.append((groups.take(pa.array(at)), pc.binary_join(phrases, " "), np.full(len(at), k, np.int32), a))
    if not out:
        return pa.RecordBatch.from_pydict({"grp": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "words": pa.array([], pa.int32()), "a": pa.array([], pa.int64())})
    grp, phrase, size, a = zip(*out)
    columns = [pa.concat_arrays(grp), pa.concat_arrays(phrase), pa.array(np.concatenate(size)), pa.array(np.concatenate(a))]
    return pa.RecordBatch.from_arrays(columns, names=["grp", "phrase", "words", "a"])


def _taken(words: pa.ListArray, start: np.ndarray, k: int) -> pa.Array:
    return words.values.take(pa.array((start[:, None] + np.arange(k)).ravel()))


def _subtrees(chunk: int, at_least: int) -> object:
    """For mapInArrow over suffix rows sorted by (part, prefix): the nodes of each prefix's subtree."""

    def built(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(kept).combine_chunks()
        columns = {c: t[c].combine_chunks() if t.num_rows else t[c] for c in t.column_names}
        return subtree(columns["grp"], columns["suffix"], columns["n"].to_numpy(), columns["depth"].to_numpy(), at_least)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for batch in it:
            if not batch.num_rows:
                continue
            kept.append(batch)
            rows += batch.num_rows
            prefix = batch.column(batch.schema.get_field_index("prefix")).to_numpy()
            new = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
            if rows >= chunk and len(new):
                cut = int(new[-1])  # the last prefix may go on in the next batch
                kept[-1] = batch.slice(0, cut)
                yield built(kept)
                kept, rows = [batch.slice(cut)], batch.num_rows - cut
        if rows:
            yield built(kept)

    return run


class Phrases:
    """Frequent phrases of ``docs`` by ``group``, and their collocation scores."""

    def __init__(self, docs: DataFrame, text: str = "text", group: str = "lang", most: int = MOST, at_least: int = AT_LEAST, budget: int = BUDGET):
        if most < 2 or at_least < 1:
            raise ValueError("phrases have two words or more and occur at least once")
        self.most, self.at_least, self.budget = most, at_least, budget
        self.sc = docs.sparkSession.sparkContext
        self.texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("grp"))

    def _filter(self, rows: DataFrame, column: str = "h"):
        return self.sc.broadcast(bit_filter(rows, column, FILTER_BITS))

    def words(self) -> DataFrame:
        """(grp, word, n, h) of the frequent words; the row of a null word has the number of all words."""
        counts = self.texts.mapInArrow(_word_counts, "grp string, word string, n long, h long").groupBy("grp", "word").agg(F.sum("n").alias("n"), F.first("h").alias("h"))
        return stored(counts.filter(F.col("word").isNull() | (F.col("n") >= self.at_least)))

    def _partition(self, words: DataFrame) -> tuple:
        """The filter of frequent pairs, the filters of prefixes of 1, 2, ... words that have too many suffixes,
        the group of every slot of prefixes, and the number of groups."""
        words = words.filter(F.col("word").isNotNull()).select("h", F.col("n"))
        known, heavy, closed = self._filter(words), [], []
        found, pairs = words.withColumn("parent", F.lit(None).cast("long")), None
        for depth in range(2, self.most + 1):
            large = found.filter(F.col("n") > self.budget)
            closed.append(found.filter(F.col("n") <= self.budget).select("h", "n"))
            if pairs is not None and large.isEmpty():
                break
            heavy.append(self._filter(large))
            counts = self.texts.mapInArrow(_prefix_counts(depth, known if pairs is None else pairs, heavy[-1]), "h long, parent long, n long")
            counts = counts.groupBy("h").agg(F.first("parent").alias("parent"), F.sum("n").alias("n"))
            counts = stored(counts.filter(F.col("n") >= self.at_least))
            if pairs is None:
                pairs = self._filter(counts)
            found = counts.join(large.select(F.col("h").alias("parent")), "parent", "left_semi")
        else:
            closed.append(found.select("h", "n"))
        weights = closed[0]
        for more in closed[1:]:
            weights = weights.unionAll(more)
        total = np.zeros(SLOTS, np.int64)
        for r in weights.mapInArrow(_slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
            total[r.slot] = r.n
        # Slots go into one group until it is full.
        group = (np.cumsum(total) - total) // self.budget
        group = np.unique(group, return_inverse=True)[1].astype(np.int32)
        return pairs, heavy, self.sc.broadcast(group), int(group[-1]) + 1

    def counts(self) -> tuple[DataFrame, DataFrame]:
        """((grp, phrase, words, a) of all frequent phrases of 1 to ``most`` words, (grp, n) of all words)."""
        with small_batches(self.texts.sparkSession):
            words = self.words()
            pairs, heavy, groups, n_groups = self._partition(words)
            schema = "part int, prefix long, depth int, grp string, suffix string, n long"
            rows = self.texts.mapInArrow(_suffixes(self.most, pairs, heavy, groups), schema)
            dealt = rows.repartition(n_groups, "part").sortWithinPartitions("part", "prefix")
            nodes = dealt.mapInArrow(_subtrees(min(self.budget, CHUNK), self.at_least), "grp string, phrase string, words int, a long")
            # A node above its subtrees' prefixes has a share in each of them.
            nodes = nodes.groupBy("grp", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= self.at_least)
            single = words.filter(F.col("word").isNotNull()).select("grp", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("a"))
            return stored(nodes.unionAll(single)), stored(words.filter(F.col("word").isNull()).select("grp", "n"))

    def scored(self, percent: int = 100) -> DataFrame:
        """(grp, phrase, a, l, r, n, score): candidates by their worst cut; those inside a longer candidate that
        has ``percent`` of their count are dropped."""
        counts, totals = self.counts()
        candidates = counts.filter("words >= 2")
        parts = F.split("phrase", " ")

        def joined(start, size):
            return F.array_join(F.slice(parts, start, size), " ")

        # If a longer candidate has the share, so has one that is a single word longer.
        longer = candidates.filter("words > 2").select("grp", F.col("a").alias("longer_a"), F.explode(F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("phrase"))
        longer = longer.groupBy("grp", "phrase").agg(F.max("longer_a").alias("longer_a"))
        left = candidates.join(longer, ["grp", "phrase"], "left").filter(F.col("longer_a").isNull() | (100 * F.col("longer_a") < percent * F.col("a")))
        cuts = left.select("grp", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        cuts = cuts.select("*", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
        of = counts.select("grp", "phrase", "a")
        cuts = cuts.join(of.withColumnsRenamed({"phrase": "head", "a": "l"}), ["grp", "head"]).join(of.withColumnsRenamed({"phrase": "rest", "a": "r"}), ["grp", "rest"])
        cuts = cuts.join(totals, "grp")
        wide = [F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")]
        cuts = cuts.select("grp", "phrase", "a", "k", "l", "r", "n", ((wide[0] * wide[1]).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)").alias("up"), (wide[2] * wide[3]).cast("decimal(38,0)").alias("down"))
        cuts = cuts.withColumn("score", F.expr("up div down"))
        worst = cuts.groupBy("grp", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        return worst.select("grp", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    def best(self, top: int = TOP) -> DataFrame:
        """The first ``top`` of each group by score, then count (both falling), then phrase, with their rank."""
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        some = self.scored().withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order)))
        some = some.filter(F.col("rank") <= top).drop("part", "rank")
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)))
        return ranked.filter(F.col("rank") <= top)
