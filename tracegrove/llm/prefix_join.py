"""Set-similarity join of documents by grouped prefixes.

A document's set is its distinct word shingles. Shingles have one global order: by hash, with those that a
sample finds frequent at the end (a bounded table; it changes the work, never the result). Two sets of
similarity t or more share a shingle among the first n - ceil(t n) + 1 of each, their prefixes.

Equal sets are one class. Classes with the same prefix and size are one group, and candidates are pairs of
groups: those with a common prefix shingle, sizes within the ratio, and prefixes that agree in enough
shingles for the whole overlap to be reachable. Group pairs are expanded to their classes, whose whole
sets are compared exactly.

The components are what is asked for, so pairs within one need no test. First every group is compared
with a few groups that lead its shingles (and every class with the first of its group); what these links
join is one component, however many copies it has. Then all candidate pairs between different components
are tested, so no link is lost. All pairs of a large group of near copies are never formed.

A class also has a sketch of 1,024 bits, the parity of its shingles' bits. Sketches that differ in d bits
mean sets that differ in d shingles at least, which settles most unlike pairs without their sets. Sets are
rebuilt from the texts where they are needed (only for classes of the pairs left, found again by a
fixed-size bit filter), so what is shuffled is prefixes and candidates, not all sets.

Defined cases: a null text or one without words has an empty set and no links; a text with fewer words
than a shingle has one shingle, its whole sequence; A-Z counts as a-z; repeated rows, and rows of one id
with different texts, are rows of their own, linked by their sets alone; rows with a null id take part, and
a component's id is its smallest non-null one; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, buffers, in_filter, leaders, mixed, near_by_sketch, passing, runs, shingle_hashes, signed, sketch_of, span_hashes, stored, text_column, word_spans
from .components import connected

WIDTH = 5
PERCENT = 80
#: One text in so many is looked at for frequent shingles, and so many of them are kept.
SAMPLE = 32
MAX_FREQUENT = 1 << 19
#: Bits of the filters that tell which shingles or classes a second look is for.
SHARED_BITS, CLASS_BITS = 27, 24
SKETCH_BITS = 1024
#: Shingles are compared by so many of their hash's bytes.
STORED = 5
#: Up to so many repeated groups (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: In the first step a group is compared with so many leading groups; the last of the rounds takes all
#: that is left.
LEADERS, ROUNDS = 3, 2


def sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for i, j in runs(texts):
        raw, off = buffers(texts[i:j])
        start, end, first = word_spans(raw, off)
        words = span_hashes(raw, start, end)
        every = shingle_hashes(words, width)
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= width:
                own = np.sort(every[a : b - width + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield shingle_hashes(words[a:b], b - a) + np.uint64(b - a)
            else:
                yield words[a:b]


def class_of(own: np.ndarray) -> int:
    """64 bits that stand for a set."""
    both = mixed(own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(own)))
    total = np.array([both.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mixed(own), initial=np.uint64(0))], np.uint64)
    return int(signed(mixed(total))[0])


def shortened(own: np.ndarray) -> bytes:
    """The highest bytes of the sorted hashes."""
    return own.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :STORED].tobytes()


def restored(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // STORED, 8), np.uint8)
    out[:, :STORED] = np.frombuffer(data, np.uint8).reshape(-1, STORED)
    return out.view(">u8").ravel()


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _frequent(width: int) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = list(sets_of(text_column(batch, "text"), width))
            token, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, int))
            yield pa.RecordBatch.from_pydict({"token": pa.array(signed(token), pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _prefixes(state, width: int, percent: int) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = state.value
        seen: set[int] = set()
        row_no = TaskContext.get().partitionId() << 40
        for batch in it:
            n, cls, grp, pre, sketch = [], [], [], [], []
            for own in sets_of(text_column(batch, "text"), width):
                n.append(len(own))
                if not len(own):
                    cls.append(None), grp.append(None), pre.append(None), sketch.append(None)
                    continue
                order = own
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                    order = own[np.lexsort((own, np.where(hot[at] == own, rank[at], 0)))]
                head = order[: prefix_size(len(own), percent)]
                g = int(signed(mixed(np.array([mixed(head).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)))[0])
                cls.append(class_of(own)), grp.append(g)
                pre.append(None if g in seen else signed(head))
                seen.add(g)
                sketch.append(sketch_of(own, SKETCH_BITS))
            numbers = pa.array(np.arange(row_no, row_no + len(n)), pa.int64())
            row_no += len(n)
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(grp, pa.int64()), pa.array(pre, pa.list_(pa.int64()))]
            columns += [pa.array(sketch, pa.binary()), numbers]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "cls", "grp", "prefix", "sketch", "row_no"])

    return run


def _shared(state) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(2)
            tokens = lists.flatten().to_numpy()
            keep = in_filter(state.value, tokens)
            row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))[keep]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep], pa.int64()), batch.column(0).take(take), batch.column(1).take(take)], names=["token", "grp", "n"])

    return run


def _sets(state, width: int) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            found = []
            for own in sets_of(text_column(batch, "text"), width):
                c = class_of(own) if len(own) else None
                if c is not None and c not in seen and in_filter(state.value, np.array([c], np.int64))[0]:
                    seen.add(c)
                    found.append((c, shortened(own)))
            yield pa.RecordBatch.from_pydict({"cls": pa.array([f[0] for f in found], pa.int64()), "own": pa.array([f[1] for f in found], pa.binary())})

    return run


def _compare(percent: int) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = restored(x.as_py()), restored(y.as_py())
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def sizes_fit(x: str, y: str, percent: int) -> F.Column:
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def within_reach(c: str, x: str, y: str, percent: int) -> F.Column:
    """Whether sets of sizes x and y whose prefixes share c shingles can be similar enough: what follows
    the prefixes adds no more than the longer rest."""
    rest = F.greatest(*[F.ceil(F.col(n) * percent / 100) - 1 for n in (x, y)])
    return (F.col(c) + rest) * (100 + percent) >= (F.col(x) + F.col(y)) * percent


class PrefixJoin:
    """The join over one table of documents; ``components`` is its result."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> None:
        own = F.coalesce(F.col(text), F.lit(""))
        self.docs = docs.select(F.col(doc_id).alias("doc_id"), own.alias("text"), F.xxhash64(own).alias("text_hash"))
        self.width, self.percent = width, percent
        self.context = docs.sparkSession.sparkContext

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequent shingles and how often the sample has them."""
        key = F.xxhash64(F.lit(3), F.col("text"))
        sample = self.docs.filter(F.pmod(key, F.lit(SAMPLE)) == 0).groupBy(key.alias("key")).agg(F.first("text").alias("text")).select("text")
        counts = sample.mapInArrow(_frequent(self.width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1")
        top = counts.orderBy(F.col("n").desc(), "token").limit(MAX_FREQUENT).toPandas()
        token, n = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
        order = np.argsort(token)
        return token[order], n[order]

    @passing
    def verified(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """Those of the class pairs (a, b) whose sets are similar enough."""
        told = pairs
        for c in ("a", "b"):
            told = told.join(members.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
        told = told.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near_by_sketch(self.percent), "a long, b long")
        left = stored(told)
        wanted = left.select(F.col("a").alias("cls")).unionByName(left.select(F.col("b").alias("cls")))
        state = self.context.broadcast(bit_filter(wanted, "cls", CLASS_BITS))
        sets = stored(self.docs.select("text").mapInArrow(_sets(state, self.width), "cls long, own binary").groupBy("cls").agg(F.first("own").alias("own")))
        x = sets.select(F.col("cls").alias("a"), F.col("own").alias("x"))
        y = sets.select(F.col("cls").alias("b"), F.col("own").alias("y"))
        both = left.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        return both.mapInArrow(_compare(self.percent), "a long, b long")

    def heads(self, rows: DataFrame) -> DataFrame:
        """(grp, n, prefix) of every group, from one row that has the prefix."""
        have = rows.filter(F.col("prefix").isNotNull())
        several = have.groupBy("grp").agg(F.min("row_no").alias("stays"), F.count("*").alias("c")).filter("c > 1")
        more = stored(have.select("grp", "row_no").join(several, "grp").filter("row_no != stays").select("row_no"))
        more = F.broadcast(more) if more.count() <= BROADCAST_ROWS else more
        return have.join(more, "row_no", "left_anti").select("grp", "n", "prefix")

    def candidates_by_leader(self, shared: DataFrame, first: DataFrame) -> DataFrame:
        """Each group with the groups that lead most of its shared shingles, as class pairs."""
        led = leaders(shared, "token", "grp", "n").withColumnRenamed("n", "m")
        near = shared.join(led, "token").filter((F.col("grp") != F.col("lead")) & sizes_fit("n", "m", self.percent))
        counted = near.groupBy("grp", "lead").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
        counted = counted.filter(within_reach("c", "n", "m", self.percent))
        best = Window.partitionBy("grp").orderBy(F.col("c").desc(), "lead")
        top = counted.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= LEADERS)
        mine = first.select("grp", F.col("cls").alias("a"))
        theirs = first.select(F.col("grp").alias("lead"), F.col("cls").alias("b"))
        return top.join(mine, "grp").join(theirs, "lead").select("a", "b")

    def still_apart(self, shared: DataFrame, own: DataFrame) -> DataFrame:
        """(token, grp, n, root) of the shingles that groups of several components share."""
        rows = shared.select("token", "grp", "n").distinct().join(own.select("grp", "root").distinct(), "grp")
        mixed_tokens = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("token")
        return stored(rows.join(mixed_tokens, "token"))

    def candidates_between(self, rows: DataFrame, own: DataFrame) -> DataFrame:
        """All candidate class pairs of different components."""
        x = rows.select("token", F.col("grp").alias("g1"), F.col("n").alias("n1"), F.col("root").alias("r1"))
        y = rows.select("token", F.col("grp").alias("g2"), F.col("n").alias("n2"), F.col("root").alias("r2"))
        both = x.join(y, "token").filter((F.col("r1") < F.col("r2")) & (F.col("g1") != F.col("g2")) & sizes_fit("n1", "n2", self.percent))
        pairs = both.groupBy("g1", "r1", "g2", "r2").agg(F.count("*").alias("c"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
        pairs = pairs.filter(within_reach("c", "n1", "n2", self.percent)).select("g1", "r1", "g2", "r2")
        a = own.select(F.col("grp").alias("g1"), F.col("root").alias("r1"), F.col("cls").alias("a"))
        b = own.select(F.col("grp").alias("g2"), F.col("root").alias("r2"), F.col("cls").alias("b"))
        across = pairs.join(a, ["g1", "r1"]).join(b, ["g2", "r2"]).select("a", "b")
        # Classes of one group: the same prefix, so candidates too.
        split = own.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("grp")
        mine = own.select("grp", "cls", "root").join(split, "grp")
        inner = mine.join(mine.select("grp", F.col("cls").alias("b"), F.col("root").alias("r2")), "grp")
        inner = inner.filter(F.col("root") < F.col("r2")).select(F.col("cls").alias("a"), "b")
        return stored(across.unionByName(inner))

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, text_hash) of every row."""
        rows, of_class = self._classes()
        out = rows.select("doc_id", "text_hash", "n", "cls").join(of_class.select("cls", "component_id"), "cls", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")

    def placed(self) -> DataFrame:
        """(doc_id, text_hash, root) of every row: equal roots are one component, no root is no words."""
        rows, of_class = self._classes()
        return rows.select("doc_id", "text_hash", "cls").join(of_class.select("cls", "root"), "cls", "left").select("doc_id", "text_hash", "root")

    def _classes(self) -> tuple[DataFrame, DataFrame]:
        """All rows with their class, and (cls, root, component_id) of every class of texts with words."""
        state = self.context.broadcast(self.frequent())
        rows = stored(self.docs.mapInArrow(_prefixes(state, self.width, self.percent), "doc_id long, text_hash long, n long, cls long, grp long, prefix array<long>, sketch binary, row_no long"))
        return rows, self._placed_classes(rows)

    @passing
    def _placed_classes(self, rows: DataFrame) -> DataFrame:
        """(cls, root, first_id, component_id) of every class."""
        full = rows.filter(F.col("n") > 0)
        members = stored(full.groupBy("cls").agg(F.first("grp").alias("grp"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
        first = members.groupBy("grp").agg(F.min("cls").alias("cls"))
        heads = self.heads(rows)
        # Five bytes of the hash are enough here: what the filter lets through in excess meets nothing later.
        key = F.col("token").bitwiseAND((1 << 40) - 1).alias("token")
        twice = heads.select(F.explode("prefix").alias("token")).select(key).groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
        filter_ = self.context.broadcast(bit_filter(twice, "token", SHARED_BITS))
        shared = heads.mapInArrow(_shared(filter_), "token long, grp long, n long")
        in_group = members.join(first.withColumnRenamed("cls", "b"), "grp").filter(F.col("cls") != F.col("b")).select(F.col("cls").alias("a"), "b")
        pairs = self.candidates_by_leader(shared, first).unionByName(in_group)
        links = self.verified(stored(pairs.distinct()), members)
        for turn in range(1, ROUNDS + 1):
            roots = connected(links)
            own = members.select("grp", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
            own = stored(own.withColumn("root", F.coalesce("root", "cls")))
            shared = self.still_apart(shared, own)
            if turn < ROUNDS:
                pairs = self.candidates_by_leader(shared.select("token", "grp", "n").distinct(), first).distinct()
            else:
                pairs = self.candidates_between(shared, own)
            found = self.verified(stored(pairs), members)
            links = links.unionByName(found)
        roots = connected(links)
        ids = full.groupBy("cls").agg(F.min("doc_id").alias("first_id"))
        placed = ids.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
        return placed.join(smallest, "root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, of several rows with that
    id the one with the least text hash, of equal rows any one.

    Documents without words are linked with none: each that differs in id or text stays. A row without an id
    stays only if its component has no row with an id.
    """
    found = PrefixJoin(docs, doc_id, text, **options).placed()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    alone = found.filter(F.col("root").isNull()).select("doc_id", "text_hash")
    first = found.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(rank).alias("x")).select("x.doc_id", "x.text_hash")
    stays = alone.unionByName(first).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    keyed = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    both = keyed.join(stays, (F.col("__own") == F.col("__hash")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left_semi")
    return both.dropDuplicates([doc_id, "__own"]).select(*docs.columns)
