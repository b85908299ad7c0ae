"""Repair of conversation structure by a Viterbi search that emits edits when its survivors coalesce.

A sound conversation is empty or ``(s?(ua)+)``: at most one system turn first, then user and assistant in
turns. Every row is kept, given another role or deleted, and empty turns may be inserted anywhere; the
cheapest edits win, ties go to the least string of their initials (K, R, D, I). The search keeps, for each
of four states (nothing yet, after system, after user, after assistant), the cheapest path to it.

Paths share their past: they are a tree of backpointers whose nodes count their living children. Once all
survivors descend from one node, the edits up to it are final; they are emitted and their nodes freed. What
stays in memory is the unresolved part of the paths, not the conversation. A path that cannot win any more
(deleting all so far, while another path is cheaper by more than a system turn is worth) is dropped, so that
survivors do coalesce. Paths of equal cost into one state are compared by their whole unresolved parts; they
edit the same rows, so neither is a beginning of the other and what comes before or after cannot turn
the comparison round.

Spark sorts each conversation's rows inside a partition and a task streams over them. Which rows repeat an
earlier one is found before that, by an aggregate and a join on (conversation, row) that spread a long
conversation over many tasks, so the stream needs no memory of rows it has passed.

Defined cases: rows are ordered by turn (nulls first), then role and text; equal rows of one turn repeat each
other. A null role or text is one space; a null conversation is one of its own. A role's initial is its first
character, as it stands; a row with none, or another one, can't be kept. Empty texts are blank; texts of any length are taken whole. A conversation of which
every row is dropped has zeros and no edits; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

#: Blanks, ends of a sentence, pairs of initials in order, prices of edits.
SENTENCE_END = "[.!?]"
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state an initial leads to, from which states.
STEPS = {"s": (SYSTEM, (START,)), "u": (USER, (START, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
ROLES = {"u": "user", "a": "assistant"}
NAMES = ("blank", "duplicate", "truncated")


class Node:
    """One edit on a path: its letter, the turn it leaves (None: none), and the nodes that go on from it."""

    __slots__ = ("parent", "letter", "turn", "children")

    def __init__(self, parent: Node | None, letter: str, turn: tuple[str, str] | None):
        self.parent, self.letter, self.turn = parent, letter, turn
        self.children: list[Node] = []


class Survivors:
    """The cheapest path to each state, and what is final of them."""

    def __init__(self):
        self.root = Node(None, "", None)
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        #: Unresolved nodes, and the most there have been.
        self.open = self.most_open = 0
        self._insert()
        self._attach()

    def _offer(self, to: dict, state: int, cost: int, parent: Node, letter: str, turn: tuple[str, str] | None) -> None:
        have = to.get(state)
        if have is not None and have[0] < cost:
            return
        node = Node(parent, letter, turn)
        if have is not None and have[0] == cost:
            mine, other = self._whole(node, have[1])
            if mine >= other:
                return
        to[state] = (cost, node)

    def _whole(self, a: Node, b: Node) -> tuple[str, str]:
        """Two paths' unresolved parts."""
        out = []
        for node in (a, b):
            letters = []
            while node is not self.root:
                letters.append(node.letter)
                node = node.parent
            out.append("".join(reversed(letters)))
        return out[0], out[1]

    def _insert(self) -> None:
        """An inserted turn may follow any path."""
        for letter in ("u", "a"):
            state, before = STEPS[letter]
            for b in before:
                if b in self.best:
                    cost, node = self.best[b]
                    self._offer(self.best, state, cost + INSERT, node, "I", (ROLES[letter], ""))

    def step(self, role: str, text: str, must_delete: bool, truncated: bool) -> Iterator[Node]:
        """Take a row; the edits that are final now."""
        old, new = self.best, {}
        extra = TRUNCATED if truncated else 0
        for state, (cost, node) in old.items():
            self._offer(new, state, cost + DELETE, node, "D", None)
        if not must_delete:
            keep = STEPS.get(role[:1])
            if keep:
                for b in keep[1]:
                    if b in old:
                        self._offer(new, keep[0], old[b][0] + KEEP + extra, old[b][1], "K", (role, text))
            for letter, named in ROLES.items():
                state, before = STEPS[letter]
                for b in before:
                    if b in old:
                        self._offer(new, state, old[b][0] + REROLE + extra, old[b][1], "R", (named, text))
        self.best = new
        self._insert()
        # After an assistant turn everything may follow that may follow nothing or a system turn, but for a
        # system turn, which can be deleted instead.
        if ASSISTANT in self.best:
            cost = self.best[ASSISTANT][0]
            for state, worth in ((START, DELETE), (SYSTEM, 0)):
                if state in self.best and self.best[state][0] > cost + worth:
                    del self.best[state]
        return self._settle(old)

    def _attach(self) -> set[int]:
        """Tie the survivors' new nodes to the tree; which nodes end a path."""
        for _, node in self.best.values():
            while node is not self.root and not any(c is node for c in node.parent.children):
                node.parent.children.append(node)
                self.open += 1
                node = node.parent
        self.most_open = max(self.most_open, self.open)
        return {id(node) for _, node in self.best.values()}

    def _settle(self, old: dict) -> Iterator[Node]:
        """Free paths that died, and emit what all survivors share."""
        tips = self._attach()
        for _, node in old.values():
            while node is not self.root and not node.children and id(node) not in tips:
                node.parent.children = [c for c in node.parent.children if c is not node]
                self.open -= 1
                node = node.parent
        while len(self.root.children) == 1 and id(self.root) not in tips:
            self.root = self.root.children[0]
            self.root.parent = None
            self.open -= 1
            yield self.root

    def finish(self) -> tuple[int, list[Node]]:
        """The whole cost, and the edits left."""
        ends = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        cost, tip = ends[0]
        for c, node in ends[1:]:
            if c < cost or (c == cost and self._whole(node, tip)[0] < self._whole(node, tip)[1]):
                cost, tip = c, node
        left = []
        while tip is not self.root:
            left.append(tip)
            tip = tip.parent
        return cost, left[::-1]


class Conversation:
    """The state of one conversation while its rows stream by."""

    def __init__(self, key):
        self.key, self.search = key, Survivors()
        self.faults = dict.fromkeys(NAMES, 0)
        self.illegal = self.turns = 0
        self.low = self.high = self.last = self.before = None
        self.audit = bytearray()
        self.sha = hashlib.sha256()
        self.n_turns = 0

    def take(self, turn, role: str, text: str, repeats: bool, blank: bool, cut: bool) -> list[tuple[str, str]]:
        """The repaired turns that are final after this row."""
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        row = (turn, role, text)
        fault = 0 if blank else 1 if repeats or row == self.last else 2 if cut else None
        if fault is not None:
            self.faults[NAMES[fault]] += 1
        if self.last is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.last, self.before = row, role[:1]
        return self._told(self.search.step(role, text, fault in (0, 1), fault == 2))

    def _told(self, nodes) -> list[tuple[str, str]]:
        out = []
        for node in nodes:
            self.audit += node.letter.encode()
            if node.turn is not None:
                self.sha.update(("\n" if self.n_turns else "").encode() + f"{node.turn[0]}:{node.turn[1]}".encode())
                self.n_turns += 1
                out.append((node.letter, *node.turn))
        return out

    def finish(self) -> list[tuple[str, str]]:
        self.cost, left = self.search.finish()
        return self._told(left)

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, edit string, role string, text string"
#: Rows of a result that are sent on together.
SENT = 4096


def _streamed(as_turns: bool, schema: pa.Schema) -> object:
    """For mapInArrow over sorted (conversation, turn, role, text, repeats, blank, cut); a null role is a row
    that only names its conversation."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, place = None, [], 0

        def told(turns):
            nonlocal place
            if as_turns:
                for letter, role, text in turns:
                    out.append((now.key, place, letter, role, text))
                    place += 1

        def closed():
            told(now.finish())
            if not as_turns:
                out.append(now.report())

        def sent():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for batch in it:
            for key, turn, role, text, repeats, blank, cut in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or key != now.key:
                    if now is not None:
                        closed()
                    now, place = Conversation(key), 0
                if role is not None:
                    told(now.take(turn, role, text, repeats, blank, cut))
                if len(out) >= SENT:
                    yield sent()
        if now is not None:
            closed()
        if out:
            yield sent()

    return run


class Repair:
    """Repairs the conversations of a table.

    ``report()`` has one row for each: gaps between its turns, rows by fault, pairs of initials out of order,
    the cost and the audit of the edits, and a hash of the repaired turns. ``turns()`` has the repaired turns.
    Rows with a null in ``dropped`` or false take part, others only name their conversation.
    """

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None):
        gone = F.coalesce(dropped, F.lit(False)) if dropped is not None else F.lit(False)
        value = [F.when(~gone, F.coalesce(F.col(c).cast("string"), F.lit(" "))).alias(n) for c, n in ((role, "role"), (text, "text"))]
        self.rows = rows.select(F.col(conv).alias("conv"), F.when(~gone, F.col(turn)).alias("turn"), *value)
        self.conv = conv

    def _sorted(self) -> DataFrame:
        rows = self.rows.withColumn("own", F.when(F.col("role").isNotNull(), F.struct(F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(1), "text", "role").alias("y"))))
        when = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))
        # A struct key also matches nulls inside it.
        keyed = rows.withColumn("at", F.struct("conv", "own"))
        first = keyed.filter("own is not null").groupBy("at").agg(F.min(when).alias("first"))
        told = keyed.join(first, "at", "left").select("conv", "turn", "role", "text", F.coalesce(F.col("first") < when, F.lit(False)).alias("repeats"))
        last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
        told = told.withColumn("blank", last == "").withColumn("cut", ~last.isin(".", "!", "?"))
        return told.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def _run(self, as_turns: bool, ddl: str) -> DataFrame:
        key = self.rows.schema["conv"].dataType
        schema = StructType([StructField(self.conv, key), *StructType.fromDDL(ddl).fields])
        return self._sorted().mapInArrow(_streamed(as_turns, to_arrow_schema(schema)), schema)

    def report(self) -> DataFrame:
        return self._run(False, REPORT)

    def turns(self) -> DataFrame:
        """(conversation, place from 0, edit, role, text) of the repaired turns; deleted rows leave none."""
        return self._run(True, TURNS)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Test damage by crc32 of ``conv:turn`` modulo 20: 0 drops the row (``dropped``), 1 empties its text, 2
    removes its sentence ends, 3 repeats it, 4 makes it a user's. Nulls are one space."""

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast(StringType()), F.lit(" "))

    kind = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain(text), SENTENCE_END, "")).otherwise(plain(text))
    rows = rows.select(F.col(conv), F.col(turn), F.when(kind == 4, "user").otherwise(plain(role)).alias(role), changed.alias(text), (kind == 0).alias("dropped"), kind.alias("_kind"))
    return rows.withColumn("_again", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_again")
