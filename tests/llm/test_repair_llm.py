"""Conversation repair against brute force and on corner cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tracegrove.llm import repair
from tracegrove.llm.repair import Repair, Survivors, damaged

SOUND = re.compile(r"(s?(ua)+)?\Z")


def judged(rows):
    """(role, text, fault) of sorted (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "b" if not last else "d" if (role, text) in seen else "t" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def all_edits(rows):
    """Every way to edit the rows with at most two inserts in a row: (cost, audit, repaired)."""
    inserts = [(), (("I", "user", ""),), (("I", "assistant", ""),), (("I", "user", ""), ("I", "assistant", "")), (("I", "assistant", ""), ("I", "user", ""))]
    options = [inserts]
    for role, text, fault in rows:
        own = [(("D", None, None),)]
        if fault not in ("b", "d"):
            own += [(("K", role, text),), (("R", "user", text),), (("R", "assistant", text),)]
        options += [own, inserts]
    price = {"K": 0, "R": 2, "D": 3, "I": 2}
    for pick in itertools.product(*options):
        edits = [e for p in pick for e in p]
        if SOUND.match("".join(e[1][:1] if e[1][:1] in ("s", "u", "a") else "?" for e in edits if e[1] is not None)) is None:
            continue
        kept = sum(1 for p, (_, _, fault) in zip(pick[1::2], rows) if p[0][0] != "D" and fault == "t")
        yield sum(price[e[0]] for e in edits) + kept, "".join(e[0] for e in edits), [(e[1], e[2]) for e in edits if e[1] is not None]


def cheapest(rows):
    cost, audit, turns = min(all_edits(rows), key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(), turns


def random_rows(rnd, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", " "]
    return [(k, rnd.choice(roles), rnd.choice(["Yes.", "No", " ", "a!", "b?", "c", "Yes."])) for k in range(n)]


def searched(rows):
    s, out = Survivors(), []
    for role, text, fault in rows:
        out += list(s.step(role, text, fault in ("b", "d"), fault == "t"))
    cost, left = s.finish()
    out += left
    return cost, "".join(n.letter for n in out), [n.turn for n in out if n.turn is not None], s


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_brute_force(seed):
    rnd = random.Random(seed)
    rows = judged(random_rows(rnd, rnd.randrange(5)))
    cost, audit, turns, _ = searched(rows)
    want = cheapest(rows)
    assert (cost, audit) == want[:2]
    assert turns == want[3] and SOUND.match("".join(r[:1] for r, _ in turns))


def whole_table(rows):
    """The same search with complete strings for every state and nothing dropped or emitted."""
    best = {0: (0, "")}
    steps = {"s": (1, (0,)), "u": (2, (0, 1, 3)), "a": (3, (2,))}

    def put(to, state, cost, audit):
        if state not in to or (cost, audit) < to[state]:
            to[state] = (cost, audit)

    def insert(to):
        for c in "ua":
            for b in steps[c][1]:
                if b in to:
                    put(to, steps[c][0], to[b][0] + 2, to[b][1] + "I")

    insert(best)
    for role, _, fault in rows:
        new = {}
        for state, (cost, audit) in best.items():
            put(new, state, cost + 3, audit + "D")
            if fault not in ("b", "d"):
                for c, (to, before) in steps.items():
                    if state in before:
                        if role[:1] == c:
                            put(new, to, cost + (fault == "t"), audit + "K")
                        if c != "s":
                            put(new, to, cost + 2 + (fault == "t"), audit + "R")
        insert(new)
        best = new
    return min(best[s] for s in (0, 3) if s in best)


@pytest.mark.parametrize("seed", range(20))
def test_long_conversations_emit_early(seed):
    rnd = random.Random(seed)
    rows = judged([(k, r, f"{k}{rnd.choice('.!?x')}" if rnd.random() < 0.9 else " ") for k, r, _ in random_rows(rnd, 600)])
    cost, audit, _, search = searched(rows)
    assert (cost, audit) == whole_table(rows)
    assert search.most_open < 200  # of over 600 edits on each of four paths


def test_memory_stays_bounded_on_a_sound_conversation():
    s = Survivors()
    emitted = 0
    for k in range(50_000):
        emitted += len(list(s.step(("user", "assistant")[k % 2], f"{k}.", False, False)))
    assert s.most_open < 40 and emitted > 49_900


def expected(rows):
    """The contract's row of a conversation from its sorted rows."""
    told = judged(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults = [sum(1 for _, _, f in told if f == x) for x in "bdt"]
    illegal = sum(1 for (a, _, _), (b, _, _) in zip(told, told[1:]) if a[:1] + b[:1] not in ("su", "ua", "au"))
    cost, audit, sha, _ = cheapest(told)
    return (gaps, *faults, illegal, cost, audit, sha)


def order(row):
    return (row[0] is not None, row[0] or 0, row[1], row[2])


@pytest.mark.parametrize("partitions", [1, 4])
def test_report_equals_brute_force(spark, partitions):
    rnd = random.Random(partitions)
    rows = []
    for conv in range(40):
        own = random_rows(rnd, rnd.randrange(1, 4))
        rows += [(conv, None if rnd.random() < 0.1 else t + rnd.randrange(2), None if rnd.random() < 0.05 else r, None if rnd.random() < 0.05 else x) for t, r, x in own]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho"), (77, None, None, None), (78, 0, "", "")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, own int").repartition(partitions)
    got = {r.conv_id: tuple(r)[1:] for r in Repair(damaged(df), dropped=F.col("dropped")).report().collect()}
    want = {}
    for conv, turn, role, text in rows:
        own = want.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    assert got == {c: expected(sorted(own, key=order)) for c, own in want.items()}
    assert any(r[0] for r in got.values()) and any(r[2] for r in got.values())


def test_turns_are_the_repaired_conversation(spark):
    rows = [(1, 0, "user", "A?"), (1, 1, "user", "B."), (1, 2, "assistant", "C."), (1, 2, "assistant", "C."), (2, 0, "system", "S."), (3, 5, "tool", "\x0b")]
    out = Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).turns()
    got = [(r.conv_id, r.place, r.edit, r.role, r.text) for r in out.orderBy("conv_id", "place").collect()]
    # Deleting a turn costs more than an empty answer.
    assert got == [(1, 0, "K", "user", "A?"), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "B."), (1, 3, "K", "assistant", "C.")]


def test_one_long_conversation_and_very_long_texts(spark):
    long = "word " * 200_000 + "."
    n = 20_000
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat(id, '.') AS text")
    df = df.unionAll(spark.createDataFrame([(1, n, "user", long), (1, n + 1, "assistant", long)], df.schema))
    (r,) = Repair(df).report().collect()
    assert (r.gaps, r.cost, r.audit, r.duplicate, r.illegal) == (0, 0, "K" * (n + 2), 0, 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert Repair(damaged(df), dropped=F.col("dropped")).report().collect() == []
    assert repair.Repair(df).turns().collect() == []
