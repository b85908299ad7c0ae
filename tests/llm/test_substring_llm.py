"""Substring deduplication against brute force and on corner cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tracegrove.llm import substring_dedup
from tracegrove.llm.substring_dedup import Doubling, least, least_at, lengths


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_force(rows, width):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def corpus(seed, n, vocabulary=40):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["é", "Ünd", " x"]
    passages = [[rnd.choice(words) for _ in range(rnd.choice([12, 13, 14, 26, 70]))] for _ in range(6)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(rnd.choice([0, 1, 2, 5])):
            w += [rnd.choice(words) for _ in range(rnd.randrange(30))]
            if rnd.random() < 0.6:
                p = rnd.choice(passages)
                w += p[rnd.randrange(3) : len(p) - rnd.randrange(3)]
        texts.append("".join(x + rnd.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"]) for x in w))
    return texts + rnd.sample(texts, n // 4)


def rows_of(got):
    return sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got), key=repr)


@pytest.mark.parametrize("width,partitions", [(13, 1), (13, 7), (4, 3), (2, 2)])
def test_equals_brute_force(spark, width, partitions):
    rnd = random.Random(width)
    rows = [(k, t) for k, t in enumerate(corpus(width, 60))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = Doubling(df, width=width).deduplicated(with_text=True).collect()
    assert rows_of(got) == sorted(brute_force(rows, width), key=repr)


def test_corner_cases(spark):
    long = " ".join(f"x{k}" for k in range(3000))
    rows = [
        (5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "one two"),
        (3, long), (3, long), (4, long), (None, long), (3, "y " + long), (None, None),
        (10, "a " * 40), (11, "a " * 13), (12, "a " * 12), (13, "A " * 13), (-1, "a " * 40),
    ]
    df = spark.createDataFrame([(*r, "z", 1, "c") for r in rows], "doc_id long, text string, id string, h long, twin string")
    got = Doubling(df).deduplicated(with_text=True).collect()
    assert rows_of(got) == sorted(brute_force(rows, 13), key=repr)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Doubling(df).deduplicated().collect() == []


def test_string_ids(spark):
    text = " ".join(f"x{k}" for k in range(20))
    df = spark.createDataFrame([("b", text), ("a", text + " end"), ("c", None)], "name string, body string")
    got = {r.id: r.n_removed for r in Doubling(df, id="name", text="body").deduplicated().collect()}
    assert got == {"a": 0, "b": 20, "c": 0}


def test_longest_is_found_at_twice_its_length(spark):
    rnd = random.Random(3)

    def fresh(n):
        return [f"f{rnd.random()}" for _ in range(n)]

    shared = {n: fresh(n) for n in (12, 13, 52, 110, 850)}
    rows, k = [], 0
    for n, p in shared.items():
        for _ in range(2):
            rows.append((k, " ".join(fresh(5) + p + fresh(3))))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: r.longest for r in Doubling(df).deduplicated().collect()}
    for k, n in enumerate(shared):
        assert got[2 * k] == 0
        at_least = max([s for s in (13, 26, 52, 104, 208, 416) if 2 * s <= n], default=13 if n >= 13 else 0)
        assert at_least <= got[2 * k + 1] <= n


def test_long_texts_and_cuts_between_blocks(spark, monkeypatch):
    rnd = random.Random(8)
    w = [f"v{rnd.randrange(50)}" for _ in range(700)]
    rows = [(1, " ".join(w)), (2, " ".join(w[100:600] + ["end"])), (3, "new " + " ".join(w[:20]))]
    import pyarrow as pa

    texts = pa.array([t for _, t in rows], pa.large_string())
    whole = [h for _, _, h, _ in substring_dedup.hashed_words(texts)]
    monkeypatch.setattr(substring_dedup, "PIECE", 64)
    pieces = [h for i in range(3) for _, _, h, _ in substring_dedup.hashed_words(texts[i : i + 1])]
    assert (np.concatenate(whole) == np.concatenate(pieces)).all()
    seen = {}
    for block in (1 << 20, 50):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        out = []
        pick = substring_dedup._halves(13)
        for words, row, place, room, here in substring_dedup.blocks(texts, 13):
            at, h = pick(words, room, here)
            out += list(zip(row[at].tolist(), h.tolist()))
        seen[block] = set(out)
    assert seen[50] == seen[1 << 20]


def test_least():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 1 << 62, 200).astype(np.uint64)
    for reach in (1, 2, 3, 7, 8, 14, 100, 200):
        want = [int(h[i : i + reach].min()) for i in range(len(h) - reach + 1)]
        m, at = least_at(h, reach)
        assert least(h, reach).tolist() == m.tolist() == h[at].tolist() == want
        assert len(at) == len(want) and all(i <= a < i + reach for i, a in enumerate(at))
    sizes = lengths(13)
    assert [next(sizes) for _ in range(5)] == [7, 13, 26, 52, 104]
