"""Collocation mining against brute force and on corner cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tracegrove.llm import collocations
from tracegrove.llm.collocations import Phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, most=5, at_least=100, top=2000, percent=100):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        count = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                count.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if a >= at_least and len(p) > 1}
        inside = set()
        for p, a in good.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= percent * count[p[i : i + m]]:
                        inside.add(p[i : i + m])
        rows = []
        for p, a in good.items():
            if p not in inside:
                cuts = [(1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["the", "of", "New", "york", "City", "é", "Été", "x y", "a\x01", "a", "'s"] + [f"w{k}" for k in range(30)]
    weights = [30, 20] + [5] * (len(words) - 2)
    fixed = [["New", "York", "City"], ["in", "spite", "of", "the"], ["a", "a", "a"]]
    rows = []
    for _ in range(n):
        w = []
        for _ in range(rnd.randrange(40)):
            w += rnd.choice(fixed) if rnd.random() < 0.2 else rnd.choices(words, weights)
            w[-1] += rnd.choice(["", "", "", "", ",", ". ", "\n", "\t", " ; "])
        rows.append((rnd.choice(["en", "en", "de", None]), " ".join(w)))
    return rows


def table_of(rows):
    return sorted((r.grp, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows)


@pytest.mark.parametrize("partitions,budget", [(1, 1 << 20), (5, 500), (3, 20)])
def test_equals_brute_force(spark, partitions, budget):
    rows = corpus(partitions, 250)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(partitions)
    got = Phrases(df, at_least=12, budget=budget).best()
    assert table_of(got.collect()) == brute_force(rows, at_least=12)


def test_top_ties_and_share(spark):
    rows = corpus(9, 200)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert table_of(Phrases(df, at_least=5, most=3).best(top=7).collect()) == brute_force(rows, 3, 5, 7)
    got = Phrases(df, at_least=5).scored(percent=60)
    assert sorted((r.grp, r.phrase, r.score) for r in got.collect()) == sorted((x[0], x[2], x[7]) for x in brute_force(rows, 5, 5, 10**9, 60))


def test_corner_cases(spark):
    rows = [(None, None), ("en", ""), ("en", ". , \n"), (None, "A b " * 60), ("und", "a B " * 60), ("en", "one two " * 40 + "\r" + "one two")]
    rows += [("fr", "end"), ("fr", "begin end")] * 3
    df = spark.createDataFrame([(*r, 1, "g", "p", 2) for r in rows], "lang string, text string, n long, grp string, phrase string, a long")
    assert table_of(Phrases(df, at_least=3).best().collect()) == brute_force(rows, at_least=3)
    assert Phrases(df.limit(0), at_least=3).best().collect() == []


def test_scores_beyond_64_bits(spark):
    """The product of the counts is taken in decimals: 1000 * a * n passes 64 bits here."""
    phrases = Phrases(spark.createDataFrame([], "lang string, text string"))
    big = 3_000_000_000
    counts = spark.createDataFrame([("en", "x y", 2, big), ("en", "x", 1, big + 1), ("en", "y", 1, big + 7)], "grp string, phrase string, words int, a long")
    totals = spark.createDataFrame([("en", 10 * big)], "grp string, n long")
    phrases.counts = lambda: (counts, totals)
    (r,) = phrases.scored().collect()
    assert r.score == 1000 * big * 10 * big // ((big + 1) * (big + 7)) and 1000 * big * 10 * big > 2**63


def test_nodes_above_a_split_prefix_are_summed(spark):
    """A budget below every word's count splits all prefixes to the last; counts stay whole."""
    rows = [("en", "a b c d e f " * 30)] * 5
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = {(r.phrase, r.a) for r in Phrases(df, at_least=50, budget=1).counts()[0].collect()}
    want = Counter()
    w = ("a b c d e f " * 30).split()
    for m in range(1, 6):
        want.update(" ".join(w[i : i + m]) for i in range(len(w) - m + 1))
    assert got == {(p, 5 * a) for p, a in want.items() if 5 * a >= 50}


def test_words_of_adjacent_texts_do_not_meet(spark):
    assert collocations.MOST == 5
    rows = [("en", "left"), ("en", "right")] * 120
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = {r.phrase: r.a for r in Phrases(df).counts()[0].collect()}
    assert got == {"left": 120, "right": 120}


def test_long_texts_are_cut_between_pieces(spark):
    import numpy as np

    texts = ["ab cd. " * 50, "ab cd " * 50, ".", "x" * 100 + ", y"]
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        parts = list(collocations._stretches(raw))
        assert parts == [(0, len(raw))]  # a run is far longer
    whole, run = collocations.RUN, collocations._stretches
    try:
        collocations.RUN = 16
        for text in texts:
            raw = np.frombuffer(text.encode(), np.uint8)
            parts = list(run(raw))
            assert parts[0][0] == 0 and parts[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
            assert all(chr(raw[b - 1]) in ".," for _, b in parts[:-1])
        assert len(list(run(np.frombuffer(texts[0].encode(), np.uint8)))) > 10
    finally:
        collocations.RUN = whole
    long = " ".join(rnd for rnd in ["one two, three"] * 200_000)
    got = {r.phrase: r.a for r in Phrases(spark.createDataFrame([("en", long)], "lang string, text string")).counts()[0].collect()}
    assert got == {"one": 200_000, "two": 200_000, "three": 200_000, "one two": 200_000, "three one": 199_999, "three one two": 199_999}
