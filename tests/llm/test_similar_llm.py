"""Prefix join, line deduplication and union-find against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tracegrove.llm import common, line_dedup, prefix_join
from tracegrove.llm.common import sketch_of
from tracegrove.llm.components import connected


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", folded(text or ""))
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def similar(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 80 * (len(a) + len(b) - both)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.3 or not texts:
            texts.append(" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 12, 60, 200]))))
        else:
            w = rnd.choice(texts).split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(("\t" if kind < 0.5 else " ").join(w).upper() if kind < 0.4 else " ".join(w))
    return texts


@pytest.mark.parametrize("partitions", [1, 3])
def test_components_equal_brute_force(spark, partitions):
    texts = corpus(5, 160) + [None, "", " \n\t", "one two", "ONE\x0btwo", "é x"]
    rows = [(k * 3, t, "extra", 0, 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string, n int, grp int").repartition(partitions)
    got = {r.doc_id: r for r in prefix_join.PrefixJoin(df).components().collect()}
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    u = Union(sets)
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and similar(sets[i], sets[j]):
                u.join(i, j)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == {i: u.find(i) for i in ids}
    kept = prefix_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({u.find(i) for i in ids})


def test_a_chain_and_a_group_of_near_copies_are_one_component(spark):
    rnd = random.Random(1)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(120):
        w = list(base)
        w[rnd.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(w)))
    got = prefix_join.PrefixJoin(spark.createDataFrame(rows, "doc_id long, text string")).components().collect()
    assert {r.component_id for r in got} == {0}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    schema = "doc_id long, text string"
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u"), (9, "z")]
    df = spark.createDataFrame(rows, schema)
    got = prefix_join.PrefixJoin(df).components().collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 7), (7, 7), (7, 7), (9, 9)]
    assert sorted((r.doc_id or -1) for r in prefix_join.one_of_each(df).collect()) == [-1, 7, 9]
    empty = spark.createDataFrame([], schema)
    assert prefix_join.PrefixJoin(empty).components().collect() == []
    assert prefix_join.one_of_each(empty).collect() == []


def test_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(50)] + [(5, 5)]
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def line_set(line):
    b = folded(line).encode()
    return frozenset([b]) if len(b) < 8 else frozenset(b[i : i + 8] for i in range(len(b) - 7))


def brute_lines(rows, min_chars):
    lines = sorted({(d, k, x) for d, t in rows if t for k, x in enumerate(t.split("\n")) if len(x) >= min_chars})
    distinct = {}
    for d, k, x in lines:
        distinct.setdefault(folded(x), []).append((d, k))
    sets = {x: line_set(x) for x in distinct}
    u = Union(range(len(distinct)))
    names = list(distinct)
    for i, x in enumerate(names):
        for j in range(i):
            if similar(sets[x], sets[names[j]]):
                u.join(i, j)
    first = {}
    for i, x in enumerate(names):
        r = u.find(i)
        first[r] = min([first.get(r, distinct[x][0]), *distinct[x]])
    stays = set(first.values())
    return {d: t and "\n".join(x for k, x in enumerate(t.split("\n")) if len(x) < min_chars or (d, k) in stays) for d, t in rows}


def test_lines_equal_brute_force(spark):
    rnd = random.Random(8)
    pool = ["".join(rnd.choice("abcde fghi jklmnop ") for _ in range(rnd.choice([25, 60, 150, 170, 250, 262, 700]))) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "\n\nshort\n")]
    for d in range(3, 60):
        own = []
        for _ in range(rnd.randrange(6)):
            x = list(rnd.choice(pool))
            for _ in range(rnd.choice([0, 0, 1])):
                x[rnd.randrange(len(x))] = "Z"
            own.append("".join(x) if rnd.random() < 0.8 else "".join(x).upper())
        rows.append((d, "\n".join(own)))
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, line_no string, n_lines int").repartition(3)
    out = line_dedup.LineDedup(df).deduplicated()
    got = {r.doc_id: r for r in out.collect()}
    want = brute_lines(rows, 20)
    assert {d: r.text for d, r in got.items()} == want
    assert got[0].n_lines == 0 and got[2].n_lines == 4 and got[3].line_no == "x"
    assert sum(r.n_removed for r in got.values()) == sum((rows[d][1] or "").count("\n") - (want[d] or "").count("\n") for d in want if want[d]) + sum(1 + (rows[d][1]).count("\n") for d in want if rows[d][1] and not want[d])


def test_lines_of_repeated_rows_null_ids_and_empty_tables(spark):
    line = "this line is long enough to count as one"
    rows = [(None, line), (1, line), (1, line), (2, line + "\nsecond line that stays where it is")]
    got = line_dedup.LineDedup(spark.createDataFrame(rows, "doc_id long, text string")).deduplicated().collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, line), (1, ""), (1, ""), (2, "second line that stays where it is")]
    assert line_dedup.LineDedup(spark.createDataFrame([], "doc_id long, text string")).deduplicated().collect() == []


def test_short_lines_equal_brute_force(spark):
    rnd = random.Random(12)
    pool = ["".join(rnd.choice("abcd efgh") for _ in range(n)) for n in (1, 2, 5, 7, 8, 9, 12, 15, 18, 19, 20, 30) for _ in range(3)] + ["}", "短い行です", "一二三四五六七八九十一二三四"]
    pool = [x for x in pool if x.strip()]
    rows = []
    for d in range(40):
        own = []
        for _ in range(rnd.randrange(8)):
            x = rnd.choice(pool)
            own.append(rnd.choice([x, x, x.upper(), x + rnd.choice("abcd")]))
        rows.append((d, "\n".join(own)))
    out = line_dedup.LineDedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).deduplicated()
    assert all(x.strip() for _, t in rows for x in t.split("\n") if x)
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(rows, 1)


def test_blank_lines_stay(spark):
    rows = [(1, "}\n\n \t\n\r\nend"), (2, "}\n\n \t\n\r\nEnd")]
    got = line_dedup.LineDedup(spark.createDataFrame(rows, "doc_id long, text string")).deduplicated()
    assert {r.doc_id: r.text for r in got.collect()} == {1: rows[0][1], 2: "\n \t\n\r"}


def test_one_of_each_chooses_one_row_of_rows_with_one_id_or_none(spark):
    """Near copies that share an id, or have none, are still one component of which one row stays."""
    base = [f"w{k}" for k in range(200)]
    near = [*base[:199], "other"]
    far = " ".join(f"v{k}" for k in range(50))
    rows = [(5, " ".join(base)), (5, " ".join(near)), (None, " ".join(base) + " x"), (7, far), (7, far), (None, "n1 n2 n3 n4 n5 n6"), (None, "n1 n2 n3 n4 n5 n6"), (None, None), (8, ""), (9, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in prefix_join.one_of_each(df).collect()), key=repr)
    fives = [t for i, t in got if i == 5]
    assert len(fives) == 1 and fives[0] in (rows[0][1], rows[1][1])
    assert [x for x in got if x[0] != 5] == sorted([(7, far), (None, "n1 n2 n3 n4 n5 n6"), (None, None), (8, ""), (9, " ")], key=repr)
    nulls = spark.createDataFrame([(None, " ".join(base)), (None, " ".join(near))], "doc_id long, text string")
    assert prefix_join.one_of_each(nulls).count() == 1


def test_variants_of_one_line_meet_by_what_tells_them_from_it(spark):
    """Of many variants of one line, near ones, far ones and near ones of far ones, no link is lost, and few pairs are compared."""
    rnd = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz "
    base = "".join(rnd.choice(letters) for _ in range(330))

    def varied(line, times):
        line = list(line)
        for _ in range(times):
            at = rnd.randrange(len(line))
            line[at : at + rnd.choice([0, 2, 5])] = rnd.choice(["to ", "onward", rnd.choice(letters)])
        return "".join(line)

    own = [base] + [varied(base, rnd.choice([1, 2, 3])) for _ in range(60)] + [varied(base, rnd.choice([4, 5, 6, 7, 8])) for _ in range(240)]
    own += [varied(rnd.choice(own), 1) for _ in range(60)] + [x[: rnd.randrange(250, 320)] for x in rnd.sample(own, 30)]
    own = list(dict.fromkeys(own))
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    sets = [line_set(x) for x in own]
    links = {(i, j) for i in range(len(own)) for j in range(i) if similar(sets[i], sets[j])}
    dedup = line_dedup.LineDedup(df)
    rows = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    named = {r.cls: r.doc_id for r in line_dedup.LineDedup(rows).lines().collect()}
    cls = {i: c for c, i in named.items()}
    star = Union(range(len(own)))
    for i, j in links:
        if 0 in (i, j):
            star.join(i, j)
    members = spark.createDataFrame([(cls[0], cls[i], cls[star.find(i)]) for i in range(1, len(own))], "lead long, cls long, root long")
    texts = spark.createDataFrame([(cls[i], bytearray(folded(x).encode())) for i, x in enumerate(own)], "cls long, line binary")
    got = {tuple(sorted((named[r.a], named[r.b]), reverse=True)) for r in dedup.apart(members, texts).collect()}
    want = {(i, j) for i, j in links if star.find(i) != star.find(j)}
    crossing = sum(star.find(i) != star.find(j) for i in range(1, len(own)) for j in range(1, i))
    assert want and want <= got
    assert len(got) < crossing / 8
    # The whole job compares few pairs too.
    seen = []
    verified = dedup.verified
    dedup.verified = lambda pairs, t: seen.append(pairs.count()) or verified(pairs, t)
    roots = {named[r.node]: r.root for r in dedup.roots().collect()}
    assert sum(seen) < crossing / 4
    for i, j in want:
        assert roots[i] == roots[j]


def test_only_the_result_of_a_step_stays_stored(spark, tmp_path, monkeypatch) -> None:
    texts = ["the quick brown fox jumps over the lazy dog, number one", "the quick brown fox jumps over the lazy dog, number two", "something else that nobody else has said"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(common, "shared_root", lambda _: str(tmp_path))
    roots = line_dedup.LineDedup(docs).roots()
    assert len(list(tmp_path.glob("llm-*"))) == 1
    assert roots.count() == 2
    placed = prefix_join.PrefixJoin(docs).components()
    assert len(list(tmp_path.glob("llm-*"))) == 3
    assert placed.count() == 3


def test_sketches_of_many_lines_are_those_of_their_sets() -> None:
    text = b"ab\n\n  \t\nabcdefgh\n" + b"Ab cd" * 40 + b"\n x \nabcdefghi" + "é".encode() * 9
    raw, off = np.frombuffer(text + b"\nlast", np.uint8), np.array([0, 4, 4, len(text), len(text) + 5])
    start, end, doc, number = line_dedup.line_spans(raw, off)
    want = [(d, k, x) for d in range(4) for k, x in enumerate(bytes(raw[off[d] : off[d + 1]]).split(b"\n")) if x.strip()]
    assert [(d, k, bytes(raw[a:b])) for a, b, d, k in zip(start, end, doc, number, strict=True)] == want
    n, sketch = line_dedup.line_sketches(raw, start, end)
    sets = [line_dedup.line_set(bytes(raw[a:b])) for a, b in zip(start, end, strict=True)]
    assert n.tolist() == [len(x) for x in sets]
    assert [x.tobytes() for x in sketch] == [sketch_of(x, line_dedup.SKETCH_BITS) for x in sets]


def test_bands_dealt_in_parts_are_counted_like_rows(spark) -> None:
    rng = np.random.default_rng(3)
    bands = rng.integers(-(2**63), 2**63 - 1, 3000)
    bands = np.concatenate([bands, bands[:50], bands[:9], bands[:5] ^ (1 << 41)])
    rows = spark.createDataFrame([(bands[k : k + 7].tolist(),) for k in range(0, len(bands), 7)], "bands array<long>").repartition(4)
    dealt = rows.mapInArrow(line_dedup._dealt, "part int, bands binary").repartition("part").sortWithinPartitions("part")
    got = sorted(r.band for r in dealt.mapInArrow(line_dedup._twice, "band long").collect())
    key, n = np.unique(bands & ((1 << line_dedup.BAND_BITS) - 1), return_counts=True)
    assert got == key[n > 1].tolist()
