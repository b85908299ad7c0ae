"""Learned operators: held-out accuracy, calibration, and their corner cases; tiling against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracegrove.llm import kneser_ney, langid, tiling, toxicity

VOWELS = {"aa": "aeiou", "bb": "yöüäø", "cc": "áéíóú"}


def words(rnd, lang, n):
    cons = {"aa": "bdfg", "bb": "klmn", "cc": "prst"}[lang]
    return [("".join(rnd.choice(cons) + rnd.choice(VOWELS[lang]) for _ in range(rnd.randrange(1, 4)))) for _ in range(n)]


def test_languages_and_mixtures(spark):
    rnd = random.Random(0)
    train = [(k, " ".join(words(rnd, lang, 40)), lang) for k, lang in enumerate(list(VOWELS) * 20)]
    train += [(900, None, "aa"), (901, "zzz", None)]
    model = langid.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    test = [(k, " ".join(words(rnd, lang, rnd.choice([2, 30]))), lang, 1.0) for k, lang in enumerate(list(VOWELS) * 15)]
    half = words(rnd, "aa", 60) + words(rnd, "bb", 40)
    test += [(100, None, None, 0.0), (101, "", None, 0.0), (102, "12 34 !?", None, 0.0), (103, " ".join(half), None, 0.0), (104, " ".join(words(rnd, "cc", 200_000)), "cc", 0.0)]
    df = spark.createDataFrame(test, "doc_id long, text string, want string, score double")
    got = {r.doc_id: r for r in langid.predict(df, model, df.columns).collect()}
    assert all(got[k].lang_pred == want for k, _, want, _ in test if want)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].languages == [] for k in (100, 101, 102))
    assert [x.lang for x in got[103].languages] == ["aa", "bb"] and abs(got[103].score - 0.6) < 0.05
    assert [x.lang for x in got[0].languages] == [test[0][2]]
    nothing = langid.learn(df.select("doc_id", "text", "want").limit(0), lang="want")
    assert {r.lang_pred for r in langid.predict(df, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(df.limit(0), model, ["doc_id"]).collect() == []


def test_segments_are_all_maximal_ones():
    rnd = random.Random(2)
    for _ in range(200):
        s = np.array([rnd.choice([-0.5, -0.1, 1.0, 2.0, -3.0]) for _ in range(rnd.randrange(1, 25))])

        def brute(lo, hi):
            best = max(((s[a:b].sum(), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
            if best[0] <= 1e-9:
                return []
            a, b = best[2], best[3]
            return brute(lo, a) + [round(float(best[0]), 6)] + brute(b, hi)

        assert sorted(round(x, 6) for _, _, x in toxicity.segments(s, 0.1)) == sorted(brute(0, len(s)))


def test_toxic_passages_are_found(spark):
    rnd = random.Random(1)
    vocab, bad = [f"word{k}" for k in range(400)], ["vile", "scum", "idiot", "trash"]
    rows, labels = [], []
    for k in range(600):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(20, 80))]
        toxic = k % 5 == 0
        for _ in range(rnd.randrange(2, 6) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((k, " ".join(w).upper() if k % 3 else " ".join(w), "x"))
        labels.append((k, int(toxic)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "é " * 50 + "You vile, stupid idiot trash " + "word1 " * 300, "x"), (1003, "word3 " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels[:400] + [(5000, 1), (None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.learn(docs, known)
    got = {r.doc_id: r for r in toxicity.detect(docs, model, docs.columns).collect()}
    right = [(got[k].score >= 0.5) == bool(t) for k, t in labels[400:]]
    assert sum(right) / len(right) > 0.97
    assert got[1000].score < 0.5 and got[1001].score < 0.5 and got[1003].score < 0.5 and got[1002].score >= 0.5
    text = rows[602][1]
    assert any("vile" in (p := text[x.from_char : x.to_char]) and p.endswith("trash") for x in got[1002].passages)
    assert all(0 <= r.score <= 1 for r in got.values())
    one_class = toxicity.learn(docs, known.filter("toxic = 0"))
    assert {r.score for r in toxicity.detect(docs, one_class, ["doc_id"]).collect()} == {0.0}
    assert toxicity.detect(docs.limit(0), model, ["doc_id"]).collect() == []


def test_kneser_ney_probabilities_sum_to_one(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc ") for _ in range(200)) for _ in range(20)]
    counts = kneser_ney.gram_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    code = counts.orderBy("code").first().code
    context = code // 64
    for c in (context, 0):
        wanted = spark.createDataFrame([(c * 64 + k,) for k in range(64)], "code int")
        p = [math.exp(r.logp) for r in kneser_ney.probabilities(counts, wanted).collect()]
        assert len(p) == 64 and abs(sum(p) - 1) < 1e-6 and min(p) > 0


def test_quality_keeps_clean_text(spark):
    rnd = random.Random(5)
    good = [(k, " ".join(words(rnd, "aa", 60)), "aa" if k % 9 else None) for k in range(300)]
    junk = [(1000 + k, "".join(rnd.choice("xq#%&zv9\n") for _ in range(300)), "aa") for k in range(40)]
    docs = spark.createDataFrame(good + junk + [(2000, None, "aa"), (2001, "", None)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(200)] + [(5,), (None,), (77777,)], "doc_id long")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, trusted).collect()}
    assert sum(got[k].keep for k in range(300)) >= 295 and not any(got[1000 + k].keep for k in range(40))
    assert got[2000].perplexity is None and not got[2000].keep and not got[2001].keep
    untaught = kneser_ney.classify(docs, trusted.limit(0)).collect()
    assert sum(r.keep for r in untaught) == 340
    assert kneser_ney.classify(docs.limit(0), trusted).collect() == []


def plain_kneser_ney(trusted, base):
    """Trigram model by dictionaries; ``base(word)`` is the probability below the unigrams."""
    three = Counter(tuple(x[k - 2 : k + 1]) for x in (["<", "<", *t, ">"] for t in trusted) for k in range(2, len(x)))
    levels = [three]
    for _ in range(2):
        levels.append(Counter(g[1:] for g in levels[-1]))

    def discounts(level):
        n1, n2, n3, n4 = (sum(v == k for v in level.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if min(n1, n2, n3) else 0
        return [float(np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))] if y else [0.5, 0.75, 0.9]

    cut = [discounts(x) for x in levels]

    def p(gram):
        if not gram:
            return None
        level, d = levels[3 - len(gram)], cut[3 - len(gram)]
        lower = base(gram[0]) if len(gram) == 1 else p(gram[1:])
        same = {g: n for g, n in level.items() if g[:-1] == gram[:-1]}
        if not same:
            return lower
        held = sum(d[min(n, 3) - 1] for n in same.values())
        n = same.get(gram, 0)
        return ((n - d[min(n, 3) - 1] if n else 0) + held * lower) / sum(same.values())

    return p


@pytest.mark.parametrize("partitions", [1, 3])
def test_word_trigrams_equal_plain_kneser_ney(spark, partitions):
    rnd = random.Random(9)
    vocab = ["мир", "дом", "лес", "12", "13", "ab", "Ab", ",", "é"]
    trusted = [[rnd.choice(vocab) for _ in range(rnd.randrange(1, 12))] for _ in range(40)]
    asked = [*trusted[:5], [*trusted[0], "новое", "zq"], ["ab"] * 300, ["zzz"], []]
    frame = lambda texts: spark.createDataFrame([(k, " ".join(t) or " ", None) for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(partitions)
    docs = frame(asked + trusted)
    model = kneser_ney.learn(frame(trusted), docs)
    table = model.spelling.table()

    def base(word):
        raw = np.frombuffer(word.strip(">").encode() + b" ", np.uint8)
        return math.exp(kneser_ney.spelled(raw, np.array([0, len(raw)]), table)[0])

    p = plain_kneser_ney(trusted, base)
    got = {r.doc_id: r for r in kneser_ney.perplexities(frame(asked), model).collect()}
    assert len(got) == len(asked)
    for k, t in enumerate(asked):
        x = ["<", "<", *t, ">"]
        want = sum(math.log(p(tuple(x[i - 2 : i + 1]))) for i in range(2, len(x)))
        assert got[k].n_symbols == len(t) + 1 and abs(math.log(got[k].perplexity) + want / (len(t) + 1)) < 1e-5


def test_model_in_slices_and_documents_in_turns(spark, monkeypatch):
    from pathlib import Path

    from tracegrove.llm import common

    rnd = random.Random(21)
    vocab = ["".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(60)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(40)) for _ in range(90)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[4], None), (500, None, "x"), (501, "", "x"), (502, "q" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    trusted = docs.filter("doc_id < 40")
    tables = lambda: {p for p in Path(common.shared_root(spark).removeprefix("file:")).glob("llm*")}
    before = tables()
    model = kneser_ney.learn(trusted, docs)
    # Besides the model nothing but emptied folders of trigrams stays.
    left = [p for p in tables() - before if any(p.rglob("*.parquet"))]
    assert len(left) == 1 and {r.shard for r in model.values.collect()} <= set(range(1 << model.bits))
    tell = lambda docs, model: sorted((str(r.doc_id), r.n_symbols, f"{r.perplexity or 0:.9g}") for r in kneser_ney.perplexities(docs, model).collect())
    once = tell(docs, model)
    assert len(once) == len(rows)
    parts = docs.repartition(4 * spark.sparkContext.defaultParallelism)
    assert tell(parts, model) == once
    monkeypatch.setattr(kneser_ney, "BATCH_BYTES", 300)
    assert tell(docs, model) == once


def test_tokens_keep_bytes_apart():
    texts = pa.array(["Ab12 ab!? é", "", "日本 한", " "], pa.large_string())
    raw, off = kneser_ney.buffers(texts)
    start, end, word, text = kneser_ney.tokens(raw, off)
    assert [(k, bytes(raw[a:b]).decode()) for a, b, k in zip(start, end, text.tolist(), strict=True)] == [
        (0, "Ab12"), (0, "ab"), (0, "!?"), (0, "é"), (0, ""), (2, "日"), (2, "本"), (2, "한"), (2, ""), (3, "")
    ]
    assert len(set(word.tolist())) == 8


def test_shuffled_words_are_dropped(spark):
    rnd = random.Random(11)
    phrases = [" ".join("".join(rnd.choice("абвгдежзиклмн") for _ in range(5)) for _ in range(8)) for _ in range(40)]
    good = [" ".join(rnd.choice(phrases) for _ in range(6)) for _ in range(300)]
    mixed = [" ".join(rnd.sample(t.split(), 48)) for t in good[:40]]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(good)] + [(1000 + k, t, "x") for k, t in enumerate(mixed)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.keep for r in kneser_ney.classify(docs, spark.range(200).toDF("doc_id")).collect()}
    assert sum(got[k] for k in range(300)) >= 290 and not any(got[1000 + k] for k in range(40))


def brute_tiles(a, b, k):
    used_a, used_b, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < k:
            return total
        n, i, j = best[0], -best[1], -best[2]
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        total += n


def test_tiles_equal_brute_force():
    rnd = random.Random(6)
    for _ in range(150):
        a = np.array([rnd.randrange(4) for _ in range(rnd.randrange(1, 14))], np.uint64)
        b = np.array([rnd.randrange(4) for _ in range(rnd.randrange(1, 18))], np.uint64)
        got = tiling.tiles(a, b, 3)
        assert all((a[x : x + n] == b[y : y + n]).all() for x, y, n in got)
        assert sum(n for _, _, n in got) == brute_tiles(a.tolist(), b.tolist(), min(3, len(a)))


@pytest.mark.parametrize("partitions", [1, 3])
def test_contaminated_documents(spark, partitions):
    rnd = random.Random(7)
    item = [f"i{k}" for k in range(40)]
    filler = lambda n: [f"f{rnd.randrange(1000)}" for _ in range(n)]
    rows = {
        1: " ".join(filler(50) + item + filler(50)),
        2: " ".join(filler(20) + item[20:] + filler(30) + item[:20]),
        3: " ".join(item).upper() + "!!",
        4: " ".join(filler(100) + item[:15]),
        5: " ".join(filler(300)),
        6: None,
        7: "",
        8: "... Ünique Phrase!",
        9: " ".join(filler(100_000) + item),
    }
    docs = spark.createDataFrame([(d, t, "keep") for d, t in rows.items()] + [(1, rows[1], "keep")], "doc_id long, text string, item_id string").repartition(partitions)
    bench = spark.createDataFrame([(2, " ".join(item)), (1, " ".join(item)), (3, None), (4, ""), (5, "ünique phrase"), (None, "f1 f2")], "item_id long, text string")
    told, clean = tiling.decontaminate(docs, bench)
    got = {r.doc_id: r for r in told.collect()}
    assert {d for d, r in got.items() if r.contaminated} == {1, 2, 3, 8, 9}
    assert got[1].item_id == 1 and got[1].n_items == 2 and got[1].coverage == 1.0 and got[8].item_id == 5
    assert told.count() == 10 and clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7]
    told, clean = tiling.decontaminate(docs, bench.limit(0))
    assert not any(r.contaminated for r in told.collect()) and clean.count() == 10
    assert tiling.decontaminate(docs.limit(0), bench)[0].collect() == []


def test_languages_do_not_depend_on_neighbours(spark):
    """The same scores, sets and fits, however the texts are dealt over partitions and runs."""
    rnd = random.Random(12)
    tongues = {"x": "abcde", "y": "uvwxyz", "z": "mnopq"}

    def text(langs, n):
        return " ".join("".join(rnd.choice(tongues[rnd.choice(langs)]) for _ in range(rnd.randrange(1, 8))) for _ in range(n))

    rows = [(k, text("xyz"[k % 3], 30), "xyz"[k % 3]) for k in range(60)]
    rows += [(100 + k, text("xy" if k % 2 else "xyz", rnd.choice([1, 2, 5, 40, 300])), None) for k in range(60)] + [(300, "", None), (301, "12 34", None), (302, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    seen = []
    for parts in (1, 4, 16):
        got = langid.predict(df.repartition(parts), model, ["doc_id"], fits=True).collect()
        seen.append({r.doc_id: (r.lang_pred, r.score, tuple(map(tuple, r.languages)), r.fit, r.n_words) for r in got})
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(rows)
    assert any(len(v[2]) > 1 for v in seen[0].values())
    spoken = [{(r.doc_id, r.lang_pred) for r in langid.spoken(df.repartition(p), ["doc_id"]).collect()} for p in (1, 5)]
    assert spoken[0] == spoken[1]


def test_expectation_maximisation_equals_a_plain_loop():
    """Proportions, likelihoods and the chosen sets against loops over words and subsets of ranked languages."""
    rnd = np.random.default_rng(4)
    first = np.array([0, 0, 1, 9, 9, 60])
    word = rnd.normal(-20, 6, (60, 3))
    share, like = langid.mixture(word, first, np.ones((5, 3)))
    best, likely = langid.choose(word, first)
    for d in range(5):
        own = word[first[d] : first[d + 1]]

        def estimate(allowed, own=own):
            p = np.array(allowed, float) / sum(allowed)
            for _ in range(langid.STEPS):
                if not len(own):
                    break
                part = np.exp(np.maximum(own - own.max(axis=1, keepdims=True), -60)) * p
                new = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
                still = abs(new - p).max() <= langid.STILL
                p = new
                if still:
                    break
            top = own.max(axis=1, keepdims=True) if len(own) else own
            return p, float(np.log((np.exp(np.maximum(own - top, -60)) * p).sum(axis=1)).sum() + top.sum())

        p, l = estimate([1, 1, 1])
        assert np.allclose(share[d], p) and np.isclose(like[d], l)
        order = sorted(range(3), key=lambda k: (-p[k], k))
        most = max(1, sum(p[k] * max(1, len(own)) >= 1 for k in range(3)))
        tried = []
        for size in range(1, most + 1):
            q, v = estimate([1 if k in order[:size] else 0 for k in range(3)])
            tried.append((v - 0.5 * (size - 1) * math.log(max(2, len(own))), -size, q, v))
        _, _, q, v = max(tried, key=lambda x: x[:2])
        assert np.allclose(best[d], q) and np.isclose(likely[d], v)
