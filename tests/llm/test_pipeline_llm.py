"""Stages of the pipeline on texts that the given tables lack."""

from __future__ import annotations

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_copies_with_blank_lines_go(spark):
    paragraphs = [f"paragraph {k} has words of its own, {k * 7919} of them in all" for k in (1, 22, 333, 4444)]
    texts = ["\n\n".join(paragraphs), "\r\n\r\n".join(paragraphs), "\n \t\n\u3000\n".join(paragraphs)]
    rows = [(10 * k + copy, t, "en", "s", len(t)) for k, t in enumerate(texts) for copy in range(3)] + [(90, "\n\n", "en", "s", 2)]
    out = corpus_pipeline.near_duplicate_lines(spark, spark.createDataFrame(rows, SCHEMA), "")
    # A document that loses no line stays as it is.
    assert sorted(r.doc_id for r in out.collect()) == [0, 90]


def test_gibberish_goes_and_unlabelled_documents_stay(spark):
    rnd = random.Random(3)
    kinds = {"aa": ("bdfg", "aeiou"), "bb": ("klmn", "yöüäø")}
    word = lambda lang: "".join(rnd.choice(kinds[lang][0]) + rnd.choice(kinds[lang][1]) for _ in range(rnd.randrange(1, 4)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = [(k, text(lang, rnd.choice([3, 12, 60])), lang if k % 3 else None) for k, lang in enumerate(["aa", "bb"] * 300)]
    rows += [(1000, text("aa", 30) + " " + text("bb", 30), None), (1001, "12 34", "aa"), (1002, None, "aa")]
    rows += [(2000 + k, " ".join("".join(rnd.choice("xqzvkjw") for _ in range(6)) for _ in range(n)), None) for k, n in enumerate([4, 20, 100] * 5)]
    docs = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows], SCHEMA)
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert sum(k in got for k in range(600)) >= 595 and 1000 in got and not any(k in got for k in [1001, 1002, *range(2000, 2015)])
    assert all(lang == ("aa", "bb")[k % 2] for k, lang in got.items() if k < 600)
    bare = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    kept = corpus_pipeline.language_id(spark, bare, "")
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
