"""Packing: every id once, all limits held, little padding."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracegrove.llm import packing
from tracegrove.llm.packing import Limits

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, wanted, lim, masks=None):
    docs, seqs = {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length > 0
        docs.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens, p.loss_tokens))
        seqs.setdefault(p.sequence_id, []).append(p)
    for d, parts in docs.items():
        parts.sort()
        assert [x for _, ids, _, _ in parts for x in ids] == wanted[d]
        at = 0
        for start, ids, total, loss in parts:
            assert start == at and total == len(wanted[d])
            at += len(ids)
            assert loss == (sum(masks[d][start : start + len(ids)]) if masks else len(ids))
    assert set(docs) == {d for d, ids in wanted.items() if ids}
    for own in seqs.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= lim.tokens and len(own) <= lim.segments and sum(p.loss_tokens for p in own) <= lim.loss_tokens
    return seqs


@pytest.mark.parametrize("partitions", [1, 3])
def test_three_limits_hold_and_nothing_is_lost(spark, partitions):
    rnd = random.Random(3)
    rows = []
    for d in range(400):
        n = rnd.choice([0, 1, 3, 40, 90, 128, 300, 1000])
        rows.append((d, [rnd.randrange(1000) for _ in range(n)], [rnd.random() < 0.4 for _ in range(n)], "x"))
    df = spark.createDataFrame([(d, i, [int(b) for b in m], e) for d, i, m, e in rows], "doc_id long, ids array<int>, mask array<int>, sequence_id string").repartition(partitions)
    lim = Limits(tokens=256, segments=5, loss_tokens=100, cell=64)
    pieces = packing.pack_examples(df, "doc_id", "ids", "mask", lim).collect()
    seqs = check(pieces, {r[0]: r[1] for r in rows}, lim, {r[0]: r[2] for r in rows})
    total = sum(len(r[1]) for r in rows)
    loss = sum(sum(r[2]) for r in rows)
    assert len(seqs) <= 1.1 * max(total / 256, loss / 100, len(rows) / 5) + 4 * partitions


def test_documents_are_tokenized_whole(spark):
    texts = {1: None, 2: "", 3: "Hello there, world's end.\n\n  tab\t12345 é漢字", 4: "word " * 30_000, 5: "x<|endoftext|>y", 6: "a" * 5000}
    rows = [(d, t, 7) for d, t in texts.items()]
    own = Tokenizer.from_file(PATH)
    wanted = {d: own.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").coalesce(1)
    pieces = packing.pack_documents(df, PATH).collect()
    seqs = check(pieces, wanted, Limits())
    assert len(seqs) == -(-sum(map(len, wanted.values())) // 2048)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [5, 6]), (1, [5, 6]), (None, [7]), (2, None)], "doc_id long, ids array<int>")
    pieces = packing.pack_examples(df, "doc_id", "ids").collect()
    assert sorted((p.doc_id or 0, p.length) for p in pieces) == [(0, 1), (1, 2), (1, 2)]
    assert packing.pack_examples(df.limit(0), "doc_id", "ids").collect() == []
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_bad_limits_and_masks_are_refused(spark):
    df = spark.createDataFrame([(1, [5, 6], [1])], "doc_id long, ids array<int>, mask array<int>")
    with pytest.raises(ValueError):
        packing.pack_examples(df, "doc_id", "ids", limits=Limits(tokens=0))
    with pytest.raises(Exception, match="mask has 1 entries"):
        packing.pack_examples(df, "doc_id", "ids", "mask").collect()


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\u00a0", " \n\t"])
def test_very_many_blanks_in_a_row(spark, blank):
    """The rank encoder's stack ends there; the file's own library takes such texts."""
    n = 1_000_000 // len(blank)
    text = "begin" + blank * n + "end"
    path = public_tokenizers.path("byte_bpe_50k.json")
    (ids,) = packing.byte_level_encoder(path)([text])
    assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    pieces = packing.pack_documents(df, path).collect()
    assert sum(p.length for p in pieces if p.doc_id == 1) == len(ids) + 1
