"""Vector bin packing of examples into training sequences.

Three limits hold at once in every sequence: tokens, segments (pieces), and loss-bearing tokens. Examples
longer than a sequence are cut into full pieces first. The rest is packed in cells of a few thousand
examples: the open sequence takes, again and again, the example whose demand has the largest dot product
with what the sequence has left (both as parts of the limits). When none fits, one example is cut to fill
the gap. Examples of equal demand form one class, so a step looks at classes, not at examples.

Each task packs the rows of its own partition, cell by cell, so nothing is shuffled, a cell bounds the
memory, and a hot source is as good as any other. A sequence's number is the task's partition and a
counter. A rerun over the same input gives the same sequences.

Defined cases: a null text or id list is empty; a document's ids end with the end id, so an empty document
is one token; a null mask counts every token as loss-bearing; ids of any length are cut as needed; equal
rows are packed each for itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_column

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, loss_tokens long"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]
    + [("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())]
)


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. ``min_piece``: a cut that only fills a gap leaves no shorter piece."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    min_piece: int = 8
    cell: int = 8192


@dataclass
class Item:
    """A stretch of a document that still has no place. ``loss``: running count of its loss tokens."""

    doc: int | None
    ids: np.ndarray
    start: int
    total: int
    loss: np.ndarray

    @property
    def demand(self) -> tuple[int, int]:
        return len(self.ids), int(self.loss[-1] - self.loss[0])

    def split(self, n: int) -> tuple[Item, Item]:
        return (
            Item(self.doc, self.ids[:n], self.start, self.total, self.loss[: n + 1]),
            Item(self.doc, self.ids[n:], self.start + n, self.total, self.loss[n:]),
        )

    def fitting(self, tokens: int, loss: int) -> int:
        """The longest prefix within both limits."""
        n = min(tokens, len(self.ids))
        return min(n, int(np.searchsorted(self.loss, self.loss[0] + loss, side="right")) - 1)


def pack_cell(items: list[Item], lim: Limits) -> Iterator[list[Item]]:
    """Sequences of pieces, until the items are used up."""
    classes: dict[tuple[int, int], list[Item]] = defaultdict(list)
    for it in reversed(items):
        classes[it.demand].append(it)
    size = len(classes) + len(items)
    tokens, loss, have = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    slot: dict[tuple[int, int], int] = {}
    stacks: list[list[Item]] = []

    def put(it: Item) -> None:
        k = slot.setdefault(it.demand, len(slot))
        if k == len(stacks):
            stacks.append([])
            tokens[k], loss[k] = it.demand
        stacks[k].append(it)
        have[k] = True

    def take(k: int) -> Item:
        it = stacks[k].pop()
        have[k] = bool(stacks[k])
        return it

    for stack in classes.values():
        for it in stack:
            put(it)
    left = len(items)
    cap_t, cap_l, cap_s = float(lim.tokens), float(max(1, lim.loss_tokens)), float(lim.segments)
    while left:
        t, s, w, out = lim.tokens, lim.segments, lim.loss_tokens, []
        while left and t and s:
            n = len(stacks)
            dot = tokens[:n] * (t / cap_t / cap_t) + loss[:n] * (w / cap_l / cap_l) + s / cap_s / cap_s
            fits = have[:n] & (tokens[:n] <= t) & (loss[:n] <= w)
            k = int(np.argmax(np.where(fits, dot, -1.0)))
            if fits[k]:
                piece = take(k)
                left -= 1
            else:
                k = int(np.argmax(np.where(have[:n], dot, -1.0)))
                cut = stacks[k][-1].fitting(t, w)
                if cut < min(lim.min_piece, lim.tokens) and out:
                    break
                cut = max(1, cut)
                piece, rest = take(k).split(cut)
                if len(slot) + 1 >= len(tokens):
                    tokens, loss, have = (np.concatenate([a, np.zeros_like(a)]) for a in (tokens, loss, have))
                put(rest)
            out.append(piece)
            t, s, w = t - piece.demand[0], s - 1, w - piece.demand[1]
        yield out


def _pack(it: Iterator[pa.RecordBatch], items_of: Callable, lim: Limits) -> Iterator[pa.RecordBatch]:
    base, count = TaskContext.get().partitionId() << 40, 0
    pending: list[Item] = []
    rows: list[tuple] = []
    size = 0

    def add(pieces: list[Item]) -> None:
        nonlocal count, size
        at = 0
        for p in pieces:
            n, w = p.demand
            rows.append((p.doc, p.start, n, p.ids.astype("<u4").tobytes(), p.total, base + count, at, w))
            at += n
            size += 4 * n + 64
        count += 1

    def flush() -> pa.RecordBatch:
        nonlocal rows, size
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
        rows, size = [], 0
        return out

    for batch in it:
        for item in items_of(batch):
            while item.demand[0] > lim.tokens or item.demand[1] > lim.loss_tokens:
                full, item = item.split(max(1, item.fitting(lim.tokens, lim.loss_tokens)))
                if len(full.ids) == lim.tokens:
                    add([full])
                else:
                    pending.append(full)
                if size > 4 << 20:
                    yield flush()
            pending.append(item)
            if len(pending) >= lim.cell:
                for seq in pack_cell(pending, lim):
                    add(seq)
                pending = []
            if size > 4 << 20:
                yield flush()
    for seq in pack_cell(pending, lim):
        add(seq)
        if size > 4 << 20:
            yield flush()
    if rows:
        yield flush()


def _check(lim: Limits) -> Limits:
    if min(lim.tokens, lim.segments, lim.loss_tokens, lim.cell) < 1:
        raise ValueError("every limit is at least 1")
    return lim


def pack_examples(df: DataFrame, doc_id: str, ids: str, mask: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Pieces of examples given as token ids and, if there is one, a 0/1 loss mask of the same length."""
    lim = _check(limits)

    def items_of(batch: pa.RecordBatch) -> Iterator[Item]:
        docs, lists = batch.column(0).to_pylist(), batch.column(1)
        masks = batch.column(2) if mask else [None] * len(docs)
        for d, x, m in zip(docs, lists, masks, strict=True):
            own = np.array(x.as_py() or [], np.int64) if x is not None else np.zeros(0, np.int64)
            if not len(own):
                continue
            bits = m.as_py() if m is not None else None
            bits = np.ones(len(own), np.int64) if bits is None else np.array(bits, np.int64)
            if len(bits) != len(own):
                raise ValueError(f"document {d}: the mask has {len(bits)} entries for {len(own)} ids")
            yield Item(d, own, 0, len(own), np.concatenate([[0], np.cumsum(bits)]))

    columns = [doc_id, ids] + ([mask] if mask else [])
    return df.select(*columns).mapInArrow(lambda it: _pack(it, items_of, lim), SCHEMA)


# --- tokens of documents ---------------------------------------------------------------------


#: So many blanks in a row are more than the rank encoder's stack may hold.
LONG_BLANKS = 100_000
_BLANKS = re.compile(rf"\s{{{LONG_BLANKS}}}")


def byte_level_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of a byte-level BPE file, without special tokens added.

    Where the file's ids follow its merges (checked here), ranks say all that the merges say, and the
    several times faster rank encoder gives the same ids; texts that hold a special token's string or very many
    blanks in a row, and files of another kind, go to the file's own library.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def plain(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
    vocab = model.get("vocab", {})
    usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    if not usual or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return plain
    import public_tokenizers
    import tiktoken

    # The printable stand-ins of bytes in such files: printable Latin-1 as itself, the rest from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    specials = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in tok): i for tok, i in vocab.items() if tok not in specials}
    fast = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def rank_encoder_fails(t: str) -> bool:
        return any(s in t for s in specials) or (len(t) >= LONG_BLANKS and _BLANKS.search(t) is not None)

    def encode(texts: list[str]) -> list[list[int]]:
        return [plain([t])[0] if rank_encoder_fails(t) else fast.encode_ordinary(t) for t in texts]

    return encode


_encoders: dict[str, Callable] = {}


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    limits: Limits = Limits(),
) -> DataFrame:
    """Pieces of whole documents: ids of the text, then ``end_id``; every token bears loss.

    ``tokenizer`` is the path of a byte-level BPE file that every worker can read.
    """
    lim = _check(limits)

    def items_of(batch: pa.RecordBatch) -> Iterator[Item]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = byte_level_encoder(tokenizer)
        docs, texts = batch.column(0).to_pylist(), text_column(batch, text)
        for i in range(0, len(docs), 64):
            for d, ids in zip(docs[i : i + 64], _encoders[tokenizer](texts[i : i + 64].to_pylist()), strict=True):
                ids.append(end_id)
                own = np.array(ids, np.uint32)
                yield Item(d, own, 0, len(own), np.arange(len(own) + 1))

    return df.select(doc_id, text).mapInArrow(lambda it: _pack(it, items_of, lim), SCHEMA)
