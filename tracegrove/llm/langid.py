"""Language identification by mixture inference.

A language's model is a smoothed distribution of byte trigrams (letters, with ASCII case folded; anything
else counts as a blank), counted over every training text. A word's likelihood in a language is that of
its trigrams, blanks at both ends included. Expectation-maximisation over a document's words estimates in
which proportions it mixes the languages. Of the nested sets of its strongest languages the one with the
best likelihood less a penalty (half the logarithm of the number of words for each further proportion)
is its language set.

``spoken`` also lets the mixture say whether a text is in any language: it compares the likelihood of the
words under the chosen set, per letter, with a limit: that of its languages, by their proportions, for
texts of about that many words. A language's limit lies below the 1 % quantile of its labelled rows by as
much as that is below their median. What is below its limit is in no language.

The model has at most 2^21 trigrams a language, whatever the corpus; it is collected and broadcast.
Documents are scored where they are read; nothing else is shuffled.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and no languages, and so is
every text if there is nothing to learn from; rows with a null text or language teach nothing; equal
proportions go to the language that comes first; a text's result does not depend on its neighbours, so
not on partitions; texts of any length are read whole; repeated rows are
rows of their own; an empty table gives an empty result; other columns are kept where ``keep`` names them,
unless they are named like a result column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, buffers, runs, text_column, with_fields, word_spans

UNKNOWN = "und"
GRAMS = 1 << 21
#: Bytes of text scored together, and rows sent on together.
RUN, SENT = 1 << 18, 1024
#: Steps of an estimate at most, and the change of a proportion that ends it.
STEPS, STILL = 12, 1e-6
# 0 blank, 1..26 letters, 32..95 bytes beyond ASCII (continuation and lead bytes by their low six bits).
_CLASS = np.zeros(256, np.int32)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 32 + (np.arange(128) & 63)


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram at every byte (the byte and both neighbours) of the texts; where it is a letter."""
    c = _CLASS[raw]
    left, right = np.zeros_like(c), np.zeros_like(c)
    left[1:], right[:-1] = c[:-1], c[1:]
    inner = off[(off > 0) & (off < len(c))]
    left[inner], right[inner - 1] = 0, 0
    return (left << 14) | (c << 7) | right, c > 0


@dataclass(frozen=True)
class LanguageModel:
    """``place``: row of each trigram in ``logp`` (the last row is that of unseen ones)."""

    languages: list[str]
    codes: np.ndarray
    logp: np.ndarray


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        parts = [(lang, np.flatnonzero(n), n) for lang, n in held.items()]
        out = pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang for lang, at, _ in parts for _ in range(len(at))], pa.string()),
                "code": pa.array(np.concatenate([at for _, at, _ in parts]), pa.int32()),
                "n": pa.array(np.concatenate([n[at] for _, at, n in parts]), pa.int64()),
            }
        )
        held.clear()
        return out

    for batch in it:
        texts, langs = text_column(batch, "text"), np.array(batch.column(1).to_pylist(), object)
        for i, j in runs(texts):
            raw, off = buffers(texts[i:j])
            code, letter = grams(raw, off)
            own = np.repeat(langs[i:j], np.diff(off))
            for lang in set(langs[i:j]):
                at = letter & (own == lang)
                if lang not in held:
                    if len(held) == 16:
                        yield flush()
                    held[lang] = np.zeros(GRAMS, np.int64)
                held[lang] += np.bincount(code[at], minlength=GRAMS)
    if held:
        yield flush()


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", smooth: float = 0.5) -> LanguageModel:
    """The model of all rows with a text and a language."""
    known = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    got = known.mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got["lang"].unique())
    codes = np.unique(got["code"].to_numpy(np.int64)) if names else np.zeros(0, np.int64)
    counts = np.zeros((len(codes) + 1, len(names)))
    if names:
        counts[np.searchsorted(codes, got["code"]), np.searchsorted(names, got["lang"])] = got["n"]
    counts += smooth
    return LanguageModel(names, codes, np.log(counts / counts.sum(axis=0)))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's stretch of ``values``, 0 where it has none; each for itself, so that what stands
    before it makes no difference."""
    out = np.zeros((len(first) - 1, *values.shape[1:]))
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0)
    return out


def mixture(word: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of every text, given its words' log-likelihoods per language and
    the languages it may mix. A text whose proportions stand still takes no further step."""
    n = np.diff(first)
    top = word.max(axis=1, keepdims=True, initial=-np.inf)
    like = np.exp(np.maximum(word - top, -60.0))
    share = allowed / np.maximum(1, allowed.sum(axis=1, keepdims=True))
    going, part_like, part_first = np.flatnonzero(n > 0), like, np.concatenate([[0], np.cumsum(n[n > 0])])
    for step in range(STEPS):
        if not len(going):
            break
        part = part_like * np.repeat(share[going], np.diff(part_first), axis=0)
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        new = sums(part, part_first) / np.diff(part_first)[:, None]
        moved = np.abs(new - share[going]).max(axis=1) > STILL
        share[going] = new
        if step + 1 < STEPS and not moved.all():
            keep = np.repeat(moved, np.diff(part_first))
            part_like, part_first = part_like[keep], np.concatenate([[0], np.cumsum(np.diff(part_first)[moved])])
            going = going[moved]
    mixed = np.log(np.maximum((like * np.repeat(share, n, axis=0)).sum(axis=1), 1e-300)) + top[:, 0]
    return share, sums(mixed, first)


def choose(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's proportions over its chosen language set, and its log-likelihood."""
    n = np.diff(first)
    docs, langs = len(n), word.shape[1]
    full, _ = mixture(word, first, np.ones((docs, langs)))
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(langs)[None, :], axis=1)
    # One language has all of a text; there is nothing to estimate.
    best = (rank < 1).astype(float)
    own = np.take_along_axis(word, np.repeat(order[:, :1], n, axis=0), axis=1)[:, 0]
    top = word.max(axis=1, initial=-np.inf)
    likely = sums(np.maximum(own, top - 60.0), first)
    value = likely.copy()
    # A language that explains less than one word of a text cannot pay its penalty there.
    most = np.maximum(1, (full * np.maximum(1, n)[:, None] >= 1).sum(axis=1))
    for size in range(2, langs + 1):
        some = np.flatnonzero((most >= size) & (n > 0))
        if not len(some):
            break
        mine = np.zeros(docs, bool)
        mine[some] = True
        share, like = mixture(word[np.repeat(mine, n)], np.concatenate([[0], np.cumsum(n[some])]), (rank[some] < size).astype(float))
        score = like - 0.5 * (size - 1) * np.log(np.maximum(2, n[some]))
        better = score > value[some]
        at = some[better]
        best[at], value[at], likely[at] = share[better], score[better], like[better]
    return best, likely


def _sets(shares: np.ndarray, languages: list[str]) -> pa.Array:
    """Each text's languages by falling proportion, as a list of (lang, share)."""
    order = np.argsort(-shares, axis=1, kind="stable")
    value = np.take_along_axis(shares, order, axis=1)
    there = value > 0
    offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
    lang = pa.array(languages, pa.string()).take(pa.array(order[there], pa.int32()))
    pairs = pa.StructArray.from_arrays([lang, pa.array(value[there], pa.float64())], names=["lang", "share"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def _predict(state, keep: int, text: str, fits: bool) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = state.value
        row = np.full(GRAMS, len(model.codes), np.int32)
        row[model.codes] = np.arange(len(model.codes), dtype=np.int32)
        for batch in (b.slice(k, SENT) for b in it for k in range(0, b.num_rows, SENT)):
            texts = text_column(batch, text)
            letters = batch.column(keep).to_numpy(zero_copy_only=False).astype(bool)
            shares = np.zeros((len(texts), len(model.languages)))
            fit, n_words = np.full(len(texts), np.nan), np.zeros(len(texts), np.int64)
            if model.languages:
                for i, j in runs(texts, RUN):
                    raw, off = buffers(texts[i:j])
                    code, _ = grams(raw, off)
                    start, end, first = word_spans(raw, off, LETTERS)
                    if not len(start):
                        continue
                    # Every second stretch is a word.
                    ends = np.stack([start, end], axis=1).ravel()
                    each = np.concatenate([model.logp[row[code]], np.zeros((1, len(model.languages)))])
                    shares[i:j], like = choose(np.add.reduceat(each, ends, axis=0)[::2], first)
                    n_words[i:j] = np.diff(first)
                    # The choice between several languages costs likelihood that one language does not.
                    own = shares[i:j]
                    like -= np.diff(first) * (own * np.log(np.maximum(own, 1e-300))).sum(axis=1)
                    fit[i:j] = like / np.maximum(1, sums((end - start).astype(float), first))
            shares[~letters] = 0
            names = np.array([*model.languages, UNKNOWN], object)
            top = shares.max(axis=1, initial=0)
            pred = names[np.where(top > 0, shares.argmax(axis=1) if len(model.languages) else 0, -1)]
            columns = [batch.column(k) for k in range(keep)]
            columns += [pa.array(pred, pa.string()), pa.array(np.minimum(1.0, top), pa.float64()), _sets(shares, model.languages)]
            names = [batch.schema.names[k] for k in range(keep)] + ["lang_pred", "score", "languages"]
            if fits:
                columns += [pa.array(fit, pa.float64(), mask=n_words == 0), pa.array(n_words, pa.int64())]
                names += ["fit", "n_words"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


#: Result columns, which ``keep`` cannot name.
OWN = ("lang_pred", "score", "languages", "fit", "n_words")


def predict(rows: DataFrame, model: LanguageModel, keep: list[str], text: str = "text", fits: bool = False) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` (the proportion of it) and ``languages`` (set and proportions); with
    ``fits`` also ``fit`` (log-likelihood per letter) and ``n_words``."""
    state = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in (OWN if fits else OWN[:3])]
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    given = rows.select(*keep, has_letter.alias("__letters"), *([] if text in keep else [F.col(text).alias("__text")]))
    fields = "lang_pred string, score double, languages array<struct<lang:string,share:double>>" + (", fit double, n_words long" if fits else "")
    schema = with_fields(rows.select(*keep), fields)
    return given.mapInArrow(_predict(state, len(keep), text if text in keep else "__text", fits), schema)


def _size(n_words: Column) -> Column:
    """Texts of about the same number of words: by powers of two, from 2^10 on together."""
    return F.least(F.floor(F.log2(F.greatest(n_words, F.lit(1)))), F.lit(10)).cast("int")


def spoken(rows: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", few: int = 50) -> DataFrame:
    """``keep`` and ``lang_pred`` of the rows that are in a language. Fewer than ``few`` labelled rows of a
    language and size take the limit of their size, and those that of all. If no row teaches a language, rows
    with a letter stay, and their ``lang_pred`` is ``UNKNOWN``."""
    model = learn(rows, text, lang)
    if not model.languages:
        return rows.filter(F.col(text).rlike(r"\p{L}")).select(*keep, F.lit(UNKNOWN).alias("lang_pred"))
    # Texts are scored for the limits and again for the result: a score needs no other text, so both agree, and
    # to keep the texts in between would cost their size on disk.
    known = rows.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"))
    told = predict(known, model, [], fits=True).filter(F.col("lang_pred") != UNKNOWN).select("lang_pred", _size(F.col("n_words")).alias("size"), "fit")
    # A row for every language and size, then for every size, then for all.
    level = told.cube("lang_pred", "size").agg(F.percentile_approx("fit", [0.01, 0.5], 10_000).alias("q"), F.count("*").alias("n"))
    limits = {(r.lang_pred, r.size): (2 * r.q[0] - r.q[1], r.n) for r in level.collect()}
    overall = limits.get((None, None), (float("-inf"), 0))[0]

    def limit(name: str | None, size: int, other: float) -> float:
        value, n = limits.get((name, size), (other, 0))
        return value if n >= few else other

    table = [(size, {name: limit(name, size, limit(None, size, overall)) for name in model.languages}) for size in range(11)]
    limits_of = F.broadcast(rows.sparkSession.createDataFrame(table, "__size int, __limits map<string,double>"))
    kept = [c for c in keep if c not in OWN]
    out = predict(rows, model, kept, text, fits=True).filter(F.col("lang_pred") != UNKNOWN).withColumn("__size", _size(F.col("n_words")))
    least = F.aggregate("languages", F.lit(0.0), lambda total, x: total + x["share"] * F.try_element_at("__limits", x["lang"]))
    return out.join(limits_of, "__size").filter(F.col("fit") >= least).select(*kept, "lang_pred")
