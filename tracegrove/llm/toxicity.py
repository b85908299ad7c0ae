"""Toxic passages as maximum-scoring segments.

From labelled documents every token (a word, and apart from it the word's first four bytes) gets the
log-odds of the toxic class with an informative Dirichlet prior from both classes' frequencies, and
its z-score; frequencies are numbers of distinct texts, so neither copies nor repetition weigh more. Tokens beyond ``z_min`` keep their log-odds; every other word scores ``-drift``, so that
expected scores are negative. A linear-time scan finds all maximal scoring segments of a document; only
words of positive score cost a step, the rest is a running sum.

A segment's score becomes an expected number of chance hits of that score, K n exp(-lambda S): lambda
solves the score distribution of the non-toxic class, K is fitted to that class's best segments. Segments
of p-value 0.05 or less are the toxic passages. A document's score is a logistic calibration, on the
training documents, of its best and its summed normalised segment scores.

Training takes at most ``max_labels`` labelled rows, drawn by a hash of the id, and the model keeps at
most ``max_tokens`` tokens, the most significant ones; scoring reads every text whole, where it is read.

Defined cases: a null or empty text scores as one without hits; null labels and labels without a document
teach nothing, and several labels of one id count as toxic if one is; without both classes every score is
0; repeated rows are rows of their own; an empty table gives an empty result; a kept column
named like a result column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, buffers, runs, settle, signed, span_hashes, text_column, uniform, with_fields, word_spans

PREFIX = 4
PASSAGE = "array<struct<from_char:int,to_char:int,score:double,p_value:double>>"
_PASSAGE = pa.list_(pa.struct([("from_char", pa.int32()), ("to_char", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))


@dataclass(frozen=True)
class ToxicModel:
    tokens: np.ndarray
    score: np.ndarray
    drift: float
    lam: float
    log_k: float
    weights: np.ndarray


def word_tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans, each text's first word, and per word the hash of it and of its prefix (told apart)."""
    start, end, first = word_spans(raw, off, ALNUM)
    whole = span_hashes(raw, start, end) | np.uint64(1)
    prefix = span_hashes(raw, start, np.minimum(end, start + PREFIX)) & ~np.uint64(1)
    return start, end, first, signed(whole), signed(prefix)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of either class each token is."""
    for batch in it:
        texts, toxic = text_column(batch, "text"), batch.column(1).to_numpy(zero_copy_only=False)
        for i, j in runs(texts, 8 << 20):
            _, _, first, whole, prefix = word_tokens(*buffers(texts[i:j]))
            for mark in (0, 1):
                own = [np.unique(np.concatenate([whole[first[d] : first[d + 1]], prefix[first[d] : first[d + 1]]])) for d in np.flatnonzero(toxic[i:j] == mark)]
                if own:
                    token, n = np.unique(np.concatenate(own), return_counts=True)
                    zero = np.zeros_like(n)
                    columns = [token, zero, n] if mark else [token, n, zero]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "n", "toxic"])


def segments(score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text.

    ``score`` is NaN for words without one, which count ``-drift``.
    """
    s = np.where(np.isnan(score), -drift, score)
    total = np.cumsum(s)
    found: list[list] = []  # first, last, sum before, sum at the end
    for k in np.flatnonzero(s > 0):
        seg = [k, k, total[k] - s[k], total[k]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= seg[2]:
                j -= 1
            if j < 0 or found[j][3] >= seg[3]:
                found.append(seg)
                break
            seg = [found[j][0], seg[1], found[j][2], seg[3]]
            del found[j:]
    return [(int(a), int(b), float(r - left)) for a, b, left, r in found]


def _scan(batch: pa.RecordBatch, text: str, tokens: np.ndarray, value: np.ndarray, drift: float) -> Iterator[tuple]:
    """Of every text: bytes, word spans and segments."""
    texts = text_column(batch, text)
    for i, j in runs(texts):
        raw, off = buffers(texts[i:j])
        start, end, first, whole, prefix = word_tokens(raw, off)
        score = np.full(len(start), np.nan)
        if len(tokens):
            for h in (prefix, whole):  # a word's own score goes before its prefix's
                at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                score = np.where(tokens[at] == h, value[at], score)
        hit = np.flatnonzero(score > 0)
        has = np.searchsorted(hit, first)
        for d in range(j - i):
            a, b = first[d], first[d + 1]
            segs = segments(score[a:b], drift) if has[d] < has[d + 1] else []
            yield raw[off[d] : off[d + 1]], start[a:b] - off[d], end[a:b] - off[d], segs


def features(n_words: int, segs: list, lam: float, log_k: float) -> tuple[float, float]:
    """Best segment in units of chance (0: as good as expected by chance) and the sum of all."""
    chance = log_k + np.log(max(1, n_words))
    scores = [lam * s for _, _, s in segs]
    return max(0.0, max(scores, default=0.0) - chance), float(np.log1p(sum(scores)))


def _measure(state) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, value, drift = state.value
        for batch in it:
            seen = [(len(s), max((x[2] for x in segs), default=0.0), sum(x[2] for x in segs)) for _, s, _, segs in _scan(batch, "text", tokens, value, drift)]
            n, best, total = zip(*seen, strict=True) if seen else ((), (), ())
            yield pa.RecordBatch.from_pydict(
                {"toxic": batch.column(1).cast(pa.int32()), "n": pa.array(n, pa.int32()), "best": pa.array(best, pa.float64()), "total": pa.array(total, pa.float64())}
            )

    return run


def _solve_lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, for a distribution of negative mean."""
    lo, hi = 1e-6, 1.0
    value = lambda x: float((p * np.exp(np.minimum(x * s, 500.0))).sum()) - 1.0
    while value(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)) / 100, x.T @ (y - p) - ridge * len(x) * w / 100)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    max_labels: int = 100_000,
    max_tokens: int = 1 << 17,
    z_min: float = 4.0,
    prior: float = 0.1,
    drift: float = 0.1,
) -> ToxicModel:
    """The model of the labelled documents; ``prior``: the prior's weight as a part of the tokens seen."""
    spark = docs.sparkSession
    known = labels.filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    known = known.agg(F.max((F.col(toxic) > 0).cast("int")).alias("toxic"))
    n = known.count()
    drawn = known.filter(uniform(F.lit(29), F.col("doc_id")) < max_labels / max(1, n))
    # Broadcasts of at most about max_labels narrow rows. Of equal texts one teaches.
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = given.join(F.broadcast(drawn), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    chosen = settle(named.select("doc_id", "toxic"))
    rows = given.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    counts = rows.mapInArrow(_count, "token long, n long, toxic long").groupBy("token").agg(F.sum("n").alias("y0"), F.sum("toxic").alias("y1"))
    # A token needs some evidence to be significant: rare ones only add to the totals.
    sums = counts.agg(F.sum("y0").alias("n0"), F.sum("y1").alias("n1"))
    n0, n1 = (float(v or 0) for v in sums.first())
    empty = ToxicModel(np.zeros(0, np.int64), np.zeros(0), drift, 1.0, 0.0, np.zeros(3))
    if not n0 or not n1:
        return empty
    a0 = prior * (n0 + n1)
    alpha = F.lit(prior) * (F.col("y0") + F.col("y1"))
    odds = [F.log((F.col(y) + alpha) / (F.lit(t + a0) - F.col(y) - alpha)) for y, t in (("y1", n1), ("y0", n0))]
    delta, var = odds[0] - odds[1], 1 / (F.col("y1") + alpha) + 1 / (F.col("y0") + alpha)
    scored = counts.withColumns({"delta": delta, "z": F.abs(delta) / F.sqrt(var)}).filter(F.col("z") >= z_min)
    top = scored.orderBy(F.col("z").desc(), "token").limit(max_tokens).toPandas().sort_values("token")
    tokens, value = top["token"].to_numpy(np.int64), top["delta"].to_numpy(float)
    seen = rows.mapInArrow(_measure(spark.sparkContext.broadcast((tokens, value, drift))), "toxic int, n int, best double, total double").toPandas()
    y = seen["toxic"].to_numpy(float)
    p = np.append(top["y0"].to_numpy(float) / n0, 0.0)
    p[-1] = max(0.0, 1.0 - p.sum())
    s = np.append(value, -drift)
    lam = _solve_lambda(p, s) if (p * s).sum() < 0 and (s > 0).any() else 1.0
    clean = seen[(seen["toxic"] == 0) & (seen["best"] > 0)]
    # Gumbel: the mean of lambda S - ln n over the non-toxic class is ln K plus Euler's constant.
    log_k = float((lam * clean["best"] - np.log(clean["n"].clip(lower=1))).mean() - np.euler_gamma) if len(clean) else 0.0
    chance = log_k + np.log(seen["n"].clip(lower=1).to_numpy(float))
    x = np.column_stack([np.maximum(0.0, lam * seen["best"].to_numpy() - chance), np.log1p(lam * seen["total"].to_numpy())])
    return ToxicModel(tokens, value, drift, lam, log_k, _logistic(x, y))


def _detect(state, keep: int, level: float) -> object:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicModel = state.value
        for batch in it:
            scores, passages = [], []
            for raw, start, end, segs in _scan(batch, "__text", m.tokens, m.score, m.drift):
                a, b = features(len(start), segs, m.lam, m.log_k)
                z = m.weights[0] + m.weights[1] * a + m.weights[2] * b
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) if m.weights.any() else 0.0)
                chars = np.cumsum((raw & 0xC0) != 0x80) if segs else raw
                own = []
                for i, j, s in segs:
                    p = -np.expm1(-np.exp(min(50.0, m.log_k + np.log(len(start)) - m.lam * s)))
                    if p <= level:
                        own.append({"from_char": int(chars[start[i]]) - 1, "to_char": int(chars[end[j] - 1]), "score": s, "p_value": float(p)})
                passages.append(own)
            columns = [batch.column(k) for k in range(keep)] + [pa.array(scores, pa.float64()), pa.array(passages, _PASSAGE)]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[k] for k in range(keep)] + ["score", "passages"])

    return run


def detect(docs: DataFrame, model: ToxicModel, keep: list[str], text: str = "text", level: float = 0.05) -> DataFrame:
    """``keep``, ``score`` and ``passages`` (from_char, to_char, score, p-value)."""
    state = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("score", "passages")]
    schema = with_fields(docs.select(*keep), f"score double, passages {PASSAGE}")
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(_detect(state, len(keep), level), schema)
