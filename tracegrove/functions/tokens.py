"""Array expressions over token ids, masks and log-probabilities. Nothing here shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bind, last_index

# Length limits.
TOKEN_LIMIT = 8192
TAIL_TOKENS = 48

# Divergence buckets, lower bound and label.
DIVERGENCE_BUCKETS = [
    (0, "0000-0127"),
    (128, "0128-0511"),
    (512, "0512-1023"),
    (1024, "1024-2047"),
    (2048, "2048-4095"),
    (4096, "4096+"),
]


def array_sum(arr: Column, kind: str = "double") -> Column:
    return F.aggregate(arr, F.lit(0).cast(kind), lambda acc, x: acc + x.cast(kind))


def fill(value: int, n: Column) -> Column:
    """``n`` mask entries of one value."""
    return F.array_repeat(F.lit(value).cast("tinyint"), F.greatest(n, F.lit(0)).cast("int"))


def trained_count(mask: Column) -> Column:
    return array_sum(mask, "bigint")


def has_trained_token(mask: Column) -> Column:
    return F.exists(mask, lambda m: m != 0)


def pick(values: Column, mask: Column) -> Column:
    """Values at trained positions."""
    pairs = F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda p: p["m"] != 0)
    return F.transform(pairs, lambda p: p["v"])


def example(prompt_ids: Column, completion_ids: Column, limit: int = TOKEN_LIMIT) -> tuple[Column, Column]:
    """(tokens, mask) of prompt + completion, cut on the right at ``limit``."""
    tokens = F.slice(F.concat(prompt_ids, completion_ids), 1, limit)
    mask = F.concat(fill(0, F.size(prompt_ids)), fill(1, F.size(completion_ids)))
    return tokens, F.slice(mask, 1, limit)


def keep_head_and_tail(arr: Column, limit: int = TOKEN_LIMIT, tail: int = TAIL_TOKENS) -> Column:
    """Cut the middle of an array longer than ``limit`` and keep its last ``tail`` entries."""
    head = max(1, limit - tail)
    cut = F.concat(F.slice(arr, 1, head), F.slice(arr, -tail, tail))
    return F.when(F.size(arr) > limit, cut).otherwise(arr)


def shift_for_training(
    tokens: Column, mask: Column, weight: Column, sign: Column
) -> tuple[Column, Column, Column]:
    """(inputs, targets, weights): each token predicts the next one."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    factor = weight.cast("double") * sign.cast("double")
    trained = F.slice(mask, F.lit(2), n)
    weights = bind(factor, lambda w: F.transform(trained, lambda m: w * m.cast("double")))
    return F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), weights


def segments(tokens: Column, mask: Column) -> Column:
    """Runs of equal mask values as array<struct(type, pos, tokens)>; in-row, no explode."""
    n = F.size(tokens)
    indices = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(indices, lambda i: (i == 0) | (F.get(mask, i) != F.get(mask, i - 1)))

    def runs(at: Column) -> Column:
        ends = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(n))
        return F.transform(F.arrays_zip(at.alias("lo"), F.slice(ends, F.lit(1), F.size(at)).alias("hi")), run)

    def run(r: Column) -> Column:
        kind = F.when(F.get(mask, r["lo"]) == 1, "unmasked").otherwise("masked")
        piece = F.slice(tokens, r["lo"] + 1, r["hi"] - r["lo"])
        return F.struct(kind.alias("type"), r["lo"].alias("pos"), piece.alias("tokens"))

    return bind(starts, runs)


def tokens_and_mask(sorted_segments: Column) -> tuple[Column, Column]:
    """Inverse of :func:`segments`; an unknown segment type is an error."""
    tokens = F.flatten(F.transform(sorted_segments, lambda s: s["tokens"]))
    mask = F.flatten(
        F.transform(
            sorted_segments,
            lambda s: F.when(s["type"] == "masked", fill(0, F.size(s["tokens"])))
            .when(s["type"] == "unmasked", fill(1, F.size(s["tokens"])))
            .otherwise(F.raise_error(F.concat(F.lit("unknown segment type: "), s["type"]))),
        )
    )
    return tokens, mask


def first_divergence(gold: Column, other: Column) -> Column:
    """0-based index of the first difference, or the shorter length when there is none."""
    n = F.least(F.size(gold), F.size(other))
    differs = F.zip_with(F.slice(gold, F.lit(1), n), F.slice(other, F.lit(1), n), lambda a, b: a != b)
    at = F.array_position(differs, True).cast("int")
    return F.when(at > 0, at - 1).otherwise(n)


def divergence_bucket(d: Column) -> Column:
    label = F.lit(DIVERGENCE_BUCKETS[0][1])
    for low, name in DIVERGENCE_BUCKETS[1:]:
        label = F.when(d >= low, F.lit(name)).otherwise(label)
    return label


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; two empty sets count as equal."""
    union = F.size(F.array_union(a, b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide(shared.cast("double"), union))


def perplexity(logp: Column, mask: Column) -> Column:
    """exp of the mean negative log-probability of trained tokens; infinite when none."""
    mean = bind(pick(logp, mask), lambda x: F.try_divide(array_sum(x), F.size(x)))
    return F.coalesce(F.exp(-mean), F.lit(float("inf")))


def sampled_logprob(candidates: Column, token_id: Column) -> Column:
    """Log-probability of the sampled token out of a map token id -> value.

    A map with a single entry stands for the token whatever its key; missing gives 0.0.
    """
    only = F.when(F.size(candidates) == 1, F.get(F.map_values(candidates), F.lit(0)))
    return F.coalesce(F.try_element_at(candidates, token_id.cast("string")), only, F.lit(0.0))


def mean_old_logp(old_logp: Column) -> Column:
    """Mean over the whole list, prompt zeros included; 0.0 for a missing or empty list."""
    return F.coalesce(F.try_divide(array_sum(old_logp), F.size(old_logp)), F.lit(0.0))


def mean_old_logp_scalar(total: Column, completion_ids: Column) -> Column:
    """Twin of :func:`mean_old_logp` for logs that hold one summed value per row."""
    n = F.greatest(F.coalesce(F.size(completion_ids), F.lit(0)), F.lit(1))
    return F.coalesce(total / n, F.lit(0.0))


def mean_trained_logp(logp: Column, mask: Column) -> Column:
    """Sum over trained tokens divided by their number, at least 1."""
    return bind(pick(logp, mask), lambda x: array_sum(x) / F.greatest(F.size(x), F.lit(1)))


def preference_loss(chosen: Column, rejected: Column, beta: float = 2.0, gamma: float = 0.5) -> Column:
    """-log sigmoid of the scaled margin between two mean log-probabilities."""
    x = (chosen - rejected) * beta - gamma
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sequence_ratio_objective(
    new_logp: Column,
    old_logp: Column,
    mask: Column,
    advantage: Column,
    *,
    eps_low: float,
    eps_high: float,
    clamp: float = 20.0,
) -> Column:
    """Clipped sequence-level policy ratio times advantage (the smaller of both variants)."""
    diff = F.zip_with(new_logp, old_logp, lambda a, b: a - b)
    mean = F.least(F.greatest(mean_trained_logp(diff, mask), F.lit(-clamp)), F.lit(clamp))

    def smaller(v: Column) -> Column:
        clipped = F.least(F.greatest(v["ratio"], F.lit(1.0 - eps_low)), F.lit(1.0 + eps_high))
        return F.least(v["ratio"] * v["adv"], clipped * v["adv"])

    return bind(F.struct(F.exp(mean).alias("ratio"), advantage.alias("adv")), smaller)


def align_old_logp(old_logp: Column, tokens: Column) -> Column:
    """Drop the first entry when the list is as long as the tokens, else cut to n - 1."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.when(F.size(old_logp) == F.size(tokens), F.slice(old_logp, F.lit(2), n)).otherwise(
        F.slice(old_logp, F.lit(1), n)
    )


def char_offsets(pieces: Column) -> Column:
    """array<struct(lo, hi)> of pieces joined by single spaces."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        span = F.struct(state["at"].alias("lo"), end.alias("hi"))
        return F.struct((end + 1).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def answer_span(text: Column) -> Column:
    """struct(lo, hi): characters from the thinking end (or the box) to the box's ``}``."""

    def around(box: Column) -> Column:
        marker = last_index(F.substring(text, F.lit(1), F.greatest(box, F.lit(0))), "</think>")
        offset = F.instr(F.substring(text, box + 1, F.length(text)), "}")
        lo = F.when(marker >= 0, marker).otherwise(box)
        hi = F.when(offset > 0, box + offset).otherwise(F.length(text))
        return F.when(box >= 0, F.struct(lo.alias("lo"), hi.alias("hi")))

    return bind(last_index(text, "\\boxed{"), around)


def weight_answer_span(
    weights: Column, offsets: Column, text: Column, factor: float = 2.0, fallback_tail: int = 64
) -> Column:
    """Multiply positive weights inside the answer span by ``factor`` (1.0 at least).

    The span covers all positions from the first to the last token that overlaps it; when a
    box exists but no token overlaps, the last ``fallback_tail`` tokens count instead.
    """

    def overlapping(span: Column) -> Column:
        marks = F.transform(offsets, lambda o, i: F.when((o["hi"] > span["lo"]) & (o["lo"] < span["hi"]), i))
        return F.filter(marks, lambda i: i.isNotNull())

    def bounds(hits: Column) -> Column:
        n = F.size(offsets)
        first = F.coalesce(F.array_min(hits), F.greatest(n - fallback_tail, F.lit(0)))
        return F.struct(first.alias("first"), F.coalesce(F.array_max(hits), n - 1).alias("last"))

    def scaled(b: Column) -> Column:
        return F.transform(
            weights,
            lambda w, i: F.when((i >= b["first"]) & (i <= b["last"]) & (w > 0), F.greatest(F.lit(1.0), w * factor)).otherwise(w),
        )

    return bind(
        answer_span(text),
        lambda span: F.when(span.isNull(), weights).otherwise(bind(bind(overlapping(span), bounds), scaled)),
    )


def hf_tokenizer(path: str):
    """Arrow-batched text -> token ids with a tokenizer file every worker can read.

    One tokenizer per Python worker; whole texts, no special tokens.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        for texts in batches:
            encoded = tok.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([e.ids for e in encoded])

    return encode


def split_tokenizer(text: Column) -> Column:
    """Built-in stand-in tokenizer: pieces between single spaces."""
    return F.split(text, " ")
