"""Training-log analytics: losses, percentiles, policy ratios, schedules and samplers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions.hashing import counter_bits, counter_uniform
from ..functions.text import passes
from .ordering import last_per_key, position, row_bucket, shuffled_place, top_per_group
from .quantiles import linear_quantile
from .selection import largest
from .reports import rolled_up

# Limits of the example pickers.
INCLUSION_THRESHOLD = -0.69
RELAXED = ["cryptarithm_guess", "equation_numeric_guess"]
DEFAULT_COUNT = 10


# --- per-row log records ---------------------------------------------------------------------


def log_record(df: DataFrame) -> DataFrame:
    """Total loss, smallest log-probability and token count of each logged example."""
    chosen = K.pick(F.col("logprobs"), F.col("mask"))
    return (
        df.withColumn("num_loss_tokens", K.trained_count(F.col("mask")))
        .withColumn("total_loss", F.round(-K.array_sum(chosen), 4))
        .withColumn("min_logprob", F.round(F.coalesce(F.array_min(chosen), F.lit(0.0)), 4))
    )


def loss_per_token(log: DataFrame) -> DataFrame:
    """Loss per token by step and category, with a TOTAL row per step."""
    tokens = F.sum("num_loss_tokens")
    out = rolled_up(
        log,
        ["step"],
        "category",
        F.try_divide(F.sum("total_loss"), tokens).alias("loss_per_token"),
        tokens.alias("tokens"),
    )
    return out.filter(F.col("tokens") > 0)


def min_logprob_by_step(log: DataFrame) -> DataFrame:
    """Smallest log-probability by step and category; an example without tokens counts 0."""
    return log.groupBy("step", "category").agg(
        F.round(F.min(F.coalesce("min_logprob", F.lit(0.0))), 4).alias("min_logprob")
    )


def average_generated_logprob(tokens: Column, prompt_marker: float | None = -1.0) -> Column:
    """Mean log-probability of array<struct(token_id, logprob)>; prompt entries have none
    (or the marker) and are left out; NULL when nothing was generated."""
    made = F.filter(tokens, lambda t: _generated(t, prompt_marker))
    return F.try_divide(K.array_sum(F.transform(made, lambda t: t["logprob"])), F.size(made))


def _generated(t: Column, prompt_marker: float | None) -> Column:
    real = t["logprob"].isNotNull()
    return real if prompt_marker is None else real & (t["logprob"] != prompt_marker)


def split_raw_tokens(tokens: Column, prompt_marker: float | None = None) -> tuple[Column, Column]:
    """(prompt ids, generated ids) of array<struct(token_id, logprob)>."""
    prompt = F.filter(tokens, lambda t: ~_generated(t, prompt_marker))
    made = F.filter(tokens, lambda t: _generated(t, prompt_marker))
    return F.transform(prompt, lambda t: t["token_id"]), F.transform(made, lambda t: t["token_id"])


def min_logprob_of_maps(candidates: Column) -> Column:
    """Smallest value over the maps of all positions; NULL when there are none."""
    return F.array_min(F.flatten(F.transform(candidates, lambda m: F.map_values(m))))


# --- comparison of two log-probability lists -------------------------------------------------


def aligned(epoch: DataFrame, reference: DataFrame, masks: DataFrame) -> DataFrame:
    """Log-probabilities of an epoch, of the reference, and the mask shifted by one token."""
    return (
        epoch.select("problem_id", F.col("logprobs").alias("epoch_lp"))
        .join(reference.select("problem_id", F.col("logprobs").alias("ref_lp")), "problem_id")
        .join(masks.select("problem_id", "mask"), "problem_id")
        .withColumn("target_mask", F.slice("mask", F.lit(2), F.size("epoch_lp")))
    )


def comparison_metrics(
    df: DataFrame,
    *,
    branch: float = 0.01,
    cutoff: float = 1.0,
    clip_low: float = 0.2,
    clip_high: float = 0.2,
    beta: float = 0.05,
) -> DataFrame:
    """Per example: shares of tokens whose log-probability fell or rose (ties half each), the
    branch-weighted variants, policy-ratio means and clip shares, and the squared-difference
    penalty over all positions. Needs epoch_lp, ref_lp, target_mask."""
    all_pairs = F.zip_with("epoch_lp", "ref_lp", lambda a, b: F.struct(a.alias("e"), b.alias("r")))
    pairs = K.pick(all_pairs, F.col("target_mask"))
    base = df.withColumn("_p", pairs).withColumn("_n", F.size("_p"))
    p, n = F.col("_p"), F.col("_n")

    def total(value) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + value(x))

    def mean(value) -> Column:
        return F.try_divide(total(value), n)

    def flag(condition) -> Column:
        return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))

    def weight(x: Column) -> Column:
        return F.least(F.lit(1.0), F.abs(x["e"]) / branch)

    def down(x: Column, w: Column) -> Column:
        return F.when(x["e"] < x["r"], w).when(x["e"] == x["r"], w * 0.5).otherwise(F.lit(0.0))

    def up(x: Column, w: Column) -> Column:
        return F.when(x["e"] > x["r"], w).when(x["e"] == x["r"], w * 0.5).otherwise(F.lit(0.0))

    def ratio(x: Column) -> Column:
        return F.exp(F.least(x["e"] - x["r"], F.lit(20.0)))

    squares = F.zip_with("epoch_lp", "ref_lp", lambda a, b: (a - b) * (a - b))
    columns = {
        "logprob_decreased": mean(lambda x: down(x, F.lit(1.0))),
        "logprob_increased": mean(lambda x: up(x, F.lit(1.0))),
        "branch_mask_fraction": mean(lambda x: flag(F.abs(x["e"]) <= branch)),
        "avg_branch_weight": mean(weight),
        "weighted_logprob_decreased": F.try_divide(total(lambda x: down(x, weight(x))), total(weight)),
        "weighted_logprob_increased": F.try_divide(total(lambda x: up(x, weight(x))), total(weight)),
        "cutoff_avg_weight": F.when(n > 0, F.lit(cutoff)),
        "avg_weight": mean(lambda x: weight(x) * cutoff),
        "kl_per_token": mean(lambda x: x["e"] - x["r"]),
        "mean_importance_ratio": mean(ratio),
        "clip_fraction_low": mean(lambda x: flag(ratio(x) < 1 - clip_low)),
        "clip_fraction_high": mean(lambda x: flag(ratio(x) > 1 + clip_high)),
        "dro_penalty_per_token": F.try_divide(K.array_sum(squares) * beta * 0.5, F.size("epoch_lp")),
        "nll": -mean(lambda x: x["e"]),
    }
    return base.withColumns({k: F.round(v, 6) for k, v in columns.items()}).drop("_p", "_n")


def token_weighted_means(metrics: DataFrame, names: Sequence[str], weight: str) -> DataFrame:
    """(metric, mean): weighted mean of each metric over the examples that have it, rounded to
    6 places; for ``nll`` also the perplexity ``exp(min(nll, 20))``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    long = metrics.select(F.col(weight).cast("double").alias("w"), F.explode(pairs).alias("m")).select("w", "m.*")
    means = (
        long.filter(F.col("value").isNotNull())
        .groupBy("metric")
        .agg(F.try_divide(F.sum(F.col("value") * F.col("w")), F.sum("w")).alias("mean"))
        .filter(F.col("mean").isNotNull())
    )
    ppl = means.filter(F.col("metric") == "nll").select(
        F.lit("perplexity").alias("metric"), F.round(F.exp(F.least("mean", F.lit(20.0))), 4).alias("mean")
    )
    return means.withColumn("mean", F.round("mean", 6)).unionByName(ppl)


def token_differences(aligned_rows: DataFrame) -> DataFrame:
    """(diff, epoch_lp) of every trained token: the one place that explodes tokens."""
    pairs = F.zip_with("epoch_lp", "ref_lp", lambda a, b: F.struct((a - b).alias("diff"), a.alias("epoch_lp")))
    return aligned_rows.select(F.explode(K.pick(pairs, F.col("target_mask"))).alias("t")).select("t.*")


def branch_weight(logprob: Column, branch: float = 0.01) -> Column:
    return F.least(F.lit(1.0), F.abs(logprob) / branch)


def branch_cutoff_weights(
    advantages: Column, previous: Column, epoch: int, branch: float = 0.01, first_cutoff: float = 0.5
) -> Column:
    """Advantages scaled by branch weight and, in epoch 0, by the cutoff weight."""
    cutoff = first_cutoff if epoch == 0 else 1.0
    return F.zip_with(advantages, previous, lambda a, lp: a * branch_weight(lp, branch) * cutoff)


# --- step metrics ----------------------------------------------------------------------------


def fill_step_loss(metrics: DataFrame, log: DataFrame) -> DataFrame:
    """Step metrics with ``_loss_per_token`` computed from the summed loss where it is absent.

    ``metrics`` holds (epoch, step, metrics map<string, double>).
    """
    tokens = log.groupBy("epoch", "step").agg(F.sum("num_loss_tokens").alias("_tokens"))
    joined = metrics.join(tokens, ["epoch", "step"], "left")
    own = F.try_element_at("metrics", F.lit("_loss_per_token"))
    total = F.try_element_at("metrics", F.lit("fwd/loss:sum"))
    derived = F.when(F.col("_tokens") > 0, total / F.col("_tokens"))
    return joined.withColumn("loss_per_token", F.coalesce(own, derived)).drop("_tokens")


def metric_series(metrics: DataFrame, prefix: str) -> DataFrame:
    """Wide to long: (epoch, step, series, value) of all keys with a prefix."""
    long = metrics.select("epoch", "step", F.explode("metrics").alias("key", "value"))
    name = F.substring("key", len(prefix) + 1, 1 << 20)
    return long.filter(F.col("key").startswith(prefix)).select("epoch", "step", name.alias("series"), "value")


def group_robust_weights(losses: DataFrame, eta: float = 0.01, adjust: float = 0.0) -> DataFrame:
    """Final group weights of multiplicative updates renormalised after every step.

    ``losses``: (step, category, group_loss) of the groups present in a step. Normalising
    never changes proportions, so the end state is the softmax of eta * sum(loss - adjust).
    """
    sums = losses.groupBy("category").agg(F.sum(F.col("group_loss") - adjust).alias("_s"))
    everything = W.partitionBy()
    score = F.col("_s") * eta
    top = F.max(score).over(everything)
    sums = sums.select("category", F.exp(score - top).alias("_e"))
    return sums.select("category", (F.col("_e") / F.sum("_e").over(everything)).alias("group_weight"))


# --- example pickers -------------------------------------------------------------------------


def latest_per_problem(log: DataFrame, order: Sequence[str] = ("row_no",)) -> DataFrame:
    """Row of the largest step per problem; the earliest one among equal steps. Ids with a
    ``-`` are derived examples and left out."""
    base = log.filter(~F.col("problem_id").contains("-"))
    ranked = base.withColumns({f"_neg_{c}": -F.col(c) for c in order})
    return last_per_key(ranked, ["problem_id"], ["step", *[f"_neg_{c}" for c in order]]).select(*log.columns)


def _limit(counts: Mapping[str, int], default: int) -> Column:
    limit = F.lit(default)
    for category, n in counts.items():
        limit = F.when(F.col("category") == category, F.lit(n)).otherwise(limit)
    return limit


def _most(counts: Mapping[str, int], default: int) -> int:
    return max([default, *counts.values()])


def worst_examples(
    latest: DataFrame, counts: Mapping[str, int], default: int = DEFAULT_COUNT, tie: str = "row_no"
) -> DataFrame:
    """Examples with the smallest log-probabilities, a set number per category."""
    order = [F.asc("min_logprob"), F.asc(tie)]
    return top_per_group(latest, ["category"], order, _most(counts, default), limit=_limit(counts, default))


def recent_examples(
    latest: DataFrame,
    counts: Mapping[str, int],
    default: int = DEFAULT_COUNT,
    *,
    threshold: float = INCLUSION_THRESHOLD,
    relaxed: Sequence[str] = tuple(RELAXED),
    tie: str = "row_no",
) -> DataFrame:
    """Latest examples below the threshold; relaxed categories are topped up with others."""
    backfill = F.col("min_logprob") >= threshold
    rows = latest.withColumn("backfill", backfill).filter(~backfill | F.col("category").isin(list(relaxed)))
    order = [F.asc("backfill"), F.desc("step"), F.asc(tie)]
    return top_per_group(rows, ["category"], order, _most(counts, default), limit=_limit(counts, default))


# --- ordering and batching -------------------------------------------------------------------


def training_order(log: DataFrame, order: Sequence[str] = ("row_no",)) -> DataFrame:
    """(problem_id, first row number) of the ids logged in epoch 0."""
    return log.filter(F.col("epoch") == 0).groupBy("problem_id").agg(F.min(order[0]).alias("first_row"))


def replay_order(log: DataFrame, corpus: DataFrame) -> DataFrame:
    """Corpus rows of the logged ids with their place in training; a logged id without a
    corpus row fails the job."""
    logged = training_order(log).join(corpus.withColumn("_found", F.lit(True)), "problem_id", "left")
    message = F.concat(F.col("problem_id"), F.lit(" is missing in the corpus"))
    return logged.filter(passes(F.col("_found").isNull(), message)).drop("_found")


def seeded_order(df: DataFrame, seed: int, order: str = "row_no") -> DataFrame:
    """Rows with ``place``, their place from 0 in a shuffle drawn by the seed.

    The shuffle maps the rows' ranks, so places have no gaps and nothing is sorted by them.
    """
    placed = position(df, order=[order], bucket=[row_bucket(order)], name="_at", total="_n")
    return placed.withColumn("place", shuffled_place(F.col("_at") - 1, F.col("_n"), seed)).drop("_at", "_n")


def sequential_batches(
    df: DataFrame, batch_size: int, order: str = "row_no", epochs: float = 1.0, max_steps: int | None = None
) -> DataFrame:
    """Rows with their training step: full batches in order, a single pass at most.

    The step count is ``round(epochs * (n div size))``, at least 1 and at most one pass.
    """
    placed = position(df, order=[order], bucket=[row_bucket(order)], name="_at", total="_n")
    full = F.floor(F.col("_n") / F.lit(batch_size))
    steps = F.greatest(F.lit(1), F.bround(F.lit(epochs) * full, 0).cast("bigint"))
    if max_steps is not None:
        steps = F.least(steps, F.lit(max_steps))
    step = F.floor((F.col("_at") - 1) / F.lit(batch_size))
    return placed.withColumn("step", step).filter(step < F.least(steps, full)).drop("_at", "_n")


def stratified_batches(df: DataFrame, batch_size: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """Deal rows over batches so that sizes, and each category's counts, differ by one at most.

    Rows are ranked by (category, draw), the draws hashing seed and ``keys``, and dealt round robin. ``batch`` and
    ``place``, the place in the batch, are drawn by bijections of the dealing order: no further exchange.
    """
    drawn = df.withColumn("_h", counter_bits(seed, *[F.col(k) for k in keys]))
    slot = F.shiftright("_h", 40)
    placed = position(drawn, order=["category", "_h", *keys], bucket=[F.col("category"), slot], name="_at", total="_n")
    n_batches = F.ceil(F.col("_n") / F.lit(batch_size))
    turn, full = F.pmod(F.col("_at") - 1, n_batches), F.floor(F.col("_n") / n_batches)
    size = full + F.when(turn < F.pmod(F.col("_n"), n_batches), F.lit(1)).otherwise(F.lit(0))
    dealt = placed.withColumn("batch", shuffled_place(turn, n_batches, seed))
    return dealt.withColumn("place", shuffled_place(F.floor((F.col("_at") - 1) / n_batches), size, seed + 1)).drop("_h", "_at", "_n")


def annealed_probabilities(df: DataFrame, difficulty: str, progress: float, t0: float, t1: float) -> DataFrame:
    """Add the z-score of the difficulty and the sampling probability at a training progress."""
    temperature = max(t0 + (t1 - t0) * progress, 1e-3)
    stats = df.agg(
        F.struct(F.avg(difficulty).alias("mean"), F.stddev_pop(difficulty).alias("std"), F.min(difficulty).alias("low"))
    ).scalar()
    z = (F.col(difficulty) - stats["mean"]) / (stats["std"] + 1e-6)
    z_low = (stats["low"] - stats["mean"]) / (stats["std"] + 1e-6)
    scored = df.withColumn("z", z).withColumn("_e", F.exp((z_low - z) / temperature))
    norm = scored.agg(F.sum("_e")).scalar()
    return scored.withColumn("probability", F.col("_e") / norm).drop("_e")


def weighted_sample(df: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """``n`` rows without replacement, chance by ``probability``: the largest of log(p) plus Gumbel noise.

    The noise hashes seed and keys, so a row's luck does not depend on the others. The n-th largest value is
    found by counts and the rows are filtered by it. A probability of zero comes last.
    """
    noise = -F.log(-F.log(counter_uniform(seed, *[F.col(k) for k in keys])))
    return largest(df, F.log("probability") + noise, n, keys)


def review_state(log: DataFrame, *, loss: str = "loss", decay: float = 0.9, base: float = 2.0) -> DataFrame:
    """Per problem after all logged losses: moving average of the loss, review interval, and
    the step at which it is due again.

    The average starts at 1 and takes ``decay * old + (1 - decay) * loss`` in row order, so
    each loss counts ``(1 - decay) * decay ^ (rows after it)`` and plain sums suffice. ``log``
    also carries ``step_mean``, the mean loss of the step.
    """
    placed = position(
        log, order=["row_no"], bucket=[row_bucket("row_no")], partition=["problem_id"], name="_at", total="_n"
    )
    share = F.lit(1 - decay) * F.pow(F.lit(decay), F.col("_n") - F.col("_at"))
    state = placed.groupBy("problem_id").agg(
        (F.sum(share * F.col(loss)) + F.pow(F.lit(decay), F.max("_n"))).alias("ema"),
        F.max("_n").alias("updates"),
        F.max_by("step", "row_no").alias("last_step"),
        F.max_by("step_mean", "row_no").alias("_mean"),
    )
    level = -F.log(F.col("ema") + 1e-6)
    whole = F.when(level >= 0, F.floor(level)).otherwise(F.ceil(level))
    interval = F.pow(F.lit(base), F.greatest(F.lit(0), F.least(F.lit(8), whole)))
    known = F.col("ema") <= F.greatest(F.col("_mean"), F.lit(1e-6))
    due = F.col("last_step") + 1 + F.when(known, F.col("interval")).otherwise(F.lit(1.0))
    return state.withColumn("interval", interval).withColumn("due", due).drop("_mean")


def entropy_weights(
    tokens: DataFrame, batch: str, *, quantile: float = 0.8, high: float = 2.0, low: float = 1.0
) -> DataFrame:
    """Add ``entropy_weight``: tokens at or above the batch's quantile of trained entropies."""
    trained = tokens.filter(F.col("weight") > 0)
    limits = linear_quantile(trained, "entropy", quantile, [batch], "_limit")
    joined = tokens.join(limits, batch, "left")
    factor = F.when(F.col("entropy") >= F.col("_limit"), F.lit(high)).otherwise(F.lit(low))
    return joined.withColumn("entropy_weight", F.col("weight") * F.when(F.col("_limit").isNull(), F.lit(1.0)).otherwise(factor)).drop("_limit")
