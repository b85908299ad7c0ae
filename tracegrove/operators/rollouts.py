"""Rollout tables: record assembly, grading, pass counts, yield, advantages, sampling plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import tokens as K
from .ordering import order_key
from .quantiles import linear_quantile

# Category groups and depths of the sampling plan.
PREFERRED = ["bit_manipulation", "cipher", "equation_numeric_deduce", "equation_numeric_guess"]
SATURATED = ["numeral", "gravity", "unit_conversion"]
PASS_RATE_TIERS = [(0.85, 2), (0.15, 32), (0.02, 64), (0.0, 4)]


def with_category(df: DataFrame, categories: DataFrame, default: str = "unknown") -> DataFrame:
    """Category of the row, else of the map (problem_id, category), else ``default``."""
    known = categories.select("problem_id", F.col("category").alias("_mapped"))
    joined = df.join(known, "problem_id", "left")
    chosen = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("_mapped"), F.lit(default))
    return joined.withColumn("category", chosen).drop("_mapped")


def remaining_problems(problems: DataFrame, rollouts: DataFrame, stage: str | None = None) -> DataFrame:
    """Problems without a rollout yet (of the stage, if one is named)."""
    done = rollouts if stage is None else rollouts.filter(F.col("stage") == stage)
    return problems.join(done.select("problem_id"), "problem_id", "left_anti")


def records_from_outputs(outputs: DataFrame, stage: str) -> DataFrame:
    """One graded rollout per completion of a generation output table."""
    one = outputs.select("*", F.posexplode("completions").alias("sample_no", "c"))
    n_prompt, ids = F.size("prompt_token_ids"), F.col("c.token_ids")
    zeros = F.array_repeat(F.lit(0.0), n_prompt)
    logps = F.transform(ids, lambda t, i: K.sampled_logprob(F.get(F.col("c.logprobs"), i), t))
    mask = F.concat(K.fill(0, n_prompt), K.fill(1, F.size(ids)))
    return (
        one.withColumn("text", F.col("c.text"))
        .withColumn("completion_token_ids", ids)
        .withColumn("old_logp", F.concat(zeros, logps))
        .withColumn("pred", A.extract_answer(F.col("text")))
        .withColumn("reward", A.reward(F.col("text"), F.col("answer"), F.col("pred")))
        .withColumn("ppl_approx", K.perplexity(F.col("old_logp"), mask))
        .withColumn("stage", F.lit(stage))
        .drop("c", "completions")
    )


def strict(df: DataFrame) -> Column:
    return A.strictly_correct(df["reward"], df["text"], df["answer"], df["pred"])


def lenient(df: DataFrame) -> Column:
    return A.leniently_correct(df["reward"], df["text"], df["answer"], df["pred"])


def pass_counts(rollouts: DataFrame) -> DataFrame:
    """(problem_id, pass_count, traces) under strict correctness.

    The list of 0/1 scores of a problem is fully described by these two counts, so no list
    is collected.
    """
    return rollouts.groupBy("problem_id").agg(
        F.count_if(strict(rollouts)).alias("pass_count"), F.count(F.lit(1)).alias("traces")
    )


def capped_pass_counts(rollouts: DataFrame, order: Sequence[str], cap: int = 8) -> DataFrame:
    """(problem_id, category of the first row, pass_count up to ``cap``, traces), lenient."""
    return rollouts.groupBy("problem_id").agg(
        F.min_by("category", order_key(order)).alias("category"),
        F.least(F.count_if(lenient(rollouts)), F.lit(cap)).alias("pass_count"),
        F.count(F.lit(1)).alias("traces"),
    )


def pass_tiers(counts: DataFrame, partial_max: int = 7, mastered_min: int = 8) -> DataFrame:
    """Numbers of ids that never, sometimes and always pass."""
    n = F.col("pass_count")
    return counts.agg(
        F.count_if(n == 0).alias("zero_ids"),
        F.count_if((n >= 1) & (n <= partial_max)).alias("partial_ids"),
        F.count_if(n >= mastered_min).alias("all_correct_ids"),
    )


def outcome_flags(rollouts: DataFrame, max_tokens: int = 7680, epsilon: int = 8) -> DataFrame:
    """Add the flags the yield report counts. Failure kinds overlap: a trace without a box
    counts as truncated and as badly formatted."""
    boxed = A.has_box(F.col("text"))
    rewarded = F.coalesce(F.col("reward"), F.lit(0.0)) > 0
    known = F.coalesce(F.col("answer"), F.lit("")) != ""
    matches = A.answers_match(F.col("answer"), A.predicted(F.col("pred"), F.col("text")))
    near_limit = F.coalesce(F.size("completion_token_ids"), F.lit(0)) >= max(0, max_tokens - epsilon)
    return (
        rollouts.withColumn("rewarded", rewarded)
        .withColumn("correct", rewarded | (boxed & known & matches))
        .withColumn("wrong", ~F.col("correct"))
        .withColumn("truncated", F.col("wrong") & (near_limit | ~boxed))
        .withColumn("bad_format", F.col("wrong") & ~boxed)
        .withColumn("slip", F.col("wrong") & boxed)
    )


def yield_report(
    rollouts: DataFrame,
    order: Sequence[str],
    *,
    stage: str | None = None,
    max_tokens: int = 7680,
    epsilon: int = 8,
) -> DataFrame:
    """Per category: problems, traces, pass@1, pass@k, failure rates, median perplexity.

    A problem belongs to the category of its first row. pass@1 uses lenient correctness,
    pass@k looks at rewards only.
    """
    rows = rollouts if stage is None else rollouts.filter(F.col("stage") == stage)
    flagged = outcome_flags(rows, max_tokens, epsilon)
    problems = flagged.groupBy("problem_id").agg(
        F.min_by("category", order_key(order)).alias("category"),
        F.count(F.lit(1)).alias("traces"),
        F.count_if("correct").alias("correct"),
        F.max(F.col("rewarded").cast("bigint")).alias("hit"),
        F.count_if("wrong").alias("wrong"),
        F.count_if("truncated").alias("truncated"),
        F.count_if("bad_format").alias("bad_format"),
        F.count_if("slip").alias("slip"),
    )
    sums = problems.groupBy("category").agg(
        F.count(F.lit(1)).alias("problems"),
        *[F.sum(c).alias(c) for c in ("traces", "correct", "hit", "wrong", "truncated", "bad_format", "slip")],
    )

    def share(n: str, d: str) -> Column:
        return F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(d)), F.lit(0.0))

    ppl = F.col("ppl_approx")
    finite = rows.filter(ppl.isNotNull() & ~F.isnan(ppl) & (F.abs(ppl) < float("inf")))
    by_problem = finite.groupBy("problem_id", "ppl_approx").agg(F.count(F.lit(1)).alias("n"))
    by_category = by_problem.join(problems.select("problem_id", "category"), "problem_id")
    medians = linear_quantile(by_category, "ppl_approx", 0.5, ["category"], "ppl_median", F.col("n"))
    return sums.join(medians, "category", "left").select(
        "category",
        "problems",
        "traces",
        share("correct", "traces").alias("pass_at_1"),
        share("hit", "problems").alias("pass_at_k"),
        "wrong",
        share("truncated", "wrong").alias("truncation_rate_wrong"),
        share("bad_format", "wrong").alias("format_rate_wrong"),
        share("slip", "wrong").alias("slip_rate_wrong"),
        "ppl_median",
    )


def zero_yield_categories(report: DataFrame) -> DataFrame:
    return report.filter(F.col("pass_at_k") == 0).select("category")


def schedule_stats(rollouts: DataFrame) -> DataFrame:
    """Per category: rollouts, completion tokens, reward sum."""
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("unknown"))
    return rollouts.groupBy(category.alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.size("completion_token_ids"), F.lit(0)).cast("bigint")).alias("tokens"),
        F.sum(F.coalesce(F.col("reward"), F.lit(0.0))).alias("correct"),
    )


def _reward_stats(rollouts: DataFrame) -> DataFrame:
    return rollouts.groupBy("problem_id").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min("reward").alias("min_reward"),
        F.max("reward").alias("max_reward"),
        F.avg("reward").alias("mean_reward"),
        F.stddev_pop("reward").alias("std_reward"),
    )


def mixed_reward_groups(rollouts: DataFrame) -> DataFrame:
    """Problems whose rewards are not all equal."""
    return _reward_stats(rollouts).filter(F.col("min_reward") != F.col("max_reward"))


def keep_mixed_groups(rollouts: DataFrame) -> DataFrame:
    """Rollouts of problems with mixed rewards."""
    return rollouts.join(mixed_reward_groups(rollouts).select("problem_id"), "problem_id", "left_semi")


def group_advantages(rollouts: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """Reward standardised within its problem; uniform or single-row problems are left out."""
    stats = mixed_reward_groups(rollouts).select("problem_id", "mean_reward", "std_reward")
    scaled = (F.col("reward") - F.col("mean_reward")) / (F.col("std_reward") + epsilon)
    return rollouts.join(stats, "problem_id").withColumn("advantage", scaled).drop("mean_reward", "std_reward")


def value_weights(
    counts: DataFrame,
    *,
    beta1: float = 0.5,
    beta2: float = 1.0,
    low: float = 0.5,
    high: float = 3.0,
) -> DataFrame:
    """Add ``value`` (soft maximum of the 0/1 scores of a problem) and the trace weight.

    ``value = beta1 * log(mean(exp(score / beta1)))``, shifted by the largest score so that
    nothing overflows; with 0/1 scores the mean needs the two counts only.
    """
    hits, n = F.col("pass_count").cast("double"), F.col("traces")
    top = F.when(hits > 0, F.lit(1.0 / beta1)).otherwise(F.lit(0.0))
    mean = (hits * F.exp(F.lit(1.0 / beta1) - top) + (n - hits) * F.exp(-top)) / n
    value = F.lit(beta1) * (top + F.log(mean))
    weight = F.least(F.greatest(F.exp((F.lit(1.0) - value) / beta2), F.lit(low)), F.lit(high))
    return counts.withColumn("value", value).withColumn("trace_weight", weight)


# --- sampling plan ---------------------------------------------------------------------------


def depth_for_pass_rate(rate: Column, fallback: int) -> Column:
    depth = F.lit(fallback)
    for low, g in reversed(PASS_RATE_TIERS):
        depth = F.when(rate >= low, F.lit(g)).otherwise(depth)
    return depth


def _equation(category: Column) -> Column:
    return category.startswith("equation_numeric")


def _hard(category: Column) -> Column:
    return category.contains("cryptarithm") | category.endswith("_guess")


def default_depth(category: Column, fallback: int) -> Column:
    return (
        F.when(category.isin(SATURATED), F.lit(2))
        .when(category == "bit_manipulation", F.lit(64))
        .when(_equation(category) | (category == "cipher"), F.lit(32))
        .when(_hard(category), F.lit(4))
        .otherwise(F.lit(fallback))
    )


def sample_depths(plan: DataFrame, fallback: int = 8) -> DataFrame:
    """Add ``depth``, the samples per problem of each category.

    ``plan`` has one row per category with optional hints, tried in this order:
    ``fixed`` (a number), ``entry_depth`` and ``entry_rate`` (of an explicit ``has_entry``
    row; a missing rate counts as -1), ``report_rate`` with ``has_report``, the earlier
    rollouts ``probe_n`` / ``probe_correct``, and the default of the category.
    """
    entry_rate = F.coalesce(F.col("entry_rate"), F.lit(-1.0))
    report_rate = F.coalesce(F.col("report_rate"), F.lit(-1.0))
    probe_rate = F.try_divide(F.col("probe_correct").cast("double"), F.col("probe_n"))
    depth = (
        F.when(F.col("fixed").isNotNull(), F.greatest(F.floor("fixed"), F.lit(1)))
        .when(F.coalesce(F.col("entry_depth"), F.lit(0)) != 0, F.greatest(F.col("entry_depth"), F.lit(1)))
        .when(F.col("has_entry"), depth_for_pass_rate(entry_rate, fallback))
        .when(F.col("has_report"), depth_for_pass_rate(report_rate, fallback))
        .when(F.col("probe_n") > 0, depth_for_pass_rate(probe_rate, fallback))
        .otherwise(default_depth(F.col("category"), fallback))
    )
    return plan.withColumn("depth", depth.cast("bigint"))


def fit_depths_to_budget(plan: DataFrame, budget: float, max_tokens: int = 7680) -> DataFrame:
    """Lower depths, one sample per category and round, until the cost fits the budget.

    ``plan``: category, problems, depth, probe_n, probe_tokens. Every possible cut is a row
    ordered by (round, cut rank, category); a cut happens when the savings before it do not
    yet reach the excess. The table has categories x depth rows.
    """
    c = F.col("category")
    preferred = c.isin(PREFERRED) | _equation(c)
    average = F.when(
        F.col("probe_n") > 0, F.greatest(F.lit(1.0), F.col("probe_tokens") / F.col("probe_n"))
    ).otherwise(F.lit(float(max_tokens)))
    priced = (
        plan.withColumn("unit_cost", F.col("problems") * average)
        .withColumn("min_depth", F.when(preferred, F.lit(8)).otherwise(F.lit(1)))
        .withColumn(
            "cut_rank",
            F.when(c.isin(SATURATED), F.lit(0)).when(_hard(c), F.lit(1)).when(preferred, F.lit(3)).otherwise(F.lit(2)),
        )
    )
    if budget <= 0:
        return priced.withColumn("capped_depth", F.col("depth"))
    excess = priced.select(F.sum(F.col("depth") * F.col("unit_cost")) - budget).scalar()
    room = F.greatest(F.col("depth") - F.col("min_depth"), F.lit(0)).cast("int")
    cuts = priced.filter(room > 0).select(
        "category", "cut_rank", "unit_cost", F.explode(F.sequence(F.lit(1), room)).alias("round")
    )
    earlier = W.orderBy("round", "cut_rank", "category").rowsBetween(W.unboundedPreceding, -1)
    made = (
        cuts.withColumn("saved", F.coalesce(F.sum("unit_cost").over(earlier), F.lit(0.0)))
        .filter(F.col("saved") < excess)
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("cuts"))
    )
    return (
        priced.join(made, "category", "left")
        .withColumn("capped_depth", F.col("depth") - F.coalesce(F.col("cuts"), F.lit(0)))
        .drop("cuts")
    )
