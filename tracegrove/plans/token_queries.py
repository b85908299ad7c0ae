"""Queries over token-level log-probabilities: alignment, means, percentiles, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import quantiles, trainlog
from .row_queries import COMPARISON_SQL, logged_v
from .views import Query, with_views

QUERIES: dict[str, Query] = {}


def add(name: str, run, views: list[str], sql: str) -> None:
    QUERIES[name] = Query(run, with_views(views, sql))


def _row_id(df: DataFrame) -> DataFrame:
    return df.withColumn("problem_id", F.concat_ws(":", "row_no", "row_sub"))


def _aligned(spark, sf):
    rows = _row_id(logged_v(spark, sf))
    epoch = rows.filter("l_linenumber > 1").select("problem_id", F.col("epoch_lp").alias("logprobs"))
    reference = rows.filter("l_linenumber < 6").select("problem_id", F.col("ref_lp").alias("logprobs"))
    masks = rows.select("problem_id", F.concat(F.array(F.lit(0).cast("tinyint")), "target_mask").alias("mask"))
    return trainlog.aligned(epoch, reference, masks)


add(
    "aligned_logprobs",
    lambda s, d: _aligned(s, d).select(
        "problem_id", F.round(K.array_sum(F.col("epoch_lp")) - K.array_sum(F.col("ref_lp")), 6).alias("gap"), K.trained_count(F.col("target_mask")).alias("trained")
    ),
    ["logged_v"],
    """SELECT row_no || ':' || row_sub AS problem_id, round(sum(e) - sum(r), 6) AS gap, count(*) FILTER (m) AS trained FROM logged_v
      WHERE l_linenumber BETWEEN 2 AND 5 GROUP BY row_no, row_sub""",
)

_MEANS = ["logprob_decreased", "kl_per_token", "mean_importance_ratio", "nll"]


def _means(spark, sf):
    metrics = trainlog.comparison_metrics(logged_v(spark, sf), branch=0.05, cutoff=0.5)
    out = trainlog.token_weighted_means(metrics.withColumn("w", K.trained_count(F.col("target_mask"))), _MEANS, "w")
    return out.select("metric", F.round("mean", 4).alias("mean"))


_PARTS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(sum({m} * w) / sum(w), 4) AS mean FROM per_row WHERE {m} IS NOT NULL" for m in _MEANS
)
add(
    "token_weighted_means",
    _means,
    ["logged_v"],
    f""", compared AS ({COMPARISON_SQL}), sizes AS (SELECT problem_id, row_no, row_sub, count(*) FILTER (m) AS w FROM logged_v GROUP BY ALL),
    per_row AS (SELECT * FROM compared JOIN sizes USING (problem_id, row_no, row_sub))
    {_PARTS} UNION ALL SELECT 'perplexity', round(exp(sum(nll * w) / sum(w)), 4) FROM per_row WHERE nll IS NOT NULL""",
)


def _differences(spark, sf):
    d = trainlog.token_differences(logged_v(spark, sf))
    return d.select(F.round("diff", 4).alias("diff"), F.round("epoch_lp", 4).alias("epoch_lp"))


_DIFF = "(SELECT round(e - r, 4) AS diff, round(e, 4) AS lp, least(1.0, abs(round(e, 4)) / 0.05) AS w FROM logged_v WHERE m)"
_PICK = ", ".join(f"s[CAST(least(floor(n * {p} / 100), n - 1) + 1 AS BIGINT)] AS p{p:02d}" for p in quantiles.PERCENTILES)
add(
    "diff_percentiles",
    lambda s, d: quantiles.nearest_rank(_differences(s, d), "diff"),
    ["logged_v"],
    f"SELECT {_PICK} FROM (SELECT list_sort(list(diff)) AS s, count(*) AS n FROM {_DIFF})",
)
_CDF = ", ".join(
    f"round((count(*) FILTER (diff < {d}) + count(*) FILTER (diff <= {d})) / (2 * count(*)), 6) AS {quantiles.cdf_name(d, 'cdf_')}" for d in quantiles.CDF_POINTS
)


def _round_all(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


add(
    "diff_cdf",
    lambda s, d: _round_all(quantiles.mid_rank_cdf(_differences(s, d), "diff")),
    ["logged_v"],
    f"SELECT {_CDF} FROM {_DIFF}",
)
_WPICK = ", ".join(f"coalesce(min(diff) FILTER (upto >= total * {p} / 100.0), max(diff)) AS p{p:02d}" for p in quantiles.PERCENTILES)
add(
    "weighted_diff_percentiles",
    lambda s, d: quantiles.weighted_percentiles(_differences(s, d), "diff", trainlog.branch_weight(F.col("epoch_lp"), 0.05)),
    ["logged_v"],
    f"""SELECT {_WPICK} FROM (SELECT diff, sum(sum(w)) OVER (ORDER BY diff) AS upto, sum(sum(w)) OVER () AS total FROM {_DIFF} GROUP BY diff)""",
)
_WCDF = ", ".join(
    f"round((coalesce(sum(w) FILTER (diff < {d}), 0) + coalesce(sum(w) FILTER (diff <= {d}), 0)) / (2 * sum(w)), 6) AS {quantiles.cdf_name(d, 'cdf_')}"
    for d in quantiles.CDF_POINTS
)
add(
    "weighted_diff_cdf",
    lambda s, d: _round_all(quantiles.mid_rank_cdf(_differences(s, d), "diff", weight=trainlog.branch_weight(F.col("epoch_lp"), 0.05))),
    ["logged_v"],
    f"SELECT {_WCDF} FROM {_DIFF}",
)


def _per_category(spark, sf):
    rows = logged_v(spark, sf).select("category", F.explode("epoch_lp").alias("lp"))
    med = quantiles.linear_quantile(rows, "lp", 0.5, ["category"], "median")
    low = quantiles.lower_median(rows, "lp", ["category"], "lower")
    top = quantiles.linear_quantile(rows, "lp", 0.8, ["category"], "q80")
    joined = med.join(low, "category").join(top, "category")
    return joined.select("category", *[F.round(c, 6).alias(c) for c in ("median", "lower", "q80")])


add(
    "quantiles_by_category",
    _per_category,
    ["logged_v"],
    """SELECT category, round(median(e), 6) AS median, round(quantile_disc(e, 0.5), 6) AS lower, round(quantile_cont(e, 0.8), 6) AS q80
      FROM logged_v GROUP BY category""",
)
