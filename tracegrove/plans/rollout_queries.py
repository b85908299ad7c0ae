"""Queries over rollout tables: reports, pass counts, sampling plans, mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import mining, rollouts
from . import views as V
from .row_queries import KEYS, KEYS_SQL, joined
from .views import HAS_BOX_SQL, ORDER, Query, match_sql, with_views

QUERIES: dict[str, Query] = {}


def add(name: str, run, views: list[str] | None = None, sql: str | None = None) -> None:
    QUERIES[name] = Query(run, None if sql is None else with_views(views or [], sql))


_PRED = "coalesce(nullif(pred, ''), extracted)"
_MATCH = match_sql("answer", _PRED)
V._view(
    "flagged_v",
    f"""SELECT *, reward > 0 OR ({HAS_BOX_SQL} AND {_MATCH}) AS correct, {HAS_BOX_SQL} AS boxed,
      {HAS_BOX_SQL} AND reward > 0 AND {_MATCH} AS strict FROM graded_v""",
    "graded_v",
)
_OUTCOME = "SELECT *, NOT correct AS wrong, NOT correct AND NOT boxed AS bad_format, NOT correct AND boxed AS slip FROM flagged_v"


def _report(df: DataFrame) -> DataFrame:
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in df.columns])


YIELD_SQL = f"""SELECT p.category, problems, traces, round(correct / traces, 6) AS pass_at_1, round(hits / problems, 6) AS pass_at_k, wrong,
  round(coalesce(truncated / nullif(wrong, 0), 0), 6) AS truncation_rate_wrong, round(coalesce(bad_format / nullif(wrong, 0), 0), 6) AS format_rate_wrong,
  round(coalesce(slip / nullif(wrong, 0), 0), 6) AS slip_rate_wrong, round(ppl, 6) AS ppl_median FROM (
  SELECT category, count(*) AS traces, count(DISTINCT problem_id) AS problems, count(*) FILTER (correct) AS correct,
    count(DISTINCT problem_id) FILTER (reward > 0) AS hits, count(*) FILTER (wrong) AS wrong, count(*) FILTER (bad_format) AS truncated,
    count(*) FILTER (bad_format) AS bad_format, count(*) FILTER (slip) AS slip, median(ppl_approx) AS ppl
  FROM ({_OUTCOME}) %s GROUP BY category) p"""

add(
    "yield_report",
    lambda s, d: _report(rollouts.yield_report(V.graded_v(s, d), ORDER)),
    ["flagged_v"],
    YIELD_SQL % "",
)
add(
    "yield_report_stage",
    lambda s, d: _report(rollouts.yield_report(V.graded_v(s, d), ORDER, stage="probe")),
    ["flagged_v"],
    YIELD_SQL % "WHERE stage = 'probe'",
)


def _zero_yield(spark, sf):
    hopeless = V.graded_v(spark, sf).withColumn("reward", F.when(F.col("category").isin("PROMO", "LARGE"), 0.0).otherwise(F.col("reward")))
    return rollouts.zero_yield_categories(rollouts.yield_report(hopeless, ORDER))


add(
    "zero_yield_categories",
    _zero_yield,
    [],
    "SELECT DISTINCT p_type AS category FROM part WHERE p_type IN ('PROMO', 'LARGE')",
)


def _taxonomy(spark, sf):
    f = rollouts.outcome_flags(V.graded_v(spark, sf))
    return f.groupBy("stage", "category").agg(*[F.count_if(c).alias(c) for c in ("correct", "wrong", "truncated", "bad_format", "slip")])


add(
    "failure_taxonomy",
    _taxonomy,
    ["flagged_v"],
    f"""SELECT stage, category, count(*) FILTER (correct) AS correct, count(*) FILTER (wrong) AS wrong, count(*) FILTER (bad_format) AS truncated,
      count(*) FILTER (bad_format) AS bad_format, count(*) FILTER (slip) AS slip FROM ({_OUTCOME}) GROUP BY ALL""",
)
add(
    "pass_counts",
    lambda s, d: rollouts.pass_counts(V.graded_v(s, d)),
    ["flagged_v"],
    "SELECT problem_id, count(*) FILTER (strict) AS pass_count, count(*) AS traces FROM flagged_v GROUP BY problem_id",
)
add(
    "pass_counts_capped",
    lambda s, d: rollouts.capped_pass_counts(V.graded_v(s, d), ORDER),
    ["flagged_v"],
    """SELECT problem_id, arg_min(category, row_no) AS category, least(count(*) FILTER (correct), 8) AS pass_count, count(*) AS traces
      FROM flagged_v GROUP BY problem_id""",
)
add(
    "pass_tiers",
    lambda s, d: rollouts.pass_tiers(rollouts.pass_counts(V.graded_v(s, d)), 12, 13),
    ["flagged_v"],
    """SELECT count(*) FILTER (n = 0) AS zero_ids, count(*) FILTER (n BETWEEN 1 AND 12) AS partial_ids, count(*) FILTER (n >= 13) AS all_correct_ids
      FROM (SELECT problem_id, count(*) FILTER (strict) AS n FROM flagged_v GROUP BY problem_id)""",
)
add(
    "distinct_ids",
    lambda s, d: V.rollouts_v(s, d).groupBy("category").agg(F.countDistinct("problem_id").alias("ids")),
    ["rollouts_v"],
    "SELECT category, count(DISTINCT problem_id) AS ids FROM rollouts_v GROUP BY category",
)
add(
    "schedule_stats",
    lambda s, d: rollouts.schedule_stats(V.graded_v(s, d)),
    ["graded_v"],
    "SELECT category, count(*) AS n, count(*) * 4 AS tokens, sum(reward) AS correct FROM graded_v GROUP BY category",
)
V._view("small_v", "SELECT *, problem_id || '/' || l_suppkey % 7 AS group_id FROM graded_v", "graded_v")


def _small_groups(spark, sf):
    """Rollouts in smaller groups, so that some have equal rewards throughout."""
    rows = V.graded_v(spark, sf)
    return rows.withColumn("problem_id", F.concat_ws("/", "problem_id", (F.col("l_suppkey") % 7).cast("string")))


add(
    "mixed_reward_groups",
    lambda s, d: rollouts.mixed_reward_groups(_small_groups(s, d)).select("problem_id", "group_size", F.round("mean_reward", 6).alias("mean_reward")),
    ["small_v"],
    """SELECT group_id AS problem_id, count(*) AS group_size, round(avg(reward), 6) AS mean_reward FROM small_v GROUP BY group_id
      HAVING count(DISTINCT reward) > 1""",
)
add(
    "keep_mixed_groups",
    lambda s, d: rollouts.keep_mixed_groups(_small_groups(s, d)).select(*KEYS),
    ["small_v"],
    """SELECT group_id AS problem_id, row_no, row_sub FROM small_v WHERE group_id IN (
      SELECT group_id FROM small_v GROUP BY group_id HAVING count(DISTINCT reward) > 1)""",
)
add(
    "group_advantages",
    lambda s, d: rollouts.group_advantages(_small_groups(s, d)).select(*KEYS, F.round("advantage", 6).alias("advantage")),
    ["small_v"],
    """SELECT problem_id, row_no, row_sub, round((reward - m) / (s + 0.0001), 6) AS advantage FROM (
      SELECT group_id AS problem_id, row_no, row_sub, reward, avg(reward) OVER w AS m, stddev_pop(reward) OVER w AS s,
        min(reward) OVER w AS lo, max(reward) OVER w AS hi FROM small_v WINDOW w AS (PARTITION BY group_id)) WHERE lo <> hi""",
)


def _value_weights(spark, sf):
    w = rollouts.value_weights(rollouts.pass_counts(V.graded_v(spark, sf)), low=0.9, high=1.4)
    return w.select("problem_id", F.round("value", 6).alias("value"), F.round("trace_weight", 6).alias("trace_weight"))


add(
    "value_weights",
    _value_weights,
    ["flagged_v"],
    """SELECT problem_id, round(v, 6) AS value, round(least(greatest(exp(1 - v), 0.9), 1.4), 6) AS trace_weight FROM (
      SELECT problem_id, 0.5 * ln(avg(exp(CASE WHEN strict THEN 2 ELSE 0 END))) AS v FROM flagged_v GROUP BY problem_id)""",
)

# --- sampling plan ---------------------------------------------------------------------------

_NAMES = {
    "ECONOMY": "numeral",
    "LARGE": "bit_manipulation",
    "MEDIUM": "cryptarithm_guess",
    "PROMO": "equation_numeric_deduce",
    "SMALL": "cipher",
    "STANDARD": "other",
}


def _puzzle(c: str = "category"):
    name = F.col(c)
    out = name
    for old, new in _NAMES.items():
        out = F.when(name == old, F.lit(new)).otherwise(out)
    return out


_PUZZLE_SQL = "CASE category " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _NAMES.items()) + " END"


def _plan(spark, sf):
    stats = rollouts.schedule_stats(V.graded_v(spark, sf).filter("stage = 'probe'"))
    counts = V.problems_v(spark, sf).groupBy("category").agg(F.count("*").alias("problems"))
    plan = counts.join(stats, "category", "left").withColumn("category", _puzzle())
    c = F.col("category")
    return plan.select(
        "category",
        "problems",
        F.when(c == "numeral", F.lit(3.7)).alias("fixed"),
        F.when(c == "cipher", F.lit(24)).alias("entry_depth"),
        F.lit(None).cast("double").alias("entry_rate"),
        c.isin("cipher", "other").alias("has_entry"),
        F.when(c == "cryptarithm_guess", F.lit(0.05)).alias("report_rate"),
        (c == "cryptarithm_guess").alias("has_report"),
        F.when(c != "bit_manipulation", F.col("n")).alias("probe_n"),
        F.col("correct").alias("probe_correct"),
        F.col("tokens").alias("probe_tokens"),
    )


V._view(
    "plan_v",
    f"""SELECT {_PUZZLE_SQL} AS category, problems, n, tokens, CASE {_PUZZLE_SQL} WHEN 'numeral' THEN 3 WHEN 'cipher' THEN 24 WHEN 'other' THEN 8
      WHEN 'cryptarithm_guess' THEN 64 WHEN 'bit_manipulation' THEN 64 ELSE CASE WHEN correct / n >= 0.85 THEN 2 WHEN correct / n >= 0.15 THEN 32
      WHEN correct / n >= 0.02 THEN 64 ELSE 4 END END AS depth FROM (
      SELECT category, count(*) AS n, count(*) * 4 AS tokens, sum(reward) AS correct FROM graded_v WHERE stage = 'probe' GROUP BY category)
      JOIN (SELECT category, count(*) AS problems FROM problems_v GROUP BY category) USING (category)""",
    "graded_v",
    "problems_v",
)
add(
    "sample_depths",
    lambda s, d: rollouts.sample_depths(_plan(s, d)).select("category", "depth"),
    ["plan_v"],
    "SELECT category, depth FROM plan_v",
)


def _budget(spark, sf):
    plan = rollouts.sample_depths(_plan(spark, sf)).withColumn("probe_n", F.coalesce("probe_n", F.lit(0)))
    return rollouts.fit_depths_to_budget(plan, 600000.0, max_tokens=6).select("category", "depth", "capped_depth")


_BUDGET_SQL = """, priced AS (SELECT *, problems * CASE WHEN category = 'bit_manipulation' THEN 6.0 ELSE greatest(1.0, tokens / n) END AS u,
  CASE WHEN category IN ('bit_manipulation', 'cipher', 'equation_numeric_deduce') THEN 8 ELSE 1 END AS low,
  CASE category WHEN 'numeral' THEN 0 WHEN 'cryptarithm_guess' THEN 1 WHEN 'other' THEN 2 ELSE 3 END AS rk FROM plan_v),
units AS (SELECT category, u, rk, unnest(range(1, CAST(depth - low + 1 AS BIGINT))) AS r FROM priced WHERE depth > low),
cuts AS (SELECT category, coalesce(sum(u) OVER (ORDER BY r, rk, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved FROM units)
SELECT category, depth, depth - coalesce((SELECT count(*) FROM cuts WHERE cuts.category = priced.category AND saved <
  (SELECT sum(depth * u) FROM priced) - %s), 0) AS capped_depth FROM priced"""

# --- joins on rollouts -----------------------------------------------------------------------


def _category_lookup(spark, sf):
    rows = V.rollouts_v(spark, sf).withColumn("category", F.when(F.col("l_linenumber") < 3, F.lit("")).when(F.col("l_linenumber") < 5, F.col("category")))
    known = V.problems_v(spark, sf).filter("status = 'rule_found'").select(F.col("id").alias("problem_id"), "category")
    return rollouts.with_category(rows, known).select(*KEYS, "category")


add(
    "category_lookup",
    _category_lookup,
    ["rollouts_v", "problems_v"],
    """SELECT problem_id, row_no, row_sub, CASE WHEN l_linenumber IN (3, 4) THEN r.category WHEN p.status = 'rule_found' THEN p.category
      ELSE 'unknown' END AS category FROM rollouts_v r JOIN problems_v p ON r.problem_id = p.id""",
)


def _remaining(spark, sf):
    problems = V.problems_v(spark, sf).withColumnRenamed("id", "problem_id")
    done = V.rollouts_v(spark, sf).filter(F.col("l_suppkey") % 11 == 0)
    return rollouts.remaining_problems(problems, done, "probe").select("problem_id")


add(
    "resume_remaining",
    _remaining,
    ["rollouts_v", "problems_v"],
    """SELECT id AS problem_id FROM problems_v WHERE id NOT IN (SELECT problem_id FROM rollouts_v WHERE l_suppkey % 11 = 0 AND stage = 'probe')""",
)

# --- mining ----------------------------------------------------------------------------------


def _greedy(spark, sf, k: int, threshold: float):
    rows = V.graded_v(spark, sf).select(*KEYS, "completion_token_ids")
    kept = mining.greedy_diverse(rows, key="problem_id", order=ORDER, items="completion_token_ids", k=k, threshold=threshold)
    return kept.select(*KEYS, "pick_no")


# Walks each problem in order with a recursive CTE, one row per step.
_WALK_SQL = """, numbered AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY row_no, row_sub) AS rn FROM {src}),
walk AS (SELECT problem_id, rn, row_no, row_sub, [completion_token_ids] AS kept, true AS taken FROM numbered WHERE rn = 1
  UNION ALL SELECT n.problem_id, n.rn, n.row_no, n.row_sub, CASE WHEN ok THEN list_append(kept, ids) ELSE kept END, ok FROM (
    SELECT n.problem_id, n.rn, n.row_no, n.row_sub, w.kept, n.completion_token_ids AS ids,
      len(w.kept) < {k} AND len(list_filter(w.kept, lambda b: len(list_intersect(list_distinct(n.completion_token_ids), list_distinct(b))) /
        len(list_distinct(list_concat(n.completion_token_ids, b))) >= {thr})) = 0 AS ok
    FROM walk w JOIN numbered n ON n.problem_id = w.problem_id AND n.rn = w.rn + 1) n)"""


def walk_sql(src: str, k: int, threshold: float, select: str, views: list[str]) -> str:
    sql = with_views(views, "") + _WALK_SQL.format(src=src, k=k, thr=threshold)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) + "\n" + select


QUERIES["greedy_diverse"] = Query(
    lambda s, d: _greedy(s, d, 4, 0.3),
    walk_sql("graded_v", 4, 0.3, "SELECT problem_id, row_no, row_sub, len(kept) AS pick_no FROM walk WHERE taken", ["graded_v"]),
)


def _positives(spark, sf, **args):
    p = mining.positives(V.graded_v(spark, sf), ORDER, **args)
    return p.select(*KEYS, "category", joined(F.col("tokens")).alias("tokens"), joined(F.col("mask")).alias("mask"), F.round("weight", 6).alias("weight"), "sign")


_EXAMPLE_SQL = """array_to_string(list_concat(prompt_token_ids, completion_token_ids), ' ') AS tokens,
  array_to_string(list_concat(list_transform(prompt_token_ids, lambda x: 0), [1, 1, 1, 1]), ' ') AS mask"""
QUERIES["mine_positives"] = Query(
    lambda s, d: _positives(s, d),
    walk_sql(
        "(SELECT * FROM flagged_v WHERE strict)",
        2,
        0.7,
        f"""SELECT {KEYS_SQL}, category, {_EXAMPLE_SQL}, 1.0 AS weight, 1.0 AS sign FROM walk w JOIN flagged_v f USING ({KEYS_SQL}) WHERE taken""",
        ["flagged_v"],
    ),
)
V._view(
    "counted",
    """SELECT problem_id, count(*) FILTER (strict) AS hits, 0.5 * ln(avg(exp(CASE WHEN strict THEN 2 ELSE 0 END))) AS v
      FROM flagged_v GROUP BY problem_id""",
    "flagged_v",
)
QUERIES["mine_partial_positives"] = Query(
    lambda s, d: _positives(s, d, categories="ECONOMY,SMALL", reward_weight=True, partial_max=14, keep_per_id=3),
    walk_sql(
        "(SELECT * FROM flagged_v JOIN counted USING (problem_id) WHERE strict AND category IN ('ECONOMY', 'SMALL') AND hits BETWEEN 1 AND 14)",
        3,
        0.7,
        f"""SELECT {KEYS_SQL}, category, {_EXAMPLE_SQL}, round(least(greatest(exp(1 - v), 0.5), 3.0), 6) AS weight, 1.0 AS sign
          FROM walk w JOIN flagged_v f USING ({KEYS_SQL}) JOIN counted USING (problem_id) WHERE taken""",
        ["counted"],
    ),
)


def _negatives(spark, sf, **args):
    n = mining.negatives(V.graded_v(spark, sf), ORDER, **args)
    return n.select(*KEYS, "category", joined(F.col("tokens")).alias("tokens"), F.round("weight", 6).alias("weight"), "sign", F.col("rank").alias("place"), "eligible")


def _negatives_sql(cap: int, weight: str) -> str:
    return f"""SELECT {KEYS_SQL}, category, array_to_string(list_concat(prompt_token_ids, completion_token_ids), ' ') AS tokens,
      round({weight}, 6) AS weight, -1.0 AS sign, place, eligible FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_no, row_sub) AS place,
      count(*) OVER (PARTITION BY category) AS eligible FROM graded_v WHERE reward <= 0 AND {HAS_BOX_SQL}) WHERE place <= {cap}"""


add("mine_negatives", lambda s, d: _negatives(s, d, max_per_category=300), ["graded_v"], _negatives_sql(300, "0.8"))
add(
    "mine_weighted_negatives",
    lambda s, d: _negatives(s, d, confidence_weight=True, gamma=2.0),
    ["graded_v"],
    _negatives_sql(2000, "0.8 * exp(2.0 * -4 * l_tax / (4 + len(prompt_token_ids)))"),
)
add(
    "category_volume_order",
    lambda s, d: mining.in_category_volume_order(mining.negatives(V.graded_v(s, d), ORDER, max_per_category=50)).select(*KEYS, "eligible", "place"),
    ["graded_v"],
    f"""SELECT {KEYS_SQL}, eligible, row_number() OVER (ORDER BY eligible DESC, category DESC, row_no, row_sub) - 1 AS place FROM ({_negatives_sql(50, '0.8')})""",
)
add(
    "negatives_report",
    lambda s, d: mining.negatives_report(V.graded_v(s, d), 300),
    ["graded_v"],
    f"""SELECT category, e AS eligible, least(e, 300) AS kept, greatest(e - 300, 0) AS capped, b AS format_bad FROM (
      SELECT category, count(*) FILTER ({HAS_BOX_SQL}) AS e, count(*) FILTER (NOT {HAS_BOX_SQL}) AS b FROM graded_v WHERE reward <= 0 GROUP BY category)""",
)


def gold_v(spark, sf) -> DataFrame:
    """Corpus rows for problems: the rewarded rollouts with some tokens changed."""
    rows = V.graded_v(spark, sf).filter(F.col("reward") > 0)
    tokens, mask = K.example(F.col("prompt_token_ids"), F.slice("completion_token_ids", 1, 3))
    text = F.concat(F.lit("Since the rule holds"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" we get \\boxed{"), "answer", F.lit("}"))).otherwise(""), F.lit("\n</think>\n\\boxed{"), "answer", F.lit("}<|im_end|>"))
    return rows.select("problem_id", "category", tokens.alias("tokens"), mask.alias("mask"), text.alias("completion_text"), *ORDER)


V._view(
    "gold_v",
    r"""SELECT problem_id, category, answer, l_linenumber, row_no, row_sub, completion_token_ids[1:3] AS gold_ids,
      'Since the rule holds' || CASE WHEN l_linenumber = 1 THEN ' we get \boxed{' || answer || '}' ELSE '' END AS reasoning
      FROM graded_v WHERE reward > 0""",
    "graded_v",
)
add(
    "gold_last_wins",
    lambda s, d: mining.gold_completions(gold_v(s, d), ORDER).select("problem_id", joined(F.col("gold_ids")).alias("gold_ids")),
    ["gold_v"],
    "SELECT problem_id, array_to_string(arg_max(gold_ids, row_no * 1000000000000::HUGEINT + row_sub), ' ') AS gold_ids FROM gold_v GROUP BY problem_id",
)


def _missing(spark, sf):
    """Rollouts of which some belong to problems no corpus row knows."""
    own = F.when(F.col("l_linenumber") == 7, F.concat("problem_id", F.lit("-new"))).otherwise(F.col("problem_id"))
    return mining.missing_gold(V.graded_v(spark, sf).withColumn("problem_id", own), gold_v(spark, sf))


add(
    "missing_gold",
    _missing,
    ["gold_v", "graded_v"],
    """SELECT category, count(*) AS missing FROM graded_v
      WHERE problem_id || CASE WHEN l_linenumber = 7 THEN '-new' ELSE '' END NOT IN (SELECT problem_id FROM gold_v) GROUP BY category""",
)


def _step_negatives(spark, sf):
    n = mining.step_negatives(V.graded_v(spark, sf), gold_v(spark, sf), ORDER, ORDER)
    return n.select(*KEYS, "category", joined(F.col("mask")).alias("mask"), "diverges_at", "d_bucket", "weight", "sign")


_LAST_GOLD = "(SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY row_no DESC, row_sub DESC) AS k FROM gold_v)"
add(
    "step_negatives",
    _step_negatives,
    ["gold_v", "graded_v"],
    f"""SELECT problem_id, row_no, row_sub, category, array_to_string(list_concat(list_transform(prompt_token_ids, lambda x: 0),
      list_transform(range(4), lambda i: CASE WHEN i >= d THEN 1 ELSE 0 END)), ' ') AS mask, d AS diverges_at, '0000-0127' AS d_bucket, 0.5 AS weight, -1.0 AS sign
      FROM (SELECT r.*, CASE WHEN gold_ids[1] <> completion_token_ids[1] THEN 0 WHEN gold_ids[2] <> completion_token_ids[2] THEN 1
        WHEN gold_ids[3] <> completion_token_ids[3] THEN 2 ELSE 3 END AS d, row_number() OVER (PARTITION BY r.problem_id ORDER BY r.row_no, r.row_sub) AS rn
        FROM graded_v r JOIN {_LAST_GOLD} g ON r.problem_id = g.problem_id AND g.k = 1 WHERE reward <= 0) WHERE rn = 1""",
)


def _corrections(spark, sf):
    c = mining.corrections(V.graded_v(spark, sf), gold_v(spark, sf), ORDER, ORDER, bridge=" ## ")
    return c.select(*KEYS, "category", "attempt", "learning", F.size("tokens").alias("n_tokens"), K.trained_count(F.col("mask")).alias("n_trained"))


add(
    "corrections",
    _corrections,
    ["gold_v", "graded_v"],
    rf"""SELECT problem_id, row_no, row_sub, category, attempt, learning, len(prompt_token_ids) + len(string_split(attempt, ' ')) + len(string_split(learning, ' ')) AS n_tokens,
      len(string_split(learning, ' ')) AS n_trained FROM (
      SELECT r.*, ' ## ' || reasoning || CASE WHEN g.l_linenumber = 1 THEN '' ELSE chr(10) || '\boxed{{' || g.answer || '}}' END || chr(10) || '</think>' || chr(10) ||
        '\boxed{{' || g.answer || '}}<|im_end|>' AS learning,
        CASE WHEN text LIKE 'So%' THEN 'So' WHEN text LIKE 'Hence%' THEN 'Hence' ELSE text END AS attempt,
        row_number() OVER (PARTITION BY r.problem_id ORDER BY r.row_no, r.row_sub) AS rn
      FROM graded_v r JOIN {_LAST_GOLD} g ON r.problem_id = g.problem_id AND g.k = 1
      WHERE reward <= 0 AND NOT {match_sql('g.answer', _PRED)}) WHERE rn = 1""",
)


def _ladder(spark, sf):
    rows = V.rollouts_v(spark, sf)
    step = F.when(F.col("text").startswith("First"), 2).when(F.col("text").startswith("Hence"), 1).otherwise(0)
    return mining.first_verified(rows.select("problem_id", "answer", "text", step.alias("step"), *ORDER), ["step", *ORDER]).select(*KEYS, "step")


add(
    "ratio_ladder",
    _ladder,
    ["graded_v"],
    """SELECT problem_id, row_no, row_sub, step FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY step, row_no, row_sub) AS k FROM (
      SELECT *, CASE WHEN text LIKE 'First%' THEN 2 WHEN text LIKE 'Hence%' THEN 1 ELSE 0 END AS step FROM graded_v WHERE reward > 0)) WHERE k = 1""",
)
PROTECTED = [r"\\boxed", r"^Applying to ", r"^Input$", r"^Output$", r"^\d+\s+[01]$"]


def _protected(spark, sf):
    text = F.col("text")
    original = F.concat(F.lit("Input\n1 0\nApplying to x\n"), text, F.lit("\nplain\n7 1"))
    kept = F.concat(F.lit("Input\n"), F.when(F.col("l_linenumber") % 2 == 0, text).otherwise("gone"), F.lit("\n7 1\n\n"))
    return V.rollouts_v(spark, sf).select(*KEYS, mining.restore_protected_lines(original, kept, PROTECTED).alias("restored"))


add(
    "restore_protected_lines",
    _protected,
    ["rollouts_v"],
    r"""SELECT problem_id, row_no, row_sub, 'Input' || chr(10) || CASE WHEN l_linenumber % 2 = 0 THEN text ELSE 'gone' END || chr(10) || '7 1' || chr(10) ||
      '1 0' || chr(10) || 'Applying to x' || CASE WHEN l_linenumber % 2 = 1 AND contains(text, '\boxed') THEN chr(10) || text ELSE '' END AS restored FROM rollouts_v""",
)


def _pairs(spark, sf):
    pairs = mining.pair_by_rank(V.graded_v(spark, sf), ORDER)
    ex = mining.preference_examples(pairs)
    return ex.select(
        "problem_id", "pair_no", joined(F.col("tokens")).alias("chosen"), joined(F.col("rejected_targets")).alias("rejected"), F.size("weights").alias("n")
    )


_RANKED = """(SELECT *, list_concat(prompt_token_ids, completion_token_ids) AS t, reward > 0 AS ok,
  row_number() OVER (PARTITION BY problem_id, reward > 0 ORDER BY row_no, row_sub) AS k FROM graded_v)"""
add(
    "preference_pairs",
    _pairs,
    ["graded_v"],
    f"""SELECT c.problem_id, c.k AS pair_no, array_to_string(c.t[:-2], ' ') AS chosen, array_to_string(r.t[2:], ' ') AS rejected, len(c.t) - 1 AS n
      FROM {_RANKED} c JOIN {_RANKED} r ON c.problem_id = r.problem_id AND c.k = r.k AND c.ok AND NOT r.ok""",
)


QUERIES["fit_depths_to_budget"] = Query(
    _budget, with_views(["plan_v"], "").rstrip() + "\n" + _BUDGET_SQL % "600000.0"
)
