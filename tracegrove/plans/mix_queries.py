"""Queries over corpus parts and reports: merging, budgets, mixture weights, status tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import tokens as K
from ..operators import mining, mixing, reports, rollouts, trainlog
from ..operators.ordering import position, shuffled_place_sql
from ..session import shared_folder
from . import views as V
from .rollout_queries import _PUZZLE_SQL, _puzzle
from .views import ORDER, Query, match_sql, with_views

QUERIES: dict[str, Query] = {}


def add(name: str, run, views: list[str] | None = None, sql: str | None = None) -> None:
    QUERIES[name] = Query(run, None if sql is None else with_views(views or [], sql))


# --- parts and merging -----------------------------------------------------------------------


def _union(spark, sf):
    whole = V.corpus_v(spark, sf).drop("part", "source", "part_index")
    parts = {name: whole.filter(F.col("row_no") % 3 == i) for i, name in enumerate(V.PARTS)}
    return mixing.union_parts(parts).select("row_no", "part", "part_index", "source")


add(
    "union_parts",
    _union,
    ["corpus_v"],
    "SELECT row_no, part, part_index, source FROM corpus_v",
)
add(
    "protect_earlier_ids",
    lambda s, d: mixing.protect_earlier_ids(V.corpus_v(s, d)).select("problem_id", "part_index", "row_no"),
    ["corpus_v"],
    """SELECT problem_id, part_index, row_no FROM corpus_v c WHERE part_index =
      (SELECT min(part_index) FROM corpus_v x WHERE x.problem_id = c.problem_id)""",
)
_SUMMED = "(SELECT *, sum(n_tokens) OVER (ORDER BY part_index, row_no) AS upto FROM corpus_v)"
add(
    "token_budget_cut",
    lambda s, d: mixing.token_budget_cut(V.corpus_v(s, d), 250000).select("part_index", "row_no"),
    ["corpus_v"],
    f"SELECT part_index, row_no FROM {_SUMMED} WHERE upto <= 250000",
)


def _odd_rows(spark, sf):
    """Corpus rows of which some lack a value or have another mask."""
    row = F.col("row_no")
    mask = F.when(row % 10 == 0, F.slice("mask", 1, 2)).otherwise(F.col("mask"))
    lacking = {"problem_id": 17, "category": 5, "weight": 7, "sign": 11, "tokens": 13}
    rows = V.corpus_v(spark, sf).withColumn("mask", F.when(row % 19 != 0, mask))
    return rows.withColumns({c: F.when(row % k != 0, F.col(c)) for c, k in lacking.items()})


add(
    "row_problems",
    lambda s, d: mixing.row_problems(_odd_rows(s, d)),
    ["corpus_v"],
    """SELECT count(*) FILTER (row_no % 17 = 0) AS null_problem_id, count(*) FILTER (row_no % 5 = 0) AS null_category, count(*) FILTER (row_no % 13 = 0) AS null_tokens,
      count(*) FILTER (row_no % 19 = 0) AS null_mask, count(*) FILTER (row_no % 7 = 0) AS null_weight, count(*) FILTER (row_no % 11 = 0) AS null_sign,
      count(*) FILTER (row_no % 13 <> 0 AND row_no % 19 <> 0 AND row_no % 10 = 0 AND n_tokens > 2) AS length_mismatch,
      count(*) FILTER (row_no % 19 <> 0 AND NOT (n_masked < CASE WHEN row_no % 10 = 0 THEN least(n_tokens, 2) ELSE n_tokens END)) AS nothing_trained FROM corpus_v""",
)

RULES = ["S_solver:fr", "N:en,es"]
_RULE_SQL = "((part = 'S_solver' AND category = 'fr') OR (source = 'N' AND category IN ('en', 'es')))"


def _counts(spark, sf):
    """Pass counts keyed like the corpus ids."""
    counts = rollouts.capped_pass_counts(V.graded_v(spark, sf), ORDER)
    return counts


def _flagged(spark, sf):
    return mixing.flag_merge(
        V.corpus_v(spark, sf), drop_rules=RULES, dedup_ids=True, max_tokens=200000, pass_counts=_counts(spark, sf), boundary=1.5, mastered=0.5
    )


_MATCH = match_sql("answer", "coalesce(nullif(pred, ''), extracted)")
V._view(
    "counts_v",
    f"""SELECT problem_id, least(count(*) FILTER (reward > 0 OR (position(chr(92) || 'boxed{{' IN text) > 0 AND {_MATCH})), 8) AS pass_count
      FROM graded_v GROUP BY problem_id""",
    "graded_v",
)
V._view(
    "merge_v",
    f"""SELECT *, NOT dropped AND NOT shadowed AND upto <= 200000 AS emitted, upto - amount <= 200000 AS was_read FROM (
      SELECT *, sum(amount) OVER (ORDER BY part_index, row_no) AS upto FROM (
      SELECT *, CASE WHEN dropped OR shadowed THEN 0 ELSE n_tokens END AS amount FROM (
      SELECT c.*, NOT dropped AND part_index > min(CASE WHEN NOT dropped THEN part_index END) OVER (PARTITION BY c.problem_id) AS shadowed, pass_count
      FROM (SELECT *, {_RULE_SQL} AS dropped FROM corpus_v) c LEFT JOIN counts_v p ON c.problem_id = p.problem_id)))""",
    "corpus_v",
    "counts_v",
)


def _merge(spark, sf):
    rows = mixing.merge_corpus(
        V.corpus_v(spark, sf), drop_rules=RULES, dedup_ids=True, max_tokens=200000, pass_counts=_counts(spark, sf), boundary=1.5, mastered=0.5
    )
    return rows.select("problem_id", "category", "part_index", "row_no", "weight", F.md5(F.array_join("tokens", " ")).alias("digest"))


add(
    "merge_corpus",
    _merge,
    ["merge_v"],
    """SELECT problem_id, category, part_index, row_no, CASE WHEN pass_count BETWEEN 1 AND 7 THEN 1.5 WHEN pass_count >= 8 THEN 0.5 ELSE 1.0 END AS weight,
      md5(text) AS digest FROM merge_v WHERE emitted""",
)
add(
    "merge_by_source",
    lambda s, d: mixing.merge_by_source(_flagged(s, d)),
    ["merge_v"],
    """SELECT source, count(*) AS read_rows, count(*) FILTER (emitted) AS emitted_rows, count(*) FILTER (dropped) AS skipped_category,
      count(*) FILTER (shadowed) AS skipped_dedup FROM merge_v WHERE was_read GROUP BY source""",
)


def _written(spark, sf):
    """The merge summary as the counters of the pass that writes the merge."""
    categories = ["de", "en", "es", "fr"]
    told = mixing.write_merged(
        V.corpus_v(spark, sf),
        shared_folder(spark, "merged"),
        sources=["S", "R", "N"],
        categories=categories,
        drop_rules=RULES,
        dedup_ids=True,
        max_tokens=200000,
        pass_counts=_counts(spark, sf),
        boundary=1.5,
        mastered=0.5,
    )
    rows = [(f"source {s}", n["read_rows"], n["emitted_rows"], n["skipped_category"], n["skipped_dedup"]) for s, n in told["by_source"].items()]
    rows += [(f"category {c}", sum(n["rows"].values()), n["tokens"], n["unmasked"], len(n["rows"])) for c, n in told["by_category"].items()]
    rows += [(f"passes {p}", n, 0, 0, 0) for p, n in told["pass_counts"].items()]
    return spark.createDataFrame(rows, "name string, a bigint, b bigint, c bigint, d bigint")


add(
    "merge_summary_observed",
    _written,
    ["merge_v"],
    """SELECT 'source ' || source AS name, count(*) AS a, count(*) FILTER (emitted) AS b, count(*) FILTER (dropped) AS c, count(*) FILTER (shadowed) AS d
        FROM merge_v WHERE was_read GROUP BY source
      UNION ALL SELECT 'category ' || category, count(*), CAST(sum(n_tokens) AS BIGINT), CAST(sum(n_tokens - n_masked) AS BIGINT), count(DISTINCT source) FROM merge_v WHERE emitted GROUP BY category
      UNION ALL SELECT 'passes ' || coalesce(pass_count, -1), count(*), 0, 0, 0 FROM merge_v WHERE emitted GROUP BY coalesce(pass_count, -1)""",
)
add(
    "merge_by_category",
    lambda s, d: mixing.merge_by_category(_flagged(s, d)).withColumn("row_share", F.round("row_share", 6)),
    ["merge_v"],
    """SELECT category, source, count(*) AS rows, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens - n_masked) AS BIGINT) AS unmasked,
      round(count(*) / sum(count(*)) OVER (PARTITION BY category), 6) AS row_share FROM merge_v WHERE emitted GROUP BY category, source""",
)
add(
    "pass_count_histogram",
    lambda s, d: mixing.pass_count_histogram(_flagged(s, d)),
    ["merge_v"],
    "SELECT coalesce(pass_count, -1) AS pass_count, count(*) AS rows FROM merge_v WHERE emitted GROUP BY 1",
)
add(
    "difficulty_weights",
    lambda s, d: V.corpus_v(s, d)
    .join(_counts(s, d), "problem_id", "left")
    .select("row_no", mixing.difficulty_factor(F.col("pass_count"), 1.5, 0.5, 0.25).alias("factor")),
    ["corpus_v", "counts_v"],
    """SELECT row_no, CASE WHEN pass_count IS NULL THEN 1.0 WHEN pass_count BETWEEN 1 AND 7 THEN 1.5 WHEN pass_count >= 8 THEN 0.5 ELSE 0.25 END AS factor
      FROM corpus_v LEFT JOIN counts_v USING (problem_id)""",
)


def _masses(spark, sf):
    return V.corpus_v(spark, sf).withColumn("mass", K.trained_count(F.col("mask")))


_WEIGHT_SQL = """(SELECT category, mass, least(greatest((0.9 * raw / sum(raw) OVER () + 0.1 / n) * n, 0.5), 2.0) AS w FROM (
  SELECT category, mass, count(*) OVER () AS n, (1.0::DOUBLE / count(*) OVER ()) / (mass / sum(mass) OVER ()) AS raw FROM (
  SELECT category, CAST(sum(n_tokens - n_masked) AS DOUBLE) AS mass FROM corpus_v GROUP BY category)))"""
add(
    "mixture_weights",
    lambda s, d: mixing.mixture_weights(_masses(s, d)).withColumn("category_weight", F.round("category_weight", 6)),
    ["corpus_v"],
    f"SELECT category, mass, round(w, 6) AS category_weight FROM {_WEIGHT_SQL}",
)


def _resample(spark, sf):
    rows = _masses(spark, sf)
    return mixing.resample(rows, mixing.mixture_weights(rows)).select("problem_id", "row_no", "copy_no")


add(
    "mixture_resample",
    _resample,
    ["corpus_v"],
    f"""SELECT problem_id || CASE WHEN k > 0 THEN '__doremi' || k ELSE '' END AS problem_id, row_no, k AS copy_no FROM (
      SELECT problem_id, row_no, unnest(range(CAST(floor(w) AS BIGINT) + CASE WHEN u < w - floor(w) THEN 1 ELSE 0 END)) AS k FROM (
      SELECT *, CAST(CAST('0x' || substr(sha256(problem_id || ':' || row_no || ':' || category), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS u
      FROM corpus_v JOIN {_WEIGHT_SQL} USING (category)))""",
)
add(
    "longest_per_category",
    lambda s, d: mining.longest_per_category(mining.completion_length(V.corpus_v(s, d)), ["row_no"], n=60).select("category", "row_no", "completion_length", "rank"),
    ["corpus_v"],
    """SELECT category, row_no, n_tokens - n_masked AS completion_length, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category
      ORDER BY n_tokens - n_masked DESC, row_no) AS k FROM corpus_v WHERE n_tokens - n_masked >= 64) WHERE k <= 60""",
)
add(
    "exclude_rule",
    lambda s, d: V.corpus_v(s, d).select("problem_id", "category").exceptAll(V.corpus_v(s, d).filter("category = 'en'").select("problem_id", "category")),
    ["corpus_v"],
    "SELECT problem_id, category FROM corpus_v EXCEPT ALL SELECT problem_id, category FROM corpus_v WHERE category = 'en'",
)


def _jaccard(spark, sf):
    turns = V.table(spark, sf, "conversations")
    answer = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    pair = turns.join(answer, ["conv_id", "turn"])
    return pair.select("conv_id", "turn", F.round(K.jaccard(F.split("text", " "), F.split("next", " ")), 6).alias("jaccard"))


add(
    "token_set_overlap",
    _jaccard,
    [],
    """SELECT a.conv_id, a.turn, round(len(list_intersect(list_distinct(string_split(a.text, ' ')), list_distinct(string_split(b.text, ' ')))) /
      len(list_distinct(list_concat(string_split(a.text, ' '), string_split(b.text, ' ')))), 6) AS jaccard
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1""",
)

def _solver_corpus(spark, sf):
    problems = V.problems_v(spark, sf)
    docs = V.table(spark, sf, "documents")
    prompts = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("prompt"), F.col("lang").alias("answer"))
    text = F.concat("text", F.lit("\n\n"))
    reasoning = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("id"), text.alias("text"))
    turns = V.table(spark, sf, "conversations").filter("role = 'assistant'")
    extra = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("chat").alias("category"), F.col("role").alias("prompt"), F.col("text").alias("completion")
    )
    rows = mixing.solver_corpus(problems, prompts, reasoning, extra)
    return rows.select("problem_id", "category", "answer", F.md5(F.array_join("tokens", " ")).alias("digest"), K.trained_count(F.col("mask")).alias("trained"))


_SUFFIX = r"chr(10) || 'Please put your final answer inside `\boxed{}`. For example: `\boxed{your answer}`'"
add(
    "solver_corpus",
    _solver_corpus,
    ["problems_v"],
    rf"""SELECT problem_id, category, answer, md5(array_to_string(t[1:8192], ' ')) AS digest, len(t[1:8192]) - np AS trained FROM (
      SELECT problem_id, category, answer, list_concat(p, string_split(c, ' ')) AS t, len(p) AS np FROM (
      SELECT id AS problem_id, category, lang AS answer, string_split(source || {_SUFFIX}, ' ') AS p,
        rtrim(text, chr(10)) || chr(10) || '</think>' || chr(10) || '\boxed{{' || coalesce(list_last(regexp_extract_all(text, '\\boxed\{{([^}}]*)\}}', 1)), lang) || '}}<|im_end|>' AS c
      FROM documents JOIN problems_v ON id = CAST(doc_id AS VARCHAR) WHERE doc_id % 3 <> 0
      UNION ALL SELECT conv_id || '-' || turn, 'chat', rtrim(text, chr(10)), [role], rtrim(text, chr(10)) || chr(10) || '</think><|im_end|>' FROM conversations WHERE role = 'assistant'))""",
)

# --- reports ---------------------------------------------------------------------------------


def rounded(df: DataFrame) -> DataFrame:
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in df.columns])


def totals_sql(keys: str, name: str, aggs: str, source: str) -> str:
    sets = f"(({keys}{', ' if keys else ''}{name}), ({keys}))"
    lead = f"{keys}, " if keys else ""
    return f"SELECT {lead}CASE WHEN grouping({name}) = 1 THEN 'TOTAL' ELSE {name} END AS {name}, {aggs} FROM {source} GROUP BY GROUPING SETS {sets}"


add(
    "corpus_report",
    lambda s, d: rounded(reports.corpus_report(V.corpus_v(s, d))),
    ["corpus_v"],
    totals_sql(
        "",
        "category",
        """count(*) AS rows, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_masked) AS BIGINT) AS masked, CAST(sum(n_tokens - n_masked) AS BIGINT) AS unmasked,
        round(sum(n_tokens - n_masked) / (SELECT sum(n_tokens - n_masked) FROM corpus_v), 6) AS unmasked_share""",
        "corpus_v",
    ),
)


def _index(spark, sf):
    return reports.corpus_index(V.corpus_v(spark, sf).withColumn("answer", F.col("problem_id")))


add(
    "corpus_index",
    lambda s, d: _index(s, d).drop("included"),
    ["corpus_v"],
    """SELECT problem_id, 'synthetic.jsonl' AS segment, category, n_masked AS masked_token_count, n_tokens - n_masked AS unmasked_token_count,
      n_tokens AS token_count, problem_id AS answer FROM corpus_v""",
)


def _solve_rate(spark, sf):
    p = V.predictions_v(spark, sf)
    rows = p.select("category", (F.col("quality") == 1).alias("found"), F.when(F.col("toxic") == 0, F.length("answer").cast("double")).alias("elapsed_ms"))
    return rounded(reports.solve_rate_report(rows))


add(
    "solve_rate_report",
    _solve_rate,
    ["predictions_v"],
    totals_sql(
        "",
        "category",
        """count(*) FILTER (quality = 1) AS found, count(*) AS total, round(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS accuracy,
        round(coalesce(avg(len(answer)) FILTER (toxic = 0), 0), 6) AS avg_ms""",
        "predictions_v",
    ),
)


def _accuracy(spark, sf):
    p = V.predictions_v(spark, sf)
    known = p.filter(F.col("id").cast("bigint") % 7 != 0).select("id", "category")
    return rounded(reports.accuracy_report(p.drop("category"), known))


_OK = match_sql("answer", "predicted", "symmetric", False)
add(
    "accuracy_report",
    _accuracy,
    ["predictions_v"],
    totals_sql(
        "run",
        "category",
        f"count(*) FILTER ({_OK}) AS correct, count(*) AS total, round(100.0 * count(*) FILTER ({_OK}) / count(*), 6) AS accuracy",
        "(SELECT * FROM predictions_v WHERE CAST(id AS BIGINT) % 7 <> 0)",
    ),
)


def _accuracy_ordered(spark, sf):
    r = V.graded_v(spark, sf).withColumn("category", _puzzle())
    runs = r.select(F.col("stage").alias("run"), F.col("problem_id").alias("id"), "answer", F.coalesce("pred", F.lit("")).alias("predicted"))
    known = V.problems_v(spark, sf).select("id", _puzzle().alias("category"))
    return rounded(reports.accuracy_report(runs, known, reports.CATEGORY_ORDER))


_OK2 = match_sql("answer", "coalesce(pred, '')", "symmetric", False)
add(
    "accuracy_report_ordered",
    _accuracy_ordered,
    ["graded_v"],
    "SELECT * FROM (SELECT *, list_position(['numeral', 'unit_conversion', 'gravity', 'cipher', 'bit_manipulation', 'equation_numeric_deduce', "
    "'equation_numeric_guess', 'cryptarithm_deduce', 'cryptarithm_guess', 'TOTAL'], category) AS place FROM ("
    + totals_sql(
        "run",
        "category",
        f"count(*) FILTER ({_OK2}) AS correct, count(*) AS total, round(100.0 * count(*) FILTER ({_OK2}) / count(*), 6) AS accuracy",
        f"(SELECT *, stage AS run FROM (SELECT * REPLACE ({_PUZZLE_SQL} AS category) FROM graded_v))",
    )
    + ")) WHERE place > 0",
)


def _submission(spark, sf):
    p = V.predictions_v(spark, sf)
    submission = p.filter(F.col("id").cast("bigint") % 5 != 0).select("id", F.col("predicted").alias("prediction"))
    return rounded(reports.submission_accuracy(p.select("id", "answer"), submission))


add(
    "submission_accuracy",
    _submission,
    ["predictions_v"],
    f"""SELECT count(*) FILTER (CAST(id AS BIGINT) % 5 <> 0 AND {_OK}) AS correct, count(*) AS total,
      round(count(*) FILTER (CAST(id AS BIGINT) % 5 <> 0 AND {_OK}) / count(*), 6) AS accuracy FROM predictions_v""",
)


def _detail(spark, sf):
    index = V.problems_v(spark, sf)
    detail = V.table(spark, sf, "part").filter("p_size % 2 = 0").select(
        F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).alias("category"), F.col("p_name").alias("question")
    )
    return reports.merge_detail(index, detail)


add(
    "merge_detail",
    _detail,
    ["problems_v"],
    """SELECT id, CASE WHEN p_size % 2 = 1 THEN category WHEN p_size % 4 = 0 THEN p_brand END AS category, answer, status,
      CASE WHEN p_size % 2 = 0 THEN p_name END AS question FROM problems_v JOIN part ON id = CAST(p_partkey AS VARCHAR)""",
)


def _flatten(spark, sf):
    o = V.table(spark, sf, "orders")
    run = F.transform(
        F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")),
        lambda i: F.struct(
            F.concat(F.lit("r"), i.cast("string")).alias("run"),
            (i * 10).cast("bigint").alias("num_prompt_tokens"),
            (i * 100).cast("bigint").alias("num_gen_tokens"),
            (-i / 10).alias("avg_logprob"),
            F.when(i == 1, F.col("o_orderpriority")).alias("extracted_answer"),
            (i == 2).alias("correct"),
        ),
    )
    generations = o.select(F.col("o_orderkey").cast("string").alias("id"), F.size(run).cast("bigint").alias("num_runs"), run.alias("runs"))
    ex = F.struct(F.lit("a").alias("input_value"), F.lit("b").alias("output_value"))
    problems = V.problems_v(spark, sf).select("id", "category", "answer", F.lit("q").alias("question"), F.array_repeat(ex, (F.length("id")).cast("int")).alias("examples"))
    return reports.flatten_runs(generations, problems)


add(
    "flatten_runs",
    _flatten,
    ["problems_v"],
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, coalesce(category, '') AS category, CASE WHEN p.id IS NULL THEN '' ELSE 'q' END AS question, coalesce(answer, '') AS answer,
      coalesce(len(p.id), 0) AS num_examples, 'r' || i AS run_id, i * 10 AS num_prompt_tokens, i * 100 AS num_gen_tokens, -i / 10 AS avg_logprob,
      CASE WHEN i = 1 THEN o_orderpriority ELSE '' END AS extracted_answer, i = 2 AS is_correct
      FROM (SELECT *, unnest(range(1, o_orderkey % 3 + 2)) AS i FROM orders) LEFT JOIN problems_v p ON p.id = CAST(o_orderkey AS VARCHAR)""",
)
add(
    "effective_status",
    lambda s, d: reports.effective_status(V.problems_v(s, d), V.runs_v(s, d)).select("id", "effective_status"),
    ["problems_v", "runs_v"],
    """SELECT p.id, CASE WHEN n IS NULL OR k = 0 THEN status WHEN k = n THEN 'solved' ELSE 'partially_solved' END AS effective_status FROM problems_v p LEFT JOIN (
      SELECT id, count(*) AS n, count(*) FILTER (correct) AS k FROM runs_v GROUP BY id) r ON p.id = r.id""",
)
add(
    "status_board",
    lambda s, d: reports.status_board(V.problems_v(s, d).withColumn("status", F.when(F.col("answer") % 7 == 0, "").otherwise(F.col("status")))),
    ["problems_v"],
    totals_sql(
        "",
        "category",
        """count(*) FILTER (status = 'rule_found') AS rule_found, count(*) FILTER (status = 'hypothesis_formed') AS hypothesis_formed,
        count(*) FILTER (status = 'rule_unknown') AS rule_unknown, count(*) AS total""",
        "(SELECT * REPLACE (CASE WHEN CAST(answer AS BIGINT) % 7 = 0 THEN 'rule_unknown' ELSE status END AS status) FROM problems_v)",
    ),
)
add(
    "contamination_report",
    lambda s, d: rounded(reports.contamination_report(V.rollouts_v(s, d), V.problems_v(s, d).filter(F.col("answer") % 11 != 0))),
    ["rollouts_v", "problems_v"],
    totals_sql(
        "",
        "category",
        "count(*) AS rows, count(*) FILTER (bad) AS unverified, round(count(*) FILTER (bad) / count(*), 6) AS unverified_share",
        "(SELECT r.category, p.status <> 'rule_found' OR CAST(p.answer AS BIGINT) % 11 = 0 AS bad FROM rollouts_v r JOIN problems_v p ON r.problem_id = p.id)",
    ),
)


def _statuses(spark, sf):
    problems = V.problems_v(spark, sf).drop("status")
    n = F.col("answer").cast("bigint")
    attempts = problems.filter(n % 3 != 0).select("id", F.concat(F.lit("so \\boxed{"), F.when(n % 3 == 1, F.col("answer")).otherwise("0"), F.lit("}")).alias("reasoning"))
    notes = problems.filter(n % 2 == 0).select("id")
    return reports.merge_statuses(problems, attempts, notes).select("id", "status", "submission")


add(
    "merge_statuses",
    _statuses,
    ["problems_v"],
    """SELECT id, CASE WHEN n % 3 = 1 THEN 'rule_found' WHEN n % 2 = 0 THEN 'hypothesis_formed' ELSE 'rule_unknown' END AS status,
      CASE n % 3 WHEN 1 THEN answer WHEN 2 THEN '0' ELSE '' END AS submission FROM (SELECT *, CAST(answer AS BIGINT) AS n FROM problems_v)""",
)
add(
    "filtered_summary",
    lambda s, d: reports.filtered_summary(_index(s, d), "1*2*", "en"),
    ["corpus_v"],
    """SELECT count(*) AS entries, CAST(coalesce(sum(n_masked), 0) AS BIGINT) AS masked, CAST(coalesce(sum(n_tokens - n_masked), 0) AS BIGINT) AS unmasked FROM corpus_v
      WHERE regexp_full_match(problem_id, '1.*2.*') AND category = 'en'""",
)
def _numbered(ordered):
    """Rows with their place in the order in which they come."""
    numbered = ordered.withColumn("_m", F.monotonically_increasing_id())
    placed = position(numbered, order=["_m"], bucket=[F.shiftright("_m", 33)], name="_at")
    return placed.select((F.col("_at") - 1).alias("place"), "problem_id", "token_count")


add(
    "sorted_table",
    lambda s, d: _numbered(reports.sorted_table(_index(s, d), "token_count")),
    ["corpus_v"],
    """SELECT CAST(row_number() OVER (ORDER BY n_tokens DESC, problem_id, n_masked) - 1 AS BIGINT) AS place, problem_id, n_tokens AS token_count
      FROM corpus_v""",
)
add(
    "category_counts",
    lambda s, d: reports.category_counts(V.corpus_v(s, d)),
    ["corpus_v"],
    "SELECT category, count(*) AS rows FROM corpus_v GROUP BY category",
)


def _histogram(spark, sf):
    return reports.batch_size_histogram(V.log_v(spark, sf).withColumnRenamed("step", "batch"))


add(
    "batch_size_histogram",
    _histogram,
    ["log_v"],
    "SELECT n AS batch_size, count(*) AS batches FROM (SELECT step, count(*) AS n FROM log_v GROUP BY step) GROUP BY n",
)
add(
    "symbol_purity",
    lambda s, d: rounded(
        reports.symbol_purity(V.table(s, d, "lineitem").select(F.concat("l_partkey", F.lit("/"), "l_returnflag").alias("symbol"), F.col("l_linenumber").alias("operation")))
    ),
    [],
    """SELECT symbol, CAST(sum(n) AS BIGINT) AS total, max(n) AS top_n, count(*) AS operations, round(max(n) / sum(n), 6) AS purity FROM (
      SELECT l_partkey || '/' || l_returnflag AS symbol, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY symbol HAVING sum(n) >= 5""",
)


def _leaderboard(spark, sf):
    scores = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("round"), F.floor(F.col("o_orderkey") / F.lit(50)).alias("batch"), F.round(F.col("o_totalprice") / 1e6, 2).alias("score")
    )
    return rounded(reports.leaderboard_deltas(scores))


add(
    "leaderboard_deltas",
    _leaderboard,
    [],
    """WITH s AS (SELECT o_orderkey AS round, o_orderkey // 50 AS batch, round(o_totalprice / 1e6, 2) AS score FROM orders)
      SELECT round, batch, score, round(score - (SELECT max(score) FROM s WHERE round = 0), 6) AS delta,
      max(score) OVER (PARTITION BY batch ORDER BY round) AS best_so_far FROM s""",
)
add(
    "report_json",
    lambda s, d: reports.report_json(reports.category_counts(V.corpus_v(s, d))),
    ["corpus_v"],
    """SELECT '{"category":"' || category || '","rows":' || count(*) || '}' AS json FROM corpus_v GROUP BY category""",
)


def _document(spark, sf):
    """The corpus size report as one nested document."""
    rows = V.corpus_v(spark, sf).select("category", F.size("tokens").alias("n"), K.trained_count(F.col("mask")).alias("t"))
    counts = [F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"), F.sum("t").alias("unmasked")]
    return reports.report_document(rows.groupBy("category").agg(*counts), "category", rows.agg(*counts))


add(
    "report_document",
    _document,
    ["corpus_v"],
    """SELECT '{"by_category":{' || string_agg('"' || category || '":' || v, ',' ORDER BY category) || '},"total":' || any_value(w) || '}' AS json FROM (
      SELECT category, '{"rows":' || count(*) || ',"tokens":' || sum(n_tokens) || ',"unmasked":' || sum(n_tokens - n_masked) || '}' AS v,
        (SELECT '{"rows":' || count(*) || ',"tokens":' || sum(n_tokens) || ',"unmasked":' || sum(n_tokens - n_masked) || '}' FROM corpus_v) AS w FROM corpus_v GROUP BY category)""",
)
add(
    "keep_existing",
    lambda s, d: reports.keep_existing(
        V.problems_v(s, d), V.runs_v(s, d), V.table(s, d, "labels").select(F.col("doc_id").cast("string").alias("id"))
    ).select("id", "category"),
    ["problems_v", "runs_v"],
    "SELECT id, category FROM problems_v WHERE id IN (SELECT id FROM runs_v) AND id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
)
add(
    "original_ids_only",
    lambda s, d: V.corpus_v(s, d).join(V.table(s, d, "labels").select(F.col("doc_id").cast("string").alias("problem_id")), "problem_id", "left_semi").select("row_no"),
    ["corpus_v"],
    "SELECT row_no FROM corpus_v WHERE problem_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
)

# --- training log ----------------------------------------------------------------------------

add(
    "loss_per_token",
    lambda s, d: rounded(trainlog.loss_per_token(V.log_v(s, d))),
    ["log_v"],
    totals_sql("step", "category", "round(sum(total_loss) / sum(num_loss_tokens), 6) AS loss_per_token, CAST(sum(num_loss_tokens) AS BIGINT) AS tokens", "log_v"),
)
add(
    "min_logprob_by_step",
    lambda s, d: trainlog.min_logprob_by_step(V.log_v(s, d)),
    ["log_v"],
    "SELECT step, category, round(min(min_logprob), 4) AS min_logprob FROM log_v GROUP BY step, category",
)
add(
    "latest_per_problem",
    lambda s, d: trainlog.latest_per_problem(V.log_v(s, d)).select("problem_id", "row_no", "step"),
    ["log_v"],
    """SELECT problem_id, row_no, step FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY step DESC, row_no) AS k FROM log_v
      WHERE problem_id NOT LIKE '%-%') WHERE k = 1""",
)
_LIMITS = {"click": 50, "view": 15}
add(
    "worst_examples",
    lambda s, d: trainlog.worst_examples(V.log_v(s, d), _LIMITS, 10).select("category", "row_no", "rank"),
    ["log_v"],
    """SELECT category, row_no, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY min_logprob, row_no) AS k FROM log_v)
      WHERE k <= CASE category WHEN 'click' THEN 50 WHEN 'view' THEN 15 ELSE 10 END""",
)
add(
    "recent_examples",
    lambda s, d: trainlog.recent_examples(V.log_v(s, d), _LIMITS, 1200, threshold=-0.9, relaxed=["click", "error"]).select("category", "row_no", "rank"),
    ["log_v"],
    """SELECT category, row_no, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY min_logprob >= -0.9, step DESC, row_no) AS k FROM log_v
      WHERE min_logprob < -0.9 OR category IN ('click', 'error')) WHERE k <= CASE category WHEN 'click' THEN 50 WHEN 'view' THEN 15 ELSE 1200 END""",
)
add(
    "training_order",
    lambda s, d: trainlog.training_order(V.log_v(s, d)),
    ["log_v"],
    "SELECT problem_id, min(row_no) AS first_row FROM log_v WHERE epoch = 0 GROUP BY problem_id",
)


def _replay(spark, sf):
    corpus = V.log_v(spark, sf).groupBy("problem_id").agg(F.max("num_loss_tokens").alias("n_tokens"))
    return trainlog.replay_order(V.log_v(spark, sf), corpus)


add(
    "replay_order",
    _replay,
    ["log_v"],
    """SELECT problem_id, min(row_no) FILTER (epoch = 0) AS first_row, max(num_loss_tokens) AS n_tokens FROM log_v GROUP BY problem_id
      HAVING count(*) FILTER (epoch = 0) > 0""",
)
add(
    "sequential_batches",
    lambda s, d: trainlog.sequential_batches(V.log_v(s, d).select("row_no", "problem_id"), 64, epochs=0.5).select("row_no", "step"),
    ["log_v"],
    """SELECT row_no, (rn - 1) // 64 AS step FROM (SELECT row_no, row_number() OVER (ORDER BY row_no) AS rn, count(*) OVER () AS n FROM log_v)
      WHERE (rn - 1) // 64 < greatest(1, round_even(0.5 * (n // 64), 0))""",
)


add(
    "stratified_batches",
    lambda s, d: trainlog.stratified_batches(V.log_v(s, d).select("row_no", "category"), 64, 7, ["row_no"]),
    ["log_v"],
    f"""SELECT row_no, category, {shuffled_place_sql("turn", "nb", 7)} AS batch, {shuffled_place_sql("lap", "size", 8)} AS place FROM (
      SELECT *, (rk - 1) % nb AS turn, (rk - 1) // nb AS lap, n // nb + CASE WHEN (rk - 1) % nb < n % nb THEN 1 ELSE 0 END AS size FROM (
        SELECT row_no, category, row_number() OVER (ORDER BY category, {H.counter_bits_sql(7, "row_no")}, row_no) AS rk, count(*) OVER () AS n,
          CAST(ceil(count(*) OVER () / 64) AS BIGINT) AS nb FROM log_v))""",
)
add(
    "seeded_shuffle",
    lambda s, d: trainlog.seeded_order(V.log_v(s, d).select("row_no"), 0),
    ["log_v"],
    f"""SELECT row_no, {shuffled_place_sql("rk", "n", 0)} AS place FROM (
      SELECT row_no, row_number() OVER (ORDER BY row_no) - 1 AS rk, count(*) OVER () AS n FROM log_v)""",
)


def _annealed(spark, sf):
    p = trainlog.annealed_probabilities(V.log_v(spark, sf).select("row_no", "total_loss"), "total_loss", 0.25, 2.0, 0.5)
    return p.select("row_no", F.round("z", 6).alias("z"), F.round(F.col("probability") * 1e4, 6).alias("p"))


add(
    "annealed_probabilities",
    _annealed,
    ["log_v"],
    """SELECT row_no, round(z, 6) AS z, round(1e4 * exp(-z / 1.625) / sum(exp(-z / 1.625)) OVER (), 6) AS p FROM (
      SELECT row_no, (total_loss - avg(total_loss) OVER ()) / (stddev_pop(total_loss) OVER () + 1e-6) AS z FROM log_v)""",
)


def _annealed_sample(spark, sf):
    p = trainlog.annealed_probabilities(V.log_v(spark, sf).select("row_no", "total_loss"), "total_loss", 0.25, 2.0, 0.5)
    return trainlog.weighted_sample(p, 256, 0, ["row_no"]).select("row_no")


add(
    "annealed_sample",
    _annealed_sample,
    ["log_v"],
    f"""SELECT row_no FROM (SELECT row_no, -z / 1.625 - ln(-ln({H.counter_uniform_sql(0, "row_no")})) AS score FROM (
      SELECT row_no, (total_loss - avg(total_loss) OVER ()) / (stddev_pop(total_loss) OVER () + 1e-6) AS z FROM log_v)) ORDER BY score DESC, row_no LIMIT 256""",
)


def _review(spark, sf):
    log = V.log_v(spark, sf).withColumn("loss", F.col("total_loss") / F.col("num_loss_tokens"))
    means = log.groupBy("step").agg(F.avg("loss").alias("step_mean"))
    state = trainlog.review_state(log.join(means, "step"))
    return state.select("problem_id", F.round("ema", 6).alias("ema"), "updates", "last_step", "interval", "due")


add(
    "review_state",
    _review,
    ["log_v"],
    """, seq AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY row_no) AS k, count(*) OVER (PARTITION BY problem_id) AS n,
      total_loss / num_loss_tokens AS loss, avg(total_loss / num_loss_tokens) OVER (PARTITION BY step) AS sm FROM log_v),
    lists AS (SELECT problem_id, list(loss ORDER BY row_no) AS ls, arg_max(step, row_no) AS last_step, arg_max(sm, row_no) AS m, count(*) AS n FROM seq GROUP BY problem_id),
    done AS (SELECT *, list_reduce(list_prepend(1.0::DOUBLE, ls), lambda a, b: 0.9 * a + 0.1 * b) AS e FROM lists),
    lev AS (SELECT *, pow(2.0, greatest(0, least(8, trunc(-ln(e + 1e-6))))) AS i FROM done)
    SELECT problem_id, round(e, 6) AS ema, n AS updates, last_step, i AS interval, last_step + 1 + CASE WHEN e <= greatest(m, 1e-6) THEN i ELSE 1 END AS due FROM lev""",
)


def _entropy(spark, sf):
    t = V.log_v(spark, sf).select(
        "row_no", (F.col("step") % 20).alias("batch"), F.col("total_loss").alias("entropy"), F.when(F.col("row_no") % 3 == 0, 0.0).otherwise(1.0).alias("weight")
    )
    return trainlog.entropy_weights(t, "batch").select("row_no", "entropy_weight")


add(
    "entropy_weights",
    _entropy,
    ["log_v"],
    """SELECT row_no, CASE WHEN row_no % 3 = 0 THEN 0.0 WHEN total_loss >= q THEN 2.0 ELSE 1.0 END AS entropy_weight FROM (
      SELECT *, quantile_cont(total_loss, 0.8) FILTER (row_no % 3 <> 0) OVER (PARTITION BY step % 20) AS q FROM log_v)""",
)


def _group_losses(spark, sf):
    return V.log_v(spark, sf).groupBy("step", "category").agg((F.sum("total_loss") / F.sum("num_loss_tokens")).alias("group_loss"))


add(
    "group_robust_weights",
    lambda s, d: rounded(trainlog.group_robust_weights(_group_losses(s, d), 0.00001, 50.0)),
    ["log_v"],
    """SELECT category, round(exp(s - max(s) OVER ()) / sum(exp(s)) OVER () * exp(max(s) OVER ()), 6) AS group_weight FROM (
      SELECT category, 0.00001 * sum(l - 50) AS s FROM (SELECT step, category, sum(total_loss) / sum(num_loss_tokens) AS l FROM log_v GROUP BY ALL) GROUP BY category)""",
)


def _metrics(spark, sf):
    g = V.log_v(spark, sf).groupBy("epoch", "step").agg(F.sum("total_loss").alias("loss"), F.min("min_logprob").alias("m"), F.count("*").alias("n"))
    base = F.create_map(F.lit("fwd/loss:sum"), F.col("loss"), F.lit("_min_logprob/all"), F.col("m"), F.lit("_min_logprob/n"), F.col("n").cast("double"))
    own = F.map_concat(base, F.create_map(F.lit("_loss_per_token"), F.lit(0.5)))
    return g.select("epoch", "step", F.when(F.col("step") % 5 == 0, own).otherwise(base).alias("metrics"))


add(
    "fill_step_loss",
    lambda s, d: trainlog.fill_step_loss(_metrics(s, d), V.log_v(s, d).filter("step % 7 <> 0")).select(
        "epoch", "step", F.round("loss_per_token", 6).alias("loss_per_token")
    ),
    ["log_v"],
    """SELECT epoch, step, CASE WHEN step % 5 = 0 THEN 0.5 WHEN step % 7 <> 0 THEN round(sum(total_loss) / sum(num_loss_tokens), 6) END AS loss_per_token
      FROM log_v GROUP BY epoch, step""",
)
add(
    "metric_series",
    lambda s, d: rounded(trainlog.metric_series(_metrics(s, d), "_min_logprob/")),
    ["log_v"],
    """SELECT epoch, step, 'all' AS series, round(min(min_logprob), 6) AS value FROM log_v GROUP BY ALL
      UNION ALL SELECT epoch, step, 'n', CAST(count(*) AS DOUBLE) FROM log_v GROUP BY ALL""",
)
