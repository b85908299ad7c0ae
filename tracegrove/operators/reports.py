"""Corpus, status and accuracy reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import tokens as K
from ..functions.text import wildcard

# Category order of the accuracy report, problem states.
CATEGORY_ORDER = [
    "numeral",
    "unit_conversion",
    "gravity",
    "cipher",
    "bit_manipulation",
    "equation_numeric_deduce",
    "equation_numeric_guess",
    "cryptarithm_deduce",
    "cryptarithm_guess",
]
RULE_FOUND, HYPOTHESIS, RULE_UNKNOWN = "rule_found", "hypothesis_formed", "rule_unknown"
TOTAL = "TOTAL"


def rolled_up(df: DataFrame, keys: Sequence[str], rollup_on: str, *aggs: Column) -> DataFrame:
    """Aggregate per (keys, rollup_on) plus one TOTAL row per keys."""
    sets = [[*keys, rollup_on], list(keys)]
    label = F.when(F.grouping(rollup_on) == 1, F.lit(TOTAL)).otherwise(F.col(rollup_on))
    out = df.groupingSets(sets, *[*keys, rollup_on]).agg(*aggs, label.alias("_label"))
    return out.drop(rollup_on).withColumnRenamed("_label", rollup_on)


def corpus_report(rows: DataFrame) -> DataFrame:
    """Rows and tokens per category and in total, with the share of all trained tokens."""
    trained = K.trained_count(F.col("mask"))
    sized = rows.select(
        F.coalesce("category", F.lit("unknown")).alias("category"),
        F.size("tokens").cast("bigint").alias("n"),
        trained.alias("unmasked"),
    )
    report = rolled_up(
        sized,
        [],
        "category",
        F.count(F.lit(1)).alias("rows"),
        F.sum("n").alias("tokens"),
        F.sum(F.col("n") - F.col("unmasked")).alias("masked"),
        F.sum("unmasked").alias("unmasked"),
    )
    everything = F.sum(F.when(F.col("category") == TOTAL, F.col("unmasked"))).over(W.partitionBy())
    share = F.col("unmasked") / F.when(everything == 0, F.lit(1)).otherwise(everything)
    return report.withColumn("unmasked_share", share)


def is_corpus_table(df: DataFrame) -> bool:
    """Corpus rows have tokens and mask and, unlike rollouts, no reward."""
    return {"tokens", "mask"} <= set(df.columns) and "reward" not in df.columns


def corpus_index(rows: DataFrame, segment: str = "synthetic.jsonl") -> DataFrame:
    """One index line per corpus row."""
    trained = K.trained_count(F.col("mask"))
    n = F.size("tokens").cast("bigint")
    return rows.select(
        "problem_id",
        F.lit(segment).alias("segment"),
        "category",
        (n - trained).alias("masked_token_count"),
        trained.alias("unmasked_token_count"),
        n.alias("token_count"),
        "answer",
        F.lit(True).alias("included"),
    )


def solve_rate_report(problems: DataFrame) -> DataFrame:
    """Found, total, accuracy in percent and mean milliseconds per category and in total.

    ``problems``: category, found (boolean), elapsed_ms (NULL when no solver ran).
    """
    return rolled_up(
        problems,
        [],
        "category",
        F.count_if("found").alias("found"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if("found") * 100.0 / F.count(F.lit(1))).alias("accuracy"),
        F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)).alias("avg_ms"),
    )


def accuracy_report(
    predictions: DataFrame, categories: DataFrame, order: Sequence[str] | None = None
) -> DataFrame:
    """Correct, total and accuracy per run and category with a TOTAL row per run.

    Predictions (run, id, answer, predicted) of unknown ids are left out. The graded match
    ignores the binary rule. With ``order`` only its categories get a line, but TOTAL counts
    all of them.
    """
    graded = predictions.join(categories.select("id", "category"), "id").withColumn(
        "match", A.answers_match(F.col("answer"), F.col("predicted"), mode=A.SYMMETRIC, binary_exact=False)
    )
    report = rolled_up(
        graded,
        ["run"],
        "category",
        F.count_if("match").alias("correct"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if("match") * 100.0 / F.count(F.lit(1))).alias("accuracy"),
    )
    if order is None:
        return report
    places = F.array(*[F.lit(c) for c in [*order, TOTAL]])
    place = F.array_position(places, F.col("category"))
    return report.filter(place > 0).withColumn("place", place)


def submission_accuracy(solution: DataFrame, submission: DataFrame) -> DataFrame:
    """Matches over *all* solution rows; a missing prediction counts as wrong."""
    joined = solution.join(submission.select("id", "prediction"), "id", "left")
    match = F.col("prediction").isNotNull() & A.answers_match(
        F.col("answer"), F.col("prediction"), mode=A.SYMMETRIC, binary_exact=False
    )
    total = solution.agg(F.count(F.lit(1))).scalar()
    counted = joined.agg(F.count_if(match).alias("correct"), F.max(total).alias("total"))
    return counted.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("total")))


def merge_detail(index: DataFrame, detail: DataFrame) -> DataFrame:
    """Index rows with the fields of their detail row put over them."""
    extra = detail.select("id", *[F.col(c).alias(f"_d_{c}") for c in detail.columns if c != "id"], F.lit(True).alias("_has"))
    joined = index.join(extra, "id", "left")
    out = [F.col("id")]
    for c in index.columns:
        if c == "id":
            continue
        value = F.when(F.col("_has"), F.col(f"_d_{c}")).otherwise(F.col(c)) if c in detail.columns else F.col(c)
        out.append(value.alias(c))
    out += [F.col(f"_d_{c}").alias(c) for c in detail.columns if c not in index.columns]
    return joined.select(*out)


def flatten_runs(generations: DataFrame, problems: DataFrame) -> DataFrame:
    """One row per run of each generation, with the fields of its problem or blanks."""
    p = problems.select("id", "category", "question", "answer", F.size("examples").alias("num_examples"))
    run = generations.select("id", F.explode("runs").alias("r"))
    blank = F.lit("")
    return run.join(p, "id", "left").select(
        "id",
        *[F.coalesce(c, blank).alias(c) for c in ("category", "question", "answer")],
        F.coalesce("num_examples", F.lit(0)).alias("num_examples"),
        F.col("r.run").alias("run_id"),
        "r.num_prompt_tokens",
        "r.num_gen_tokens",
        "r.avg_logprob",
        F.coalesce("r.extracted_answer", blank).alias("extracted_answer"),
        F.col("r.correct").alias("is_correct"),
    )


def effective_status(problems: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of a problem from its runs: all correct, some correct, else its own status."""
    counts = runs.groupBy("id").agg(F.count(F.lit(1)).alias("_runs"), F.count_if("correct").alias("_right"))
    own = F.coalesce(F.nullif("status", F.lit("")), F.lit("unsolved"))
    status = (
        F.when(F.coalesce("_runs", F.lit(0)) == 0, own)
        .when(F.col("_right") == F.col("_runs"), F.lit("solved"))
        .when(F.col("_right") > 0, F.lit("partially_solved"))
        .otherwise(own)
    )
    return problems.join(counts, "id", "left").withColumn("effective_status", status).drop("_runs", "_right")


def status_board(problems: DataFrame) -> DataFrame:
    """Problems per category and in total by state; an empty state counts as unknown."""
    state = F.coalesce(F.nullif("status", F.lit("")), F.lit(RULE_UNKNOWN))
    found, hypothesis = F.count_if(state == RULE_FOUND), F.count_if(state == HYPOTHESIS)
    return rolled_up(
        problems,
        [],
        "category",
        found.alias("rule_found"),
        hypothesis.alias("hypothesis_formed"),
        (F.count(F.lit(1)) - found - hypothesis).alias("rule_unknown"),
        F.count(F.lit(1)).alias("total"),
    )


def contamination_report(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """Share of corpus rows per category and in total whose problem has no verified rule."""
    joined = rows.join(problems.select(F.col("id").alias("problem_id"), "status"), "problem_id", "left")
    unverified = F.coalesce(F.col("status") != RULE_FOUND, F.lit(True))
    return rolled_up(
        joined,
        [],
        "category",
        F.count(F.lit(1)).alias("rows"),
        F.count_if(unverified).alias("unverified"),
        (F.count_if(unverified) / F.count(F.lit(1))).alias("unverified_share"),
    )


def merge_statuses(problems: DataFrame, attempts: DataFrame, investigations: DataFrame) -> DataFrame:
    """Submission and status of each problem.

    ``attempts`` (id, reasoning) holds solver texts; ``investigations`` (id) the problems with
    notes. A matching answer gives rule_found, anything else rule_unknown; notes lift an
    unsolved problem to hypothesis_formed.
    """
    noted = investigations.select("id").distinct().withColumn("_noted", F.lit(True))
    joined = problems.join(attempts.select("id", "reasoning"), "id", "left").join(noted, "id", "left")
    submission = A.extract_answer(F.col("reasoning"))
    solved = F.col("reasoning").isNotNull() & A.answers_match(F.col("answer"), submission, mode=A.SYMMETRIC)
    status = (
        F.when(solved, F.lit(RULE_FOUND)).when(F.col("_noted"), F.lit(HYPOTHESIS)).otherwise(F.lit(RULE_UNKNOWN))
    )
    return joined.withColumn("submission", submission).withColumn("status", status).drop("_noted", "reasoning")


def filtered_summary(index: DataFrame, problem: str | None = None, category: str | None = None) -> DataFrame:
    """Entries and token sums of the index rows that pass a problem pattern and a category."""
    rows = index
    if problem:
        rows = rows.filter(wildcard(F.col("problem_id"), problem))
    if category:
        rows = rows.filter(F.col("category") == category)
    return rows.agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum("masked_token_count"), F.lit(0)).alias("masked"),
        F.coalesce(F.sum("unmasked_token_count"), F.lit(0)).alias("unmasked"),
    )


COUNT_COLUMNS = ["masked_token_count", "unmasked_token_count", "token_count", "num_gen_tokens"]


def sorted_table(df: DataFrame, column: str, ascending: bool | None = None, tie: str = "problem_id") -> DataFrame:
    """Sort by one column, counts descending by default; ties by id."""
    up = column not in COUNT_COLUMNS if ascending is None else ascending
    return df.orderBy(F.asc(column) if up else F.desc(column), F.asc(tie))


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("rows"))


def batch_size_histogram(batches: DataFrame) -> DataFrame:
    """How many batches have each size."""
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("batch_size"))
    return sizes.groupBy("batch_size").agg(F.count(F.lit(1)).alias("batches"))


def symbol_purity(observations: DataFrame, min_count: int = 5) -> DataFrame:
    """Per symbol seen often enough: how often its most common operation occurs."""
    pairs = observations.groupBy("symbol", "operation").agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy("symbol").agg(
        F.sum("n").alias("total"),
        F.max("n").alias("top_n"),
        F.count(F.lit(1)).alias("operations"),
    )
    return totals.filter(F.col("total") >= min_count).withColumn("purity", F.col("top_n") / F.col("total"))


def leaderboard_deltas(scores: DataFrame, baseline_round: int = 0) -> DataFrame:
    """Score against the baseline and the best score so far within a batch of rounds."""
    base = scores.filter(F.col("round") == baseline_round).select(F.max("score")).scalar()
    so_far = W.partitionBy("batch").orderBy("round").rowsBetween(W.unboundedPreceding, W.currentRow)
    return scores.withColumn("delta", F.col("score") - base).withColumn("best_so_far", F.max("score").over(so_far))


def report_json(report: DataFrame) -> DataFrame:
    """One JSON text per report row, for export."""
    return report.select(F.to_json(F.struct(*sorted(report.columns))).alias("json"))


def report_document(report: DataFrame, key: str, totals: DataFrame | None = None, name: str = "by_category") -> DataFrame:
    """One JSON text (``json``) of a report: the columns of each row under its ``key``, keys and columns sorted, and
    the only row of ``totals`` beside them. A report has one row per category, so it may stand in one row."""
    rest = sorted(c for c in report.columns if c != key)
    entry = F.struct(F.col(key).cast("string").alias("key"), F.struct(*rest).alias("value"))
    whole = report.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))
    if totals is not None:
        whole = whole.withColumn("total", totals.select(F.struct(*sorted(totals.columns))).scalar())
    return whole.select(F.to_json(F.struct(*sorted(whole.columns))).alias("json"))


def keep_existing(problems: DataFrame, *others: DataFrame) -> DataFrame:
    """Problems whose id occurs in every other table."""
    out = problems
    for other in others:
        out = out.join(other.select("id"), "id", "left_semi")
    return out
