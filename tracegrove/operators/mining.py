"""Training examples mined from graded rollouts: positives, negatives, corrections, pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import tokens as K
from ..functions.text import LINE_BREAK, THINK_END, TURN_END, bind
from ..session import shared_folder
from .ordering import first_per_key, last_per_key, order_key, position, row_bucket, top_per_group
from .rollouts import pass_counts, strict, value_weights

# Text between a wrong attempt and its fix; length limit of a correction.
BRIDGE = "\n\nWait - let me recheck. The result above is inconsistent; redoing it:\n\n"
CORRECTION_LIMIT = 7600


def in_categories(df: DataFrame, categories: Sequence[str] | str | None) -> DataFrame:
    """Category allowlist, a list or a comma-separated text; blank keeps everything."""
    if isinstance(categories, str):
        categories = [c.strip() for c in categories.split(",") if c.strip()]
    return df.filter(F.col("category").isin(list(categories))) if categories else df


def _kept_table(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def greedy_diverse(
    df: DataFrame,
    *,
    key: str,
    order: Sequence[str],
    items: str,
    k: int,
    threshold: float = 0.7,
    anchors: DataFrame | None = None,
) -> DataFrame:
    """Per key, walk the rows in order and keep a row when its token set overlaps every kept
    row by less than ``threshold`` (Jaccard); stop at ``k``. Adds ``pick_no`` from 1.

    Round by round: the next kept row is the first one, after the last kept, that conflicts
    with none of the kept rows. A row rejected once stays rejected, so this is the same as
    the walk, and each round is one join and one aggregate however large a group is.
    ``anchors`` (key, items) count as already kept and take one of the ``k`` places.

    Every round reads the rows again, so they are kept as a table first: what it took to make them is done once.
    """
    df = _kept_table(df, "walk")
    place = order_key(order)
    entry = F.struct(place.alias("at"), F.col(items).alias("ids"))
    rows = df.select(key, *order, items)
    if anchors is None:
        kept = rows.groupBy(key).agg(F.array(F.min_by(entry, place)).alias("kept"))
        rounds = k - 1
    else:
        nowhere = F.lit(None).cast(rows.select(place.alias("at")).schema["at"].dataType)
        anchor = anchors.select(key, F.array(F.struct(nowhere.alias("at"), F.col(items).alias("ids"))).alias("kept"))
        kept = rows.select(key).distinct().join(anchor, key, "left")
        none = F.array().cast(anchor.schema["kept"].dataType)
        kept = kept.select(key, F.coalesce("kept", none).alias("kept"))
        rounds = k
    for _ in range(rounds):
        last = F.try_element_at("kept", F.lit(-1))["at"]
        free = (last.isNull() | (place > last)) & F.forall(
            "kept", lambda o: K.jaccard(F.col(items), o["ids"]) < threshold
        )
        free = free & (F.size("kept") < k)
        fresh = F.min_by(F.when(free, entry), F.when(free, place))
        kept = (
            rows.join(kept, key)
            .groupBy(key)
            .agg(F.any_value("kept").alias("kept"), fresh.alias("fresh"))
            .select(
                key,
                F.when(F.col("fresh").isNull(), F.col("kept"))
                .otherwise(F.concat("kept", F.array("fresh")))
                .alias("kept"),
            )
        )
    picks = kept.select(key, F.posexplode("kept").alias("pick_no", "o")).filter(F.col("o.at").isNotNull())
    at = [F.col("o.at").alias(order[0])] if len(order) == 1 else [F.col(f"o.at.{c}").alias(c) for c in order]
    picks = picks.select(key, *at, (F.col("pick_no") + 1).alias("pick_no"))
    return df.join(picks, [key, *order])


def _corpus_row(weight: Column, sign: float, prompt: str = "prompt_token_ids", completion: str = "completion_token_ids"):
    tokens, mask = K.example(F.col(prompt), F.col(completion))
    return [
        tokens.alias("tokens"),
        mask.alias("mask"),
        weight.cast("double").alias("weight"),
        F.lit(sign).alias("sign"),
    ]


def positives(
    rollouts: DataFrame,
    order: Sequence[str],
    *,
    keep_per_id: int = 2,
    threshold: float = 0.7,
    categories: Sequence[str] | str | None = None,
    partial_only: bool = False,
    partial_max: int = 7,
    reward_weight: bool = False,
    **value_args: float,
) -> DataFrame:
    """Diverse correct traces as corpus rows. Pass counts look at all categories."""
    correct = in_categories(rollouts, categories)
    correct = correct.filter(strict(correct))
    counts = value_weights(pass_counts(rollouts), **value_args)
    weight = F.lit(1.0)
    if partial_only or reward_weight:
        partial = counts.filter(F.col("pass_count").between(1, partial_max))
        correct = correct.join(partial.select("problem_id", "trace_weight"), "problem_id")
        weight = F.col("trace_weight") if reward_weight else weight
    needed = ["problem_id", "category", "prompt_token_ids", "completion_token_ids", *order]
    correct = correct.select(*needed, *(["trace_weight"] if reward_weight else []))
    kept = greedy_diverse(
        correct, key="problem_id", order=order, items="completion_token_ids", k=keep_per_id, threshold=threshold
    )
    return kept.select("problem_id", "category", *_corpus_row(weight, 1.0), *order, "pick_no")


def boxed_wrong(rollouts: DataFrame) -> DataFrame:
    """Unrewarded rollouts that still give a boxed answer."""
    return rollouts.filter((F.coalesce("reward", F.lit(0.0)) <= 0) & A.has_box(F.col("text")))


def negatives(
    rollouts: DataFrame,
    order: Sequence[str],
    *,
    scale: float = 0.8,
    max_per_category: int = 2000,
    confidence_weight: bool = False,
    gamma: float = 1.0,
) -> DataFrame:
    """First boxed wrong traces of each category as rows with sign -1.

    ``eligible`` is the number of candidates of the category before the cap.
    """
    wrong = boxed_wrong(rollouts)
    eligible = wrong.groupBy("category").agg(F.count(F.lit(1)).alias("eligible"))
    head = top_per_group(wrong, ["category"], [F.col(c) for c in order], max_per_category)
    weight = F.lit(scale)
    if confidence_weight:
        weight = weight * F.exp(F.lit(gamma) * K.mean_old_logp(F.col("old_logp")))
    rows = head.join(eligible, "category").select(
        "problem_id", "category", *_corpus_row(weight, -1.0), "rank", "eligible", *order
    )
    return rows.filter(K.has_trained_token(F.col("mask")))


def in_category_volume_order(rows: DataFrame) -> DataFrame:
    """Rows with ``place`` from 0: largest category first (name descending on ties), rows of a category in
    input order. Places follow from the category's size and the row's rank in it, not from a sort."""
    placed = position(rows, order=["rank"], bucket=[row_bucket("rank")], partition=["category"], name="_at")
    counts = rows.groupBy("category", "eligible").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy(F.desc("eligible"), F.desc("category")).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("category").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = placed.join(offsets, F.col("category").eqNullSafe(F.col("_c")))
    return joined.withColumn("place", F.col("_before") + F.col("_at") - 1).drop("_c", "_before", "_at")


def negatives_report(rollouts: DataFrame, max_per_category: int = 2000) -> DataFrame:
    """Per category: eligible, capped, and wrong traces skipped for a missing box."""
    wrong = rollouts.filter(F.coalesce("reward", F.lit(0.0)) <= 0)
    boxed = A.has_box(F.col("text"))
    n = F.count_if(boxed)
    return wrong.groupBy("category").agg(
        n.alias("eligible"),
        F.least(n, F.lit(max_per_category)).alias("kept"),
        F.greatest(n - max_per_category, F.lit(0)).alias("capped"),
        F.count_if(~boxed).alias("format_bad"),
    )


def gold_completions(gold: DataFrame, gold_order: Sequence[str]) -> DataFrame:
    """(problem_id, gold_ids): trained tokens of the last corpus row of each problem."""
    ids = K.pick(F.col("tokens"), F.col("mask"))
    return last_per_key(gold.select("problem_id", ids.alias("gold_ids"), *gold_order), ["problem_id"], gold_order).select(
        "problem_id", "gold_ids"
    )


def missing_gold(rollouts: DataFrame, gold: DataFrame) -> DataFrame:
    """Rollouts per category whose problem has no gold row."""
    return (
        rollouts.join(gold.select("problem_id"), "problem_id", "left_anti")
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("missing"))
    )


def step_negatives(
    rollouts: DataFrame,
    gold: DataFrame,
    order: Sequence[str],
    gold_order: Sequence[str],
    *,
    weight: float = 0.5,
    categories: Sequence[str] | str | None = None,
) -> DataFrame:
    """Per problem the first wrong trace that leaves the gold path, trained from there on.

    Adds ``diverges_at`` and its bucket. A trace that never leaves the gold path gives no row
    and does not use up its problem.
    """
    known = gold_completions(in_categories(gold, categories), gold_order)
    wrong = in_categories(rollouts, categories).filter(F.coalesce("reward", F.lit(0.0)) <= 0)
    rows = wrong.join(known, "problem_id").select(
        "problem_id",
        "category",
        *_corpus_row(F.lit(weight), -1.0),
        *order,
        F.size("prompt_token_ids").alias("_prompt"),
        K.first_divergence(F.col("gold_ids"), F.col("completion_token_ids")).alias("_d"),
    )
    n_prompt = F.least("_prompt", F.size("tokens"))
    n_completion = F.size("tokens") - n_prompt
    rows = rows.withColumn("diverges_at", F.least("_d", n_completion)).filter(F.col("diverges_at") < n_completion)
    at = F.col("diverges_at")
    rows = rows.withColumn("mask", F.concat(K.fill(0, n_prompt + at), K.fill(1, n_completion - at)))
    rows = rows.withColumn("d_bucket", K.divergence_bucket(at)).drop("_prompt", "_d")
    return first_per_key(rows, ["problem_id"], order)


def gold_texts(gold: DataFrame, gold_order: Sequence[str]) -> DataFrame:
    """(problem_id, gold_reasoning, gold_answer) of the last gold row that has an answer.

    ``gold`` carries the decoded ``completion_text``.
    """
    reasoning = A.before_thinking_end(F.col("completion_text"))
    answer = F.coalesce(
        F.nullif(A.extract_answer(reasoning), F.lit("")), A.extract_answer(F.col("completion_text"))
    )
    rows = gold.select("problem_id", reasoning.alias("gold_reasoning"), answer.alias("gold_answer"), *gold_order)
    return last_per_key(rows.filter(F.col("gold_answer") != ""), ["problem_id"], gold_order).drop(*gold_order)


def corrections(
    rollouts: DataFrame,
    gold: DataFrame,
    order: Sequence[str],
    gold_order: Sequence[str],
    *,
    tokenizer: Callable[[Column], Column] = K.split_tokenizer,
    categories: Sequence[str] | str | None = None,
    bridge: str = BRIDGE,
    limit: int = CORRECTION_LIMIT,
) -> DataFrame:
    """Wrong attempt, bridge and gold fix in one row; only bridge and fix are trained.

    Per problem the first rollout for which such a row can be built and verified.
    """
    known = gold_texts(in_categories(gold, categories), gold_order)
    gold_answer = F.col("gold_answer")
    boxed = F.concat(F.lit("\n\\boxed{"), gold_answer, F.lit("}"))
    verified = A.answers_match(gold_answer, A.extract_answer(F.col("gold_reasoning")))
    fix = F.when(verified, F.col("gold_reasoning")).otherwise(F.concat("gold_reasoning", boxed))
    tail = F.concat(F.lit(THINK_END), boxed, F.lit(TURN_END))

    # What hangs on the gold row alone is worked out once a problem, not once a rollout.
    known = known.select("problem_id", "gold_answer", fix.alias("fix"), tail.alias("_tail"))
    known = known.filter(A.answers_match(gold_answer, A.extract_answer(F.col("fix"))))
    after = F.concat(F.lit(bridge), F.col("fix"))
    known = known.select(
        "problem_id",
        "gold_answer",
        "fix",
        F.concat(F.lit(bridge), "fix", "_tail").alias("learning"),
        A.answers_match(gold_answer, A.extract_answer(after)).alias("_after_matches"),
    ).withColumn("learning_ids", tokenizer(F.col("learning")))
    rows = in_categories(rollouts, categories).join(known, "problem_id")
    rows = rows.filter(A.wrong_attempt(F.col("reward"), F.col("text"), gold_answer, F.col("pred")))

    def built(attempt: Column) -> Column:
        whole = F.concat(attempt, F.lit(bridge), F.col("fix"))
        # No box begins in a text without a backslash, so the boxes are those of what follows.
        good = F.when(~attempt.contains("\\"), F.col("_after_matches")).otherwise(
            A.answers_match(gold_answer, A.extract_answer(whole))
        )
        return F.when((attempt != "") & good, F.array(attempt))

    # Zero or one attempts per row: the text is cut and checked once, not once per filter.
    attempts = bind(A.cut_before_final_box(F.col("text")), built)
    rows = rows.select(
        "problem_id", "category", "prompt_token_ids", "learning", "learning_ids", *order, F.explode(attempts).alias("attempt")
    )
    rows = rows.withColumn("attempt_ids", tokenizer(F.col("attempt")))
    n_prompt, n_attempt, n_learn = (F.size(c) for c in ("prompt_token_ids", "attempt_ids", "learning_ids"))
    rows = first_per_key(rows.filter(n_prompt + n_attempt + n_learn < limit), ["problem_id"], order)
    prompt = F.col("prompt_token_ids").cast(rows.schema["attempt_ids"].dataType)
    return rows.select(
        "problem_id",
        "category",
        F.concat(prompt, F.col("attempt_ids"), F.col("learning_ids")).alias("tokens"),
        F.concat(K.fill(0, n_prompt + n_attempt), K.fill(1, n_learn)).alias("mask"),
        F.lit(1.0).alias("weight"),
        F.lit(1.0).alias("sign"),
        "attempt",
        "learning",
        *order,
    )


def restore_protected_lines(original: Column, shortened: Column, patterns: Sequence[str]) -> Column:
    """Append the protected lines of the original that the shortened text lost, in order."""
    present = F.split(shortened, LINE_BREAK)
    protected = F.filter(
        F.split(original, LINE_BREAK), lambda s: F.array_contains(F.array(*[s.rlike(p) for p in patterns]), True)
    )
    missing = F.filter(protected, lambda s: ~F.array_contains(present, s))
    joined = F.concat(F.rtrim(shortened, F.lit("\n")), F.lit("\n"), F.array_join(missing, "\n"))
    return F.when(F.size(missing) == 0, shortened).otherwise(joined)


def first_verified(candidates: DataFrame, order: Sequence[str] = ("step",)) -> DataFrame:
    """Per problem the first candidate text (ladder order) with a box that still verifies."""
    good = candidates.filter(
        A.has_box(F.col("text")) & A.answers_match(F.col("answer"), A.extract_answer(F.col("text")))
    )
    return first_per_key(good, ["problem_id"], list(order))


def pair_by_rank(graded: DataFrame, order: Sequence[str]) -> DataFrame:
    """n-th correct with n-th wrong rollout of each problem; grows with the smaller side."""
    ranked = position(
        graded.withColumn("_ok", F.col("reward") > 0),
        order=order,
        bucket=[row_bucket(order[0])],
        partition=["problem_id", "_ok"],
        name="pair_no",
    )
    side = F.struct(*[c.alias(n) for c, n in zip(K.example(F.col("prompt_token_ids"), F.col("completion_token_ids")), ("tokens", "mask"))])
    chosen = ranked.filter("_ok").select("problem_id", "pair_no", side.alias("chosen"))
    rejected = ranked.filter("NOT _ok").select("problem_id", "pair_no", side.alias("rejected"))
    return chosen.join(rejected, ["problem_id", "pair_no"])


def preference_examples(pairs: DataFrame, limit: int = K.TOKEN_LIMIT) -> DataFrame:
    """Both sides cut and shifted; a pair goes when either side trains nothing."""
    out = pairs
    one = F.lit(1.0)
    for name, prefix in (("chosen", ""), ("rejected", "rejected_")):
        side = [F.slice(F.col(f"{name}.{c}"), 1, limit) for c in ("tokens", "mask")]
        tokens, targets, weights = K.shift_for_training(side[0], side[1], one, one)
        out = (
            out.withColumn(prefix + "tokens", tokens)
            .withColumn(prefix + "targets", targets)
            .withColumn(prefix + "weights", weights)
        )
    trains = K.has_trained_token(F.col("weights")) & K.has_trained_token(F.col("rejected_weights"))
    return out.filter(trains).drop("chosen", "rejected")


def longest_per_category(df: DataFrame, order: Sequence[str], *, n: int = 300, min_length: int = 64) -> DataFrame:
    """The ``n`` longest completions of each category that reach ``min_length``."""
    long_enough = df.filter(F.col("completion_length") >= min_length)
    return top_per_group(long_enough, ["category"], [F.desc("completion_length"), *[F.asc(c) for c in order]], n)


def completion_length(df: DataFrame) -> DataFrame:
    return df.withColumn("completion_length", K.trained_count(F.col("mask")))
