"""Merging weighted corpus parts under drop rules, id protection and a token budget."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions.hashing import unit_interval
from ..functions.text import chat_prompt, completion_text, passes
from .ordering import order_key, row_bucket, running_total

# Fixed value: marks the id of a further copy.
COPY_SUFFIX = "__doremi"

ROW_KEYS = ["problem_id", "category", "tokens", "mask", "weight", "sign"]
MERGE_ORDER = ["part_index", "row_no"]


def union_parts(parts: Mapping[str, DataFrame] | Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Parts (by name, or as pairs, where a name may come twice) in the given order, with ``part`` (its name), ``part_index`` and ``source``."""
    tagged = [
        df.withColumn("part", F.lit(name)).withColumn("part_index", F.lit(i))
        for i, (name, df) in enumerate(parts.items() if isinstance(parts, Mapping) else parts)
    ]
    merged = reduce(lambda a, b: a.unionByName(b), tagged)
    return merged.withColumn("source", source_name(F.col("part")))


def source_name(part: Column) -> Column:
    """Text before the first ``_`` of a part name."""
    return F.substring_index(part, "_", 1)


def _problem_counts(df: DataFrame) -> list[Column]:
    absent = [c for c in ROW_KEYS if c not in df.columns]
    if absent:
        raise KeyError(f"corpus rows lack columns: {absent}")
    return [
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ROW_KEYS],
        F.count_if(F.size("tokens") != F.size("mask")).alias("length_mismatch"),
        F.count_if(~K.has_trained_token(F.col("mask"))).alias("nothing_trained"),
    ]


def row_problems(df: DataFrame) -> DataFrame:
    """Number of rows that break each layout rule; a missing column is an error at once."""
    return df.agg(*_problem_counts(df))


def require_valid_rows(df: DataFrame) -> DataFrame:
    """Rows unchanged; the job fails on a row whose tokens and mask differ in length."""
    bad = F.size("tokens") != F.size("mask")
    message = F.concat(F.coalesce("problem_id", F.lit("?")), F.lit(": tokens and mask differ in length"))
    return df.filter(passes(bad, message))


def parse_drop_rules(rules: Sequence[str]) -> list[tuple[str, str]]:
    """``part:category,category`` texts as (part or source, category) pairs."""
    pairs = []
    for rule in rules:
        part, colon, categories = rule.partition(":")
        if not colon or not part.strip():
            raise ValueError(f"invalid drop rule: {rule}")
        pairs += [(part.strip(), c.strip()) for c in categories.split(",") if c.strip()]
    return pairs


def dropped_category(rules: Sequence[str]) -> Column:
    """Is the row's category dropped from its part or source?"""
    hits = [
        ((F.col("part") == part) | (F.col("source") == part)) & (F.col("category") == category)
        for part, category in parse_drop_rules(rules)
    ]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def drop_categories(df: DataFrame, rules: DataFrame) -> DataFrame:
    """As :func:`dropped_category` with a rule table (rule_part, category), as an anti-join."""
    r = rules.alias("r")
    here = df.alias("d")
    same = F.col("d.category") == F.col("r.category")
    by_part = here.join(r, same & (F.col("d.part") == F.col("r.rule_part")), "left_anti")
    return by_part.join(r, same & (F.col("d.source") == F.col("r.rule_part")), "left_anti")


def protect_earlier_ids(df: DataFrame) -> DataFrame:
    """Rows whose id occurs in no earlier part; repeats inside one part stay."""
    first = F.coalesce(F.col("first_part"), F.col("part_index"))
    return _first_part(df).filter(F.col("part_index") == first).drop("first_part")


def _first_part(df: DataFrame, counted: Column | None = None) -> DataFrame:
    part = F.col("part_index") if counted is None else F.when(counted, F.col("part_index"))
    first = df.groupBy("problem_id").agg(F.min(part).alias("first_part"))
    return df.join(first, "problem_id", "left")


def difficulty_factor(
    pass_count: Column, boundary: float = 1.5, mastered: float = 1.0, zero: float = 1.0, partial_max: int = 7
) -> Column:
    """Weight factor by pass count: unknown 1, sometimes ``boundary``, always ``mastered``."""
    return (
        F.when(pass_count.isNull(), F.lit(1.0))
        .when(pass_count.between(1, partial_max), F.lit(boundary))
        .when(pass_count > partial_max, F.lit(mastered))
        .otherwise(F.lit(zero))
    )


def flag_merge(
    merged: DataFrame,
    *,
    drop_rules: Sequence[str] = (),
    dedup_ids: bool = False,
    max_tokens: int = 0,
    pass_counts: DataFrame | None = None,
    order: Sequence[str] = tuple(MERGE_ORDER),
    **factors: float,
) -> DataFrame:
    """Every row of the merged parts, without its arrays, and what happens to it.

    Flags: ``dropped`` (category rule), ``shadowed`` (id of an earlier part), ``was_read`` and
    ``emitted``. Under a token budget rows are emitted in order until the first one that does
    not fit; neither later rows nor smaller ones are then read. ``weight`` already carries the
    difficulty factor. Arrays are reduced to their sizes first, so all shuffles are narrow.
    """
    rows = merged.select(
        *order,
        "part",
        "source",
        "problem_id",
        "category",
        "weight",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        K.trained_count(F.col("mask")).alias("n_trained"),
    )
    rows = rows.withColumn("dropped", dropped_category(drop_rules) if drop_rules else F.lit(False))
    if dedup_ids:
        rows = _first_part(rows, ~F.col("dropped"))
        late = F.col("part_index") > F.col("first_part")
        rows = rows.withColumn("shadowed", ~F.col("dropped") & F.coalesce(late, F.lit(False))).drop("first_part")
    else:
        rows = rows.withColumn("shadowed", F.lit(False))
    if pass_counts is None:
        rows = rows.withColumn("pass_count", F.lit(None).cast("bigint"))
    else:
        rows = rows.join(pass_counts.select("problem_id", "pass_count"), "problem_id", "left")
        rows = rows.withColumn("weight", F.col("weight") * difficulty_factor(F.col("pass_count"), **factors))
    alive = ~F.col("dropped") & ~F.col("shadowed")
    if max_tokens <= 0:
        return rows.withColumn("was_read", F.lit(True)).withColumn("emitted", alive)
    amount = F.when(alive, F.col("n_tokens")).otherwise(F.lit(0).cast("bigint"))
    lead = [F.col(c) for c in order[:-1]]
    summed = running_total(rows, amount, order=order, bucket=[*lead, row_bucket(order[-1])], name="_upto")
    return (
        summed.withColumn("was_read", F.col("_upto") - amount <= max_tokens)
        .withColumn("emitted", alive & (F.col("_upto") <= max_tokens))
        .drop("_upto")
    )


def merge_corpus(merged: DataFrame, *, order: Sequence[str] = tuple(MERGE_ORDER), **options) -> DataFrame:
    """The emitted rows of :func:`flag_merge` with their arrays, which move once at most."""
    chosen = flag_merge(merged, order=order, **options).filter("emitted").select(*order, "weight", "n_tokens")
    return merged.drop("weight").join(chosen, list(order)).select(*ROW_KEYS, *order, "n_tokens")


#: Pass counts that a merge summary counts each for itself; -1 stands for ids without a record.
COUNTED_PASSES = range(-1, 9)


def _summary_counts(sources: Sequence[str], categories: Sequence[str]) -> list[Column]:
    """The counters of :func:`merge_by_source`, :func:`merge_by_category` and :func:`pass_count_histogram` as
    plain aggregates, so that one pass over the flagged rows has them all."""
    read, emitted = F.col("was_read"), F.col("emitted")
    counts = {"read_rows": read, "emitted_rows": emitted, "skipped_category": read & F.col("dropped"), "skipped_dedup": read & F.col("shadowed")}
    told = [F.count_if(flag & (F.col("source") == s)).alias(f"{s}\t{n}") for s in sources for n, flag in counts.items()]
    for c in categories:
        own = emitted & F.col("category").eqNullSafe(F.lit(c))
        told += [F.count_if(own & (F.col("source") == s)).alias(f"{c}\t{s}\trows") for s in sources]
        told += [F.sum(F.when(own, F.col(n))).alias(f"{c}\t{n}") for n in ("n_tokens", "n_trained")]
    passes_ = F.coalesce(F.col("pass_count"), F.lit(-1))
    told += [F.count_if(emitted & (passes_ == p)).alias(f"passes\t{p}") for p in COUNTED_PASSES]
    return [*told, F.count_if(read).alias("read"), F.count_if(emitted).alias("emitted")]


def _counts(observed: Observation) -> Mapping[str, int]:
    """Observed counters; all 0 if the plan had no row to begin with, for then it has no counters either."""
    try:
        return defaultdict(int, {k: v or 0 for k, v in observed.get.items()})
    except Py4JJavaError:
        return defaultdict(int)


def write_merged(
    merged: DataFrame,
    path: str,
    *,
    sources: Sequence[str],
    categories: Sequence[str],
    order: Sequence[str] = tuple(MERGE_ORDER),
    partition_by: Sequence[str] = (),
    **options,
) -> dict:
    """Write :func:`merge_corpus` as Parquet and return the merge summary and the broken layout rules.

    All counters are observed while the rows pass by on their way into the table; no row is read again for
    them. ``sources`` and ``categories`` name what is counted each for itself; what else there is shows as the
    difference to ``read`` and ``emitted``.
    """
    flagged = flag_merge(merged, order=order, **options)
    summary, broken = Observation(), Observation()
    chosen = flagged.observe(summary, *_summary_counts(sources, categories)).filter("emitted").select(*order, "weight", "n_tokens")
    rows = merged.drop("weight").join(chosen, list(order)).select(*ROW_KEYS, *order, "n_tokens")
    rows.observe(broken, *_problem_counts(rows)).write.partitionBy(*partition_by).parquet(path)
    told, problems = _counts(summary), _counts(broken)
    by_source = {s: {n: told[f"{s}\t{n}"] for n in ("read_rows", "emitted_rows", "skipped_category", "skipped_dedup")} for s in sources}
    by_category = {}
    for c in categories:
        shares = {s: told[f"{c}\t{s}\trows"] for s in sources if told[f"{c}\t{s}\trows"]}
        if shares:
            total = sum(shares.values())
            by_category[c] = {"tokens": told[f"{c}\tn_tokens"], "unmasked": told[f"{c}\tn_trained"], "rows": shares, "row_share": {s: n / total for s, n in shares.items()}}
    return {
        "read": told["read"],
        "emitted": told["emitted"],
        "by_source": {s: n for s, n in by_source.items() if n["read_rows"]},
        "by_category": by_category,
        "pass_counts": {p: told[f"passes\t{p}"] for p in COUNTED_PASSES if told[f"passes\t{p}"]},
        "problems": dict(problems),
    }


def token_budget_cut(df: DataFrame, max_tokens: int, order: Sequence[str] = tuple(MERGE_ORDER)) -> DataFrame:
    """Rows in order up to the first that exceeds the budget; 0 means no budget.

    Only sizes are summed; the rows themselves are filtered by the place of the cut.
    """
    if max_tokens <= 0:
        return df
    lead = [F.col(c) for c in order[:-1]]
    sizes = df.select(*order, F.size("tokens").cast("bigint").alias("_n"))
    summed = running_total(sizes, F.col("_n"), order=order, bucket=[*lead, row_bucket(order[-1])], name="_upto")
    cut = summed.filter(F.col("_upto") > max_tokens).agg(F.min(order_key(order))).scalar()
    return df.filter(F.coalesce(order_key(order) < cut, F.lit(True)))


def merge_by_source(flagged: DataFrame) -> DataFrame:
    """Read, emitted and skipped rows per source; rows after the cut are not counted."""
    read = F.col("was_read")
    counts = flagged.groupBy("source").agg(
        F.count_if(read).alias("read_rows"),
        F.count_if("emitted").alias("emitted_rows"),
        F.count_if(read & F.col("dropped")).alias("skipped_category"),
        F.count_if(read & F.col("shadowed")).alias("skipped_dedup"),
    )
    return counts.filter(F.col("read_rows") > 0)


def merge_by_category(flagged: DataFrame) -> DataFrame:
    """Emitted rows per category and source with the source's share of the category."""
    counts = (
        flagged.filter("emitted")
        .groupBy("category", "source")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("n_tokens").alias("tokens"),
            F.sum("n_trained").alias("unmasked"),
        )
    )
    share = F.col("rows") / F.sum("rows").over(W.partitionBy("category"))
    return counts.withColumn("row_share", share)


def pass_count_histogram(flagged: DataFrame) -> DataFrame:
    """Emitted rows per pass count; -1 stands for ids without a record."""
    known = F.coalesce(F.col("pass_count"), F.lit(-1)).cast("bigint").alias("pass_count")
    return flagged.filter("emitted").groupBy(known).agg(F.count(F.lit(1)).alias("rows"))


# --- solver corpus ---------------------------------------------------------------------------


def solver_corpus(
    problems: DataFrame,
    prompts: DataFrame,
    reasoning: DataFrame,
    augmentations: DataFrame | None = None,
    *,
    tokenizer: Callable[[Column], Column] = K.split_tokenizer,
    template: str = "{}",
    limit: int = K.TOKEN_LIMIT,
) -> DataFrame:
    """(problem_id, category, tokens, mask, answer) of problems with a prompt and a reasoning text.

    ``problems``: id, category; ``prompts``: id, prompt, answer; ``reasoning``: id, text.
    Solver rows are cut at ``limit``. Augmentation rows (id, category, prompt, completion) get
    neither suffix nor box, and one above the limit fails the job.
    """
    solved = problems.select("id", "category").join(prompts, "id").join(reasoning.select("id", "text"), "id")
    done = completion_text(F.rtrim(F.col("text"), F.lit("\n")), F.col("answer"))
    rows = solved.select(
        "id", "category", tokenizer(chat_prompt(F.col("prompt"), template)).alias("p"), tokenizer(done).alias("c"), "answer"
    )
    tokens, mask = K.example(F.col("p"), F.col("c"), limit)
    out = rows.select(F.col("id").alias("problem_id"), "category", tokens.alias("tokens"), mask.alias("mask"), "answer")
    if augmentations is None:
        return out
    body = F.rtrim(F.col("completion"), F.lit("\n"))
    extra = augmentations.select(
        "id",
        "category",
        tokenizer(chat_prompt(F.col("prompt"), template, suffix="")).alias("p"),
        tokenizer(completion_text(body, body, closing_box=False)).alias("c"),
        body.alias("answer"),
    )
    size = F.size("p") + F.size("c")
    message = F.concat("id", F.lit(" exceeds the token limit: "), size.cast("string"))
    extra = extra.filter(passes(size > limit, message))
    whole = F.concat("p", "c")
    mask = F.concat(K.fill(0, F.size("p")), K.fill(1, F.size("c")))
    more = extra.select(F.col("id").alias("problem_id"), "category", whole.alias("tokens"), mask.alias("mask"), "answer")
    return out.unionByName(more)


# --- mixture reweighting ---------------------------------------------------------------------


def mixture_weights(
    examples: DataFrame, *, smoothing: float = 0.1, low: float = 0.5, high: float = 2.0, strict: bool = False
) -> DataFrame:
    """Category weights against the token share, smoothed towards uniform and bounded.

    ``examples`` needs category and ``mass`` (trained tokens). A single category keeps weight
    1; with ``strict`` it is an error.
    """
    mass = examples.groupBy("category").agg(F.sum("mass").cast("double").alias("mass"))
    everything = W.partitionBy()
    n = F.count(F.lit(1)).over(everything)
    share = F.col("mass") / F.sum("mass").over(everything)
    raw = mass.select("*", n.alias("n"), share.alias("share"))
    raw = raw.withColumn("raw", (F.lit(1.0) / F.col("n")) / F.greatest(F.col("share"), F.lit(1e-12)))
    raw = raw.withColumn("raw_total", F.sum("raw").over(everything))
    smooth = F.lit(1.0 - smoothing) * F.col("raw") / F.col("raw_total") + F.lit(smoothing) / F.col("n")
    bounded = F.least(F.greatest(smooth * F.col("n"), F.lit(low)), F.lit(high))
    alone = F.raise_error(F.lit("only one category")).cast("double") if strict else F.lit(1.0)
    return raw.select("category", "mass", F.when(F.col("n") <= 1, alone).otherwise(bounded).alias("category_weight"))


def resample(examples: DataFrame, weights: DataFrame, row_no: str = "row_no") -> DataFrame:
    """``int(w)`` copies of each row plus one more with probability ``frac(w)``.

    The draw hashes id, row number and category. Copies after the first get a suffix.
    """
    joined = examples.join(weights.select("category", "category_weight"), "category", "left")
    w = F.greatest(F.coalesce("category_weight", F.lit(1.0)), F.lit(0.0))
    whole = F.floor(w)
    key = F.concat_ws(":", "problem_id", F.col(row_no).cast("string"), "category")
    copies = whole + F.when(unit_interval(key) < w - whole, F.lit(1)).otherwise(F.lit(0))
    numbers = F.filter(F.sequence(F.lit(0), copies.cast("int")), lambda i: i < copies)
    expanded = joined.withColumn("copy_no", F.explode(numbers)).drop("category_weight")
    suffix = F.concat(F.col("problem_id"), F.lit(COPY_SUFFIX), F.col("copy_no").cast("string"))
    return expanded.withColumn("problem_id", F.when(F.col("copy_no") > 0, suffix).otherwise(F.col("problem_id")))
