"""Synthetic problems and augmentation rows, generated from seed tables.

Random choices are hashes of (seed, keys): every rerun and every partitioning draws the
same. Distribution and validity are promised, not any particular random stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.answers import answers_match
from ..functions.hashing import counter_bits, counter_int, counter_pick, pick_from, pick_int, sha_mod, short_id, text_bits
from ..session import shared_folder
from .ordering import position, top_per_group
from .rules import BIT_FAMILIES, N_BITS, answer_of_examples, apply_bit_rules, rules_explained, solve_equations

# Symbol alphabets, sizes and wording of the generated problems.
SYMBOLS = list("!\"#$%&'()*+-./:;<>?@[\\]^`{|}")
PUZZLE_SYMBOLS = list("!#$%&'()*+-./:;<>?@[]^`{|}")
OPERATORS = list("+-*/?!@#$%&")
LINES_PER_PROBLEM = 100
DEMO_LINES = 3
#: Tasks a core that the seeds of lines are dealt to.
SEED_WAVES = 4
ROWS_INTRO = "In Alice's Wonderland, secret processing rules are used on text.\n\n"
EQUATION_INTRO = (
    "In Alice's Wonderland, a secret set of transformation rules is applied "
    "to equations. Below are a few examples:\n"
)
BIT_INTRO = (
    "In Alice's Wonderland, a secret bit manipulation rule transforms 8-bit binary numbers. "
    "The transformation involves operations like bit shifts, rotations, XOR, AND, OR, NOT, "
    "and possibly majority or choice functions.\n\n"
    "Here are some examples of input -> output:\n"
)
MATCHING_INTRO = ROWS_INTRO + "x: not matched anywhere\ny: matched but wrong position\n\n"


# --- parallel rows ---------------------------------------------------------------------------


def _drawn(low: int, high: int, seed: int, key: Column, before: str = "", after: str = "") -> Column:
    """``counter_int`` of ``key``, which is joined to a text already, with fixed keys before and after it."""
    return F.lit(low) + (text_bits(F.concat(F.lit(f"{seed}|{before}"), key, F.lit(after))) % (high - low + 1)).cast("int")


def _symbols(length: Column, most: int, seed: int, key: Column) -> Column:
    """Text of seeded symbols, ``most`` at most: the ``counter_pick`` of ``key`` and 1, 2, ... One by one, as Spark
    compiles no lambda."""
    symbols = F.array(*[F.lit(x) for x in SYMBOLS])
    picks = [F.element_at(symbols, _drawn(1, len(SYMBOLS), seed, key, after=f"|{i}")) for i in range(1, most + 1)]
    return F.concat(*[F.when(length >= i, x).otherwise("") for i, x in enumerate(picks, 1)])


def _row_length(kind: str, seed: int, key: Column) -> tuple[Column, int]:
    """Number of symbols of a line, and the largest there is."""
    if kind == "lstrip":
        return F.when(_drawn(0, 1, seed, key, "half|") == 0, F.lit(5)).otherwise(_drawn(1, 10, seed, key, "length|")), 10
    return _drawn(2, 8, seed, key, "length|"), 8


def _row_pair(kind: str, symbols: Column) -> tuple[Column, Column]:
    if kind == "lstrip":
        return X.bracket_whole(F.concat(F.lit(" "), symbols)), X.bracket_whole(symbols)
    each, whole = X.bracket_each(symbols), X.bracket_whole(symbols)
    return (each, whole) if kind == "concatenation" else (whole, each)


def parallel_row_lines(seeds: DataFrame, kind: str, lines: int = LINES_PER_PROBLEM, seed: int = 0) -> DataFrame:
    """(problem_no, part, line_no, input_text, output_text) for each row of ``seeds``.

    ``kind``: concatenation, splitting or lstrip. Part ``demo`` has three lines.
    """
    numbered = F.sequence(F.lit(-DEMO_LINES), F.lit(lines - 1))
    # A seed is a number and makes a hundred lines: dealt out, whatever files and row groups the seeds come in.
    dealt = seeds.select("problem_no").repartition(SEED_WAVES * seeds.sparkSession.sparkContext.defaultParallelism)
    rows = dealt.select("problem_no", F.explode(numbered).alias("n"))
    # Each in a step of its own, as the next uses it several times: the key's text, the length, the symbols.
    number = F.coalesce(F.concat(F.lit("|"), F.col("problem_no").cast("string")), F.lit(""))
    rows = rows.withColumn("key", F.concat(F.lit(kind), number, F.lit("|"), F.col("n").cast("string")))
    length, most = _row_length(kind, seed, F.col("key"))
    rows = rows.withColumn("length", length)
    rows = rows.withColumn("symbols", _symbols(F.col("length"), most, seed, F.col("key")))
    given, wanted = _row_pair(kind, F.col("symbols"))
    return rows.select(
        "problem_no",
        F.when(F.col("n") < 0, "demo").otherwise("row").alias("part"),
        F.when(F.col("n") < 0, F.col("n") + DEMO_LINES).otherwise(F.col("n")).alias("line_no"),
        given.alias("input_text"),
        wanted.alias("output_text"),
    )


def row_problems(lines: DataFrame, kind: str, separator: str = " ") -> DataFrame:
    """Lines put together: one (id, prompt, completion, category) per problem.

    A group has a fixed number of lines, so it is safe to gather.
    """
    number = X.padded(F.col("line_no"), 2)
    given = F.concat_ws(separator, number, "input_text")
    pair = F.concat(given, F.lit(" -> "), F.col("output_text"))

    def block(part: str, line: Column) -> Column:
        chosen = F.collect_list(F.when(F.col("part") == part, F.struct("line_no", line.alias("t"))))
        return F.array_join(F.transform(F.array_sort(chosen), lambda s: s["t"]), "\n")

    blocks = lines.groupBy("problem_no").agg(
        block("demo", given).alias("demo_in"),
        block("demo", pair).alias("demo_out"),
        block("row", given).alias("rows_in"),
        block("row", pair).alias("completion"),
    )
    prompt = F.concat(
        F.lit(ROWS_INTRO + "This is a sample input.\n"),
        "demo_in",
        F.lit("\n\nThis is a sample output.\n"),
        "demo_out",
        F.lit("\n\nThis is your input.\n"),
        "rows_in",
    )
    return blocks.select(
        short_id(F.lit(kind), F.col("problem_no")).alias("id"),
        prompt.alias("prompt"),
        "completion",
        F.lit(kind).alias("category"),
    )


def _ranked_pool(pool: DataFrame, seed: int) -> DataFrame:
    """(token, _at, _n): tokens in an order drawn by the seed, from 1, and their number."""
    drawn = pool.select("token", counter_bits(seed, F.col("token")).alias("_h"))
    return position(drawn, order=["_h", "token"], bucket=[F.shiftright("_h", 44)], name="_at", total="_n")


def _n_spelling_problems(bare: DataFrame, spaced: DataFrame, lines: int, repeats: int) -> Column:
    def size(pool: DataFrame) -> Column:
        return pool.agg(F.count(F.lit(1))).scalar()

    return F.greatest(F.ceil(size(bare) * repeats / F.lit(lines)), F.ceil(size(spaced) * repeats / F.lit(2 * lines)))


def spelling_lines(bare: DataFrame, spaced: DataFrame, lines: int = LINES_PER_PROBLEM, repeats: int = 4, seed: int = 42) -> DataFrame:
    """(problem_no, line_no, input_text, output_text): one bare and two spaced tokens a line.

    Both pools (``token``) are shuffled by draws and used in a circle until each token had its
    ``repeats`` turns. Every token computes the turns it takes; lines meet on their number.
    """
    problems = _n_spelling_problems(bare, spaced, lines, repeats)

    def turns(pool: DataFrame, per_line: int) -> DataFrame:
        places = F.sequence(F.col("_at") - 1, problems * lines * per_line - 1, F.col("_n"))
        fits = F.col("_at") <= problems * lines * per_line
        return _ranked_pool(pool, seed).filter(fits).select("token", F.explode(places).alias("turn"))

    b = turns(bare, 1).select(F.col("turn").alias("line"), F.col("token").alias("b"))
    s = turns(spaced, 2).withColumn("line", F.floor(F.col("turn") / F.lit(2)))
    pair = s.groupBy("line").agg(
        F.max(F.when(F.col("turn") % 2 == 0, F.col("token"))).alias("s1"), F.max(F.when(F.col("turn") % 2 == 1, F.col("token"))).alias("s2")
    )
    text = F.concat_ws(" ", "b", "s1", "s2")
    return b.join(pair, "line").select(
        F.floor(F.col("line") / F.lit(lines)).alias("problem_no"),
        (F.col("line") % lines).alias("line_no"),
        text.alias("input_text"),
        X.spell_out(text).alias("output_text"),
    )


def spelling_demos(bare: DataFrame, spaced: DataFrame, n_problems: DataFrame, seed: int = 42) -> DataFrame:
    """(problem_no, line_no, input_text, output_text) of the lines each problem (``problem_no``) shows first: tokens
    drawn from the pools with replacement."""
    wanted = n_problems.select("problem_no", F.explode(F.sequence(F.lit(0), F.lit(DEMO_LINES - 1))).alias("line_no"))
    for name, pool in (("b", bare), ("s1", spaced), ("s2", spaced)):
        ranked = _ranked_pool(pool, seed).select(F.col("_at").alias("_place"), F.col("token").alias(name))
        size = pool.agg(F.count(F.lit(1))).scalar()
        draw = counter_bits(seed, F.lit(name), F.col("problem_no"), F.col("line_no")) % size + 1
        wanted = wanted.withColumn("_place", draw).join(ranked, "_place").drop("_place")
    text = F.concat_ws(" ", "b", "s1", "s2")
    return wanted.select("problem_no", "line_no", text.alias("input_text"), X.spell_out(text).alias("output_text"))


def spelling_problems(bare: DataFrame, spaced: DataFrame, lines: int = LINES_PER_PROBLEM, repeats: int = 4, seed: int = 42) -> DataFrame:
    """(id, prompt, completion, category): the lines of each problem put together, after lines that show how."""
    rows = spelling_lines(bare, spaced, lines, repeats, seed)
    numbers = bare.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), _n_spelling_problems(bare, spaced, lines, repeats) - 1)).alias("problem_no"))
    demos = spelling_demos(bare, spaced, numbers.repartition("problem_no"), seed)
    return row_problems(rows.withColumn("part", F.lit("row")).unionByName(demos.withColumn("part", F.lit("demo"))), "spelling", "\n")


# --- equation problems -----------------------------------------------------------------------


#: What an equation problem does to its two operands, by name.
NUMERIC_PAIRS: dict[str, Callable[[Column, Column], Column]] = {
    "addition": lambda a, b: (a.cast("int") + b.cast("int")).cast("string"),
    "subtraction": lambda a, b: (a.cast("int") - b.cast("int")).cast("string"),
    "absolute difference": lambda a, b: F.abs(a.cast("int") - b.cast("int")).cast("string"),
    "multiplication": lambda a, b: (a.cast("int") * b.cast("int")).cast("string"),
    "concatenation": F.concat,
    "reverse concatenation": lambda a, b: F.concat(b, a),
}
SYMBOL_PAIRS: dict[str, Callable[[Column, Column], Column]] = {
    "both": F.concat,
    "both turned": lambda a, b: F.concat(b, a),
    "first": lambda a, b: a,
    "second": lambda a, b: b,
    "ends": lambda a, b: F.concat(F.left(a, F.lit(1)), F.right(b, F.lit(1))),
}


def hindsight_problems(seeds: DataFrame, numeric: bool = True, seed: int = 11) -> DataFrame:
    """One equation problem per seed row: a drawn rule, four examples and a question.

    Columns: problem_no, id, category, rule, op, examples, question, answer, prompt. All draws are
    :func:`..functions.hashing.counter_bits`, so SQL can repeat them.
    """
    key = F.col("problem_no")
    pairs = NUMERIC_PAIRS if numeric else SYMBOL_PAIRS
    category = "equation_numeric_guess" if numeric else "cryptarithm_guess"
    base = seeds.select(
        "problem_no", counter_pick(list(pairs), seed, F.lit("rule"), key).alias("rule"), counter_pick(OPERATORS, seed, F.lit("op"), key).alias("op")
    )

    def operands(i: Column) -> Column:
        if numeric:
            sides = [F.lpad(counter_int(0, 99, seed, F.lit(side), key, i).cast("string"), 2, "0") for side in "ab"]
        else:
            drawn = F.transform(F.array(*[F.lit(s) for s in PUZZLE_SYMBOLS]), lambda s: F.struct(counter_bits(seed, key, i, s).alias("h"), s.alias("s")))
            four = F.transform(F.slice(F.array_sort(drawn), 1, 4), lambda x: x["s"])
            return X.bind(four, lambda f: F.struct(F.array_join(F.slice(f, 1, 2), "").alias("a"), F.array_join(F.slice(f, 3, 2), "").alias("b")))
        return F.struct(sides[0].alias("a"), sides[1].alias("b"))

    def written(x: Column) -> Column:
        a, b = x["a"], x["b"]
        result = F.coalesce(*[F.when(F.col("rule") == name, of(a, b)) for name, of in pairs.items()])
        return F.struct(F.concat(a, F.col("op"), b).alias("input_value"), result.alias("output_value"))

    def line(i: Column) -> Column:
        # The operands are drawn once for all that is made of them.
        return X.bind(operands(i), written)

    built = base.withColumn("lines", F.transform(F.sequence(F.lit(1), F.lit(5)), line))
    shown = F.transform("examples", lambda e: F.concat(e["input_value"], F.lit(" = "), e["output_value"]))
    return (
        built.withColumn("examples", F.slice("lines", 1, 4))
        .withColumn("question", F.element_at("lines", 5)["input_value"])
        .withColumn("answer", F.element_at("lines", 5)["output_value"])
        .withColumn("id", short_id(F.lit("her_" + category), key))
        .withColumn("category", F.lit(category))
        .withColumn(
            "prompt",
            F.concat(
                F.lit(EQUATION_INTRO), F.array_join(shown, "\n"), F.lit("\nNow, determine the result for: "), F.col("question")
            ),
        )
        .drop("lines")
    )


# --- bit problems ----------------------------------------------------------------------------


def _rule(family: Column, primary: Column, secondary: Column) -> Column:
    return F.struct(
        family.alias("family"), primary.cast("int").alias("primary"), secondary.cast("int").alias("secondary")
    )


@dataclass(frozen=True)
class Mutation:
    """How a rule changes: the families to draw from, and whether its first operand stays."""

    families: tuple[str, ...]
    keeps_operand: bool


_PLAIN = ("XOR", "OR", "AND")
_NEGATED = tuple(f"{name}-NOT" for name in _PLAIN)
MUTATIONS = {
    "add_operand": Mutation(_PLAIN, keeps_operand=True),
    "longer_chain": Mutation(_PLAIN + _NEGATED, keeps_operand=False),
    "nest_op": Mutation(_NEGATED, keeps_operand=True),
}


def mutate_rules(vector: Column, op: str, seed: int, *keys: Column) -> Column:
    """Vector of new two-operand rules, one for each bit, by one of ``MUTATIONS``.

    The second operand lies at a drawn distance from the first, so the two always differ. An unknown
    operation leaves the vector as it is.
    """
    mutation = MUTATIONS.get(op)
    if mutation is None:
        return vector

    def mutated(rule: Column, bit: Column) -> Column:
        drawn = [F.lit(op), *keys, bit]
        anywhere = pick_int(0, N_BITS - 1, seed, F.lit("operand"), *drawn)
        first = F.coalesce(rule["primary"], anywhere) if mutation.keeps_operand else anywhere
        distance = pick_int(1, N_BITS - 1, seed, F.lit("distance"), *drawn)
        family = pick_from(list(mutation.families), seed, F.lit("family"), *drawn)
        return _rule(family, first, F.pmod(first + distance, F.lit(N_BITS)))

    return F.transform(vector, mutated)


def family_rules(family: Column, seed: int, *keys: Column) -> Column:
    """Vector of one family whose operands run along the bits from seeded offsets."""
    first = pick_int(0, N_BITS - 1, seed, F.lit("first"), *keys)
    second = F.pmod(first + pick_int(1, N_BITS - 1, seed, F.lit("second"), *keys), F.lit(N_BITS))
    constant, single = family.isin("0", "1"), family.isin("I", "NOT")

    def rule(bit: Column) -> Column:
        return _rule(
            family,
            F.when(~constant, F.pmod(first + bit, F.lit(N_BITS))),
            F.when(~constant & ~single, F.pmod(second + bit, F.lit(N_BITS))),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(N_BITS - 1)), rule)


def _walk(seed: int, key: Column) -> tuple[Column, Column]:
    """Start and odd stride of a problem's inputs among the 256 values."""
    return pick_int(0, 255, seed, F.lit("start"), key), pick_int(0, 127, seed, F.lit("stride"), key) * 2 + 1


def bit_problems(vectors: DataFrame, n_examples: Column, seed: int) -> DataFrame:
    """Add distinct examples, an unseen question and its answer to rows (problem_id, vector).

    Inputs walk through the 256 values with a seeded odd stride, so none repeats.
    """
    start, stride = _walk(seed, F.col("problem_id"))

    def bits(i: Column) -> Column:
        return F.lpad(F.bin(F.pmod(start + stride * i, F.lit(256)).cast("bigint")), N_BITS, "0")

    def example(i: Column) -> Column:
        x = bits(i)
        return F.struct(x.alias("input_value"), apply_bit_rules(x, F.col("vector")).alias("output_value"))

    built = (
        vectors.withColumn("examples", F.transform(F.sequence(F.lit(1), n_examples), example))
        .withColumn("question", bits(F.lit(0)))
        .withColumn("answer", apply_bit_rules(F.col("question"), F.col("vector")))
    )
    lines = F.transform("examples", lambda e: F.concat(e["input_value"], F.lit(" -> "), e["output_value"]))
    ask = F.concat(F.lit("\n\nNow, determine the output for: "), F.col("question"))
    return built.withColumn("prompt", F.concat(F.lit(BIT_INTRO), F.array_join(lines, "\n"), ask))


def verify_bit_problems(problems: DataFrame) -> DataFrame:
    """Add ``verified``: rules inferred anew from the examples give the stored answer."""
    again = answer_of_examples(F.col("examples"), F.col("question")) == F.col("answer")
    return problems.withColumn("verified", F.coalesce(again, F.lit(False)))


#: Attempts after which the variants that verified are set aside, so that only open ones are tried on.
ROUNDS = (4, 8, 16, 28)


def evolve_bit_problems(
    vectors: DataFrame, ops: Sequence[str], n_examples: int = 8, seed: int = 1234, attempts: int = 50
) -> DataFrame:
    """Mutated variants of inferred vectors (problem_id, vector) that verify.

    A variant that does not verify is drawn anew, up to ``attempts`` times; the first that does counts.
    Attempts are made in rounds; from round to round only variants go on that are still open. An attempt is
    tried as numbers; only the one that counts is written out as a problem.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark, "evolved")
    slots = 4 * spark.sparkContext.defaultParallelism
    base = vectors.select(F.col("problem_id").alias("seed_id"), F.col("vector").alias("old"))
    names = F.array(*[F.struct(F.lit(i).alias("op_no"), F.lit(op).alias("op")) for i, op in enumerate(ops)])
    variants = base.select("*", F.inline(names)).withColumn(
        "variant", F.concat("seed_id", F.lit("__e"), F.col("op_no").cast("string"), F.lit("_"), F.col("op"))
    )
    # The id seeds the examples, so each attempt has one of its own until it is chosen.
    name = F.concat_ws("#", "variant", F.col("attempt").cast("string"))

    def tried(open_: DataFrame, low: int, high: int) -> DataFrame:
        rows = open_.withColumn("attempt", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        vector = F.col("old")
        for op in dict.fromkeys(ops):
            vector = F.when(F.col("op") == op, mutate_rules(F.col("old"), op, seed, F.col("variant"), F.col("attempt"))).otherwise(vector)
        rows = rows.withColumn("vector", vector)
        good = rows.withColumn("good", rules_explained(F.col("vector"), *_walk(seed, name), F.lit(n_examples))).filter("good")
        first = F.min_by(F.struct("seed_id", "op", "vector", "attempt"), "attempt")
        return good.groupBy("variant").agg(first.alias("x")).select("variant", "x.*")

    # Variants lie by their name, which the choice among their attempts needs, over many more tasks than
    # their few bytes would be given.
    variants.repartition(slots, "variant").write.parquet(f"{folder}/open-0")
    ends = [n for n in ROUNDS if n < attempts] + [attempts]
    for k, (low, high) in enumerate(zip([0, *ends], ends)):
        open_ = spark.read.schema(variants.schema).parquet(f"{folder}/open-{k}").repartition(slots, "variant")
        tried(open_, low, high).write.parquet(f"{folder}/done/round={k}")
        if high < attempts:
            done = spark.read.parquet(f"{folder}/done/round={k}").select(F.col("variant").alias("_done"))
            # Rows without an id stay open after the first round.
            same = (open_["variant"] == done["_done"]) if k == 0 else open_["variant"].eqNullSafe(done["_done"])
            open_.join(done, same, "left_anti").write.parquet(f"{folder}/open-{k + 1}")
    chosen = spark.read.parquet(f"{folder}/done").repartition(slots, "variant").withColumn("problem_id", name)
    made = bit_problems(chosen, F.lit(n_examples), seed)
    return made.select(F.col("variant").alias("problem_id"), "seed_id", "op", "vector", "examples", "question", "answer", "prompt")


# Operations of evolved equations, taken in turn.
EQUATION_RULES = ["addition", "absolute difference", "multiplication", "concatenation"]


def evolve_equations(seeds: DataFrame, variants: int = 3, seed: int = 1234) -> DataFrame:
    """Equation problems that keep the operator character of their seed (problem_id, op)."""
    key = F.col("seed_id")
    rows = seeds.select(
        F.col("problem_id").alias("seed_id"), "op", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("v")
    ).withColumn("rule", F.get(F.array(*[F.lit(r) for r in EQUATION_RULES]), F.pmod("v", F.lit(len(EQUATION_RULES)))))

    def line(i: Column) -> Column:
        # An odd step through 88 values keeps the left numbers of a problem apart.
        a = F.lit(12) + F.pmod(counter_int(0, 87, seed, F.lit("a"), key, F.col("v")) + i * 21, F.lit(88))
        b = counter_int(11, 98, seed, F.lit("b"), key, F.col("v"), i)
        result = (
            F.when(F.col("rule") == "addition", (a + b).cast("string"))
            .when(F.col("rule") == "absolute difference", F.abs(a - b).cast("string"))
            .when(F.col("rule") == "multiplication", (a * b).cast("string"))
            .otherwise(F.concat(a.cast("string"), b.cast("string")))
        )
        return F.struct(
            F.concat(a.cast("string"), F.col("op"), b.cast("string")).alias("input_value"), result.alias("output_value")
        )

    lines = F.transform(F.sequence(F.lit(1), F.lit(4)), line)
    suffix = F.concat(F.lit("__e"), F.col("v").cast("string"), F.lit("_"), F.regexp_replace("rule", " ", "_"))
    return rows.withColumn("lines", lines).select(
        F.concat("seed_id", suffix).alias("problem_id"),
        "seed_id",
        "rule",
        F.slice("lines", 1, 3).alias("examples"),
        F.element_at("lines", 4)["input_value"].alias("question"),
        F.element_at("lines", 4)["output_value"].alias("answer"),
    )


def verified_equations(problems: DataFrame) -> DataFrame:
    """The problems (problem_id, examples, question, answer) whose answer the rules inferred from their examples
    give; the others are dropped."""
    examples = problems.select("problem_id", F.posexplode("examples").alias("row_no", "x")).select(
        "problem_id", "row_no", F.inline(F.array(X.parse_equation(F.col("x.input_value")))), F.col("x.output_value").alias("output_value")
    )
    questions = problems.select("problem_id", F.inline(F.array(X.parse_equation(F.col("question")))))
    solved = solve_equations(examples, questions).select("problem_id", "solution")
    good = problems.join(solved, "problem_id").filter(F.coalesce(answers_match(F.col("answer"), F.col("solution")), F.lit(False)))
    return good.select(problems.columns)


def short_curriculum(
    vectors: DataFrame, variants: int = 2, min_examples: int = 3, max_examples: int = 6, seed: int = 1234
) -> DataFrame:
    """Variants of inferred vectors with few examples; ``verified`` tells which to keep."""
    rows = vectors.select(
        F.col("problem_id").alias("seed_id"), "vector", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant")
    )
    rows = rows.withColumn(
        "n_examples", pick_int(min_examples, max_examples, seed, F.lit("n"), F.col("seed_id"), F.col("variant"))
    ).withColumn(
        "problem_id",
        F.concat(
            F.lit("evolveH_"), "seed_id", F.lit("_"), X.padded(F.col("variant"), 2), F.lit("_"), F.col("n_examples").cast("string"), F.lit("c")
        ),
    )
    return verify_bit_problems(bit_problems(rows, F.col("n_examples"), seed))


def curriculum_tiers(seeds: DataFrame, generated: DataFrame, max_examples: int = 6) -> DataFrame:
    """Per number of examples: seeds, held-out seeds, generated and kept variants.

    ``seeds``: problem_id, n_examples.
    """
    held = F.col("n_examples") > max_examples
    old = seeds.groupBy("n_examples").agg(
        F.count(F.lit(1)).alias("seeds"), F.count_if(held).alias("held_out"), F.lit(0).cast("bigint").alias("generated"), F.lit(0).cast("bigint").alias("kept")
    )
    new = generated.groupBy("n_examples").agg(
        F.lit(0).cast("bigint").alias("seeds"), F.lit(0).cast("bigint").alias("held_out"), F.count(F.lit(1)).alias("generated"), F.count_if("verified").alias("kept")
    )
    return old.unionByName(new).groupBy("n_examples").agg(*[F.sum(c).alias(c) for c in ("seeds", "held_out", "generated", "kept")])


def weakness_problems(
    counts: DataFrame, *, top_k: int = 5, per_family: int = 400, n_examples: int = 8, seed: int = 4321
) -> DataFrame:
    """``per_family`` verified problems for each of the ``top_k`` weakest rule families.

    ``counts``: family, wrong_rollouts. Up to 50 candidates per wanted problem are tried, at
    least 100. Two per problem nearly always suffice, so the others are only made for
    families that came out short.
    """
    places = F.array(*[F.lit(f) for f in BIT_FAMILIES])
    weakest = counts.orderBy(F.desc("wrong_rollouts"), F.array_position(places, F.col("family"))).limit(top_k)
    first, last = 2 * per_family, max(50 * per_family, 100)

    def tried(families: DataFrame, low: int, high: int) -> DataFrame:
        # A limit leaves one partition; the attempts are dealt over all.
        rows = families.select("family", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("attempt")).repartition("family", "attempt")
        number = X.padded(F.col("attempt"), 5)
        name = F.concat(F.lit("synthI_"), X.slug(F.col("family")), F.lit("_"), number)
        rows = rows.withColumn("problem_id", name).withColumn(
            "vector", family_rules(F.col("family"), seed, F.col("family"), F.col("attempt"))
        )
        return verify_bit_problems(bit_problems(rows, F.lit(n_examples), seed)).filter("verified").drop("verified")

    good = tried(weakest, 0, first)
    enough = good.groupBy("family").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= per_family)
    more = tried(weakest.join(enough, "family", "left_anti").select("family"), first, last)
    return top_per_group(good.unionByName(more), ["family"], [F.asc("attempt")], per_family, rank="problem_no")


# --- matching sections -----------------------------------------------------------------------

# Headers of a bit trace and of its sections, and the rule prefix of each.
OUTPUT_COLUMNS = "Output bit columns (with bitsum as hash)"
SELECTING = "Selecting"
SECTION_PREFIX = {
    "Identity": "I",
    "NOT": "NOT",
    "Constant": "C",
    "AND": "AND",
    "OR": "OR",
    "XOR": "XOR",
    "AND-NOT": "AND-NOT",
    "OR-NOT": "OR-NOT",
    "XOR-NOT": "XOR-NOT",
}


def _from(arr: Column, start: Column) -> Column:
    """Array from a 1-based place on."""
    return F.slice(arr, start, F.greatest(F.size(arr) - start + 1, F.lit(0)))


def _until(arr: Column, stop) -> Column:
    """Entries before the first one that meets ``stop``."""
    at = F.array_position(F.transform(arr, stop), True).cast("int")
    return F.when(at > 0, F.slice(arr, F.lit(1), at - 1)).otherwise(arr)


def _after(arr: Column, name: str) -> Column:
    """Lines behind the first line that reads ``name``; NULL when there is none."""
    at = F.array_position(F.transform(arr, X.strip), name).cast("int")
    return F.when(at > 0, _from(arr, at + 1))


def _chain(lines: Column) -> Column:
    """struct(lines before a blank or a Best line, that Best line or blank)."""

    def best(chain: Column) -> Column:
        after = F.coalesce(F.get(lines, F.size(chain)), F.lit(""))
        line = F.when(X.strip(after).startswith("Best:"), after).otherwise(F.lit(""))
        return F.struct(chain.alias("lines"), line.alias("best"))

    stops = _until(lines, lambda s: X.strip(s).startswith("Best:") | (X.strip(s) == ""))
    return X.bind(stops, best)


def _without_trailing_blanks(lines: Column) -> Column:
    filled = F.filter(F.transform(lines, lambda s, i: F.when(X.strip(s) != "", i + 1)), lambda i: i.isNotNull())
    return F.slice(lines, F.lit(1), F.coalesce(F.array_max(filled), F.lit(0)))


def _section(body: Column) -> Column:
    """Parts of one section; NULL unless it has its matches, left and right blocks."""
    data = _without_trailing_blanks(_until(body, lambda s: X.strip(s) == "Matching output"))

    def parts(x: Column) -> Column:
        found = F.struct(
            data.alias("data"),
            _until(x["rest"], lambda s: X.strip(s).isin("", "Left")).alias("matches"),
            _chain(x["left"]).alias("left"),
            _chain(x["right"]).alias("right"),
        )
        return F.when(x["right"].isNotNull(), found)

    def blocks(rest: Column) -> Column:
        left = _after(rest, "Left")
        return F.struct(rest.alias("rest"), left.alias("left"), _after(left, "Right").alias("right"))

    return X.bind(X.bind(_after(body, "Matching output"), blocks), parts)


def _trace_sections(text: Column) -> Column:
    """Sections of one trace as array<struct(section, head, part)>."""
    names = F.array(*[F.lit(n) for n in SECTION_PREFIX])

    def bounds(t: Column) -> Column:
        start = F.array_position(t["bare"], OUTPUT_COLUMNS).cast("int")
        place = F.array_position(_from(t["bare"], start), SELECTING).cast("int")
        end = F.when(place > 0, start + place - 1).otherwise(F.size(t["bare"]) + 1)
        return F.when(start > 0, F.struct(t["lines"].alias("lines"), t["bare"].alias("bare"), start.alias("lo"), end.alias("hi")))

    def cut(t: Column) -> Column:
        starts = F.filter(F.sequence(t["lo"], t["hi"] - 1), lambda i: F.array_contains(names, F.get(t["bare"], i - 1)))

        def ranges(at: Column) -> Column:
            ends = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(t["hi"]))
            return F.arrays_zip(at.alias("lo"), F.slice(ends, F.lit(1), F.size(at)).alias("hi"))

        return F.transform(
            X.bind(starts, ranges),
            lambda r: F.struct(
                F.get(t["bare"], r["lo"] - 1).alias("section"),
                F.slice(t["lines"], t["lo"] + 1, F.lit(8)).alias("head"),
                _section(F.slice(t["lines"], r["lo"] + 1, r["hi"] - r["lo"] - 1)).alias("part"),
            ),
        )

    both = X.bind(F.split(text, "\n"), lambda ls: F.struct(ls.alias("lines"), F.transform(ls, X.strip).alias("bare")))
    return X.bind(X.bind(both, bounds), lambda t: F.when(t.isNotNull(), F.filter(cut(t), lambda x: x["part"].isNotNull())))


def matching_sections(traces: DataFrame) -> DataFrame:
    """Sections of bit-rule traces (file, text) as (file, section, input, output, flags)."""
    rows = traces.select("file", F.inline(_trace_sections(F.col("text")))).select("file", "section", "head", "part.*")
    prefix = F.lit("")
    for name, short in SECTION_PREFIX.items():
        prefix = F.when(F.col("section") == name, F.lit(short)).otherwise(prefix)

    def bare_best(c: str) -> Column:
        tagged = F.concat(F.lit("Best: "), prefix)
        best = F.col(f"{c}.best")
        rest = F.concat(F.lit("Best: "), F.substring(best, F.length(tagged) + 1, F.length(best)))
        return F.when(F.startswith(best, tagged), rest).otherwise(best)

    output = F.concat(
        F.col("matches"),
        F.array(F.lit(""), F.lit("Left")),
        F.col("left.lines"),
        F.array(bare_best("left"), F.lit(""), F.lit("Right")),
        F.col("right.lines"),
        F.array(bare_best("right")),
    )
    n_matches = F.size(F.filter("data", lambda s: s.contains("match")))
    chains = F.array_join(F.concat("left.lines", "right.lines"), " ")
    none = F.array(F.lit("none"))
    return rows.select(
        "file",
        "section",
        F.concat(F.array_join("head", "\n"), F.lit("\n\n"), F.array_join("data", "\n")).alias("input"),
        F.array_join(output, "\n").alias("output"),
        chains.rlike(r"\dx").alias("has_x"),
        chains.rlike(r"\dy").alias("has_y"),
        (n_matches == 0).alias("all_absent"),
        ((F.col("left.lines") == none) & (F.col("right.lines") == none)).alias("both_none"),
        (n_matches < 4).alias("few_matches"),
    )


def keep_by_sparsity(sections: DataFrame) -> DataFrame:
    """Sparse sections are kept by hash: 1 in 100, 10 or 5 by how little they show."""
    key = F.concat_ws("_", "file", "section")
    keep = (
        F.when(F.col("all_absent"), sha_mod(key, 100) == 0)
        .when(F.col("both_none"), sha_mod(key, 10) == 0)
        .when(F.col("few_matches"), sha_mod(key, 5) < 1)
        .otherwise(F.lit(True))
    )
    return sections.filter(keep)


def matching_problems(sections: DataFrame, number: str = "n") -> DataFrame:
    """(id, prompt, completion, category) of numbered sections."""
    return sections.select(
        short_id(F.lit("matching"), F.col(number)).alias("id"),
        F.concat(F.lit(MATCHING_INTRO), "input").alias("prompt"),
        F.col("output").alias("completion"),
        F.lit("matching").alias("category"),
    )
