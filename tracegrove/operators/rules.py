"""Inferring simple rules from worked examples, as aggregates over example tables.

Example tables hold one row per example: ``problem_id, input_value, output_value`` (strings).
A rule fits a problem when it fits *all* its examples. Instead of one row per example and
rule, each example becomes bit masks; ``bit_or`` / ``bit_and`` combine them map-side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache, reduce
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType

from ..functions import answers as A
from ..functions import text as X
from ..session import shared_folder
from .ordering import top_per_group
from .quantiles import lower_median

# --- linear coefficients ---------------------------------------------------------------------


def _trunc_milli(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("decimal(28,0)")


def _square(x: Column) -> Column:
    """Exact for numbers below 10^8; larger ones keep six decimals."""
    small = x.try_cast("decimal(14,6)")
    return F.coalesce((small * small).try_cast("decimal(38,10)"), F.try_multiply(x, x).try_cast("decimal(38,10)"))


def thousandths(number_text: Column) -> Column:
    """Number text in thousandths, further decimals cut off; NULL for other text."""
    return _trunc_milli(number_text.try_cast("decimal(28,8)") * F.lit(1000))


def linear_factors(examples: DataFrame, squared: bool = False) -> DataFrame:
    """(problem_id, factor_milli): quotient output / input of each example, cut to 3 decimals.

    With ``squared`` the input counts squared (rounded to 4 places, then cut to 3). Inputs
    that are zero (squared: not positive) are left out.
    """
    x = F.col("input_value").try_cast("decimal(28,8)")
    divisor = _trunc_milli(F.round(_square(x), 4).cast("decimal(32,4)") * F.lit(1000)) if squared else thousandths(F.col("input_value"))
    usable = (x > 0) if squared else (x != 0)
    rows = examples.filter(usable).select(
        "problem_id", thousandths(F.col("output_value")).alias("_out"), divisor.alias("_in")
    )
    quotient = F.floor(F.try_divide((F.col("_out") * 1000).try_cast("decimal(28,0)"), F.col("_in")))
    return rows.select("problem_id", quotient.try_cast("bigint").alias("factor_milli")).filter(
        F.col("factor_milli").isNotNull()
    )


def solve_linear(examples: DataFrame, questions: DataFrame, squared: bool = False) -> DataFrame:
    """Answer = question (or its square) times the lower-middle factor, cut to 3 decimals.

    ``questions``: problem_id, question. Adds ``factor`` and ``answer`` (decimals).
    """
    factors = lower_median(linear_factors(examples, squared), "factor_milli", ["problem_id"], "factor_milli")
    q = F.col("question").try_cast("decimal(28,8)")
    base = _square(q) if squared else q
    factor = F.col("factor_milli").cast("decimal(19,0)")
    # Exact as long as it fits; a product of more digits keeps six decimals.
    product = F.coalesce(
        F.try_multiply(base.try_cast("decimal(22,10)"), factor.try_cast("decimal(14,0)")),
        F.try_multiply(base.try_cast("decimal(38,8)"), factor),
    )
    return questions.join(factors, "problem_id").select(
        *questions.columns,
        (F.col("factor_milli") / F.lit(1000.0)).alias("factor"),
        (F.floor(product) / F.lit(1000.0)).alias("answer"),
    )


# --- substitution ciphers --------------------------------------------------------------------

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _words(c: Column) -> Column:
    return F.filter(F.split(X.strip(c), r"(?U)\s+"), lambda w: w != "")


def substitution_maps(examples: DataFrame, order: str = "row_no") -> DataFrame:
    """(problem_id, mapping map<cipher, plain>) from aligned words; the first mapping wins.

    Lines with different word counts and word pairs with different lengths say nothing. Each
    line is reduced to its distinct letters in-row before anything is shuffled.
    """
    cipher, plain = _words(F.col("input_value")), _words(F.col("output_value"))
    pairs = F.filter(F.arrays_zip(cipher.alias("c"), plain.alias("p")), lambda w: F.length(w["c"]) == F.length(w["p"]))
    lines = examples.filter(F.size(cipher) == F.size(plain)).select(
        "problem_id",
        order,
        F.array_join(F.transform(pairs, lambda w: w["c"]), "").alias("c"),
        F.array_join(F.transform(pairs, lambda w: w["p"]), "").alias("p"),
    )
    first_place = F.transform(
        F.array_distinct(X.chars(F.col("c"))),
        lambda x: F.struct(x.alias("cipher"), F.substring(F.col("p"), F.call_function("locate", x, F.col("c")), F.lit(1)).alias("plain")),
    )
    found = lines.select("problem_id", order, F.inline(first_place))
    first = found.groupBy("problem_id", "cipher").agg(F.min_by("plain", order).alias("plain"))
    return first.groupBy("problem_id").agg(
        F.map_from_entries(F.collect_list(F.struct("cipher", "plain"))).alias("mapping")
    )


def translate(question: Column, mapping: Column, unknown: str = "?") -> Column:
    """Question with every letter replaced; spaces stay, unmapped letters show ``unknown``."""
    return F.array_join(
        F.transform(
            X.chars(question),
            lambda c: F.when(c == " ", c).otherwise(F.coalesce(F.try_element_at(mapping, c), F.lit(unknown))),
        ),
        "",
    )


def unknown_letters(question: Column, mapping: Column) -> Column:
    """Letters of the question without a mapping, sorted."""
    letters = F.filter(X.chars(question), lambda c: c != " ")
    return F.array_sort(F.array_except(letters, F.map_keys(mapping)))


def unused_targets(mapping: Column, alphabet: str = ALPHABET) -> Column:
    """Letters no cipher letter maps to yet."""
    return F.array_except(F.array(*[F.lit(c) for c in alphabet]), F.map_values(mapping))


def letter_pattern(word: Column) -> Column:
    """Shape of a word: for each letter the place of its first occurrence."""
    letters = X.chars(word)
    return F.array_join(F.transform(letters, lambda c: F.array_position(letters, c).cast("string")), ",")


#: Parts of a pattern's words; each is looked up by itself, as a pattern may have a third of all words.
SALTS = 8


def _fits(candidate: Column, letters: Column, known: Column) -> Column:
    """Agrees with known letters and gives the others targets that are not in use."""
    pairs = F.arrays_zip(letters.alias("c"), X.chars(candidate).alias("p"))
    used = F.map_values(known)
    return F.forall(
        pairs,
        lambda x: F.when(
            F.map_contains_key(known, x["c"]), F.try_element_at(known, x["c"]) == x["p"]
        ).otherwise(~F.array_contains(used, x["p"])),
    )


def solve_cipher(questions: DataFrame, maps: DataFrame, words: DataFrame) -> DataFrame:
    """``questions`` (problem_id, question) with ``solution``, NULL where a word stays open.

    Words the mapping covers are translated. The others are completed from the dictionary ``words`` (column
    ``word``, of any size), from left to right; a completed word's letters are known to the next ones. A
    fitting dictionary word has the same shape, agrees with known letters and gives unknown letters unused
    targets; the first one in alphabetical order wins.

    The dictionary is a table keyed by shape. The first open words of all questions are looked up by one join
    and aggregate, then the second ones, and so on.
    """
    spark = questions.sparkSession
    folder = shared_folder(spark, "cipher")
    salt = F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")
    shaped = words.select("word").filter(F.col("word").isNotNull()).distinct()
    shaped = shaped.select(F.col("word").alias("_candidate"), letter_pattern(F.col("word")).alias("_shape"), salt.alias("_salt"))
    mapping, open_words = F.col("mapping"), F.col("_open")
    is_open = lambda w: F.exists(X.chars(w), lambda c: ~F.map_contains_key(mapping, c))
    state = questions.join(maps, "problem_id").withColumn("_words", _words(F.col("question")))
    state = state.withColumn("_open", F.array_distinct(F.filter("_words", is_open)))
    state = state.withColumns({"_known": mapping, "_stuck": F.lit(False)})
    steps = 0
    while True:
        state.write.parquet(path := f"{folder}/{steps}")
        state = spark.read.schema(state.schema).parquet(path)
        waiting = ~F.col("_stuck") & (F.size("_open") > steps)
        if state.filter(waiting).isEmpty():
            break
        word = F.when(waiting, F.get(open_words, F.lit(steps)))
        state = state.withColumns({"_word": word, "_key": F.to_json(F.array_sort(F.map_entries("_known")))})
        asked = state.filter(F.col("_word").isNotNull()).groupBy("_word", "_key").agg(F.first("_known").alias("_known"))
        asked = asked.withColumns({"_shape": letter_pattern(F.col("_word")), "_salt": F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))})
        fitting = asked.join(shaped, ["_shape", "_salt"]).filter(_fits(F.col("_candidate"), X.chars(F.col("_word")), F.col("_known")))
        chosen = fitting.groupBy("_word", "_key").agg(F.min("_candidate").alias("_chosen"))
        state = state.join(chosen, ["_word", "_key"], "left")
        pairs = F.array_distinct(F.arrays_zip(X.chars(F.col("_word")).alias("cipher"), X.chars(F.col("_chosen")).alias("plain")))
        fresh = F.filter(pairs, lambda x: ~F.map_contains_key("_known", x["cipher"]))
        more = F.when(F.col("_chosen").isNotNull(), F.map_concat("_known", F.map_from_entries(fresh))).otherwise(F.col("_known"))
        state = state.withColumns({"_known": more, "_stuck": F.col("_stuck") | (F.col("_word").isNotNull() & F.col("_chosen").isNull())})
        state = state.drop("_word", "_key", "_chosen")
        steps += 1
    plain = F.array_join(F.transform("_words", lambda w: translate(w, F.col("_known"))), " ")
    return state.withColumn("solution", F.when(~F.col("_stuck"), plain)).drop("mapping", "_words", "_open", "_known", "_stuck")


# --- bit rules -------------------------------------------------------------------------------

N_BITS = 8

# Rule families in the order they are tried.
BIT_FAMILIES = ["I", "NOT", "0", "1", "XOR", "OR", "AND", "AND-NOT", "XOR-NOT", "OR-NOT"]

RULE_TYPE = "struct<family:string,primary:int,secondary:int>"


def _rule_value(family: str, a: int, b: int) -> int:
    if family.endswith("-NOT"):
        family, b = family[:-4], 1 - b
    values = {"0": 0, "1": 1, "I": a, "NOT": 1 - a, "XOR": a ^ b, "OR": a | b, "AND": a & b}
    return values[family]


def bit_rules() -> list[tuple[str, int | None, int | None]]:
    """All rules in priority order: family, then operands ascending."""
    rules: list[tuple[str, int | None, int | None]] = []
    for family in BIT_FAMILIES:
        if family in "01":
            rules.append((family, None, None))
        elif family in ("I", "NOT"):
            rules += [(family, i, None) for i in range(N_BITS)]
        else:
            rules += [(family, i, j) for i, j in permutations(range(N_BITS), 2)]
    return rules


@cache
def _rule_table_text() -> str:
    entries = []
    for family, i, j in bit_rules():
        table = 0
        for x in range(256):
            a = x >> (7 - i) & 1 if i is not None else 0
            b = x >> (7 - j) & 1 if j is not None else 0
            table |= _rule_value(family, a, b) << x
        words = [int.from_bytes((table >> (64 * w) & (2**64 - 1)).to_bytes(8, "big"), "big", signed=True) for w in range(4)]
        numbers = ["CAST(NULL AS INT)" if v is None else str(v) for v in (i, j)]
        outputs = ", ".join(f"'t{w}', CAST('{v}' AS BIGINT)" for w, v in enumerate(words))
        entries.append(f"named_struct('family', '{family}', 'primary', {numbers[0]}, 'secondary', {numbers[1]}, {outputs})")
    return f"array({', '.join(entries)})"


def _rule_table() -> Column:
    """Array of rules with their outputs for all 256 inputs, as four 64-bit words.

    Plain constructors, so that it becomes one constant of the plan.
    """
    return F.expr(_rule_table_text())


def clean_bits(c: Column) -> Column:
    """Only the 0 and 1 characters; blank unless there are exactly eight."""
    bits = F.regexp_replace(c, "[^01]", "")
    return F.when(F.length(bits) == N_BITS, bits).otherwise(F.lit(""))


def infer_bit_rules(examples: DataFrame) -> DataFrame:
    """(problem_id, vector array<rule>): the first rule per output bit that fits all examples.

    Problems with a malformed value or a bit without any rule are left out. Each problem
    shrinks to 64 words: which inputs were seen with output bit 1, and with 0.
    """
    x = F.conv(clean_bits(F.col("input_value")), 2, 10).cast("int")
    y = F.conv(clean_bits(F.col("output_value")), 2, 10).cast("int")
    bad = (clean_bits(F.col("input_value")) == "") | (clean_bits(F.col("output_value")) == "")
    rows = examples.select(
        "problem_id",
        bad.alias("bad"),
        F.when(~bad, x).alias("x"),
        F.when(~bad, y).alias("y"),
    ).withColumn("at", F.expr("shiftleft(1L, x % 64)"))
    aggs = [F.bool_or("bad").alias("bad")]
    for w in range(4):
        here = F.col("x").between(64 * w, 64 * w + 63)
        for bit in range(N_BITS):
            one = F.getbit(F.col("y"), F.lit(7 - bit)) == 1
            for name, hit in (("ones", one), ("zeros", ~one)):
                word = F.when(here & hit, F.col("at")).otherwise(F.lit(0).cast("bigint"))
                aggs.append(F.bit_or(word).alias(f"{name}_{bit}_{w}"))
    seen = rows.groupBy("problem_id").agg(*aggs).filter("NOT bad")
    words = F.array(*[F.col(f"{n}_{b}_{w}") for n in ("ones", "zeros") for b in range(N_BITS) for w in range(4)])
    table = _rule_table()
    # The search of numbers works on whole batches; the table turns them into rules.
    found = seen.select("problem_id", F.arrow_udf(_first_rules, ArrayType(IntegerType()))(words).alias("_found")).filter(F.col("_found").isNotNull())
    vector = F.transform("_found", lambda k: X.bind(F.get(table, k), _bare_rule))
    return found.select("problem_id", vector.alias("vector"))


def _bare_rule(rule: Column) -> Column:
    return F.struct(*[rule[c].alias(c) for c in ("family", "primary", "secondary")])


@cache
def _outputs() -> np.ndarray:
    """Output of each rule for the inputs 0 to 255 and, at 256, for none."""
    return np.concatenate([_all_outputs()[BIT_FAMILIES.index(f), N_BITS if i is None else i, N_BITS if j is None else j][None] for f, i, j in bit_rules()])


@cache
def _all_outputs() -> np.ndarray:
    """Output by family (the last one: any other), first and second operand (8: none) and input (256: none), as
    :func:`apply_bit_rules` has it: what is unknown gives 0."""
    x = np.arange(256)
    bit = np.stack([np.append(x >> (7 - i) & 1, -1) for i in range(N_BITS)] + [np.full(257, -1)])
    out = np.zeros((len(BIT_FAMILIES) + 1, N_BITS + 1, N_BITS + 1, 257), np.uint8)
    for k, family in enumerate(BIT_FAMILIES):
        for i in range(N_BITS + 1):
            for j in range(N_BITS + 1):
                a, b = bit[i], bit[j]
                if family.endswith("-NOT"):
                    b = np.where(b < 0, b, 1 - b)
                base = family.removesuffix("-NOT")
                both = (a >= 0) & (b >= 0)
                out[k, i, j] = {
                    "0": a > 1, "1": a < 2, "I": a == 1, "NOT": a == 0, "XOR": both & (a != b), "OR": (a == 1) | (b == 1), "AND": (a == 1) & (b == 1)
                }[base]
    return out


def _lists(column: pa.Array, missing: int) -> np.ndarray:
    """A list column as a table; short lists and NULL entries are filled up."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    table = np.full((len(sizes), max(sizes.max(initial=0), 1)), missing, np.int64)
    table[np.arange(table.shape[1]) < sizes[:, None]] = pc.fill_null(column.flatten(), missing)
    return table


def _with_nulls(values: np.ndarray, missing: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind, mask=missing)


#: Rows worked on at a time.
SLICE = 1024


def _fitting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of the first rule for each output bit that fits the examples of each row, -1 for none. An input or
    output below 0 and an input above 255 say nothing."""
    shifts = np.arange(N_BITS - 1, -1, -1)
    best = np.empty((len(x), N_BITS), np.int64)
    for low in range(0, len(x), SLICE):
        xs, ys = x[low : low + SLICE], y[low : low + SLICE]
        fits = np.ones((len(xs), N_BITS, len(_outputs())), bool)
        for first in range(0, xs.shape[1], 8):
            # Eight examples in one byte: what a rule gives, and what is wanted.
            given = np.zeros((len(xs), len(_outputs())), np.uint8)
            wanted = np.zeros((len(xs), N_BITS), np.uint8)
            for k, at in enumerate(range(first, min(first + 8, xs.shape[1]))):
                known = (xs[:, at] >= 0) & (xs[:, at] < 256) & (ys[:, at] >= 0)
                now = np.where(known, xs[:, at], 256)
                given |= np.where(known[:, None], _outputs().T[now], 0).astype(np.uint8) << k
                wanted |= np.where(known[:, None], ys[:, at, None] >> shifts & 1, 0).astype(np.uint8) << k
            fits &= given[:, None, :] == wanted[:, :, None]
        best[low : low + SLICE] = np.where(fits.any(2), fits.argmax(2), -1)
    return best


def _outputs_packed(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.int64) @ (1 << np.arange(N_BITS - 1, -1, -1))


def _answered(x: np.ndarray, y: np.ndarray, question: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(answer to each question by the rules that fit first, whether there are none)."""
    rule = _fitting(x, y)
    at = np.where(question < 0, 256, question & 255)
    return _outputs_packed(_outputs()[rule, at[:, None]]), (rule < 0).any(1)


def _first_rules(words: pa.Array) -> pa.Array:
    """Numbers of the first rules that fit the inputs seen with a 1 and with a 0 (see :func:`infer_bit_rules`)."""
    seen = np.asarray(words.flatten(), np.int64).view(np.uint64).reshape(-1, 2, N_BITS, 4)
    table = np.ascontiguousarray(np.packbits(_outputs()[:, :256], axis=1, bitorder="little")).view("<u8")
    best = np.empty((len(seen), N_BITS), np.int64)
    for low in range(0, len(seen), SLICE):
        part = seen[low : low + SLICE]
        for bit in range(N_BITS):
            clash = np.zeros((len(part), len(table)), bool)
            for w in range(4):
                clash |= ((part[:, 0, bit, w, None] & ~table[None, :, w]) | (part[:, 1, bit, w, None] & table[None, :, w])) != 0
            best[low : low + len(part), bit] = np.where(clash.all(1), -1, (~clash).argmax(1))
    none = (best < 0).any(1)
    ends = np.concatenate([[0], np.cumsum(np.where(none, 0, N_BITS))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(best[~none].ravel(), pa.int32()), mask=pa.array(none))


def _answer_of(x: pa.Array, y: pa.Array, question: pa.Array) -> pa.Array:
    xs, ys = _lists(x, -1), _lists(y, -1)
    answer, none = _answered(xs, ys, np.asarray(pc.fill_null(question, -1), np.int64))
    return _with_nulls(answer, none | np.asarray(x.is_null()), pa.int32())


def _same_answer(codes: pa.Array, start: pa.Array, stride: pa.Array, n: pa.Array) -> pa.Array:
    rule, sizes = _lists(codes, 0), np.asarray(n, np.int64)
    steps = np.arange(sizes.max(initial=0) + 1)
    xs = (np.asarray(start, np.int64)[:, None] + np.asarray(stride, np.int64)[:, None] * steps) % 256
    made = _outputs_packed(_all_outputs().reshape(-1, 257)[rule[:, None, :], xs[:, :, None]])
    shown = np.where(steps[1:] <= sizes[:, None], xs[:, 1:], -1)
    answer, none = _answered(shown, made[:, 1:], xs[:, 0])
    return pa.array(~none & (answer == made[:, 0]))


def _number(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("int")


def _stays(f: Callable, kind: DataType) -> Callable[..., Column]:
    """``f`` over Arrow arrays as a function of columns. It counts as nondeterministic, which it is not, so that a filter
    by its result stays where it is: below the columns it needs they would all be worked out twice."""
    return F.arrow_udf(f, kind).asNondeterministic()


def answer_of_examples(examples: Column, question: Column) -> Column:
    """:func:`apply_bit_rules` of :func:`rules_of_examples` for a question; NULL without rules. Rules are searched for
    in whole batches of rows."""
    x = F.transform(examples, lambda e: _number(e["input_value"]))
    y = F.transform(examples, lambda e: _number(e["output_value"]))
    return F.lpad(F.bin(_stays(_answer_of, IntegerType())(x, y, _number(question)).cast("bigint")), N_BITS, "0")


def rules_explained(vector: Column, start: Column, stride: Column, n_examples: Column) -> Column:
    """Whether rules inferred from what ``vector`` makes of ``start + i * stride`` (modulo 256, i from 1 to
    ``n_examples``) agree with it on ``start``. Nothing is written as text, so it suits vectors tried in great number."""
    families = F.array(*[F.lit(f) for f in BIT_FAMILIES])

    def code(rule: Column) -> Column:
        place = F.array_position(families, rule["family"])
        family = F.when(place > 0, place - 1).otherwise(len(BIT_FAMILIES))
        first, second = (F.coalesce(rule[c], F.lit(N_BITS)) for c in ("primary", "secondary"))
        return ((family * (N_BITS + 1) + first) * (N_BITS + 1) + second).cast("int")

    return _stays(_same_answer, BooleanType())(F.transform(vector, code), start, stride, n_examples)


def _complete_vector(bits: Column) -> Column:
    """array(vector) of the first fitting rule per output bit, NULL when a bit has none.

    ``bits``: per output bit the inputs seen with a 1 and with a 0, as four words each.
    """
    rules = _rule_table()

    def fits(rule: Column, bit: Column) -> Column:
        # The conjunction stops at the first word that contradicts the rule.
        checks = []
        for w in range(4):
            checks.append(bit[f"ones{w}"].bitwiseAND(F.bitwise_not(rule[f"t{w}"])) == 0)
            checks.append(bit[f"zeros{w}"].bitwiseAND(rule[f"t{w}"]) == 0)
        return reduce(lambda a, b: a & b, checks)

    def first_fit(bit: Column) -> Column:
        return X.bind(
            F.get(F.filter(rules, lambda r: fits(r, bit)), F.lit(0)),
            lambda r: F.when(r.isNotNull(), F.struct(*[r[c].alias(c) for c in ("family", "primary", "secondary")])),
        )

    return X.bind(F.transform(bits, first_fit), lambda v: F.when(~F.exists(v, lambda r: r.isNull()), F.array(v)))


def rules_of_examples(examples: Column) -> Column:
    """Rule vector of one row's examples array<struct(input_value, output_value)>, or NULL.

    For problems that carry their few examples in the row: no shuffle.
    """

    def number(c: Column) -> Column:
        return F.conv(c, 2, 10).cast("int")

    def words(pairs: Column) -> Column:
        def word(bit: Column, w: int, value: int) -> Column:
            def add(acc: Column, e: Column) -> Column:
                here = e["x"].between(64 * w, 64 * w + 63) & (F.getbit(e["y"], F.lit(N_BITS - 1) - bit) == value)
                one = F.call_function("shiftleft", F.lit(1).cast("bigint"), e["x"] % 64)
                return F.when(here, acc.bitwiseOR(one)).otherwise(acc)

            return F.aggregate(pairs, F.lit(0).cast("bigint"), add)

        def of_bit(bit: Column) -> Column:
            named = (("ones", 1), ("zeros", 0))
            return F.struct(*[word(bit, w, v).alias(f"{n}{w}") for n, v in named for w in range(4)])

        return F.transform(F.sequence(F.lit(0), F.lit(N_BITS - 1)), of_bit)

    pairs = F.transform(
        examples, lambda e: F.struct(number(e["input_value"]).alias("x"), number(e["output_value"]).alias("y"))
    )
    return F.get(_complete_vector(X.bind(pairs, words)), F.lit(0))


def apply_bit_rules(bits: Column, vector: Column) -> Column:
    """Output bits of a rule vector for one 8-character input."""

    def outputs(x: Column) -> Column:
        def value(rule: Column) -> Column:
            base = F.substring_index(rule["family"], "-", 1)
            a = F.getbit(x, F.lit(N_BITS - 1) - rule["primary"]) == 1
            b = (F.getbit(x, F.lit(N_BITS - 1) - rule["secondary"]) == 1) != rule["family"].endswith("-NOT")
            truth = (
                F.when(base == "0", F.lit(False))
                .when(base == "1", F.lit(True))
                .when(base == "I", a)
                .when(base == "NOT", ~a)
                .when(base == "XOR", a != b)
                .when(base == "OR", a | b)
                .when(base == "AND", a & b)
            )
            return F.when(truth, "1").otherwise("0")

        return F.array_join(F.transform(vector, value), "")

    return X.bind(F.conv(bits, 2, 10).cast("int"), outputs)


def solve_bits(examples: DataFrame, questions: DataFrame) -> DataFrame:
    """``questions`` (problem_id, question) with ``vector`` and ``solution`` where rules exist."""
    solved = questions.join(infer_bit_rules(examples), "problem_id")
    return solved.withColumn("solution", apply_bit_rules(F.col("question"), F.col("vector")))


def rule_families(vector: Column) -> Column:
    return F.array_distinct(F.transform(vector, lambda r: r["family"]))


def weakness_counts(rollouts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Wrong rollouts per rule family of their problem (all rollouts of a problem count)."""
    wrong = A.wrong_attempt(F.col("reward"), F.col("text"), F.col("answer"), F.col("pred"), need_answer=True)
    per_problem = rollouts.filter(wrong).groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"))
    families = vectors.select("problem_id", F.explode(rule_families(F.col("vector"))).alias("family"))
    return per_problem.join(families, "problem_id").groupBy("family").agg(F.sum("n").alias("wrong_rollouts"))


def count_sections(vector: Column) -> Column:
    """Stretches of neighbouring rules with one family and operands that step by one (mod 8)."""

    def step(prev: Column, now: Column) -> Column:
        def strides(field: str) -> Column:
            follows = F.pmod(prev[field] + 1, F.lit(N_BITS)) == now[field]
            return F.coalesce(follows, F.lit(True))

        constant = now["family"].isin("0", "1")
        same = (prev["family"] == now["family"]) | (constant & prev["family"].isin("0", "1"))
        return same & (constant | (strides("primary") & strides("secondary")))

    breaks = F.zip_with(
        F.slice(vector, 1, N_BITS - 1), F.slice(vector, 2, N_BITS - 1), lambda p, n: F.when(step(p, n), 0).otherwise(1)
    )
    return F.aggregate(breaks, F.lit(1), lambda acc, b: acc + b)


def section_accuracy(solved: DataFrame, samples: int = 3) -> DataFrame:
    """Accuracy by number of sections with the first ids on both sides.

    ``solved``: problem_id, vector, solution, answer.
    """
    match = A.answers_match(F.col("answer"), F.col("solution"), mode=A.SYMMETRIC)
    rows = solved.select("problem_id", count_sections(F.col("vector")).alias("sections"), match.alias("match"))
    counts = rows.groupBy("sections").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("match").alias("correct"),
        (F.count_if("match") * 100.0 / F.count(F.lit(1))).alias("accuracy"),
    )
    some = top_per_group(rows, ["sections", "match"], [F.asc("problem_id")], samples)

    def ids(side: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(side, F.col("problem_id")))), ", ")

    names = some.groupBy("sections").agg(
        ids(F.col("match")).alias("correct_ids"), ids(~F.col("match")).alias("wrong_ids")
    )
    return counts.join(names, "sections", "left")


# --- numeric operations ----------------------------------------------------------------------


def _as_text(c: Column) -> Column:
    return c.cast("string")


OPERANDS = ["sa", "sb", "a", "b", "d1", "d2", "d3", "d4"]


def operands(sa: Column, sb: Column) -> dict[str, Column]:
    """Two digit strings, their values and, for two-digit strings, their digits.

    Worth a projection of its own: the operations use each of them many times.
    """
    two = (F.length(sa) == 2) & (F.length(sb) == 2)
    digits = [F.when(two, F.substring(s, i, 1).try_cast("int")) for s in (sa, sb) for i in (1, 2)]
    return dict(zip(OPERANDS, [sa, sb, sa.try_cast("bigint"), sb.try_cast("bigint"), *digits]))


class Result(NamedTuple):
    """An operation's result: a long or else a text, and, for a long that may overflow, the text it then has."""

    value: Column
    is_long: bool = False
    wide: Column | None = None

    def text(self) -> Column:
        text = _as_text(self.value) if self.is_long else self.value
        return text if self.wide is None else F.coalesce(text, self.wide)


def numeric_results(v: Mapping[str, Column]) -> dict[str, Column]:
    """Texts of the results of all numeric operations, as :func:`numeric_values` has them."""
    return {n: r.text() for n, r in numeric_values(v).items()}


def numeric_values(v: Mapping[str, Column]) -> dict[str, Result]:
    """Results of all numeric operations on :func:`operands`, in the order they are tried.

    The first eight are the common ones. An operation that is undefined gives NULL.
    """
    sa, sb, a, b = v["sa"], v["sb"], v["a"], v["b"]
    d = [v["d1"], v["d2"], v["d3"], v["d4"]]

    def text(*values: Column) -> Result:
        if len(values) == 1:
            return Result(values[0].cast("bigint"), True)
        return Result(F.concat(*[_as_text(v) for v in values]))

    def exact(narrow: Column, wide: Callable[[Column, Column], Column]) -> Result:
        """The long, or the decimal's text where the long overflows."""
        c, d = (x.cast("decimal(19,0)") for x in (a, b))
        return Result(narrow, True, F.when(narrow.isNull(), wide(c, d).cast("string")))

    def total(x: Column, y: Column, plus: int = 0) -> Result:
        return exact(F.try_add(F.try_add(x, y), F.lit(plus)), lambda c, d: c + d + plus)

    def difference(x: Column, y: Column, plus: int = 0) -> Result:
        return text(F.try_add(F.try_subtract(x, y), F.lit(plus)))

    def product(plus: int = 0) -> Result:
        return exact(F.try_add(F.try_multiply(a, b), F.lit(plus)), lambda c, d: c * d + plus)

    ten = F.lit(10)
    big, small = F.greatest(a, b), F.least(a, b)
    det = d[0] * d[3] - d[1] * d[2]
    common = {
        "concatenation": Result(F.concat(sa, sb)),
        "reverse concatenation": Result(F.concat(sb, sa)),
        "addition": total(a, b),
        "absolute difference": text(F.abs(a - b)),
        "negated absolute difference": text(-F.abs(a - b)),
        "subtraction (a-b)": difference(a, b),
        "reverse subtraction (b-a)": difference(b, a),
        "multiplication": product(),
    }
    rare = {
        "multiply+1": product(1),
        "multiply-1": product(-1),
        "add+1": total(a, b, 1),
        "add-1": total(a, b, -1),
        "sub+1": difference(a, b, 1),
        "sub-1": difference(a, b, -1),
        "max mod min": text(F.try_mod(big, small)),
        "integer division (a/b)": text(F.when(b != 0, F.floor(F.try_divide(a, b)))),
        "modulo (a mod b)": text(F.try_mod(a, b)),
        "reverse division (b/a)": text(F.when(a != 0, F.floor(F.try_divide(b, a)))),
        "reverse modulo (b mod a)": text(F.try_mod(b, a)),
        "digit absolute diff": text(F.abs(d[0] - d[2]), F.abs(d[1] - d[3])),
        "digit add mod10": text(F.pmod(d[0] + d[2], ten), F.pmod(d[1] + d[3], ten)),
        "digit sub mod10": text(F.pmod(d[0] - d[2], ten), F.pmod(d[1] - d[3], ten)),
        "cross multiply": text(d[0] * d[2] + d[1] * d[3]),
        "cross multiply rev": text(d[0] * d[3] + d[1] * d[2]),
        "digit multiply": text(d[0] * d[2], d[1] * d[3]),
        "digit multiply rev": text(d[0] * d[3], d[1] * d[2]),
        "digit sum diff": text((d[0] + d[1]) - (d[2] + d[3])),
        "digit sum sum": text((d[0] + d[1]) + (d[2] + d[3])),
        "digit product diff": text(d[0] * d[1] - d[2] * d[3]),
        "digit product sum": text(d[0] * d[1] + d[2] * d[3]),
        "determinant": text(det),
        "abs determinant": text(F.abs(det)),
    }
    return common | rare


N_COMMON = 8
# Order in which operand and result reversal is tried.
REVERSALS = [(True, True), (False, False), (True, False), (False, True)]


def _hits(results: Column, wanted: Column) -> Column:
    """Bit mask of the results that equal the wanted text."""
    bits = F.transform(
        results, lambda r, i: F.when(r == wanted, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    )
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, m: acc.bitwiseOR(m))


#: Ways a negative result may be written: as a number, with a minus behind, with the operator behind, and
#: with the operator before the digits.
AS_NUMBER, MINUS_BEHIND, OP_BEHIND, OP_BEFORE = range(4)


def _sign_flags(out: Column, op: Column) -> dict[str, Column]:
    """What an output says about how its operator writes negative results."""
    long = F.length(out) > 1
    return {
        "minus_behind": (op != "-") & out.endswith("-") & long,
        "minus_before": (op != "-") & out.startswith("-") & long,
        "op_behind": F.endswith(out, op) & long,
        "op_before": F.startswith(out, op) & long,
    }


def _written(out: Column, op: Column) -> list[Column]:
    """The output as a number under each way of writing negative results."""
    n = F.length(out)
    behind = F.concat(F.lit("-"), F.substring(out, F.lit(1), n - 1))
    return [
        out,
        F.when(out.endswith("-") & (n > 1), behind).otherwise(out),
        F.when(F.endswith(out, op) & (n > 1), behind).otherwise(out),
        F.when(F.startswith(out, op) & (n > 1), F.concat(F.lit("-"), F.substring(out, F.lit(2), n))).otherwise(out),
    ]


def _long_of(name: str) -> Column:
    """The long that a column is the text of, as a cast writes it; else NULL."""
    value = F.col(name).try_cast("bigint")
    return F.when(value.cast("string") == F.col(name), value)


def infer_numeric_ops(equations: DataFrame) -> DataFrame:
    """(problem_id, op, fmt, examples, first_row, rule_name, rev_ops, rev_res).

    ``equations``: problem_id, row_no, a, op, b, output_value. ``fmt`` tells how an operator writes negative
    results: ``neg_suffix`` / ``neg_prefix`` if a minus, or else the operator itself, stands behind or before
    the digits of any of its outputs, else ``num``. The rule is the first operation, in the order common/rare
    set, reversal, operation, that explains every example of an operator.

    One aggregate has the masks of all ways of writing and the flags that choose among them, so rows move
    once. A row whose output reads the same in all ways, as nearly every one does, is worked out once.
    """
    op, out = F.col("op"), F.col("output_value")
    ways = F.array(*_written(out, op))
    rows = equations.select(
        "problem_id",
        "op",
        "row_no",
        "a",
        "b",
        *[c.alias(n) for n, c in _sign_flags(out, op).items()],
        F.posexplode(X.bind(ways, lambda w: F.transform(F.array_distinct(w), lambda x: F.struct(x.alias("out"), w.alias("ways"))))).alias("_way", "_w"),
    )
    ways_of = [(F.col("_w.ways")[k] == F.col("_w.out")).alias(f"is{k}") for k in range(4)]
    flags = ["minus_behind", "minus_before", "op_behind", "op_before"]
    rows = rows.select(
        "problem_id",
        "op",
        "row_no",
        "_way",
        *flags,
        *ways_of,
        F.col("_w.out").alias("_out"),
        F.reverse("_w.out").alias("_tuo"),
        *[c.alias(f"f_{n}") for n, c in operands(F.col("a"), F.col("b")).items()],
        *[c.alias(f"r_{n}") for n, c in operands(F.reverse("a"), F.reverse("b")).items()],
    )
    forward = numeric_values({n: F.col(f"f_{n}") for n in OPERANDS})
    backward = numeric_values({n: F.col(f"r_{n}") for n in OPERANDS})
    names = list(forward)
    keep = ["problem_id", "op", "row_no", "_way", *flags, *[f"is{k}" for k in range(4)]]
    sides = {"_plain": list(forward.values()), "_turned": list(backward.values())}
    # A long is compared as a long with outputs that are a long's text, not written out for each comparison.
    rows = rows.select(
        *keep,
        "_out",
        "_tuo",
        _long_of("_out").alias("_out_long"),
        _long_of("_tuo").alias("_tuo_long"),
        *[r.value.alias(f"{side}{i}") for side, rs in sides.items() for i, r in enumerate(rs)],
        *[r.wide.alias(f"{side}{i}w") for side, rs in sides.items() for i, r in enumerate(rs) if r.wide is not None],
    )

    def equal(side: str, i: int, wanted: str) -> Column:
        r = sides[side][i]
        same = F.col(f"{side}{i}") == F.col(f"{wanted}_long" if r.is_long else wanted)
        return same if r.wide is None else F.coalesce(same, F.col(f"{side}{i}w") == F.col(wanted))

    masks = []
    for k, (rev_ops, rev_res) in enumerate(REVERSALS):
        side, wanted = "_turned" if rev_ops else "_plain", "_tuo" if rev_res else "_out"
        bits = [
            F.when(equal(side, i, wanted), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
            for i in range(len(names))
        ]
        masks.append(reduce(lambda a, b: a.bitwiseOR(b), bits).alias(f"m{k}"))
    found = rows.select(*keep, *masks).groupBy("problem_id", "op").agg(
        *[F.bit_and(F.when(F.col(f"is{w}"), F.col(f"m{k}"))).alias(f"m{w}{k}") for w in range(4) for k in range(len(REVERSALS))],
        *[F.bool_or(n).alias(n) for n in flags],
        F.count_if(F.col("_way") == 0).alias("examples"),
        F.min("row_no").alias("first_row"),
    )
    way = (
        F.when(F.col("minus_behind"), MINUS_BEHIND)
        .when(F.col("minus_before"), AS_NUMBER)
        .when(F.col("op_behind"), OP_BEHIND)
        .when(F.col("op_before"), OP_BEFORE)
        .otherwise(AS_NUMBER)
    )
    behind = F.col("minus_behind") | (~F.col("minus_before") & F.col("op_behind"))
    fmt = F.when(behind, "neg_suffix").when(F.col("minus_before") | F.col("op_before"), "neg_prefix").otherwise("num")
    chosen = [F.get(F.array(*[F.col(f"m{w}{k}") for w in range(4)]), way).alias(f"m{k}") for k in range(len(REVERSALS))]
    found = found.select("problem_id", "op", fmt.alias("fmt"), "examples", "first_row", *chosen)
    trials = []
    for low, high in ((0, N_COMMON), (N_COMMON, len(names))):
        for k, (rev_ops, rev_res) in enumerate(REVERSALS):
            window = F.lit((1 << high) - (1 << low)).cast("bigint")
            hit = F.col(f"m{k}").bitwiseAND(window)
            lowest = F.bit_count(hit.bitwiseAND(-hit) - 1)
            trials.append(
                F.when(
                    hit != 0,
                    F.struct(lowest.cast("int").alias("op_no"), F.lit(rev_ops).alias("rev_ops"), F.lit(rev_res).alias("rev_res")),
                )
            )
    best = F.coalesce(*trials)
    return found.withColumn("_best", best).select(
        "problem_id",
        "op",
        "fmt",
        "examples",
        "first_row",
        F.get(F.array(*[F.lit(n) for n in names]), F.col("_best.op_no")).alias("rule_name"),
        F.col("_best.rev_ops").alias("rev_ops"),
        F.col("_best.rev_res").alias("rev_res"),
    )


def apply_numeric_op(a: Column, b: Column, rule_name: Column, rev_ops: Column, rev_res: Column) -> Column:
    sa, sb = F.when(rev_ops, F.reverse(a)).otherwise(a), F.when(rev_ops, F.reverse(b)).otherwise(b)

    def pick(v: Mapping[str, Column]) -> Column:
        results = numeric_results(v)
        place = F.array_position(F.array(*[F.lit(n) for n in results]), rule_name) - 1
        return F.get(F.array(*results.values()), place.cast("int"))

    raw = _with_operands(sa, sb, pick)
    return F.when(rev_res, F.reverse(raw)).otherwise(raw)


def _with_operands(sa: Column, sb: Column, body) -> Column:
    """``body`` of the operands, each computed once per row."""
    texts = F.struct(sa.alias("sa"), sb.alias("sb"))
    return X.bind(
        X.bind(texts, lambda t: F.struct(*[c.alias(n) for n, c in operands(t["sa"], t["sb"]).items()])),
        lambda v: body({n: v[n] for n in OPERANDS}),
    )


def solve_equations(equations: DataFrame, questions: DataFrame) -> DataFrame:
    """``questions`` (problem_id, a, op, b) with the inferred rule and ``solution``.

    A question with an operator no example has uses the absolute difference, provided the
    problem's most frequent operator (the earliest on ties) could be explained.
    """
    # Read twice below; a row per problem and operator, so kept rather than inferred again.
    spark, path = equations.sparkSession, shared_folder(equations.sparkSession, "rules-found")
    infer_numeric_ops(equations).write.parquet(path)
    found = spark.read.parquet(path)
    ranking = F.struct(F.col("examples"), -F.col("first_row"))
    common = found.groupBy("problem_id").agg(
        F.max_by("op", ranking).alias("top_op"), F.max_by("rule_name", ranking).alias("top_rule"), F.max_by("fmt", ranking).alias("top_fmt")
    )
    own = found.select("problem_id", "op", "fmt", "rule_name", "rev_ops", "rev_res", F.lit(True).alias("seen"))
    q = questions.join(common, "problem_id").join(own, ["problem_id", "op"], "left")
    seen = F.coalesce("seen", F.lit(False))
    rule = F.when(seen, F.col("rule_name")).when(F.col("top_rule").isNotNull(), F.lit("absolute difference"))
    q = q.withColumn("rule_name", rule).withColumn("fmt", F.when(seen, F.col("fmt")).otherwise(F.col("top_fmt")))
    value = apply_numeric_op(
        F.col("a"),
        F.col("b"),
        F.col("rule_name"),
        F.coalesce("rev_ops", F.lit(False)),
        F.coalesce("rev_res", F.lit(False)),
    )

    def written(v: Column) -> Column:
        minus, digits = v.startswith("-"), F.substring(v, F.lit(2), F.length(v))
        return (
            F.when((F.col("fmt") == "neg_suffix") & minus, F.concat(digits, "op"))
            .when((F.col("fmt") == "neg_prefix") & minus, F.concat("op", digits))
            .otherwise(v)
        )

    solution = X.bind(value, written)
    return q.withColumn("solution", solution).filter(F.col("rule_name").isNotNull()).select(
        *questions.columns, "rule_name", "rev_ops", "rev_res", "fmt", "solution"
    )


# --- consistency gate ------------------------------------------------------------------------


def _gate_numeric(v: Mapping[str, Column]) -> dict[str, Column]:
    r = numeric_results(v)
    digits = v["sa"].rlike(r"^\d+$") & v["sb"].rlike(r"^\d+$")
    named = {
        "addition": r["addition"],
        "subtraction": r["subtraction (a-b)"],
        "reverse subtraction": r["reverse subtraction (b-a)"],
        "absolute difference": r["absolute difference"],
        "multiplication": r["multiplication"],
        "concatenation": r["concatenation"],
        "reverse concatenation": r["reverse concatenation"],
        "integer division": r["integer division (a/b)"],
        "modulo": r["modulo (a mod b)"],
        "reverse integer division": r["reverse division (b/a)"],
        "reverse modulo": r["reverse modulo (b mod a)"],
        "digit add mod10": r["digit add mod10"],
        "digit sub mod10": r["digit sub mod10"],
        "cross multiply": r["cross multiply"],
        "cross multiply reverse": r["cross multiply rev"],
        "determinant": r["determinant"],
        "absolute determinant": r["abs determinant"],
    }
    return {k: F.when(digits, v) for k, v in named.items()}


def _gate_symbols(v: Mapping[str, Column]) -> dict[str, Column]:
    left, right = v["sa"], v["sb"]
    return {
        "left side": left,
        "right side": right,
        "concatenation": F.concat(left, right),
        "reverse concatenation": F.concat(right, left),
        "outer symbols": F.concat(F.left(left, F.lit(1)), F.right(right, F.lit(1))),
        "inner symbols": F.concat(F.right(left, F.lit(1)), F.left(right, F.lit(1))),
        "left reversed plus right": F.concat(F.reverse(left), right),
        "right reversed plus left": F.concat(F.reverse(right), left),
    }


EXPRESSION = r"^(.+?)(\D)(.+)$"


def consistent_rule(examples: Column, question: Column, answer: Column) -> Column:
    """Name of the first operation that explains the answer and every example; NULL if none.

    ``examples`` is array<struct(input_value, output_value)>. Numeric operations apply when
    all example operands are digits, symbol operations otherwise.
    """

    def part(c: Column, i: int) -> Column:
        return F.regexp_extract(c, EXPRESSION, i)

    parsable = question.rlike(EXPRESSION) & F.forall(examples, lambda e: e["input_value"].rlike(EXPRESSION))
    numeric = F.forall(
        examples,
        lambda e: part(e["input_value"], 1).rlike(r"^\d+$") & part(e["input_value"], 3).rlike(r"^\d+$"),
    )

    def first_name(table) -> Column:
        names = list(table({n: F.lit(None) for n in OPERANDS}))

        def mask(text: Column, out: Column) -> Column:
            return _with_operands(part(text, 1), part(text, 3), lambda v: _hits(F.array(*table(v).values()), out))

        shared = F.aggregate(
            examples, mask(question, answer), lambda acc, e: acc.bitwiseAND(mask(e["input_value"], e["output_value"]))
        )
        lowest = F.bit_count(shared.bitwiseAND(-shared) - 1).cast("int")
        return F.when(shared != 0, F.get(F.array(*[F.lit(n) for n in names]), lowest))

    return F.when(parsable, F.when(numeric, first_name(_gate_numeric)).otherwise(first_name(_gate_symbols)))


def concatenation_types(equations: DataFrame) -> DataFrame:
    """(problem_id, op, kind): all outputs are a‖b (fwd) or all are b‖a (rev), else NULL."""
    out = F.col("output_value")
    flags = equations.groupBy("problem_id", "op").agg(
        F.bool_and(out == F.concat("a", "b")).alias("f"), F.bool_and(out == F.concat("b", "a")).alias("r")
    )
    return flags.select("problem_id", "op", F.when(F.col("f"), "fwd").when(F.col("r"), "rev").alias("kind"))
