"""String helpers shared by the graders, templates and parsers. All are plain Column functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by a strip on both ends.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: line separators.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Prompt suffix, end markers.
PROMPT_SUFFIX = (
    "\nPlease put your final answer inside `\\boxed{}`. "
    "For example: `\\boxed{your answer}`"
)
THINK_END = "\n</think>"
TURN_END = "<|im_end|>"

LEFT_BRACKET = "\u3010"
RIGHT_BRACKET = "\u3011"
EN_DASH = "\u2013"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column, chars: str = WHITESPACE) -> Column:
    return F.rtrim(c, F.lit(chars))


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def last(arr: Column) -> Column:
    """Last element, NULL for an empty array."""
    return F.try_element_at(arr, F.lit(-1))


def last_index(c: Column, needle: str) -> Column:
    """0-based start of the last occurrence of ``needle``, -1 when absent."""
    tail = F.length(F.substring_index(c, needle, -1))
    return F.when(c.contains(needle), F.length(c) - tail - len(needle)).otherwise(F.lit(-1))


def slug(c: Column) -> Column:
    """Runs of other characters than letters and digits become one ``_``; lower case."""
    return F.lower(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def wildcard(c: Column, pattern: str) -> Column:
    """``*`` stands for any text, everything else is literal; no ``*`` means equality."""
    if "*" not in pattern:
        return c == pattern
    quoted = re.sub(r"([\\%_])", r"\\\1", pattern)
    return c.like(quoted.replace("*", "%"))


def category_from_id(c: Column, head: int = 8) -> Column:
    """Text before the first ``-``, or the first ``head`` characters."""
    return F.when(F.instr(c, "-") > 0, F.substring_index(c, "-", 1)).otherwise(F.substring(c, 1, head))


def run_label(run: Column) -> Column:
    """``MM-DD-HH-MM...`` shown as ``MM/DD HH:MM``; other text unchanged."""
    pattern = r"^(\d{2})-(\d{2})-(\d{2})-(\d{2}).*$"
    return F.when(run.rlike(pattern), F.regexp_replace(run, "(?s)" + pattern, "$1/$2 $3:$4")).otherwise(run)


# --- decimal strings -------------------------------------------------------------------------


def decimal_places(c: Column) -> Column:
    return F.when(F.instr(c, ".") > 0, F.length(F.split_part(c, F.lit("."), F.lit(2)))).otherwise(F.lit(0))


def truncate_decimals(c: Column, places: int = 3) -> Column:
    """Cut (never round) a decimal string to at most ``places`` decimals."""
    cut = F.concat(
        F.split_part(c, F.lit("."), F.lit(1)), F.lit("."), F.substring(F.split_part(c, F.lit("."), F.lit(2)), 1, places)
    )
    return F.when(decimal_places(c) > places, cut).otherwise(c)


def pad_decimals(c: Column, places: Column) -> Column:
    """Right-fill the decimals of a number string with zeros up to ``places``."""
    dotted = F.when(F.instr(c, ".") > 0, c).otherwise(F.concat(c, F.lit(".")))
    missing = F.greatest(places - decimal_places(c), F.lit(0))
    return F.concat(dotted, F.repeat(F.lit("0"), missing))


def align_decimals(a: Column, b: Column) -> tuple[Column, Column]:
    """Both number strings padded to the larger of their decimal counts."""
    places = F.greatest(decimal_places(a), decimal_places(b))
    return pad_decimals(a, places), pad_decimals(b, places)


# --- bracket and spelling transforms ---------------------------------------------------------


def chars(c: Column) -> Column:
    """Characters of a string as an array (empty for an empty string)."""
    return F.array_remove(F.split(c, ""), "")


def bracket_each(c: Column) -> Column:
    boxed = F.concat(F.lit(LEFT_BRACKET), F.array_join(chars(c), RIGHT_BRACKET + LEFT_BRACKET), F.lit(RIGHT_BRACKET))
    return F.when(c == "", "").otherwise(boxed)


def bracket_whole(c: Column) -> Column:
    return F.concat(F.lit(LEFT_BRACKET), c, F.lit(RIGHT_BRACKET))


def drop_leading_space(c: Column) -> Column:
    return F.ltrim(c)


def spell_out(c: Column) -> Column:
    """Non-space characters separated and enclosed by en dashes."""
    letters = F.filter(chars(c), lambda x: x != " ")
    return F.concat(F.lit(EN_DASH), F.array_join(letters, EN_DASH), F.lit(EN_DASH))


# --- numerals and equations ------------------------------------------------------------------

# Roman digits per decimal place.
ROMAN_ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
ROMAN_TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
ROMAN_HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]


def to_roman(n: Column) -> Column:
    """Arabic to Roman. Thousands repeat ``M``; numbers below 1 give an empty string."""

    def digit(symbols: list[str], unit: int) -> Column:
        place = F.pmod(F.floor(n / unit), F.lit(10)).cast("int")
        return F.element_at(F.array(*[F.lit(s) for s in symbols]), place + 1)

    roman = F.concat(
        F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")),
        digit(ROMAN_HUNDREDS, 100),
        digit(ROMAN_TENS, 10),
        digit(ROMAN_ONES, 1),
    )
    return F.when(n < 1, F.lit("")).otherwise(roman)


EQUATION = r"^(\d+)(\D)(\d+)$"


def parse_equation(c: Column) -> Column:
    """``12+34`` as struct(a, op, b); NULL when the text has another form."""
    parts = [F.regexp_extract(c, EQUATION, i) for i in (1, 2, 3)]
    parsed = F.struct(parts[0].alias("a"), parts[1].alias("op"), parts[2].alias("b"))
    return F.when(c.rlike(EQUATION), parsed)


# The two lines that frame an equation prompt.
EQUATION_HEAD = "Below are a few examples:\n"
EQUATION_ASK = "\nNow, determine the result for:"


def parse_equation_prompt(prompt: Column) -> Column:
    """Prompt text as struct(examples array<struct(input_value, output_value)>, question).

    NULL when a framing line, every example or the question is missing, or the question is
    not two characters, an operator and two characters at least.
    """
    body = F.substring(prompt, F.instr(prompt, EQUATION_HEAD) + len(EQUATION_HEAD), F.length(prompt))
    example_text = F.substring_index(body, EQUATION_ASK, 1)
    tail = F.substring(body, F.length(example_text) + len(EQUATION_ASK) + 1, F.length(body))
    question = strip(F.element_at(F.split(strip(tail), LINE_BREAK), 1))
    lines = F.filter(
        F.transform(F.split(example_text, LINE_BREAK), strip), lambda s: s.contains(" = ")
    )

    def pair(s: Column) -> Column:
        left = F.substring_index(s, " = ", 1)
        right = F.substring(s, F.length(left) + 4, F.length(s))
        return F.struct(strip(left).alias("input_value"), strip(right).alias("output_value"))

    examples = F.transform(lines, pair)
    good = (
        prompt.contains(EQUATION_HEAD)
        & body.contains(EQUATION_ASK)
        & (F.size(examples) > 0)
        & question.rlike(r"^.{2,}\S.{2,}$")
    )
    return F.when(good, F.struct(examples.alias("examples"), question.alias("question")))


# --- templates -------------------------------------------------------------------------------


def chat_prompt(prompt: Column, template: str = "{}", suffix: str = PROMPT_SUFFIX) -> Column:
    """Prompt plus suffix put into the ``{}`` of a chat template string."""
    before, after = template.split("{}", 1)
    return F.concat(F.lit(before), prompt, F.lit(suffix), F.lit(after))


def completion_text(reasoning: Column, answer: Column, closing_box: bool = True) -> Column:
    """Reasoning, end of thinking, boxed answer, end of turn.

    The boxed answer is the last closed box of the reasoning, or ``answer``. Without
    ``closing_box`` (augmentation rows) the box line is left out.
    """
    body = F.rtrim(reasoning, F.lit("\n"))
    if not closing_box:
        return F.concat(body, F.lit(THINK_END + TURN_END))
    boxes = F.regexp_extract_all(reasoning, F.lit(r"\\boxed\{([^}]*)\}"), F.lit(1))
    final = F.coalesce(last(boxes), answer)
    return F.concat(body, F.lit(THINK_END + "\n\\boxed{"), final, F.lit("}" + TURN_END))


# --- detokenising ----------------------------------------------------------------------------

BYTE_TOKEN = "^(<0x[0-9A-Fa-f]{2}>)+$"


def join_vocab_pieces(pieces: Column) -> Column:
    """Token strings as text. Byte tokens (``<0xE2>``, also several in one) contribute raw
    bytes; bytes that do not form UTF-8 become the replacement character.

    Ordinary tokens are whole UTF-8, so decoding the joined bytes once equals decoding every
    run of byte tokens for itself.
    """
    as_hex = F.transform(
        pieces,
        lambda t: F.when(t.rlike(BYTE_TOKEN), F.regexp_replace(t, "<0x|>", "")).otherwise(
            F.hex(F.encode(t, "UTF-8"))
        ),
    )
    return F.make_valid_utf8(F.unhex(F.array_join(as_hex, "")).cast("string"))


def padded(number: Column, width: int) -> Column:
    """A number's text, filled with zeros on the left; longer ones stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def passes(bad: Column, message: Column) -> Column:
    """Filter condition that keeps every row, but fails the job on a bad one.

    In a filter a check survives column pruning. The random part keeps the optimizer from evaluating it
    beforehand, or from moving it past an outer join.
    """
    return F.coalesce(F.when(bad, F.raise_error(message).cast("boolean")), F.rand() >= 0)
