"""Answer extraction, the graders and the correctness predicates built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LINE_BREAK, THINK_END, bind, last, last_index, or_empty, rstrip, strip

# The patterns that define what counts as an answer.
BOX = r"\\boxed\{([^}]*)(?:\}|$)"
OPEN_BOX = "\\boxed{"
FINAL_ANSWER_PATTERNS = [
    r"(?i)The final answer is:\s*([^\n]+)",
    r"(?i)Final answer is:\s*([^\n]+)",
    r"(?i)Final answer\s*[:：]\s*([^\n]+)",
    r"(?i)final answer\s*[:：]\s*([^\n]+)",
]
NUMBER = r"-?\d+(?:\.\d+)?"
NOT_FOUND = "NOT_FOUND"

_DIGITS = r"\d+(?:_\d+)*"
FLOAT_TEXT = (
    rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$|^(?i:[+-]?(?:inf|infinity))$"
)
NAN_TEXTS = ["nan", "+nan", "-nan"]


def _matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def extract_answer(text: Column) -> Column:
    """Last non-blank box, trimmed; an unclosed box at the end counts; ``''`` when none."""
    boxes = F.transform(_matches(text, BOX, 1), strip)
    found = F.when(text.contains(OPEN_BOX), last(F.filter(boxes, lambda b: b != "")))
    return F.coalesce(found, F.lit(""))


def extract_final_answer(text: Column) -> Column:
    """Box, else a "final answer" phrase, else the last number, else the last line."""
    boxed = F.when(text.rlike(BOX), extract_answer(text))
    phrases = [strip(last(_matches(text, p, 1))) for p in FINAL_ANSWER_PATTERNS]
    number = last(_matches(text, NUMBER, 0))
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda s: s != "")
    return F.coalesce(boxed, *phrases, number, last(lines), F.lit(NOT_FOUND))


def to_float(c: Column) -> Column:
    """Number text as double, NULL for anything that is not a plain number.

    The pattern guard keeps out forms only a SQL cast would take (``1d``); ``_`` between
    digits is allowed; ``inf`` and ``nan`` are numbers.
    """
    plain = F.when(c.rlike(FLOAT_TEXT), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.lower(c).isin(NAN_TEXTS), F.lit(float("nan"))).otherwise(plain)


ASYMMETRIC = "asymmetric"
SYMMETRIC = "symmetric"


def answers_match(
    stored: Column,
    pred: Column,
    *,
    mode: str = ASYMMETRIC,
    binary_exact: bool = True,
    tolerance: float = 1e-2,
    floor: float = 1e-5,
) -> Column:
    """Does ``pred`` equal the stored answer?

    Binary strings must be equal as text (unless ``binary_exact`` is off). Two numbers match
    within ``tolerance``: relative to the stored number (``asymmetric``), or to the larger of
    both with an absolute ``floor`` (``symmetric``). Anything else: text, ignoring case.
    """
    if mode not in (ASYMMETRIC, SYMMETRIC):
        raise ValueError(f"unknown mode: {mode}")

    def close(a: Column, b: Column) -> Column:
        if mode == ASYMMETRIC:
            gap = F.try_divide(F.abs(a - b), F.abs(a))
            return F.when(a == 0, F.abs(b) < tolerance).otherwise(~F.isnan(gap) & (gap <= tolerance))
        finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
        limit = F.greatest(F.greatest(F.abs(a), F.abs(b)) * tolerance, F.lit(floor))
        return (a == b) | (finite & (F.abs(a - b) <= limit))

    def compare(v: Column) -> Column:
        same_text = F.lower(v["p"]) == F.lower(v["s"])
        numbers = F.struct(to_float(v["s"]).alias("a"), to_float(v["p"]).alias("b"))
        graded = bind(
            numbers,
            lambda n: F.when(
                n["a"].isNotNull() & n["b"].isNotNull(),
                ~F.isnan(n["a"]) & ~F.isnan(n["b"]) & close(n["a"], n["b"]),
            ).otherwise(same_text),
        )
        if binary_exact:
            graded = F.when(v["s"].rlike("^[01]+$"), same_text).otherwise(graded)
        # Equal texts match, except infinite and undefined numbers, which have an n.
        return F.when((v["p"] == v["s"]) & ~F.lower(v["s"]).contains("n"), F.lit(True)).otherwise(graded)

    both = F.struct(strip(or_empty(stored)).alias("s"), strip(or_empty(pred)).alias("p"))
    return bind(both, compare)


def has_box(text: Column) -> Column:
    return or_empty(text).contains(OPEN_BOX)


def reward(text: Column, answer: Column, extracted: Column | None = None) -> Column:
    """1.0 for a boxed answer that matches, else 0.0. ``extracted`` is the text's answer where it is known already."""
    good = has_box(text) & answers_match(answer, extract_answer(text) if extracted is None else extracted)
    return F.when(good, F.lit(1.0)).otherwise(F.lit(0.0))


def predicted(pred: Column, text: Column) -> Column:
    """The stored prediction, or the one in the text when it is blank."""
    return F.coalesce(F.nullif(pred, F.lit("")), extract_answer(text))


def _score(reward_col: Column) -> Column:
    return F.coalesce(reward_col, F.lit(0.0))


def strictly_correct(reward_col: Column, text: Column, answer: Column, pred: Column) -> Column:
    """Boxed, rewarded, and the prediction matches again."""
    return has_box(text) & (_score(reward_col) > 0) & answers_match(answer, predicted(pred, text))


def leniently_correct(reward_col: Column, text: Column, answer: Column, pred: Column) -> Column:
    """Rewarded, or boxed with a matching prediction for a known answer."""
    known = (or_empty(text) != "") & (or_empty(answer) != "") & has_box(text)
    return (_score(reward_col) > 0) | (known & answers_match(answer, predicted(pred, text)))


def wrong_attempt(
    reward_col: Column, text: Column, gold: Column, pred: Column, need_answer: bool = False
) -> Column:
    """Unrewarded and the prediction does not match the gold answer."""
    wrong = (_score(reward_col) <= 0) & ~answers_match(gold, predicted(pred, text))
    return wrong & (or_empty(gold) != "") if need_answer else wrong


def valid_box_and_end(text: Column, end: str = "<|im_end|>") -> Column:
    """A closed box anywhere (its content may span lines) and the end-of-turn marker."""
    return text.rlike(r"(?s)\\boxed\{.*\}") & text.contains(end)


def before_thinking_end(text: Column) -> Column:
    return rstrip(F.substring_index(text, THINK_END, 1))


def cut_before_final_box(text: Column) -> Column:
    """Reasoning up to its last non-blank box (or last box when all are blank)."""
    body = before_thinking_end(text)
    # A control character marks the start of each box; boxes inside a box get no mark.
    mark = "\x01"

    def marked(t: Column, pattern: str) -> Column:
        return F.regexp_replace(t, F.lit(pattern), F.lit(mark + "$0"))

    def cut(t: Column) -> Column:
        head = F.substring(t, F.lit(1), last_index(t, mark))
        return F.when(t.contains(mark), F.regexp_replace(head, mark, "")).otherwise(t)

    filled = bind(
        marked(body, r"\\boxed\{(?=[^}]*[^}\s])[^}]*"),
        lambda t: F.when(t.contains(mark), t).otherwise(marked(t, r"\\boxed\{[^}]*")),
    )
    return rstrip(bind(filled, cut))
