"""Chat formatting with typed content parts (DataFrame functions only).

A turn is an ordered array of parts. A visitor flattens text, image, audio and document parts into the
turn's text: text is escaped, every other part becomes one placeholder, whose reference and expanded
token count go to the conversation's list of attachments, in the order of the placeholders.

Control strings all begin with ``<``. Inside texts and roles ``&`` is written ``&amp;`` and ``<`` is
written ``&lt;``, so no text, nor any two neighbouring parts, can form a control string, and replacing
the two back restores every text.

Defined cases: a null role, text or part list is empty; rows of one conversation come by (turn, role,
parts as text), nulls first, so ties and repeated rows have one order and all stay; a null conversation
id is a key like any other; an unknown part kind keeps its own name in the placeholder and counts one
token; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings, the role whose texts bear loss, and what one attachment expands to."""

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>"
    placeholder: str = "<|part:"
    close: str = "|>"
    loss_role: str = "assistant"
    patch: int = 28
    tokens_per_second: float = 25.0
    tokens_per_page: int = 256

    def __post_init__(self) -> None:
        marks = (self.turn, self.body, self.end, self.placeholder)
        if any(not m.startswith("<") or "&" in m or "<" in m[1:] for m in marks):
            raise ValueError("a control string begins with '<' and has no other '<' or '&'")
        if any(a != b and b.startswith(a) for a in marks for b in marks) or len(set(marks)) < 4:
            raise ValueError("no control string may begin another")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """A part list holding one text."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.alias("text"),
            none.cast("string").alias("ref"),
            none.cast("int").alias("width"),
            none.cast("int").alias("height"),
            none.cast("double").alias("seconds"),
            none.cast("int").alias("pages"),
        )
    )


def is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def part_text(part: Column, t: ChatTemplate) -> Column:
    """What the part is in the flat text."""
    mark = F.concat(F.lit(t.placeholder), escape(part["kind"]), F.lit(t.close))
    return F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)


def part_tokens(part: Column, t: ChatTemplate) -> Column:
    """Tokens that the placeholder expands to; an unknown measure counts as one unit."""

    def units(measure: Column) -> Column:
        return F.greatest(F.coalesce(F.ceil(measure), F.lit(1)).cast("long"), F.lit(1).cast("long"))

    kind = part["kind"]
    return (
        F.when(is_text(part), F.lit(0).cast("long"))
        .when(kind == "image", units(part["width"] / t.patch) * units(part["height"] / t.patch))
        .when(kind == "audio", units(part["seconds"] * t.tokens_per_second))
        .when(kind == "document", units(part["pages"]) * t.tokens_per_page)
        .otherwise(F.lit(1).cast("long"))
    )


def format_conversations(
    rows: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    template: ChatTemplate | None = None,
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans`` (start and length of every
    text under the loss mask, in code points of ``formatted``), ``attachments`` (ordinal, turn_no, kind,
    ref, n_tokens) and ``attachment_tokens``.

    The only shuffle is by conversation; a conversation is one output record, so its turns meet anyway.
    """
    t = template or ChatTemplate()
    own_role, own_parts = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    head = F.concat(F.lit(t.turn), escape(own_role), F.lit(t.body))
    body = F.array_join(F.transform(own_parts, lambda p: part_text(p, t)), "")
    flat = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(parts).alias("parts")
    ).select(
        "conv_id",
        "turn",
        "role",
        (own_role == t.loss_role).alias("loss"),
        head.alias("head"),
        body.alias("body"),
        F.transform(
            F.filter(own_parts, lambda p: ~is_text(p)),
            lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p, t).alias("n_tokens")),
        ).alias("media"),
    )
    size = F.length("head") + F.length("body") + len(t.end)
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    placed = flat.withColumns(
        {
            "turn_no": F.row_number().over(by_turn),
            "at": F.sum(size.cast("long")).over(by_turn.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("head"),
        }
    )
    piece = F.struct("turn_no", F.concat("head", "body", F.lit(t.end)).alias("text"), "loss", "at", F.length("body").alias("n"), "media")
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    media = F.flatten(
        F.transform("turns", lambda x: F.transform(x["media"], lambda m: F.struct(x["turn_no"].alias("turn_no"), m.alias("m"))))
    )
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: x["text"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda x: x["loss"]),
            lambda x: F.struct(x["at"].cast("long").alias("start"), x["n"].cast("long").alias("length")),
        ).alias("loss_spans"),
        F.transform(
            media,
            lambda x, i: F.struct(
                (i + 1).cast("long").alias("ordinal"),
                x["turn_no"].alias("turn_no"),
                x["m"]["kind"].alias("kind"),
                x["m"]["ref"].alias("ref"),
                x["m"]["n_tokens"].alias("n_tokens"),
            ),
        ).alias("attachments"),
        F.aggregate(media, F.lit(0).cast("long"), lambda a, x: a + x["m"]["n_tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The (role, text) of every turn, read back from a formatted conversation; placeholders stay."""
    t = template or ChatTemplate()

    def literal(s: str) -> str:
        return r"\Q" + s + r"\E"

    turns = F.filter(F.split(formatted, literal(t.turn)), lambda x, i: i > 0)
    return F.transform(
        turns,
        lambda x: F.struct(
            unescape(F.substring_index(x, t.body, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(x, t.body, -1), t.end, 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(loss_spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))),
        "",
    )
