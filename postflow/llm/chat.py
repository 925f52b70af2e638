"""Chat formatting: typed content parts to one marked-up string, and back.

A turn is a row with a role and an array of typed parts. The visitor turns every part into text:
a text part is escaped, any other part becomes the placeholder of its kind, in order, with its
reference, place and token count set down as an attachment. All of it is built-in expressions.
"""

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"

# The template's markers, and the control strings no text may hold unescaped.
TURN, SEP, END = "<|turn|>", "<|sep|>", "<|end|>"
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESCAPE = "\\"
# What stands for a character after the escape.
CODES = {ESCAPE: "e", "<": "l", "[": "b"}


@dataclass(frozen=True)
class Template:
    """Tokens that a unit of each kind expands to: image tiles, audio seconds, document pages."""

    tokens_per_unit: Mapping[str, float] = field(
        default_factory=lambda: {"image": 256.0, "audio": 25.0, "document": 600.0}
    )
    trained_roles: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    """Break every control string by an escape code for its first character; null is empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE + CODES[ESCAPE]))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(ESCAPE + CODES[control[0]] + control[1:]))
    return out


def unescape(text: Column) -> Column:
    """The inverse of `escape`. In escaped text each escape is followed by its code, so the order is safe."""
    out = text
    for char in ("<", "[", ESCAPE):
        out = F.replace(out, F.lit(ESCAPE + CODES[char]), F.lit(char))
    return out


def text_part(text: Column) -> Column:
    """One text part as the array that `format_chat` takes."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.cast("string").alias("text"),
            null("string").alias("ref"), null("double").alias("units"),
        )
    )


def format_chat(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per `conv_id` from rows `(conv_id, turn, role, parts)`; further columns are ignored.

    Returned: `formatted`; `n_turns`; `formatted_chars`; `turn_starts`, where each turn begins;
    `loss_mask`, for each turn the spans `(start, length)` of a trained role's text parts, in code
    points of `formatted`; `attachments` `(ordinal, turn, kind, ref, start, tokens)` in order; and
    `expanded_tokens`, their sum.

    Turns are ordered by `turn`, null first, then role and parts, so ties and repeated rows have
    one order and all stay. Null role and null text are empty; a null kind counts as text; null
    or no parts are an empty turn; an unknown kind or null units expand to no tokens. Rows with a
    null `conv_id` are one conversation. An empty table gives no rows. A conversation is one
    value of the result, so it has to fit a row; many conversations spread over many tasks.
    """
    kind = lambda p: F.coalesce(p["kind"], F.lit("text"))
    rate = F.create_map(*[F.lit(x) for pair in template.tokens_per_unit.items() for x in pair])
    tokens = lambda p: F.ceil(F.coalesce(rate[kind(p)] * p["units"], F.lit(0.0))).cast("long")
    placeholder = lambda p: F.concat(F.lit("<|"), escape(kind(p)), F.lit("|>"))
    visited = F.transform(
        F.coalesce(F.col("parts"), F.array().cast(PARTS)),
        lambda p: F.struct(
            F.when(kind(p) == "text", escape(p["text"])).otherwise(placeholder(p)).alias("body"),
            (kind(p) != "text").alias("attached"),
            kind(p).alias("kind"),
            p["ref"].alias("ref"),
            tokens(p).alias("tokens"),
        ),
    )
    lengths = F.transform("_visited", lambda p: F.length(p["body"]).cast("long"))
    # Places inside a turn: parts of one turn are few, so the sums over slices are short.
    starts = F.transform(
        "_visited",
        lambda p, i: F.aggregate(F.slice("_lengths", F.lit(1), i), F.col("_head"), lambda a, x: a + x),
    )
    rows = (
        turns.select("conv_id", "turn", "role", F.col("parts").cast(PARTS).alias("parts"))
        .withColumn("_visited", visited)
        .withColumn("_header", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SEP)))
        .withColumn("_lengths", lengths)
        .withColumn("_head", F.length("_header").cast("long"))
        .withColumn("_starts", starts)
        .withColumn(
            "_piece",
            F.concat(F.col("_header"), F.array_join(F.transform("_visited", lambda p: p["body"]), ""), F.lit(END)),
        )
        .withColumn("_size", F.length("_piece").cast("long"))
        .withColumn("_trained", F.coalesce(F.col("role").isin(*template.trained_roles), F.lit(False)))
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # The window and the aggregate need the same partitioning: one shuffle.
    placed = rows.select(
        "conv_id", "_piece", "_visited", "_lengths", "_starts", "_trained", "_size",
        (F.row_number().over(order) - 1).alias("_at"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_from"),
    )
    indexed = F.arrays_zip("_visited", "_lengths", "_starts")
    spans = F.transform(
        F.filter(indexed, lambda p: ~p["_visited"]["attached"] & (p["_lengths"] > 0)),
        lambda p: F.struct((F.col("_from") + p["_starts"]).alias("start"), p["_lengths"].alias("length")),
    )
    attachments = F.transform(
        F.filter(indexed, lambda p: p["_visited"]["attached"]),
        lambda p: F.struct(
            F.col("_at").alias("turn"),
            p["_visited"]["kind"].alias("kind"),
            p["_visited"]["ref"].alias("ref"),
            (F.col("_from") + p["_starts"]).alias("start"),
            p["_visited"]["tokens"].alias("tokens"),
        ),
    )
    per_turn = F.struct(
        "_at", "_from", "_piece",
        F.when(F.col("_trained"), spans).otherwise(F.filter(spans, lambda s: F.lit(False))).alias("spans"),
        attachments.alias("attachments"),
    )
    gathered = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(per_turn)).alias("_turns"),
        F.sum("_size").alias("formatted_chars"),
    )
    listed = F.flatten(F.transform("_turns", lambda t: t["attachments"]))
    numbered = F.transform(
        "_listed",
        lambda a, i: F.struct(i.alias("ordinal"), *[a[c].alias(c) for c in ("turn", "kind", "ref", "start", "tokens")]),
    )
    return (
        gathered.withColumn("_listed", listed)
        .select(
            "conv_id",
            F.array_join(F.transform("_turns", lambda t: t["_piece"]), "").alias("formatted"),
            F.size("_turns").cast("long").alias("n_turns"),
            "formatted_chars",
            F.transform("_turns", lambda t: t["_from"]).alias("turn_starts"),
            F.transform("_turns", lambda t: t["spans"]).alias("loss_mask"),
            numbered.alias("attachments"),
            F.aggregate("_listed", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
        )
    )


def _pieces(formatted: Column) -> Column:
    """What follows each turn marker; markers cannot occur inside a piece."""
    pieces = F.split(formatted, _literal(TURN))
    return F.slice(pieces, F.lit(2), F.size(pieces))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def read_turns(formatted: Column) -> Column:
    """Array of `(role, text)` read back from a formatted conversation; placeholders are left out."""
    split = lambda piece: F.split(piece, _literal(SEP))
    body = lambda piece: F.regexp_replace(F.replace(split(piece)[1], F.lit(END), F.lit("")), r"<\|.*?\|>", "")
    return F.transform(
        _pieces(formatted),
        lambda piece: F.struct(unescape(split(piece)[0]).alias("role"), unescape(body(piece)).alias("text")),
    )


def read_masked(formatted: Column, turn_starts: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between.

    Each span is cut from its own turn's piece, so the work is linear in the conversation.
    """
    turns = F.arrays_zip(_pieces(formatted).alias("piece"), turn_starts.alias("at"), loss_mask.alias("spans"))

    def cut(turn: Column) -> Column:
        place = lambda s: (s["start"] - turn["at"] - len(TURN) + 1).cast("int")
        return F.transform(
            turn["spans"], lambda s: unescape(F.substr(turn["piece"], place(s), s["length"].cast("int")))
        )

    return F.array_join(F.flatten(F.transform(turns, cut)), "")
