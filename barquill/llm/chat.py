"""Conversations as training text, with DataFrame expressions only.

A turn is written ``<|turn|>role<|says|>body<|end|>``. Its content is a list of typed parts, which a visitor flattens in
order: text is escaped, an image, audio or document part becomes a placeholder and an attachment with the tokens that it
will take once expanded. Strings inside texts and roles that look like control strings get a backslash after their first
character (one more, if they have some already), which reading takes away again; so no text can end a turn or fake one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: What templates in use give a meaning: tags in angle brackets with bars, sentence tags, instruction tags.
_CONTROL = r"(/?s>|/?INST\]|\|[A-Za-z0-9_]+\|>)"
#: Tokens that media take: a patch of an image, a second of audio, a page of a document.
PATCH_PIXELS, TOKENS_A_SECOND, TOKENS_A_PAGE = 14, 25, 256

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PARTS = f"array<{PART}>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", "$1$2$3")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part; null is an empty text."""
    fields = {"kind": F.lit("text"), "text": F.coalesce(text, F.lit("")), "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    return F.array(F.struct(*((F.lit(None) if v is None else v).alias(k) for k, v in fields.items()))).cast(PARTS)


def _placeholder(kind: Column) -> Column:
    out = F.lit("")
    for name, mark in PLACEHOLDERS.items():
        out = F.when(kind == name, F.lit(mark)).otherwise(out)
    return out


def _tokens(part: Column) -> Column:
    def side(x: Column) -> Column:
        return F.ceil(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)) / PATCH_PIXELS)

    image = side(part["width"]) * side(part["height"])
    audio = F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * TOKENS_A_SECOND)
    pages = F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * TOKENS_A_PAGE
    return F.when(part["kind"] == "image", image).when(part["kind"] == "audio", audio).otherwise(pages).cast("long")


def _is_media(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*PLACEHOLDERS), F.lit(False))


def flatten(parts: Column) -> Column:
    """The parts of a turn in order, as one string: escaped texts and placeholders. A part of no known kind is its text."""
    return F.array_join(F.transform(parts, lambda p: F.when(_is_media(p), _placeholder(p["kind"])).otherwise(escape(p["text"]))), "")


def attachments(parts: Column) -> Column:
    """kind, ref and tokens of the media parts of a turn, in order."""
    media = F.filter(parts, _is_media)
    return F.transform(media, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))


def format_chat(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, and either parts or text).

    Returns conv_id, formatted, loss_spans (from and length, in characters of ``formatted``: the bodies of the turns of
    ``trained`` roles) and attachments (ordinal, kind, ref, tokens; ordinal counts the placeholders in ``formatted``).
    Turns are in order of turn, then role, then content, null first; repeated rows are turns of their own. Null roles
    and texts are empty, a null list of parts has none. Rows with a null conv_id are one conversation.

    Offsets are running sums over a conversation's turns and the turns are then joined: both on one exchange by conv_id.
    A formatted conversation is one string, so a conversation has to fit in a task.
    """
    parts = F.col("parts") if "parts" in turns.columns else text_parts(F.col("text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(parts, F.array().cast(PARTS)).alias("parts"))
    rows = rows.select("conv_id", "turn", "role", flatten(F.col("parts")).alias("body"), attachments(F.col("parts")).alias("media"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    rows = rows.withColumn("head", F.length(head)).withColumn("piece", F.concat(head, "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", F.to_json("media"))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("to", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.length("body")
    span = F.struct((F.col("to") - len(END) - body).alias("start"), body.cast("long").alias("length"))
    row = F.struct("at", "piece", "media", F.when(F.col("role").isin(*trained), span).alias("span"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    media = F.flatten(F.col("turns.media"))
    media = F.transform(media, lambda m, i: F.struct(i.alias("ordinal"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))
    return whole.select(
        "conv_id",
        F.array_join("turns.piece", "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        media.alias("attachments"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of role and text, unescaped; placeholders stay."""
    pieces = F.split(formatted, r"<\|end\|>")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        said = F.split(piece, r"<\|says\|>", 2)
        return F.struct(unescape(F.substring(said[0], len(TURN) + 1, 1 << 30)).alias("role"), unescape(said[1]).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
