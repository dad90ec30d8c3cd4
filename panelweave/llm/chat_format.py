"""Chat formatting: conversations of typed content parts rendered into one training string each.

A turn's content is an ordered array of parts.  The visitor flattens it: a text
part becomes its escaped text; an image, audio or document part becomes one
placeholder, and its reference and expanded token count are recorded in order.

    <|im_start|>role \\n content <|im_end|> \\n

Escaping is reversible: a backslash becomes `\\e`, `<|` becomes `<\\p`, and in
roles a new line becomes `\\n`.  A text can therefore contain no control string
and no placeholder, and reading back splits on control strings alone.

Everything is DataFrame functions.  Turns of one conversation meet in one row,
which is that conversation's output; one shuffle by conv_id serves both the
running offsets and the collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.text import let

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Tokens that a placeholder expands to.
IMAGE_PATCH = 14
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 256


def escape(text: Column, line_breaks: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<|"), F.lit("<\\p"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line_breaks else out


def unescape(text: Column, line_breaks: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if line_breaks else text
    return F.replace(F.replace(out, F.lit("\\p"), F.lit("|")), F.lit("\\e"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """One text part, for tables whose turns are plain texts; null: the empty text."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                    F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
                    F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"),
                    F.lit(None).cast("int").alias("pages"))
    return F.array(part)


def _kind(part: Column) -> Column:
    kind = F.lower(F.coalesce(part["kind"], F.lit("")))
    return F.when(kind.isin("text", "image", "audio", "document"), kind).otherwise("file")


def _placeholder(part: Column) -> Column:
    return F.when(_kind(part) == "text", escape(F.coalesce(part["text"], F.lit("")))) \
        .otherwise(F.concat(F.lit("<|"), _kind(part), F.lit("|>")))


def _tokens(part: Column) -> Column:
    kind = _kind(part)
    patches = F.ceil(part["width"] / IMAGE_PATCH) * F.ceil(part["height"] / IMAGE_PATCH)
    count = F.when(kind == "image", patches) \
        .when(kind == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS_PER_SECOND)) \
        .when(kind == "document", part["pages"].cast("long") * DOCUMENT_TOKENS_PER_PAGE)
    return F.coalesce(count.cast("long"), F.lit(0).cast("long"))


def _attachments(parts: Column) -> Column:
    return F.transform(
        F.filter(parts, lambda p: _kind(p) != "text"),
        lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))


def format_chat(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments, attachments, n_turns, expanded_tokens.

    turns: conv_id, turn, role, parts (array of PART).  Turns are ordered by turn,
    null first; ties by role and content, so repeated rows come out as repeated
    turns.  A null role is the empty role; null parts and null members of the array
    are left out; a part of unknown kind becomes <|file|> with 0 tokens.  Rows with a
    null conv_id form one conversation.  Other columns are ignored.

    segments, one per turn: `start` of the turn in formatted, `text_start` and
    `length` of its content, all in code points, and `loss`, whether it is trained on.
    attachments: kind, ref and tokens in the order of the placeholders.
    """
    empty = F.array().cast(f"array<{PART}>")
    parts = F.filter(F.coalesce(F.col("parts").cast(f"array<{PART}>"), empty), lambda p: p.isNotNull())
    body = F.array_join(F.transform(parts, _placeholder), "")
    head = F.concat(F.lit(START), escape(F.coalesce("role", F.lit("")), line_breaks=True), F.lit("\n"))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), body.alias("body"),
        _attachments(parts).alias("attachments"))
    rows = rows.select(
        "*", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), F.char_length("head").alias("n_head"),
        F.char_length("body").alias("n_body"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    before = F.sum(F.char_length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select(
        "conv_id", F.row_number().over(order).alias("n"), F.coalesce(before, F.lit(0)).alias("start"), "piece",
        "n_head", "n_body", F.col("role").isin(*trained_roles).alias("loss"), "attachments")
    item = F.struct("n", "piece", "start", (F.col("start") + F.col("n_head")).alias("text_start"),
                    F.col("n_body").cast("long").alias("length"), "loss", "attachments")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    segment = lambda x: F.struct(x["start"].alias("start"), x["text_start"].alias("text_start"),
                                 x["length"].alias("length"), x["loss"].alias("loss"))
    out = grouped.select(
        "conv_id", F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("items", segment).alias("segments"),
        F.flatten(F.transform("items", lambda x: x["attachments"])).alias("attachments"),
        F.size("items").cast("long").alias("n_turns"))
    return out.withColumn("expanded_tokens", F.aggregate(
        "attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]))


def _chunks(formatted: Column) -> Column:
    """The turns of a formatted string, without their start marks."""
    return F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted string alone."""
    def turn(chunk: Column) -> Column:
        role = F.substring_index(chunk, "\n", 1)
        length = F.char_length(chunk) - F.char_length(role) - 2 - len(END)
        return F.struct(unescape(role, line_breaks=True).alias("role"),
                        unescape(chunk.substr(F.char_length(role) + 2, length)).alias("text"))
    return F.transform(_chunks(formatted), turn)


def read_loss(formatted: Column, segments: Column) -> Column:
    """The unescaped text under the loss mask, in order.

    Each span is cut from its own turn, so the time is linear in the conversation.
    """
    def cut(chunk: Column, s: Column) -> Column:
        first = (s["text_start"] - s["start"] - len(START) + 1).cast("int")
        return F.when(s["loss"], unescape(chunk.substr(first, s["length"].cast("int"))))
    return F.array_join(F.zip_with(_chunks(formatted), segments, cut), "")


def turns_text(turns: Column) -> Column:
    """role, new line, text, new line per turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def digest(text: Column) -> Column:
    return let(text, lambda t: F.sha2(t, 256))
