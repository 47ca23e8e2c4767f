"""Chat formatting with typed content parts, by DataFrame functions only.

A message is a list of parts: text, image, audio or document. A visitor over the
list writes text as it is and every other part as a placeholder, in order, and
records the attachment with its place and the tokens it expands to. The template is

    <s>[INST]role[/INST]content</s>

for each turn. Control strings inside texts get one more backslash after their
bracket, and lose it again when read, so any text comes back as it was; roles are
URL-encoded. The loss mask is a list of byte ranges of the formatted string.

Order within a conversation is by turn, then role, then text; null turns come
first, null texts and roles are empty, repeated rows are repeated turns, and null
conv_ids are one conversation. A conversation is one string, so it is
bounded by the 2 GB of a string; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conefix.session import Scratch

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Placeholders of parts that are no text.
KINDS = ("image", "audio", "document")
_CONTROL = rf"/?(?:s|INST|{'|'.join(KINDS)})[>\]]"
ESCAPE = rf"([<\[])(\\*)({_CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)({_CONTROL})"

#: Tokens that attachments expand to: a token for each square of an image, a second of sound, a page.
IMAGE_SQUARE, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 512
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def text_parts(text: Column) -> Column:
    """One text part, for messages that are plain strings."""
    null = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *null))


def _written(part: Column) -> Column:
    placeholder = F.concat(F.lit("<"), part["kind"], F.lit(">"))
    return F.when(part["kind"].isin(*KINDS), placeholder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def expanded_tokens(part: Column) -> Column:
    """The tokens of an attachment; 0 where its measures are unknown."""
    squares = F.ceil(part["width"] / IMAGE_SQUARE) * F.ceil(part["height"] / IMAGE_SQUARE)
    sized = F.when(part["kind"] == "image", squares).when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS)).when(part["kind"] == "document", part["pages"].cast("long") * PAGE_TOKENS)
    return F.coalesce(sized.cast("long"), F.lit(0).cast("long"))


def format_conversations(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``messages(conv_id, turn, role, parts)`` -> a row for each conversation.

    formatted; mask: array of (start, length), the byte ranges of trained turns'
    contents; attachments: array of (turn, part, kind, ref, start, tokens) with
    the byte of the placeholder, in order.
    """
    rows = messages.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce(F.col("parts"), F.array().cast(PARTS)).alias("parts"),
    )
    rows = rows.withColumn("written", F.transform("parts", _written)).withColumn("body", F.array_join("written", ""))
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit(MIDDLE))
    rows = rows.withColumn("head", head).withColumn("size", F.octet_length("head") + F.octet_length("body") + len(CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("start", before + F.octet_length("head"))

    def attachment(part: Column, i: Column) -> Column:
        place = F.col("start") + F.octet_length(F.array_join(F.slice("written", F.lit(1), i), ""))
        return F.struct(F.col("turn"), i.alias("part"), part["kind"].alias("kind"), part["ref"].alias("ref"), place.alias("start"), expanded_tokens(part).alias("tokens"))

    found = F.filter(F.transform("parts", attachment), lambda a: a["kind"].isin(*KINDS))
    turn = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("segment"), F.col("role").isin(*trained).alias("loss"), "start", F.octet_length("body").cast("long").alias("length"), found.alias("attachments"))
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["segment"]), "").alias("formatted"),
        F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("mask"),
        F.flatten(F.transform("ts", lambda t: t["attachments"])).alias("attachments"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    pieces = F.split(formatted, CLOSE)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def read(turn: Column) -> Column:
        inner = turn.substr(F.lit(len(OPEN) + 1), F.char_length(turn))
        role = F.substring_index(inner, MIDDLE, 1)
        text = inner.substr(F.char_length(role) + len(MIDDLE) + 1, F.char_length(inner))
        return F.struct(F.url_decode(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, read)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    raw = formatted.cast("binary")
    parts = F.transform(mask, lambda m: unescape(raw.substr((m["start"] + 1).cast("int"), m["length"].cast("int")).cast("string")))
    return F.array_join(parts, "")


def digests(output: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them."""
    read = output.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("mask")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def format_and_read(messages: DataFrame) -> DataFrame:
    """Format, write to the shared folder, and read back."""
    scratch = Scratch(messages.sparkSession, "chat")
    return digests(scratch.save(format_conversations(messages), "formatted"))
