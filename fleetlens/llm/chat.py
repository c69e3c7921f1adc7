"""Chat formatting with typed content parts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the template.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Every mark and every control string of common templates holds one of these characters.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))

#: Type of one content part; fields that a kind lacks are null.
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
PATCH = 14  #: pixels along one side of an image token
AUDIO_RATE = 25  #: tokens per second of audio
PAGE_TOKENS = 256  #: tokens per page of a document


def escape(text: Column) -> Column:
    """No control string is left, and ``unescape`` gives the text back."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 0 for text and for sizes that are not known."""
    side = lambda name: F.ceil(part[name] / PATCH)
    return F.coalesce(
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
        .when(part["type"] == "document", part["pages"] * PAGE_TOKENS),
        F.lit(0),
    ).cast("long")


def flatten_parts(parts: Column) -> Column:
    """Visit parts in order: text is escaped, any other part becomes ``<|type:tokens|>``."""

    def visit(part: Column) -> Column:
        kind = F.coalesce(part["type"], F.lit("text"))
        mark = F.concat(F.lit("<|"), escape(kind), F.lit(":"), expanded_tokens(part).cast("string"), F.lit("|>"))
        return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)

    return F.coalesce(F.array_join(F.transform(parts, visit), ""), F.lit(""))


def attachments(parts: Column) -> Column:
    """Parts that are not text: their place among the parts, kind, reference and expanded tokens."""
    placed = F.transform(parts, lambda p, i: F.struct(i.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    return F.filter(placed, lambda p: F.coalesce(p["type"], F.lit("text")) != "text")


def text_part(text: Column) -> Column:
    """A plain text as the only part of a message."""
    return F.array(F.named_struct(
        F.lit("type"), F.lit("text"), F.lit("text"), F.coalesce(text.cast("string"), F.lit("")), F.lit("ref"), F.lit(None).cast("string"),
        F.lit("width"), F.lit(None).cast("int"), F.lit("height"), F.lit(None).cast("int"),
        F.lit("seconds"), F.lit(None).cast("double"), F.lit("pages"), F.lit(None).cast("int"),
    ))


def format_chats(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, formatted, attachments) from rows (conv_id, turn, role, parts).

    A conversation's turns follow ``turn``, null first; turns of one number follow role and content, so ties and repeated
    rows have one order. A null role or null parts count as empty; a null conv_id is a conversation of its own;
    an empty table gives no rows; other columns are not read. ``attachments`` lists (turn place, part place, type, ref, tokens) in order.
    One shuffle on conv_id, of formatted messages; a conversation is one output value, which a row has to hold.
    """
    formed = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.concat(F.lit(TURN), escape(F.coalesce(F.col("role").cast("string"), F.lit(""))), F.lit(BODY), flatten_parts(F.col("parts")), F.lit(END)).alias("text"),
            F.coalesce(attachments(F.col("parts")), F.array()).alias("attached"),
        ).alias("m"),
    )
    told = formed.groupBy("conv_id").agg(F.array_sort(F.collect_list("m"), _by_turn).alias("m"))
    listed = F.flatten(F.transform("m", lambda m, i: F.transform(m["attached"], lambda a: F.struct(
        i.alias("message"), a["place"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return told.select("conv_id", F.array_join(F.transform("m", lambda m: m["text"]), "").alias("formatted"), listed.alias("attachments"))


def _by_turn(a: Column, b: Column) -> Column:
    low, high = F.lit(-1), F.lit(1)
    none = F.lit(-(2**63))
    x, y = F.coalesce(a["turn"], none), F.coalesce(b["turn"], none)
    return (
        F.when(x < y, low).when(x > y, high)
        .when(a["text"] < b["text"], low).when(a["text"] > b["text"], high).otherwise(0)
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as (role, text, body): text unescaped, body as it stands."""
    whole = F.split(formatted, r"\Q" + TURN + r"\E")
    return F.transform(
        F.slice(whole, 2, F.greatest(F.size(whole) - 1, F.lit(0))),
        lambda piece: F.struct(
            unescape(F.substring_index(piece, BODY, 1)).alias("role"),
            unescape(_body(piece)).alias("text"),
            _body(piece).alias("body"),
        ),
    )


def _body(piece: Column) -> Column:
    """Between the mark of the body and the mark of the end, which stand once each."""
    after = F.length(F.substring_index(piece, BODY, 1)) + len(BODY)
    return piece.substr(after + 1, F.length(piece) - after - len(END))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: what the assistant says, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def digest(chats: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = loss_text(F.col("turns"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
