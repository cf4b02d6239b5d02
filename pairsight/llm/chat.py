"""Chat formatting: typed content parts to one marked string a conversation, with a loss mask.

A turn is ``<s>[ROLE]role[/ROLE]body</s>``. The body is the conversation part by part, in order: text as
it is, with control strings escaped, and ``[IMAGE]``, ``[AUDIO]`` or ``[DOCUMENT]`` for an attachment, whose
reference and expanded token count go to ``attachments`` in the same order.

Escaping puts a backslash behind the opening bracket of anything that is a control string, with or without
such backslashes already there; taking one away again restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"\\*/?(?:(?:INST|ROLE|IMAGE|AUDIO|DOCUMENT)\]|s>)"
TURN_OPEN, ROLE_END, TURN_END = "<s>[ROLE]", "[/ROLE]", "</s>"
#: Turns whose numbers share a block of this width are joined first, so that a conversation with very many turns is put together by many tasks.
BLOCK = 256

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])({CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\({CONTROL})", "$1$2")


def text_parts(text: Column) -> Column:
    """One text part for a plain text; null is an empty text."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return F.array(part).cast(PARTS)


def _visit(part: Column) -> Column:
    """The string that stands for a part. A part of an unknown type counts as text."""
    kind = part["type"]
    return F.when(kind == "image", "[IMAGE]").when(kind == "audio", "[AUDIO]").when(kind == "document", "[DOCUMENT]").otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _tokens(part: Column, patch: int, per_second: float, per_page: int) -> Column:
    """Tokens that an attachment takes once a model expands its placeholder; 1 at least."""
    side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / patch)
    n = F.when(part["type"] == "image", side(part["width"]) * side(part["height"])).when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * per_second)).otherwise(F.coalesce(part["pages"], F.lit(0)) * per_page)
    return F.greatest(n.cast("long"), F.lit(1).cast("long"))


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", patch: int = 14, per_second: float = 25.0, per_page: int = 256) -> DataFrame:
    """One row a conversation: conv_id, formatted, spans, attachments, n_turns.

    ``messages`` has a row a turn with ``parts`` as PARTS. spans has a row a turn with code point offsets
    into formatted: turn_start, start and end (exclusive) of the body, and loss, true for the assistant's turns.

    Turns are ordered by number, nulls first; rows that repeat a number all stay, ordered by role and body.
    Null roles, texts and parts are empty. A null conv_id is a conversation of its own. Other columns are ignored.
    """
    m = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(PARTS)).alias("parts"))
    attached = F.transform(F.filter("parts", lambda p: p["type"].isin("image", "audio", "document")), lambda p: F.struct(F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p, patch, per_second, per_page).alias("tokens")))
    head = F.concat(F.lit(TURN_OPEN), escape(F.col("role")), F.lit(ROLE_END))
    m = m.select("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"), F.struct("turn", "role", F.array_join(F.transform("parts", _visit), "").alias("body"), head.alias("head"), attached.alias("attached")).alias("t"))
    m = m.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def place(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.struct(acc["at"].alias("turn_start"), start.alias("start"), end.alias("end"), (t["role"] == "assistant").alias("loss"))
        return F.struct((end + len(TURN_END)).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    placed = F.aggregate("ts", F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<turn_start:int,start:int,end:int,loss:boolean>>))"), place)
    m = m.select("conv_id", F.struct(F.col("block"), F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END))), "").alias("string"), placed.alias("placed"), F.flatten(F.transform("ts", lambda t: t["attached"])).alias("attached")).alias("b"))
    m = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("b"), lambda a, b: F.when(a["block"].isNull(), -1).when(b["block"].isNull(), 1).when(a["block"] < b["block"], -1).otherwise(1)).alias("bs"))
    starts = F.aggregate("bs", F.expr("named_struct('at', 0, 'all', cast(array() as array<int>))"), lambda acc, b: F.struct((acc["at"] + b["placed"]["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
    m = m.withColumn("starts", starts)
    shift = lambda s, by: F.struct((s["turn_start"] + by).alias("turn_start"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["loss"].alias("loss"))
    spans = F.flatten(F.zip_with("bs", "starts", lambda b, by: F.transform(b["placed"]["spans"], lambda s: shift(s, by))))
    return m.select("conv_id", F.array_join(F.transform("bs", lambda b: b["string"]), "").alias("formatted"), spans.alias("spans"), F.flatten(F.transform("bs", lambda b: b["attached"])).alias("attachments")).withColumn("n_turns", F.size("spans").cast("long"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, unescaped) and loss_texts, from what format_chats() wrote: the string and the mask."""
    turn = lambda s: F.struct(unescape(F.substring_index(F.substr(s, F.lit(len(TURN_OPEN) + 1)), ROLE_END, 1)).alias("role"), unescape(F.substr(s, F.instr(s, ROLE_END) + len(ROLE_END))).alias("text"))
    pieces = F.split("formatted", TURN_END)
    masked = F.zip_with("pieces", "spans", lambda p, s: F.when(s["loss"], unescape(F.substr(p, s["start"] - s["turn_start"] + 1, s["end"] - s["start"]))))
    got = formatted.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    return got.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.filter(masked, lambda x: x.isNotNull()).alias("loss_texts"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Formats whole conversations and returns digests of what is read back from the result."""
    rows = conversations.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    back = read_back(format_chats(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
