"""Chat formatting of messages with typed content parts, in DataFrame functions only.

A visitor flattens the parts of each message in order: text is escaped and written, image, audio and document
parts become numbered placeholders, each recorded as an attachment with its reference, its place in the
formatted string and the number of tokens that the placeholder expands to. The template is

    <|turn|>ROLE<|body|>CONTENT<|end|>        for each message, in order

and the loss mask lists the spans (code points, end exclusive) of assistant contents. Texts and roles may hold
anything: a backslash is put behind every `<`, `[` and backslash, so that nothing that follows, in the same part or the
next, makes a control string of them; unescape() drops each such backslash and gives the very text back. In the
reference of a placeholder every `|` gets one too, so that it ends at the first `|>`.

Definitions at the edges: a null text or role is the empty string; a null or empty list of parts is an empty
content; an unknown part type is written as its text; turns order by number (nulls first), then role, then text;
repeated rows are repeated turns; an empty table gives no rows. One conversation is one string, so a conversation
must fit a row; conversations are dealt out by id. Places follow from running sums over a conversation's turns, so time
grows with its length alone; within one message it also grows with the square of its attachments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: First characters of all control strings, of this template and of common others, and the escape itself.
MARKED = r"([<\[\\])"
#: Tokens of an image: one for each tile of so many pixels a side; of audio, for each second; of a document, for each page.
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column, marked: str = MARKED) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), marked, r"$1\\")


def unescape(text: Column) -> Column:
    """What escape() was given: a backslash makes the next character, if any, stand for itself."""
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def part_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 0 for text, 1 at least for an attachment."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(0)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(0)) / TILE)
    n = (F.when(part["type"] == "image", tiles).when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
         .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS))
    return F.coalesce(F.greatest(n, F.lit(1)), F.lit(0)).cast("long")


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def visit(part: Column) -> Column:
    """What a part writes."""
    mark = F.concat(F.lit("<|"), part["type"], F.lit("|"), escape(part["ref"], r"([<\[\\|])"), F.lit("|>"))
    return F.when(is_attachment(part), mark).otherwise(escape(part["text"]))


def flatten(messages: DataFrame, parts: str = "parts") -> DataFrame:
    """messages with content (the flattened parts), content_chars and attachments (kind, ref, at, tokens; at counts code points of content)."""
    pieces = F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: F.struct(visit(p).alias("out"), is_attachment(p).alias("att"), p["type"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<kind:string,ref:string,at:bigint,tokens:bigint>>").alias("got"))

    def step(acc: Column, x: Column) -> Column:
        own = F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"), acc["at"].alias("at"), x["tokens"].alias("tokens"))
        return F.struct((acc["at"] + F.char_length(x["out"])).cast("long").alias("at"), F.when(x["att"], F.concat(acc["got"], F.array(own))).otherwise(acc["got"]).alias("got"))

    return messages.withColumn("__pieces", pieces).withColumns({
        "content": F.array_join(F.transform("__pieces", lambda x: x["out"]), ""),
        "attachments": F.aggregate("__pieces", zero, step, lambda acc: acc["got"]),
    }).withColumn("content_chars", F.char_length("content").cast("long")).drop("__pieces")


def format_chats(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments of messages (conv_id, turn, role, parts: array of PART)."""
    flat = flatten(messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "parts"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    rows = flat.withColumns({"__head": head, "loss": F.col("role").isin(*loss_roles), "__size": F.char_length(head) + F.col("content_chars") + len(END)})
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", (F.sum("__size").over(before) - len(END)).cast("long")).withColumn("begin", F.col("end") - F.col("content_chars"))
    moved = F.transform("attachments", lambda a: F.struct(a["kind"].alias("kind"), a["ref"].alias("ref"), (a["at"] + F.col("begin")).alias("at"), a["tokens"].alias("tokens")))
    turn = F.struct("begin", "end", "loss", F.concat("__head", "content", F.lit(END)).alias("text"), moved.alias("attachments"))
    grouped = ends.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["begin"].alias("begin"), t["end"].alias("end")))
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"), spans.alias("loss_spans"), F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"))


def text_parts(rows: DataFrame) -> DataFrame:
    """Messages of one text part each from rows (conv_id, turn, role, text)."""
    part = F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), F.col("text"), F.lit("ref"), F.lit(None).cast("string"), F.lit("width"), F.lit(None).cast("int"),
                          F.lit("height"), F.lit(None).cast("int"), F.lit("seconds"), F.lit(None).cast("double"), F.lit("pages"), F.lit(None).cast("int"))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and loss_text, all taken from formatted and loss_spans alone."""
    blocks = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, F.size(F.split("formatted", r"<\|turn\|>", -1)))
    turns = F.transform(blocks, lambda b: F.struct(
        unescape(F.substring_index(b, BODY, 1)).alias("role"),
        unescape(F.substring(b, F.instr(b, F.lit(BODY)) + len(BODY), F.char_length(b) - F.instr(b, F.lit(BODY)) + 1 - len(BODY) - len(END))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})
