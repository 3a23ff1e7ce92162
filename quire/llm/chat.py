"""Chat formatting: turns of typed parts become one marked text a conversation, with a loss mask and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The template. No text can hold a control string: texts have & and < escaped, and each control string starts with <.
TURN, ROLE_END, TURN_END = "<turn ", ">", "</turn>\n"
LOSS_ROLES = ("assistant",)
#: Tokens that a placeholder stands for: an image by tiles of TILE pixels a side, a second of audio, a page of a document.
TILE, AUDIO_PER_SECOND, DOCUMENT_PER_PAGE = 28, 25, 1024
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Conversation that op4 adds: control strings of several templates in its texts.
ODD_ID, ODD_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("&gt;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&gt;"), F.lit(">")))


def text_part(text: Column) -> Column:
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def part_tokens(p: Column) -> Column:
    tiles = F.ceil(p["width"] / TILE) * F.ceil(p["height"] / TILE)
    return (
        F.when(p["kind"] == "image", F.coalesce(tiles, F.lit(1)))
        .when(p["kind"] == "audio", F.coalesce(F.ceil(p["seconds"] * AUDIO_PER_SECOND), F.lit(1)))
        .when(p["kind"] == "document", F.coalesce(p["pages"] * DOCUMENT_PER_PAGE, F.lit(1)))
        .otherwise(F.lit(0))
        .cast("long")
    )


def is_attachment(p: Column) -> Column:
    return p["kind"].isin("image", "audio", "document")


def visit(p: Column) -> Column:
    """What a part becomes: escaped text, or the placeholder of an attachment; a part of another kind is its text."""
    return F.when(is_attachment(p), F.concat(F.lit("<"), p["kind"], F.lit(">"))).otherwise(escape(p["text"]))


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None) -> DataFrame:
    """-> (conv_col, formatted, segments, attachments): a row for each conversation.

    A message is `<turn ROLE>` + content + `</turn>` and a line end, content being its parts in order (parts_col, an
    array of PART, or else one text part of text_col). segments: array<struct<piece, loss>> whose pieces make up
    formatted; loss is true for the content of LOSS_ROLES. attachments: array<struct<kind, ref, place, tokens>> in
    order, place counting from 0; in formatted the place-th placeholder stands for it.

    Messages are rendered where they are read; only then are a conversation's brought together, in turn order (equal
    turns by role, then text, nulls first), since its text is one value of the result: a conversation must fit in a row,
    as any text must. Null text: empty. Null role: empty. A null conv_col is a conversation. Rows that repeat stay.
    An empty table has no rows. Other columns are not read.
    """
    parts = F.col(parts_col) if parts_col else text_part(F.col(text_col))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(parts, F.array().cast(f"array<{PART}>")).alias("parts"))
    found = F.transform(F.filter("parts", is_attachment), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    rows = rows.select("conv", F.struct("turn", "role", F.array_join(F.transform("parts", visit), "").alias("content"), found.alias("found")).alias("m"))
    talks = rows.groupBy("conv").agg(F.array_sort(F.collect_list("m")).alias("ms"))

    def turn(m: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("piece"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(TURN), escape_role(m["role"]), F.lit(ROLE_END)), F.lit(False)),
            piece(m["content"], F.coalesce(m["role"].isin(*LOSS_ROLES), F.lit(False))),
            piece(F.lit(TURN_END), F.lit(False)),
        )

    talks = talks.select("conv", F.flatten(F.transform("ms", turn)).alias("segments"), F.flatten(F.transform("ms", lambda m: m["found"])).alias("found"))
    placed = F.transform("found", lambda a, k: F.struct(a["kind"].alias("kind"), a["ref"].alias("ref"), k.alias("place"), a["tokens"].alias("tokens")))
    formatted = F.array_join(F.transform("segments", lambda s: s["piece"]), "")
    return talks.select(F.col("conv").alias(conv_col), formatted.alias("formatted"), "segments", placed.alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: what format_chat was given, placeholders as they stand."""
    def one(t: Column) -> Column:
        head = F.length(F.lit(TURN))
        end = F.locate(ROLE_END, t)
        return F.struct(unescape_role(F.substring(t, head + 1, end - head - 1)).alias("role"), unescape(F.substring(t, end + 1, F.length(t))).alias("text"))

    ended = F.split(formatted, TURN_END)
    return F.transform(F.slice(ended, 1, F.greatest(F.size(ended) - 1, F.lit(0))), one)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([(ODD_ID, 0, "user", ODD_TEXT), (ODD_ID, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string")
    df = format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(odd))
    turns, loss = read_turns(F.col("formatted")), read_loss(F.col("segments"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    df = df.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
