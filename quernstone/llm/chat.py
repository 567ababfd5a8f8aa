"""Chat formatting with Spark expressions only.

Turns of one conversation are collected as structs and sorted, adjacent turns of one role are merged, and the pieces of
the template are concatenated; array aggregation adds up where each piece begins. A turn is merged with its neighbours by
looking at their roles in the sorted array, and places are added up in runs of about the square root of the number of
pieces, so that no array is copied once per turn and a conversation of very many turns takes no quadratic time. Nothing
here leaves the JVM.

Template (``role`` groups in order)::

    user        [INST]text[SEP]text[/INST]
    assistant   text[SEP]text</s>
    other       [ROLE]name[TEXT]text[SEP]text[/ROLE]

``[SEP]`` keeps the border between turns that were merged, so reading back gives the rows that went in. Any control
string inside a text gains one backslash after its first character (and a backslashed one gains one more), which the
reader takes away again, so no text can be mistaken for a mark.

Defined results: null text and null role are empty strings; a null ``conv_id`` is one conversation of its own; rows are
ordered by (turn, role, text) with nulls first, so repeated or tied rows stay, in a fixed order; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER_OPEN, USER_CLOSE, END, SEP = "[INST]", "[/INST]", "</s>", "[SEP]"
ROLE_OPEN, ROLE_TEXT, ROLE_CLOSE = "[ROLE]", "[TEXT]", "[/ROLE]"
_FAMILY = r"(/?s>|/?INST\]|SEP\]|/?ROLE\]|TEXT\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _FAMILY, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _FAMILY, r"$1$2$3")


def _pieces(turns: Column) -> Column:
    """Sorted array<(role, text)> -> array<(s, loss)> in template order, neighbours of one role in one group."""

    def mark(s: Column) -> Column:
        return F.struct(s.alias("s"), F.lit(False).alias("loss"))

    def piece(t: Column, i: Column) -> Column:
        role = t["role"]
        begins = F.coalesce(F.get(turns, i - 1)["role"] != role, F.lit(True))
        ends = F.coalesce(F.get(turns, i + 1)["role"] != role, F.lit(True))
        opening = (
            F.when(role == "user", F.lit(USER_OPEN))
            .when(role == "assistant", F.lit(""))
            .otherwise(F.concat(F.lit(ROLE_OPEN), escape(role), F.lit(ROLE_TEXT)))
        )
        closing = F.when(role == "user", F.lit(USER_CLOSE)).when(role == "assistant", F.lit(END)).otherwise(F.lit(ROLE_CLOSE))
        return F.array(
            mark(F.when(begins, opening).otherwise(F.lit(SEP))),
            F.struct(escape(t["text"]).alias("s"), (role == "assistant").alias("loss")),
            mark(F.when(ends, closing).otherwise(F.lit(""))),
        )

    return F.flatten(F.transform(turns, piece))


def _spans(pieces: Column) -> Column:
    """array<(start, end)> of the pieces under the loss mask."""
    start = F.expr("cast(named_struct('at', 0L, 'spans', array()) as struct<at:bigint,spans:array<struct<start:bigint,end:bigint>>>)")

    def walk(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["s"])
        span = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def join(acc: Column, run: Column) -> Column:
        moved = F.transform(run["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    size = F.ceil(F.sqrt(F.size(pieces))).cast("int")
    first = F.sequence(F.lit(1), F.size(pieces), size)
    runs = F.transform(first, lambda k: F.aggregate(F.slice(pieces, k, size), start, walk))
    return F.aggregate(runs, start, join, lambda acc: acc["spans"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, formatted, loss_spans array<(start, end)>), 0-based, end exclusive."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = sorted_.select("conv_id", _pieces(F.col("turns")).alias("pieces"))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), _spans(F.col("pieces")).alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The inverse: adds ``turns`` array<(role, text)> and ``loss_text`` (all text under the mask), from the output alone."""

    def texts(role: Column, body: Column) -> Column:
        return F.transform(F.split(body, r"\[SEP\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    def group(g: Column) -> Column:
        body = F.regexp_replace(g, r"(\[/INST\]|</s>|\[/ROLE\])$", "")
        user = g.endswith(USER_CLOSE)
        other = g.endswith(ROLE_CLOSE)
        role = (
            F.when(user, F.lit("user"))
            .when(other, unescape(F.substring_index(F.substr(body, F.lit(len(ROLE_OPEN) + 1)), ROLE_TEXT, 1)))
            .otherwise(F.lit("assistant"))
        )
        inner = (
            F.when(user, F.substr(body, F.lit(len(USER_OPEN) + 1)))
            .when(other, F.substr(body, F.instr(body, ROLE_TEXT) + F.lit(len(ROLE_TEXT))))
            .otherwise(body)
        )
        return texts(role, inner)

    groups = F.filter(F.split("formatted", r"(?<=\[/INST\])|(?<=</s>)|(?<=\[/ROLE\])", -1), lambda g: F.length(g) > 0)
    masked = F.transform(
        "loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    return formatted.select(
        "*", F.flatten(F.transform(groups, group)).alias("turns"), F.array_join(masked, "").alias("loss_text")
    )


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Digest columns of every conversation, all computed from what :func:`read_chats` reads back."""
    back = read_chats(format_chats(conversations))
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(body.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
