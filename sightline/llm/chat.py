"""Chat formatting from an event log: fold events into messages, render, read back.

A log holds one row per event: ``conv_id, turn, seq, kind, role, text``. Kinds:

* ``delta``: a streamed piece, appended to the message ``turn`` of its conversation;
* ``edit``: the text replaces everything the message held so far;
* ``regenerate``: the message starts again, empty or with the event's text.

The log is partitioned by conversation and sorted by sequence; the last edit or
regeneration of a message and all pieces after it make the final text, and the last
role named is the message's role. A conversation's messages follow ``turn``.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` per message. Control strings inside
texts and roles (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get one more
backslash after their first character, so the escape can be undone whatever the text
holds; a newline or ``%`` in a role is percent-encoded.

Defined cases: a null text or role is empty; a null turn or sequence sorts first; equal
sequences sort by kind, role and text, and repeated rows count as often as they occur;
an empty log gives no rows; other columns are ignored. Everything is a column expression.
A conversation is one output row, so its own events meet in one row, as its text must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template and the control strings that texts may hold.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL_REST = r"(?:\||/?s>|/?INST\])"
_ESCAPE = r"([<\[])(?=\\*" + CONTROL_REST + ")"
_UNESCAPE = r"([<\[])\\(?=\\*" + CONTROL_REST + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def _role_out(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return escape(plain)


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def turns_as_events(turns: DataFrame) -> DataFrame:
    """Finished turns (``conv_id, turn, role, text``) as a log of one piece each.

    Every row is a message of its own, also those with the same turn: they are numbered by
    turn (null last), role and text.
    """
    texts = [F.coalesce(name, F.lit("")) for name in ("role", "text")]
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), *texts)
    number = F.row_number().over(order)
    return turns.select("conv_id", number.alias("turn"), "role", "text").select(
        "conv_id", "turn", F.col("turn").alias("seq"), F.lit("delta").alias("kind"), "role", "text"
    )


def fold_messages(events: DataFrame) -> DataFrame:
    """``conv_id, messages``: final messages of each conversation as role and text, in order."""
    log = events.select(
        "conv_id",
        "turn",
        F.struct(
            F.col("seq").alias("seq"),
            F.col("kind").alias("kind"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("event"),
    ).repartition("conv_id")
    folded = log.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("event")).alias("log"))
    last = F.array_max(
        F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(0))
    )
    folded = folded.withColumn("kept", F.slice("log", last + 1, F.size("log")))
    message = F.struct(
        F.element_at(F.concat(F.array(F.lit("")), F.filter(F.col("log")["role"], lambda r: r != "")), -1).alias("role"),
        F.array_join(F.col("kept")["text"], "").alias("text"),
    )
    return (
        folded.select("conv_id", F.struct(F.col("turn").alias("turn"), message.alias("message")).alias("turn"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("turn"))["message"].alias("messages"))
    )


def render(folded: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans``: the text, and where assistant texts lie in it.

    A span is ``start, size`` in code points of ``formatted`` (start from 0).
    """
    pieces = F.transform(
        "messages",
        lambda m: F.struct(
            (m["role"] == "assistant").alias("loss"),
            F.concat(F.lit(START), _role_out(m["role"]), F.lit("\n")).alias("head"),
            escape(m["text"]).alias("body"),
        ),
    )
    ended = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END) + 1).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("size"))
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return folded.select("conv_id", pieces.alias("pieces")).select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "").alias(
            "formatted"
        ),
        ended["spans"].alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The role and text of every message of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b.startswith(START))
    return F.transform(
        blocks,
        lambda b: F.struct(
            _role_in(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(b, F.locate("\n", b) + 1)).alias("text"),
        ),
    )


def digests(rendered: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, all read from the formatted text."""
    turns = F.array_join(
        F.transform("read", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), ""
    )
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["size"]))), ""
    )
    return (
        rendered.select("conv_id", "formatted", read_back(F.col("formatted")).alias("read"), loss.alias("loss"))
        .select("conv_id", "read", "loss", "formatted", turns.alias("turns"))
        .select(
            "conv_id",
            F.size("read").cast("long").alias("n_turns"),
            F.sha2("turns", 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def format_chats(events: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of a log of events."""
    return render(fold_messages(events))
