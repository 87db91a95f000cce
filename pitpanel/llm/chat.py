"""Chat formatting from an event log.

A log row is (conversation, seq, kind, target, role, text). Kinds:

- ``message`` opens the conversation's next message (also any unknown or null kind);
- ``delta`` is appended to the current message, the one opened or regenerated last (as
  a first event, it opens one);
- ``edit`` replaces the text of message ``target`` (1, 2, ..; null: the current one);
- ``regenerate`` does so too, and drops the messages that had been opened after it.

Logs are partitioned by conversation and sorted by ``seq``; every message is the fold of
its own events, rendered in a template with control strings as turn marks. Inside texts
and roles a control string's beginning gets a backslash, which :func:`read_back` takes
away again, so no text can open or close a turn and every text comes back whole.

Defined cases: null text and role count as empty; events of one seq are ordered by
kind, role and text; edits of messages that don't exist do nothing; a conversation
without messages gives no row; null is a conversation of its own; repeated rows are
repeated messages; an empty log gives an empty table; other columns are ignored.
Everything is DataFrame expressions. A conversation is one output row, so one task
holds it; its events are folded message by message before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_END_LINE = r"<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """One backslash more between ``<`` and ``|``, wherever nothing but those is between."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """As :func:`escape`, and a role stays on one line."""
    doubled = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return escape(F.replace(doubled, F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(
        parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def fold(log: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, message, role, text): the final messages of every conversation."""
    by = Window.partitionBy("conv")
    ordered = by.orderBy("seq", "kind", "role", "text")
    known = F.col("kind").isin("delta", "edit", "regenerate")
    events = log.select(
        F.col(conversation).alias("conv"), "seq",
        F.when(known, F.col("kind")).otherwise(F.lit("message")).alias("kind"),
        F.col("target").cast("long").alias("target"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("at", F.row_number().over(ordered))
    opens = (F.col("kind") == "message") | ((F.col("kind") == "delta") & (F.col("at") == 1))
    so_far = by.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = events.withColumn("opens", opens).withColumn(
        "opened", F.sum(F.col("opens").cast("long")).over(so_far))
    redone = (F.col("kind") == "regenerate") & F.col("target").between(1, F.col("opened"))
    current = F.last(F.when(F.col("opens"), F.col("opened")).when(redone, F.col("target")),
                     ignorenulls=True).over(so_far)
    resets = F.col("kind").isin("edit", "regenerate")
    aim = F.coalesce("target", "current")
    aimed = opened.withColumn("current", current).withColumn(
        "message", F.when(~resets, F.col("current"))
        .when(aim.between(1, F.col("opened")), aim)).filter("message IS NOT NULL")
    folded = aimed.groupBy("conv", "message").agg(
        F.min(F.when(F.col("opens"), F.struct("at", "role"))).alias("opening"),
        F.max(F.when(resets, F.col("at"))).alias("reset_at"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).alias("redone_at"),
        F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts")) \
        .filter("opening IS NOT NULL")
    before = by.orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    redone_before = F.coalesce(F.max("redone_at").over(before), F.lit(0))
    # Events of a message before its last reset are gone; the reset brings its own text.
    left = F.filter("parts", lambda p: p["at"] >= F.coalesce("reset_at", F.lit(0)))
    return folded.withColumn("redone_before", redone_before) \
        .filter(F.col("opening.at") > F.col("redone_before")) \
        .select(F.col("conv").alias(conversation), "message",
                F.col("opening.role").alias("role"),
                F.array_join(F.transform(left, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, conversation: str = "conv_id",
           learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conversation, formatted, loss): loss holds (start, end) of the learned texts.

    Positions are code points of ``formatted``, the end exclusive.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = messages.select(
        F.col(conversation).alias("conv"), "message", F.col("role").isin(*learned).alias("learn"),
        head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(f"{END}\n")))
    before = Window.partitionBy("conv").orderBy("message") \
        .rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("turn").cast("long")).over(before), F.lit(0).cast("long")) \
        + F.length("head")
    placed = turns.withColumn("begin", begin)
    return placed.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("message", "turn"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("learn"), F.struct(
            F.col("begin").alias("start"),
            (F.col("begin") + F.length("body")).alias("end"))))).alias("loss")) \
        .select(F.col("conv").alias(conversation),
                F.array_join("turns.turn", "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``learned`` (texts), both from the formatted string."""
    pieces = F.filter(F.split("formatted", _END_LINE), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substring(p, F.lit(len(START) + 1), F.length(p)), "\n", 1)
        return F.struct(
            unescape_role(role).alias("role"),
            unescape(F.substring(p, F.length(role) + len(START) + 2, F.length(p))).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.substring(
        "formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", F.transform(pieces, turn)) \
        .withColumn("learned", learned)


def streamed(turns: DataFrame, conversation: str = "conv_id", chunk: int = 1024) -> DataFrame:
    """The event log of a table of (conversation, turn, role, text) rows.

    Assistant texts arrive as deltas of ``chunk`` code points after an opening event
    without text; other texts arrive with theirs.
    """
    order = Window.partitionBy(conversation).orderBy("turn", "role", "text")
    rows = turns.withColumn("n", F.row_number().over(order))
    text, is_streamed = F.coalesce("text", F.lit("")), F.col("role") == "assistant"
    opening = F.struct(F.lit(0).alias("part"), F.lit("message").alias("kind"),
                       F.when(is_streamed, F.lit("")).otherwise(text).alias("text"))
    parts = F.when(is_streamed & (F.length(text) > 0), F.transform(
        F.sequence(F.lit(0), F.floor((F.length(text) - 1) / chunk).cast("int")),
        lambda k: F.struct((k + 1).alias("part"), F.lit("delta").alias("kind"),
                           F.substring(text, k * chunk + 1, F.lit(chunk)).alias("text"))))
    none = F.array().cast("array<struct<part:int,kind:string,text:string>>")
    return rows.select(
        conversation, "n", "role",
        F.explode(F.concat(F.array(opening), F.coalesce(parts, none))).alias("e")) \
        .select(conversation, F.struct("n", "e.part").alias("seq"), F.col("e.kind").alias("kind"),
                F.lit(None).cast("long").alias("target"), "role", F.col("e.text").alias("text"))


def format_log(log: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, formatted, loss) of an event log."""
    return render(fold(log, conversation), conversation)
