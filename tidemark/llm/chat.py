"""Chat formatting: every participant's view of a dialogue, as the text a model would be trained on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import small, stored

#: Markers around a turn: fixed values of this format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: The role that instructs and takes no part.
SYSTEM = "system"


def _safe(text: Column) -> Column:
    """Text and names cannot close or open a turn: the markers' ``<|`` is split by a blank."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate_perspectives(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation, participant and turn, in which that participant is the assistant.

    The participants of a conversation are its distinct roles but ``system``; a null role is the
    participant ``unknown``; line breaks in a name become a blank in the header. Returned are conv_id, perspective, turn, role (assistant, user, system),
    name (the speaker of others' turns, else null), rendered (the turn's whole text with its
    markers), start and end (the code points of the learnt part, offsets into
    the rendered turn) and train (true on the perspective's own turns: the learnt part is the
    speech and the closing marker; on other turns start equals end).

    A dialogue is the concatenation of its rows' rendered in order of turn; it stays in rows, so that a
    conversation of any length is spread over tasks and no task gathers one. Turns with null text
    render as empty speech, equal turn numbers stay as separate rows, a null conv_id is a
    conversation of its own, a conversation of system turns only gives no row, and so does an empty
    table. Other columns are ignored.

    The participants, one row per conversation and role, are aggregated before the shuffle; the join
    with the turns is keyed by conversation, and adaptive execution splits a hot one.
    """
    said = turns.select(
        F.col(conv_id).alias("conv"),
        F.col(turn).alias("at"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"),
        _safe(F.col(text)).alias("speech"),
    )
    who = stored(
        said.where(F.col("speaker") != SYSTEM).groupBy(F.col("conv").alias("in_conv"), F.col("speaker").alias("me")).count().drop("count"),
        "participants",
    )
    own, system = F.col("speaker") == F.col("me"), F.col("speaker") == SYSTEM
    as_role = F.when(own, "assistant").when(system, SYSTEM).otherwise("user")
    name = F.when(~own & ~system, F.regexp_replace(_safe(F.col("speaker")), r"[\r\n]+", " "))  # the header is one line
    head = F.concat(F.lit(OPEN), as_role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    body = F.concat("speech", F.lit(CLOSE))
    begin = F.length("head").cast("long")
    return (
        said.join(small(who), F.col("conv").eqNullSafe(F.col("in_conv")))
        .withColumns({"head": head, "body": body, "as_role": as_role, "name": name})
        .select(
            F.col("conv").alias("conv_id"),
            F.col("me").alias("perspective"),
            F.col("at").alias("turn"),
            F.col("as_role").alias("role"),
            "name",
            F.concat("head", "body").alias("rendered"),
            begin.alias("start"),
            F.when(own, begin + F.length("body")).otherwise(begin).alias("end"),
            own.alias("train"),
        )
    )


def render_dialogues(rotated: DataFrame) -> DataFrame:
    """Whole dialogues from the rows of ``rotate_perspectives``: conv_id, perspective, rendered and
    spans, the [start, end) of the learnt parts in it. For conversations known to fit one task.

    Turns of equal number are put in order of their rendered text, null turn numbers first.
    """
    gathered = rotated.groupBy("conv_id", "perspective").agg(
        F.sort_array(F.collect_list(F.struct("turn", "rendered", "start", "end", "train"))).alias("turns")
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        span = F.struct((state["at"] + t["start"]).alias("start"), (state["at"] + t["end"]).alias("end"))
        return F.struct(
            (state["at"] + F.length(t["rendered"])).alias("at"),
            F.when(t["train"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return gathered.select(
        "conv_id",
        "perspective",
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("rendered"),
        F.aggregate("turns", zero, add, lambda s: s["spans"]).alias("spans"),
    )
