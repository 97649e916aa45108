"""Render dialogues of several parties once from the perspective of each participant.

In the rendering for a participant, their turns are those of the assistant and
are trained on; all others are users with a name.  System turns belong to
nobody and keep their role.  A dialogue is rendered in parts of a fixed number
of turns, which in order make up the whole, so that a dialogue of any length is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Turn numbers of one part.
PART_TURNS = 64
SYSTEM, NAMELESS = "system", "unknown"
END = "<|end|>"


def _head(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == SYSTEM, F.lit("<|system|>\n"))
        .when(role == speaker, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


def _spans(turns: Column) -> Column:
    """[start, end) of what is trained on, in code points of the part."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(state, turn):
        end = state["at"] + turn["n_head"] + turn["n_body"]
        span = F.array(F.struct((state["at"] + turn["n_head"]).alias("start"), end.alias("end")))
        spans = F.when(turn["trained"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.cast(kind).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("spans"))
    return F.aggregate(turns, start, step, lambda state: state["spans"])


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """All dialogues from all perspectives.  Columns: conv_id, perspective, part, n_turns, text, spans.

    ``conversations`` has ``conv_id``, ``turn``, ``role``, ``text``; other
    columns are not read.  Participants are the roles of a dialogue but for
    ``system``.  ``spans`` covers the text and end marker of the participant's
    turns; part p has the turns from p * ``part_turns``.  Markers inside a text
    are broken up by a space.  Cases: a null role is named ``unknown``; a null
    text is empty; a null id is one dialogue; null turns form a part with a null
    number; turns of one number are ordered by role, then text, and repeated
    rows are repeated; a dialogue of system turns only, and an empty table, give
    no rows.
    """
    turns = conversations.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(NAMELESS)).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    speakers = turns.where(F.col("role") != SYSTEM).select("key", F.col("role").alias("perspective")).distinct()
    head = _head(F.col("role"), F.col("perspective"))
    turn = F.struct(
        "turn",
        "role",
        "text",
        head.alias("head"),
        F.length(head).alias("n_head"),
        (F.length("text") + len(END)).alias("n_body"),
        (F.col("role") == F.col("perspective")).alias("trained"),
    )
    parts = (
        turns.join(speakers, "key")
        .groupBy("key", "perspective", F.floor(F.col("turn") / part_turns).alias("part"))
        .agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("turns"))
    )
    rendered = F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END + "\n")))
    return parts.select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", rendered).alias("text"),
        _spans(F.col("turns")).alias("spans"),
    )
