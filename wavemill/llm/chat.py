"""Multi-party perspective rotation of dialogues.

Every participant of a dialogue gets a rendering in which their own turns are
the assistant's and carry the loss; all other participants are named users, and
system turns stay system turns. A rendering is cut after every ``part_turns``
turns, so that a dialogue of any length stays in bounded rows; its parts in
order are the whole.

A rendering can be read back: in texts and names every ``<|`` (also with backslashes
between its two characters) gets one backslash more, in names every ``|>`` too, so
that marks of the format stand nowhere else.

Defined cases: a null text is an empty turn; a null speaker is the participant
``unknown``; turns equal in number are ordered by speaker and text; repeated rows
are repeated turns; a null dialogue id is a dialogue; a dialogue with system
turns only has no participant and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import running, same


def _escaped(text: Column, name: bool = False) -> Column:
    plain = F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")
    return F.regexp_replace(plain, r"\|(\\*)>", r"|\\$1>") if name else plain


def _piece(turn: Column, me: Column, system: list[str]) -> Column:
    head = (
        F.when(turn["speaker"].isin(system), F.lit("<|system|>\n"))
        .when(turn["speaker"] == me, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _escaped(turn["speaker"], name=True), F.lit("|>\n")))
    )
    return F.struct(head.alias("head"), F.concat(_escaped(turn["text"]), F.lit("<|end|>\n")).alias("body"), (turn["speaker"] == me).alias("own"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: tuple[str, ...] = ("system",), part_turns: int = 64) -> DataFrame:
    """conv_id, perspective, part, n_turns, rendered, spans (array of [begin, end) in code points of rendered, the loss mask)."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    placed = running(rows, ["conv_id"], ["turn", "speaker", "text"], {}, "at").withColumn("part", F.floor(F.col("at") / part_turns).cast("long"))
    parts = placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "speaker", "text"))).alias("turns"))
    people = rows.where(~F.col("speaker").isin(list(system))).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    views = parts.join(people, same(F.col("conv_id"), F.col("of")))
    pieces = F.transform("turns", lambda t: _piece(t, F.col("perspective"), list(system)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:long,end:long>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = (begin + F.length(p["body"])).cast("long")
        span = F.array(F.struct(begin.cast("long").alias("begin"), (end - 1).alias("end")))  # with the end mark, without the line feed
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return views.withColumn("pieces", pieces).select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.aggregate("pieces", start, step)["spans"].alias("spans"),
    )
