"""Messages and chunk logs, ordered by an explicit sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
END_OF_STREAM = "stream-end"


def last_message(df: DataFrame, conversation: str, turn: str, role: str, text: str, of: str) -> DataFrame:
    """Last text of a role per conversation, NULL where the role never spoke."""
    return df.groupBy(conversation).agg(
        F.max_by(text, F.when(F.col(role) == of, F.col(turn))).alias(f"last_{of}_text")
    )


def last_prompt(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Last user text per conversation, empty without one."""
    last = last_message(df, conversation, turn, role, text, "user")
    return last.select(conversation, F.coalesce("last_user_text", F.lit("")).alias("prompt"))


def first_message(df: DataFrame, conversation: str, turn: str, role: str, text: str, of: str) -> DataFrame:
    return df.groupBy(conversation).agg(
        F.min_by(text, F.when(F.col(role) == of, F.col(turn))).alias(f"first_{of}_text")
    )


def assemble(df: DataFrame, session: str, seq: str, text: str, span: int = 4096, separator: str = "", parts: bool = False) -> DataFrame:
    """Ordered pieces joined to one text per session.

    Pieces are joined in parts of ``span`` sequence numbers and the parts then to the whole, so a long session's pieces
    are sorted in several tasks. With ``parts`` the parts themselves are returned, ordered by ``part``.
    """
    part = F.floor(F.col(seq) / span).cast("long").alias("part")
    pieces = F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(text))))
    joined = df.groupBy(session, part).agg(
        F.array_join(F.transform(pieces, lambda p: p[text]), separator).alias("text"), F.count("*").alias("pieces")
    )
    if parts:
        return joined
    whole = F.array_sort(F.collect_list(F.struct("part", "text")))
    return joined.groupBy(session).agg(
        F.array_join(F.transform(whole, lambda p: p["text"]), separator).alias("text"), F.sum("pieces").alias("pieces")
    )


def until_end(df: DataFrame, session: str, seq: str, kind: str) -> DataFrame:
    """Entries before the first end mark of their session; all of them while it is open.

    The marks are one row per session. The join is on the session alone and adaptive execution splits a
    session that is much larger than the others.
    """
    ends = df.filter(F.col(kind) == END_OF_STREAM).groupBy(session).agg(F.min(seq).alias("_end"))
    joined = df.filter(F.col(kind) != END_OF_STREAM).join(ends, session, "left")
    return joined.filter(F.col("_end").isNull() | (F.col(seq) < F.col("_end"))).drop("_end")


def after_position(seq: Column, position) -> Column:
    """Entries after a saved position; the text "0" stands for all, the number 0 is a position."""
    return F.lit(True) if isinstance(position, str) and position == "0" else seq > F.lit(position)
