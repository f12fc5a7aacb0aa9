"""Chat formatting from an event log.

A log holds events of conversations: ``message`` (a whole text), ``delta`` (a streamed piece, appended), ``edit`` (a new
text for the message) and ``regenerate`` (the message starts anew, and all later messages of the conversation so far are
dropped). Events are partitioned by conversation and sorted by sequence; folding gives final messages, which are rendered
with a template that marks turns. Control strings inside texts are escaped by one more backslash behind their bracket, so
the formatted text can be read back. Spans tell what a loss counts: the assistant's texts, without the marks.

Only DataFrame functions are used, and texts are shuffled once, by conversation; windows and groups reuse that
partitioning. One conversation becomes one row, so it has to fit into a task. Work is in proportion to its length: offsets
are running sums, and texts are cut out of their own turn.

Null conversation ids are one conversation, null texts and roles are empty ones, and of events with one sequence number the
kind, then the text decides. Repeated events count as often as they occur. Empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks before and after the text of a turn. Other roles are written out between ROLE marks.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, TEXT = ("[ROLE]", "[/ROLE]"), "[/TURN]"
LOSS = "assistant"
# A bracket, backslashes, and the rest of a control string; in << and <</ it is the inner bracket.
REST = r"/?(?:s>|SYS>>|INST\]|ROLE\]|TURN\])"
TURN_END = r"</s>|<</SYS>>|\[/INST\]|\[/TURN\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*{REST})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*{REST})", "$1$2")


def as_log(conversations: DataFrame, turn: str = "turn") -> DataFrame:
    """A log of a table of whole turns: a user's or system's text is one event, an assistant's comes line by line.

    Rows that share a turn are messages of their own, by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy(turn, "role", "text")
    # One shuffle, by conversation: folding finds its rows in place.
    rows = conversations.select("conv_id", turn, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    streamed = F.col("role") == LOSS
    lines = F.when(streamed, F.split("text", "(?<=\n)")).otherwise(F.array("text"))
    each = rows.select("conv_id", "message", "role", F.when(streamed, "delta").otherwise("message").alias("kind"), F.posexplode(lines).alias("piece", "text"))
    return each.select("conv_id", (F.col("message") * (1 << 32) + F.col("piece")).alias("seq"), "message", "role", "kind", "text")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role and text of the final messages of a log (conv_id, seq, message, role, kind, text)."""
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    regenerated = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    logs = events.repartition("conv_id").groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"), regenerated.alias("again"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    # What a regeneration of an earlier message has dropped.
    logs = logs.withColumn("cut", F.max("again").over(before))
    left = logs.select("conv_id", "message", F.when(F.col("cut").isNull(), F.col("log")).otherwise(F.filter("log", lambda e: e.seq > F.col("cut"))).alias("log"))
    left = left.where(F.size("log") > 0)
    # The last event that starts the text anew; deltas after it are appended.
    starts = F.array_max(F.transform(F.filter("log", lambda e: e.kind != "delta"), lambda e: F.struct(e.seq, e.kind, e.text, e.role)))
    left = left.withColumn("start", starts)
    own = F.when(F.col("start").isNull(), F.col("log")).otherwise(F.filter("log", lambda e: F.struct(e.seq, e.kind, e.text, e.role) >= F.col("start")))
    left = left.select("conv_id", "message", F.element_at("log", -1).role.alias("role"), own.alias("log"))
    return left.select("conv_id", "message", "role", F.array_join(F.transform("log", lambda e: e.text), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and spans of each conversation, from its messages (conv_id, message, role, text).

    A span is one assistant text: the number of its turn from 0, ``at``, where the turn starts, and ``start`` and ``end`` of
    the escaped text, all in code points of ``formatted``.
    """
    known = F.col("role").isin(*MARKS)
    opening = F.concat(F.lit(ROLE[0]), escape(F.col("role")), F.lit(ROLE[1]))
    closing = F.lit(TEXT)
    for role, (first, last) in MARKS.items():
        opening = F.when(F.col("role") == role, first).otherwise(opening)
        closing = F.when(F.col("role") == role, last).otherwise(closing)
    turns = messages.select("conv_id", "message", (known & (F.col("role") == LOSS)).alias("loss"), opening.alias("opening"), escape(F.col("text")).alias("body"), closing.alias("closing"))
    long = F.length("opening") + F.length("body") + F.length("closing")
    upto = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("at", F.sum(long).over(upto) - long).withColumn("number", F.row_number().over(upto) - 1)
    start = F.col("at") + F.length("opening")
    span = F.when(F.col("loss"), F.struct(F.col("number").alias("turn"), "at", start.alias("start"), (start + F.length("body")).alias("end")))
    piece = F.struct("message", F.concat("opening", "body", "closing").alias("piece"), span.alias("span"))
    done = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return done.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x.piece), "").alias("formatted"),
        F.filter(F.transform("p", lambda x: x.span), lambda s: s.isNotNull()).alias("spans"))


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, formatted and spans of the conversations of a log."""
    return render(fold(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """The columns of ``formatted``, turns (role, text) and loss (the unescaped text under the spans) read from the string."""
    pieces = F.filter(F.split("formatted", f"(?<={TURN_END})"), lambda p: F.length(p) > 0)

    def turn(p):
        role = F.regexp_extract(p, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)
        start, end = F.length(role) + len(ROLE[0] + ROLE[1]), len(TEXT)
        for name, (first, last) in MARKS.items():
            own = p.startswith(first)
            role, start, end = F.when(own, name).otherwise(role), F.when(own, len(first)).otherwise(start), F.when(own, len(last)).otherwise(end)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(p, start + 1, F.length(p) - start - end)).alias("text"))

    held = formatted.withColumn("_pieces", pieces)
    # Cut from its own turn: cutting from the whole string would walk over it once for each span.
    under = F.transform("spans", lambda s: unescape(F.substring(F.get("_pieces", s.turn), (s.start - s.at + 1).cast("int"), (s.end - s.start).cast("int"))))
    return held.withColumn("turns", F.transform("_pieces", turn)).withColumn("loss", F.array_join(under, "")).drop("_pieces")


def probe(like: DataFrame) -> DataFrame:
    """Conversation -1, whose texts hold the template's own marks."""
    text = "</s>[INST] ok [/INST]"
    return like.sparkSession.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def report(conversations: DataFrame) -> DataFrame:
    """Per conversation, and for conversation -1: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe(conversations))
    done = read_back(format_chats(as_log(rows)))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
