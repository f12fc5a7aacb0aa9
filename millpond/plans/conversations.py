"""Conversations, message parts and chunk logs."""

from pyspark.sql import functions as F

from millpond.functions import messages
from millpond.operators import conversations
from millpond.plans import plan, read_parquet


def _said(spark, sf):
    return read_parquet(spark, sf, "conversations")


def _last(role, best="DESC"):
    return (
        f"SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn {best}) AS rn "
        f"FROM conversations WHERE role = '{role}') WHERE rn = 1"
    )


_CONVS = "(SELECT DISTINCT conv_id FROM conversations)"


@plan(
    "last_assistant_message", "W2",
    f"SELECT c.conv_id, m.text AS last_assistant_text FROM {_CONVS} c LEFT JOIN ({_last('assistant')}) m ON c.conv_id = m.conv_id",
)
def last_assistant_message(spark, sf):
    return conversations.last_message(_said(spark, sf), "conv_id", "turn", "role", "text", "assistant")


@plan(
    "last_user_prompt", "W3",
    f"SELECT c.conv_id, coalesce(m.text, '') AS prompt FROM {_CONVS} c LEFT JOIN ({_last('user')}) m ON c.conv_id = m.conv_id",
)
def last_user_prompt(spark, sf):
    return conversations.last_prompt(_said(spark, sf), "conv_id", "turn", "role", "text")


@plan(
    "first_user_message", "W4",
    f"SELECT c.conv_id, m.text AS first_user_text FROM {_CONVS} c LEFT JOIN ({_last('user', 'ASC')}) m ON c.conv_id = m.conv_id",
)
def first_user_message(spark, sf):
    return conversations.first_message(_said(spark, sf), "conv_id", "turn", "role", "text", "user")


def _with_parts(spark, sf):
    """Messages as parts: a step mark, the text, an artifact of assistants, and the role as a second text."""
    part = lambda kind, text, data: F.struct(
        F.lit(kind).alias("type"), text.cast("string").alias("text"), data.cast("string").alias("data"))
    none = F.lit(None)
    report = F.when(F.col("role") == "assistant", F.concat(F.lit("report of "), F.col("conv_id").cast("string")))
    parts = F.array(
        part("step-start", none, none), part("text", F.col("text"), none), part("data-report-bundle", none, report),
        part("text", F.col("role"), none), part("data-unknown", none, F.col("role")))
    return _said(spark, sf).select("conv_id", "turn", parts.alias("parts"))


@plan("message_texts", "E9", "SELECT conv_id, turn, text || ' ' || role AS text FROM conversations")
def message_texts(spark, sf):
    return _with_parts(spark, sf).select("conv_id", "turn", messages.message_text("parts").alias("text"))


@plan(
    "message_artifacts", "E10 F16",
    """SELECT conv_id, turn, true AS has_report, false AS has_ui,
         CASE WHEN role = 'assistant' THEN 'report of ' || conv_id ELSE '' END AS artifacts, CAST(4 AS INTEGER) AS visible
       FROM conversations""",
)
def message_artifacts(spark, sf):
    return _with_parts(spark, sf).select(
        "conv_id", "turn",
        messages.has_part("parts", "data-report-bundle").alias("has_report"),
        messages.has_part("parts", "data-ui-bundle").alias("has_ui"),
        F.array_join(messages.artifacts("parts"), "|").alias("artifacts"),
        F.size(messages.visible_parts("parts")).alias("visible"),
    )


@plan(
    "assembled_messages", "Z4",
    """SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS pieces FROM conversations GROUP BY conv_id""",
)
def assembled_messages(spark, sf):
    return conversations.assemble(_said(spark, sf), "conv_id", "turn", "text", separator=" ")


@plan(
    "assembled_in_parts", "Z4",
    """SELECT conv_id, turn // 2 AS part, string_agg(text, '' ORDER BY turn) AS text, count(*) AS pieces
       FROM conversations GROUP BY 1, 2""",
)
def assembled_in_parts(spark, sf):
    return conversations.assemble(_said(spark, sf), "conv_id", "turn", "text", span=2, parts=True)


@plan(
    "long_session_parts", "Z4",
    """SELECT conv_id % 3 AS session, (conv_id * 1000 + turn) // 4096 AS part,
         string_agg(text, '' ORDER BY conv_id * 1000 + turn) AS text, count(*) AS pieces
       FROM conversations GROUP BY 1, 2""",
)
def long_session_parts(spark, sf):
    """Three sessions with as many sequence numbers as the table has conversations, as ordered parts of bounded size."""
    said = _said(spark, sf).select((F.col("conv_id") % 3).alias("session"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text")
    return conversations.assemble(said, "session", "seq", "text", parts=True)


def chunk_log(df):
    """Conversation turns as a chunk log; the first answer of the assistant is the end mark."""
    kind = F.when(F.col("role") == "assistant", conversations.END_OF_STREAM).otherwise("stream-chunk")
    return df.select("conv_id", "turn", kind.alias("kind"), "text")


CHUNKS_UNTIL_END = """
SELECT c.conv_id, c.turn, c.text FROM conversations c LEFT JOIN (
  SELECT conv_id, min(turn) AS fin FROM conversations WHERE role = 'assistant' GROUP BY 1) e ON c.conv_id = e.conv_id
WHERE c.role <> 'assistant' AND (fin IS NULL OR c.turn < fin)"""


@plan("chunks_until_end", "Z6", CHUNKS_UNTIL_END)
def chunks_until_end(spark, sf):
    return conversations.until_end(chunk_log(_said(spark, sf)), "conv_id", "turn", "kind").drop("kind")


@plan("chunks_after_position", "Z7", "SELECT conv_id, turn, text FROM conversations WHERE turn > 2")
def chunks_after_position(spark, sf):
    return _said(spark, sf).filter(conversations.after_position(F.col("turn"), 2)).select("conv_id", "turn", "text")


@plan("chunks_from_start", "Z7", "SELECT conv_id, turn, text FROM conversations")
def chunks_from_start(spark, sf):
    return _said(spark, sf).filter(conversations.after_position(F.col("turn"), "0")).select("conv_id", "turn", "text")
