"""Conversation history: context text and the question to answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factlake import constants as K
from factlake.functions.text import strip_space
from factlake.operators.ranking import first_rows

# The shortest line is ": x" with its newline, so no more lines than this can
# reach into the context.
_CONTEXT_LINES = K.CONTEXT_CHARS // 4 + 2


def chat_context(conversations: DataFrame) -> DataFrame:
    """Last characters of the "role: text" lines of every conversation.

    Only the last lines, and of each only its last characters, can be part of
    the result; the rest is dropped before the shuffle, so a conversation of any
    length is joined from a bounded piece. Lines of one turn come in order of their text.
    """
    spoken = conversations.withColumn("body", strip_space(F.coalesce("text", F.lit("")))).where("body <> ''")
    line = F.concat_ws(": ", F.coalesce("role", F.lit("user")), F.col("body"))
    tails = spoken.select("conv_id", "turn", F.right(line, F.lit(K.CONTEXT_CHARS)).alias("line"))
    recent = first_rows(tails, ["conv_id"], [F.desc("turn"), F.desc("line")], n=_CONTEXT_LINES, salt_by=["turn", "line"])
    joined = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    context = F.right(F.array_join("lines.line", "\n"), F.lit(K.CONTEXT_CHARS))
    with_text = joined.select("conv_id", context.alias("context"))
    everyone = conversations.select("conv_id").distinct()
    return everyone.join(with_text, "conv_id", "left").select(
        "conv_id", F.coalesce("context", F.lit("")).alias("context")
    )


def last_user_message(conversations: DataFrame) -> DataFrame:
    """Newest user turn per conversation; NULL query if there is none or it is blank."""
    by_user = F.lower("role") == "user"
    newest = conversations.groupBy("conv_id").agg(
        F.max(F.when(by_user, F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("last")
    )
    return newest.select("conv_id", F.nullif(strip_space(F.col("last.text")), F.lit("")).alias("query"))
