"""Conversation memory: the window of turns that fit, what falls out of it, and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

BUDGET, LAST, SUMMARY = 1500, 4, 600


def spoken(messages: DataFrame) -> DataFrame:
    """Turns of user and assistant only."""
    return messages.where(F.col("role").isin("user", "assistant"))


def memory_window(messages: DataFrame, budget: int = BUDGET, summary_tokens: int = 0) -> DataFrame:
    """``messages`` with ``cost`` and ``kept``: from the newest back while they fit, the newest always."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    m = spoken(messages).withColumn("cost", T.token_estimate(F.col("text")))
    total = F.sum("cost").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return m.withColumn("kept", (F.row_number().over(newest) == 1) | (total + summary_tokens <= budget))


def last_turns(messages: DataFrame, most: int = LAST, cut: int = 400) -> DataFrame:
    """``(conv_id, transcript)`` of the last ``most`` turns, oldest first."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    m = spoken(messages).withColumn("n", n).where(F.col("n") <= most)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, cut))
    by = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return by.select("conv_id", F.array_join(F.transform("x", lambda t: t["line"]), "\n").alias("transcript"))


def summaries(windowed: DataFrame, most: int = SUMMARY) -> DataFrame:
    """What fell out of the window, as the last ``most`` characters of its transcript."""
    line = F.concat("role", F.lit(": "), F.substring("text", 1, most))
    by = windowed.where("NOT kept").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    whole = F.array_join(F.transform("x", lambda t: t["line"]), " ")
    return by.select("conv_id", F.right(whole, F.lit(most)).alias("summary"))


def export(messages: DataFrame) -> DataFrame:
    """A Markdown transcript of each conversation."""
    block = F.concat(F.lit("**"), F.initcap("role"), F.lit("**\n\n"), "text")
    by = spoken(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("x"))
    return by.select("conv_id", F.array_join(F.transform("x", lambda t: t["block"]), "\n\n").alias("markdown"))
