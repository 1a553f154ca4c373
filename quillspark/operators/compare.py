"""Comparing results of two days, and summaries of history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_patterns(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, name, status, frequencies, severities): new, resolved or changed patterns; unchanged ones are left out.

    The name of a changed pattern is the earlier one.
    """
    b = before.select("id", F.col("name").alias("bn"), F.col("frequency").alias("before_frequency"), F.col("severity").alias("before_severity"))
    a = after.select("id", F.col("name").alias("an"), F.col("frequency").alias("after_frequency"), F.col("severity").alias("after_severity"))
    both = b.join(a, "id", "full_outer")
    status = F.when(F.col("before_frequency").isNull(), "new").when(F.col("after_frequency").isNull(), "resolved")
    status = status.when((F.col("before_frequency") != F.col("after_frequency")) | (F.col("before_severity") != F.col("after_severity")), "changed")
    return both.select("id", F.coalesce("bn", "an").alias("name"), status.alias("status"), "before_frequency", "after_frequency", "before_severity", "after_severity").filter("status is not null")


def score_delta(before: float, after: float) -> float:
    """Change of the score."""
    return after - before


def history_summary(history: DataFrame) -> DataFrame:
    """One row over (provider, prompts, score): entries, scores, providers, prompts."""
    return history.agg(F.count("*").alias("entries"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.sort_array(F.collect_set("provider")).alias("providers"), F.sum("prompts").alias("prompts"))


def week_ago(day):
    """Seven days before."""
    return F.date_sub(day, 7)


def month_ago(day):
    """A month before; the end of a month stays within it."""
    return F.add_months(day, -1)
