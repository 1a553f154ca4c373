"""What is added to a result: statistics of its prompts, and the trend of its history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import lexical, specificity
from ..functions.text import js_round, word_count
from .stats import describe, trend

#: Prompts, the first in order, whose specificity and complexity are measured.
SAMPLE = 20
#: Tokens that a prompt is taken for.
TOKENS = 100


def statistics(prompts: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row: total, mean specificity and complexity of the first prompts with the scores, mean words of all, tokens. Without prompts the means are 0."""
    first = prompts.orderBy(*order).limit(SAMPLE).select(F.struct(*order).alias("at"), specificity(F.col(text))["overall"].alias("score"), lexical(F.col(text))["unique_ratio"].alias("ratio"))
    mean = lambda c, k: js_round(F.coalesce(F.avg(c), F.lit(0.0)), k)
    scores = F.transform(F.sort_array(F.collect_list(F.struct("at", "score"))), lambda x: x["score"])
    few = first.agg(mean("score", 1).alias("specificity"), scores.alias("scores"), mean("ratio", 3).alias("complexity"))
    every = prompts.agg(F.count("*").alias("total"), mean(word_count(F.col(text)), 1).alias("words"), (F.count("*") * TOKENS).alias("tokens"))
    return every.crossJoin(few).select("total", "specificity", "scores", "complexity", "words", "tokens")


def distribution(scores: DataFrame, column: str) -> DataFrame:
    """Descriptive statistics of real scores."""
    return describe(scores, column)


def trend_of(history: DataFrame, day: str, score: str) -> DataFrame:
    """The line through the scores of history; no row with fewer than two entries."""
    return trend(history, day, score).filter("n >= 2")
