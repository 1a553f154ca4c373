"""Analysis of prompts: look up, redact, pack, ask the provider, merge, override.

Each batch is sent once: the answers are written to the shared folder before anything is made of them.
"""

from __future__ import annotations

import logging

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import sanitize, sanitized
from ..functions.text import normalize_score, prompt_key
from ..operators.batching import greedy_batches
from ..operators.issues import apply_rules, merge_patterns, merge_totals, with_metadata
from ..sources.store import misses, settled
from .provider import OfflineProvider, Provider, analyze_split

_OUT = "date string, batch long, part int, issues array<string>, score double, n long, with_issues long, failed long"
_LOG = logging.getLogger(__name__)


def keyed(prompts: DataFrame, model: str, schema: str = "minimal", system: str = "") -> DataFrame:
    """prompts with the hash under which a result is stored; the model's own name is part of it."""
    s = F.lit
    return prompts.withColumn("hash", prompt_key(F.col("content"), F.col("date"), F.col("project"), s(model), s(schema), s(system)))


def run_batches(batched: DataFrame, provider: Provider, context: dict | None = None) -> DataFrame:
    """One row per batch (per part, where it was split) with issues and score; failed counts prompts that were left out."""

    def ask(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["timestamp", "content"])
        got = analyze_split(provider, rows["content"].tolist(), key[0], context=context)
        out = [(key[0], int(key[1]), i, list(g["issues"]), None if g["score"] is None else float(g["score"]), g["n"], g.get("prompts_with_issues", int(bool(g["issues"]))), g.get("failed", 0)) for i, g in enumerate(got)]
        return pd.DataFrame(out, columns=["date", "batch", "part", "issues", "score", "n", "with_issues", "failed"])

    return batched.groupBy("date", "batch").applyInPandas(ask, _OUT)


def analyze(prompts: DataFrame, provider: Provider | None = None, max_tokens: int | None = None, max_prompts: int | None = None, rules: DataFrame | None = None, context: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(patterns per day, totals per day) of prompts (content, timestamp, date, project).

    Limits of batches are the provider's, unless given; context is what is known of the project. Prompts that fail even
    alone are left out and logged; if all do, that is an error.
    """
    provider = provider or OfflineProvider()
    own = provider.batch_limits() if hasattr(provider, "batch_limits") else (3000, 50)
    if max_tokens is None:
        max_tokens, max_prompts = own[0], max_prompts if max_prompts is not None else own[1]
    clean = sanitized(prompts, "content", "content_").drop("content").withColumnRenamed("content_", "content")
    batched = greedy_batches(clean, "content", "date", ["timestamp", "content"], max_tokens, max_prompts)
    answers = settled(run_batches(batched, provider, context), "answers")
    left, kept = answers.agg(F.coalesce(F.sum("failed"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if left:
        if not kept:
            raise RuntimeError(f"all {left} prompts failed")
        _LOG.warning("%d prompts left out, as the provider failed on each", left)
    answers = answers.filter("n > 0")
    at = F.struct("batch", "part").alias("pos")
    flat = answers.select("date", at, F.explode("issues").alias("id")).groupBy("date", "pos", "id").agg(F.count("*").cast("double").alias("frequency"))
    named = with_metadata(flat).withColumn("examples", F.array("before"))
    patterns = merge_patterns(named, "pos", ["date"])
    if rules is not None:
        patterns = apply_rules(patterns, rules)
    parts = answers.select("date", F.col("n").alias("total_prompts"), F.col("with_issues").alias("prompts_with_issues"), normalize_score(F.col("score")).alias("overall_score"))
    return patterns, merge_totals(parts, ["date"])


def analyze_new(prompts: DataFrame, stored: DataFrame | None, model: str, **options) -> tuple[DataFrame, DataFrame]:
    """As analyze, of the prompts that have no stored result."""
    rows = keyed(prompts, model)
    return analyze(misses(rows, stored) if stored is not None else rows, **options)


def one_prompt(spark: SparkSession, prompt: str, date: str, provider: Provider | None = None) -> dict:
    """Result of a single prompt, as the service functions return it; the provider sees it redacted."""
    clean = spark.createDataFrame([(prompt,)], "content string").select(sanitize(F.col("content"))).first()[0]
    got = (provider or OfflineProvider()).analyze([clean], date)
    counts = spark.createDataFrame([(i, 1) for i in got["issues"]], "id string, frequency int")
    patterns = [r.asDict() for r in with_metadata(counts).collect()]
    return {"date": date, "score": got["score"] / 10, "patterns": patterns}
