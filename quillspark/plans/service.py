"""The three service functions: analyse a prompt, suggest improvements, check its context."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .pipeline import one_prompt
from .provider import Provider


def _checked(prompt: str) -> str:
    if not isinstance(prompt, str) or not prompt.strip():
        raise ValueError("the prompt is empty")
    return prompt


def analyze_prompt(spark: SparkSession, prompt: str, date: str, provider: Provider | None = None) -> dict:
    """Patterns and score of a prompt."""
    return one_prompt(spark, _checked(prompt), date, provider)


def suggest_improvements(spark: SparkSession, prompt: str, date: str, provider: Provider | None = None) -> list[dict]:
    """What to change, with an example before and after."""
    got = one_prompt(spark, _checked(prompt), date, provider)
    return [{k: p[k] for k in ("name", "severity", "suggestion", "before", "after")} for p in got["patterns"]]


def is_about_context(pattern: dict) -> bool:
    """Whether a pattern speaks of missing context or vagueness."""
    text = f"{pattern['id']} {pattern['name']}".lower()
    return "context" in text or "vague" in text


def check_context(spark: SparkSession, prompt: str, date: str, provider: Provider | None = None) -> dict:
    """Whether a prompt gives enough context, and what it lacks."""
    lacking = [p for p in one_prompt(spark, _checked(prompt), date, provider)["patterns"] if is_about_context(p)]
    return {"has_context": not lacking, "missing": [{k: p[k] for k in ("name", "suggestion")} for p in lacking]}
