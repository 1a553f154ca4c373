"""The eight issue predicates over a prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_of, has, js_trim, word_count

_CODE_FILE = r"\w+\.(?:go|java|jsx|js|php|py|rb|tsx|ts)\b"
_ANY_FILE = r"\w+\.(?:go|java|json|jsx|js|php|py|rb|tsx|ts|yaml|yml)\b"
ORDERING = r"\b(?:after|before|finally|first|next|second|then|third)\b"
LIMITS = r"\b(?:boundary|compatib|constraint|edge case|limit|must|performance|requirement|should)\b"
UNITS = r"\b(?:<=|>=|<|>|\d+kb|\d+mb|\d+ms)\b"


def _some(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def predicates(prompt: Column) -> dict[str, Column]:
    """Issue id -> whether the prompt shows it."""
    t = js_trim(prompt)
    low, n, words = F.lower(t), F.length(t), word_count(prompt)
    ands = count_of(low, r"\band\b")
    return {
        "vague": (n < 50) & (words <= 5) & _some(low, "create", "do", "fix", "help", "make") & ~has(low, _CODE_FILE),
        "no-context": _some(low, "it", "that", "the bug", "this") & ~has(low, _CODE_FILE) & ~_some(low, "class", "component", "function", "method"),
        "too-broad": (n > 100) & (ands >= 2) & _some(low, "also", "build", "create", "then"),
        "no-goal": (n < 30) & (words <= 4) & ~has(low, r"\b(?:add|build|create|fix|how|what|when|where|why)\b") & ~low.contains("?"),
        "imperative": (n < 20) & (words <= 3) & has(low, r"^(?:add|change|delete|modify|remove|update)\b") & ~low.contains("?"),
        "missing-technical-details": ~has(low, _ANY_FILE) & ~_some(low, "class ", "const ", "def ", "function", "let ", "var ") & ~has(low, r"\.\w+\(") & ~_some(low, "crash", "error", "exception", "failed", "null", "undefined") & (words >= 3),
        "unclear-priorities": (ands + count_of(low, r"\bor\b") + count_of(low, r"\balso\b") >= 2) & ~has(low, ORDERING) & (words >= 10),
        "insufficient-constraints": ~has(low, LIMITS) & ~has(low, UNITS) & _some(low, "add", "improve", "make", "optimize") & (words >= 4),
    }


def issues_of(prompt: Column) -> Column:
    """Array of the ids of the issues that a prompt shows, in the order of the taxonomy."""
    flags = [F.when(c, F.lit(k)) for k, c in predicates(prompt).items()]
    return F.array_compact(F.array(*flags))
