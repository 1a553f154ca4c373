"""Text, date and hash expressions with the semantics of ECMAScript where they differ from Spark's."""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundary: the JVM's own is Unicode-aware.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: White space as ECMAScript defines it.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


_WORD = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _edge(nodes: list, first: bool) -> bool:
    """Whether every match of parsed nodes begins (or ends) with a word character."""
    if not nodes:
        return False
    (kind, arg), rest = (nodes[0], nodes[1:]) if first else (nodes[-1], nodes[:-1])
    if kind is op.LITERAL:
        return chr(arg) in _WORD
    if kind is op.IN:
        word = lambda k, a: chr(a) in _WORD if k is op.LITERAL else {chr(a[0]), chr(a[1])} <= _WORD and chr(a[0]).isdigit() == chr(a[1]).isdigit() and chr(a[0]).isupper() == chr(a[1]).isupper() if k is op.RANGE else k is op.CATEGORY and a in (op.CATEGORY_DIGIT, op.CATEGORY_WORD)
        return all(word(k, a) for k, a in arg)
    if kind is op.BRANCH:
        return all(_edge(list(b), first) for b in arg[1])
    if kind is op.SUBPATTERN:
        return _edge(list(arg[3]), first)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, _, sub = arg
        return _edge(list(sub), first) and (low > 0 or _edge(rest, first))
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return _edge(rest, first)
    return False


def _boundaries(nodes: list) -> list[str]:
    """JVM form of each boundary of parsed nodes, in order."""
    out = []
    for i, (kind, arg) in enumerate(nodes):
        if kind is op.AT and arg is op.AT_BOUNDARY:
            out.append("(?<![A-Za-z0-9_])" if _edge(nodes[i + 1 :], True) else "(?![A-Za-z0-9_])" if _edge(nodes[:i], False) else BOUNDARY)
        elif kind is op.BRANCH:
            for b in arg[1]:
                out += _boundaries(list(b))
        elif kind is op.SUBPATTERN:
            out += _boundaries(list(arg[3]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            out += _boundaries(list(arg[2]))
        elif kind in (op.ASSERT, op.ASSERT_NOT):
            out += _boundaries(list(arg[1]))
    return out


@lru_cache(None)
def jvm(pattern: str) -> str:
    r"""An ECMAScript-style pattern for the JVM: each \b becomes an ASCII boundary, one-sided where what stands beside it is known."""
    pieces = pattern.split(r"\b")
    if len(pieces) == 1:
        return pattern
    marks = _boundaries(list(parser.parse(pattern)))
    # The parser may move a prefix out of a branch; then the full form stands everywhere.
    marks = marks if len(marks) == len(pieces) - 1 else [BOUNDARY] * (len(pieces) - 1)
    return pieces[0] + "".join(m + p for m, p in zip(marks, pieces[1:]))


def count_of(text: Column, pattern: str) -> Column:
    """Number of matches."""
    return F.regexp_count(text, F.lit(jvm(pattern)))


def has(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs."""
    return text.rlike(jvm(pattern))


def js_trim(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def js_round(x: Column, places: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    k = F.lit(float(10**places))
    return F.floor(x * k + F.lit(0.5)) / k


def word_count(text: Column) -> Column:
    """Pieces between white space of the trimmed text; an empty text counts as one."""
    return F.size(F.split(js_trim(text), f"{SPACE}+"))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(F.length(text) / F.lit(4))


def normalize_score(score: Column) -> Column:
    """A score of 0..100 on the scale 0..10."""
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), score / F.lit(10.0)))


def title_case(ident: Column) -> Column:
    """no-context -> No Context."""
    return F.array_join(F.transform(F.split(ident, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def collapse(text: Column) -> Column:
    """Trimmed text with each run of white space as one space."""
    return F.regexp_replace(js_trim(text), f"{SPACE}+", " ")


def slug(name: Column, index: Column | int = 0) -> Column:
    """Identifier of a free-form issue name; issue-<index> if nothing is left of it."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    i = index if isinstance(index, Column) else F.lit(index)
    return F.when(s == "", F.concat(F.lit("issue-"), i.cast("string"))).otherwise(s)


def truncate_text(text: Column, most: int) -> Column:
    """At most so many characters, cut at the last space if there is one, with three dots."""
    head = F.substring(text, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def extract_date(ts: Column) -> Column:
    """UTC day of an ISO timestamp, 'unknown' if it isn't one; needs a UTC session."""
    return F.coalesce(F.date_format(F.try_to_timestamp(ts), "yyyy-MM-dd"), F.lit("unknown"))


def project_of(path: Column) -> Column:
    """Folder after the first 'projects' folder of a path, else the file's name without .jsonl."""
    inside = F.regexp_extract(path, r"^(?:.*?/)?projects/([^/]+)", 1)
    return F.when(inside != "", inside).otherwise(F.regexp_extract(path, r"([^/]+?)(?:\.jsonl)?$", 1))


def text_hash(text: Column) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(text, 256)


def batch_key(prompts: Column, model: Column, schema: str = "full") -> Column:
    """Key of an ordered batch (array of texts)."""
    return F.sha2(F.concat(model, F.lit(f":{schema}:"), F.array_join(prompts, "\n---\n")), 256)


def prompt_key(prompt: Column, date: Column, project: Column, model: Column, schema: Column, system: Column) -> Column:
    """Key of one analysed prompt; a null project counts as ''."""
    return F.sha2(F.concat_ws("\u0000", prompt, date, F.coalesce(project, F.lit("")), model, schema, system), 256)


def model_of(provider: Column) -> Column:
    """What stands in the first parentheses, else the whole name."""
    inside = F.regexp_extract(provider, r"\(([^)]+)\)", 1)
    return F.when(inside != "", inside).otherwise(provider)


def provider_kind(provider: Column) -> Column:
    """Family of a provider by its name."""
    low = F.lower(provider)
    out = F.when(low.contains("ollama"), "ollama").when(low.contains("anthropic") | low.contains("claude"), "anthropic")
    return out.when(low.contains("google") | low.contains("gemini"), "google").otherwise("ollama")


def severity_rank(severity: Column) -> Column:
    """high 3, medium 2, low 1."""
    return F.when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def severity_of(rank: Column) -> Column:
    """Severity of a rank; low for none."""
    return F.when(rank == 3, "high").when(rank == 2, "medium").otherwise("low")


def severity_icon(severity: Column) -> Column:
    """A coloured dot per severity."""
    return F.when(severity == "high", "🔴").when(severity == "medium", "🟡").otherwise("🟢")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v))
