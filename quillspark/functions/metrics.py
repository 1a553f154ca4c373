"""Specificity and lexical complexity of a text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, count_of, has, js_round, jvm, word_count


def _any(words: str, sep: str = " ") -> str:
    return "(?:" + "|".join(sorted(words.split(sep))) + ")"


_FILES = rf"(?i)\b[-/\w]+\.{_any('bash css go html java js json jsx md php py rb rs sass scss sh sql svelte ts tsx vue xml yaml yml')}\b"
_CALLS = rf"\b{_any('async class const def export fn func function let method var')}\s+\w+|\.?\w+\("
_ERRORS = rf"(?i)\b{_any('NaN ReferenceError SyntaxError TypeError crash error exception failed fatal null panic undefined warning')}\b"
_CODE = r"```[\d\D]*?```|`[^`]+`"
_VERBS = rf"(?i)\b{_any('add build change compile create debug delete deploy enhance fix implement improve install migrate modify optimize refactor remove replace test update validate')}\b"
_TERMS = rf"(?i)\b{_any('API,CI/CD,Docker,GraphQL,JWT,Kubernetes,REST,Redis,SQL,async,auth,authentication,authorization,cache,callback,closure,component,controller,database,deployment,endpoint,hook,immutable,integration,lifecycle,middleware,model,production,promise,props,route,schema,service,session,state,testing,token,unit test,view', ',')}\b"

#: A text without any of these has no match of the pattern; looking for them is much cheaper than trying it.
_GATES = {
    "files": [f".{x}" for x in "bash css go htm java js json jsx md php py rb rs sass scss sh sql svelte ts vue xml yaml yml".split()],
    "calls": ["(", *"async class const def export fn func let method var".split()],
    "errors": "nan error crash exception failed fatal null panic undefined warning".split(),
    "code": ["`"],
    "verbs": "add build change compile create debug delete deploy enhance fix implement improve install migrate modify optimize refactor remove replace test update validate".split(),
    "terms": "api,ci/cd,docker,graphql,jwt,kubernetes,rest,redis,sql,async,auth,cache,callback,closure,component,controller,database,deployment,endpoint,hook,immutable,integration,lifecycle,middleware,model,production,promise,props,route,schema,service,session,state,test,token,view".split(","),
}


def _gated(text: Column, low: Column, name: str, found: Column, none: Column) -> Column:
    """found, where the text, in small letters, has a part that the pattern needs; else none."""
    hit = F.lit(False)
    for part in _GATES[name]:
        hit = hit | low.contains(part)
    return F.when(text.isNull(), F.lit(None)).when(hit, found).otherwise(none)


def _once(values: dict[str, Column], use) -> Column:
    """use(struct of the values), each of which is computed once, however often it is used."""
    return F.transform(F.array(F.struct(*(c.alias(k) for k, c in values.items()))), use)[0]


#: The patterns by name, for those who state them in SQL.
PATTERNS = {"files": _FILES, "calls": _CALLS, "errors": _ERRORS, "code": _CODE, "verbs": _VERBS, "terms": _TERMS}


def specificity(text: Column) -> Column:
    """Struct of the counts and the overall score 0..100."""
    def measured(x: Column) -> Column:
        low, t = x["low"], x["text"]
        count = lambda name: _gated(t, low, name, count_of(t, PATTERNS[name]), F.lit(0))
        seen = lambda name: _gated(t, low, name, has(t, PATTERNS[name]), F.lit(False))
        return _once({"files": count("files"), "calls": count("calls"), "error": seen("errors"), "code": seen("code"), "verbs": count("verbs"), "words": word_count(t), "size": F.length(t)}, scored)

    def scored(x: Column) -> Column:
        clarity = x["verbs"] / x["words"] * F.lit(100.0)
        points = F.least(F.lit(30), x["files"] * 15) + F.least(F.lit(20), x["calls"] * 10) + F.when(x["error"], 15).otherwise(0) + F.when(x["code"], 15).otherwise(0)
        overall = F.least(F.lit(100.0), js_round(points + F.least(F.lit(20.0), clarity / F.lit(10.0) * F.lit(20.0))))
        return F.struct(
            overall.cast("int").alias("overall"), x["files"].alias("file_paths"), x["calls"].alias("functions"), x["error"].alias("has_error"), x["code"].alias("has_code"),
            F.least(F.lit(100.0), js_round(clarity, 1)).alias("verb_clarity"), x["words"].alias("words"), x["size"].alias("characters"),
        )

    return _once({"text": text, "low": F.lower(text)}, measured)


def lexical(text: Column) -> Column:
    """Struct of type-token ratio, word length, technical terms, sentences and their length."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def measured(x: Column) -> Column:
        words, t = x["words"], x["text"]
        return _once({
            "n": F.size(words), "distinct": F.size(F.array_distinct(words)), "chars": F.length(F.array_join(words, "")), "terms": _gated(t, x["low"], "terms", count_of(t, _TERMS), F.lit(0)),
            "sentences": F.size(F.filter(F.split(t, "[.!?]+"), lambda s: s.rlike(f"[^{SPACE[1:-1]}]"))),
        }, scored)

    def scored(x: Column) -> Column:
        return F.struct(
            js_round(ratio(x["distinct"], x["n"]), 3).alias("unique_ratio"), js_round(ratio(x["chars"], x["n"]), 1).alias("word_length"), js_round(ratio(x["terms"], x["n"]) * 100, 1).alias("term_density"),
            x["sentences"].alias("sentences"), js_round(ratio(x["n"], x["sentences"]), 1).alias("sentence_length"),
        )

    return _once({"text": text, "low": F.lower(text), "words": F.regexp_extract_all(F.lower(text), F.lit(jvm(r"\b[a-z]+\b")), 0)}, measured)
