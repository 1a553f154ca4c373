"""Scalar functions, metrics and issue predicates on literal rows."""

from pyspark.sql import functions as F

from quillspark.functions import metrics, text
from quillspark.functions.issues import issues_of
from quillspark.plans.provider import find_issues

PROMPTS = [
    ("help me", {"vague", "no-goal"}), ("fix it", {"vague", "no-context"}), ("Look around here", {"no-goal", "missing-technical-details"}), ("add button", {"imperative"}),
    ("Please make the whole page look nicer", {"missing-technical-details", "insufficient-constraints"}), ("fix src/a.ts", set()),
    ("We want a shop and a blog and then build the api also with many pages and things for people who come to see", {"too-broad", "missing-technical-details"}),
    ("tests and docs and release or whatever else you can think of today", {"unclear-priorities", "missing-technical-details"}),
]


def test_issue_predicates_agree_with_plain_python(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PROMPTS)], "i int, t string")
    got = {r.i: set(r.x) for r in df.select("i", issues_of(F.col("t")).alias("x")).collect()}
    for i, (p, want) in enumerate(PROMPTS):
        assert got[i] == set(find_issues(p)), p
        assert want <= got[i], (p, got[i])


def one(spark, c, value):
    return spark.createDataFrame([(value,)], "t string").select(c(F.col("t")).alias("x")).first().x


def test_scalars(spark):
    assert one(spark, text.estimate_tokens, "abcde") == 2 and one(spark, text.estimate_tokens, "") == 0
    assert one(spark, text.title_case, "no-context") == "No Context"
    assert one(spark, text.slug, "--Too Vague!") == "too-vague" and one(spark, text.slug, "!!") == "issue-0"
    assert one(spark, lambda c: text.truncate_text(c, 7), "one two three") == "one..."
    assert one(spark, lambda c: text.truncate_text(c, 50), "short") == "short"
    assert one(spark, text.project_of, "/x/projects/app/a/b.jsonl") == "app" and one(spark, text.project_of, "/x/b.jsonl") == "b"
    assert one(spark, text.extract_date, "2025-01-20T23:30:00.000Z") == "2025-01-20" and one(spark, text.extract_date, "nonsense") == "unknown"
    assert one(spark, text.model_of, "Local (tiny)") == "tiny" and one(spark, text.model_of, "Cloud") == "Cloud"
    assert one(spark, text.js_trim, " ﻿ x \n") == "x" and one(spark, text.word_count, "") == 1
    assert one(spark, lambda c: text.js_round(c.cast("double")), "-0.5") == 0 and one(spark, lambda c: text.normalize_score(c.cast("double")), "250") == 10


def test_boundaries_are_ascii(spark):
    assert one(spark, lambda c: F.regexp_extract_all(c, F.lit(text.jvm(r"\b[a-z]+\b")), 0), "éon été abc on") == ["on", "t", "abc", "on"]


def test_metrics(spark):
    s = one(spark, metrics.specificity, "Fix the bug in src/auth/login.ts where `token` fails with TypeError in validate(x)")
    assert s.file_paths == 1 and s.functions == 1 and s.has_error and s.has_code and s.overall > 60
    x = one(spark, metrics.lexical, "One two two. API here!")
    assert (x.unique_ratio, x.sentences, x.term_density) == (0.8, 2, 20.0)
    e = one(spark, metrics.lexical, "")
    assert (e.unique_ratio, e.word_length, e.sentences, e.sentence_length) == (0, 0, 0, 0)
