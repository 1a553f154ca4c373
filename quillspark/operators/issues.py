"""Counting, merging, ranking and overriding issue patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.issues import predicates
from ..functions.text import collapse, js_round, js_trim, normalize_score, severity_of, severity_rank, title_case
from ..schemas import ALL_GOOD, DEFAULT_CATEGORY_SUGGESTION, DEFAULT_SUGGESTION, MAX_EXAMPLES, MAX_PATTERNS, categories, taxonomy


def with_metadata(counts: DataFrame, tax: DataFrame | None = None) -> DataFrame:
    """Issue ids with name, severity, suggestion and examples; unknown ids get defaults."""
    tax = tax if tax is not None else taxonomy(counts.sparkSession)
    t = tax.select("id", "name", "severity", "suggestion", "before", "after")
    out = counts.join(F.broadcast(t), "id", "left")
    suggestion = F.coalesce("suggestion", F.lit(DEFAULT_SUGGESTION))
    return out.withColumns({"name": F.coalesce("name", title_case(F.col("id"))), "severity": F.coalesce("severity", F.lit("medium")), "suggestion": suggestion, "before": F.coalesce("before", F.lit("Example not available")), "after": F.coalesce("after", suggestion)})


def with_category(counts: DataFrame, column: str = "id") -> DataFrame:
    """Categories with name, severity and suggestion; unknown ones keep their id as name."""
    c = categories(counts.sparkSession).withColumnRenamed("id", column)
    out = counts.join(F.broadcast(c), column, "left")
    return out.withColumns({"name": F.coalesce("name", F.col(column)), "severity": F.coalesce("severity", F.lit("low")), "suggestion": F.coalesce("suggestion", F.lit(DEFAULT_CATEGORY_SUGGESTION))})


def count_issues(results: DataFrame, issues: str = "issues", order: str = "pos") -> DataFrame:
    """(id, frequency, first_seen) over rows with an array of issues and an ordinal."""
    found = results.select(order, F.posexplode(issues).alias("_i", "id"))
    return found.groupBy("id").agg(F.count("*").alias("frequency"), F.min(F.struct(order, "_i")).alias("first_seen"))


def top_patterns(counts: DataFrame, k: int = MAX_PATTERNS) -> DataFrame:
    """The k most frequent, earlier seen first among equals."""
    return counts.orderBy(F.desc("frequency"), "first_seen").limit(k)


def aggregate_minimal(results: DataFrame, issues: str = "issues", score: str = "score", order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(ranked patterns with metadata, one row of totals) of results with issue ids and a score 0..100."""
    found = F.count_if(F.size(issues) > 0)
    totals = results.agg(F.count("*").alias("total_prompts"), found.alias("prompts_with_issues"), normalize_score(F.avg(score)).alias("overall_score"))
    return with_metadata(top_patterns(count_issues(results, issues, order))), totals


def top_suggestion(patterns: DataFrame) -> str:
    """Suggestion of the first pattern, or the good news."""
    first = patterns.first()
    return first["suggestion"] if first else ALL_GOOD


def real_examples(prompts: DataFrame, text: str, order: list[str], limit: int = MAX_EXAMPLES) -> DataFrame:
    """(id, examples): per issue the first `limit` prompts that show it, and then the distinct among them."""
    found = predicates(F.col(text))
    ids = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in found.items())))
    hits = prompts.select(*order, F.col(text).alias("_text"), F.explode(ids).alias("id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    few = hits.withColumn("r", rank).filter(F.col("r") <= limit)
    return few.groupBy("id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("r", "_text"))), lambda x: collapse(x["_text"]))).alias("examples"))


def aggregate_individual(results: DataFrame, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(top patterns, totals) of single-prompt results (status, categories, example, suggestion)."""
    bad = results.filter("status = 'problems'")
    found = bad.select(order, F.posexplode("categories").alias("_i", "id"), "example", "suggestion")
    at = F.struct(order, "_i")
    by = found.groupBy("id").agg(
        F.count("*").alias("frequency"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct(order, "_i", "example"))), lambda x: x["example"]), 1, MAX_EXAMPLES).alias("examples"),
        F.min_by("suggestion", at).alias("own_suggestion"),
        F.min(at).alias("first_seen"),
    )
    named = with_category(by).withColumn("suggestion", F.coalesce("own_suggestion", "suggestion")).drop("own_suggestion")
    top = named.orderBy(F.desc("frequency"), F.desc(severity_rank(F.col("severity"))), "first_seen").limit(MAX_PATTERNS)
    n, b = F.count("*"), F.count_if(F.col("status") == "problems")
    score = F.when(n > 0, js_round((F.lit(1.0) - b / n) * 100) / 10).otherwise(F.lit(10.0))
    return top, results.agg(n.alias("total_prompts"), b.alias("prompts_with_issues"), score.alias("overall_score"))


def merge_patterns(patterns: DataFrame, order: str = "pos", keys: list[str] | None = None, k: int = MAX_PATTERNS) -> DataFrame:
    """Patterns of several batches as one: mean frequency, rounded where there are several, gravest severity, first three examples; the k gravest, then most frequent."""
    keys = keys or []
    at = F.col(order)
    first = lambda c: F.min_by(c, at).alias(c)
    extra = [first(c) for c in ("name", "suggestion", "before", "after") if c in patterns.columns]
    frequency = F.when(F.count("*") > 1, js_round(F.avg("frequency"))).otherwise(F.first("frequency").cast("double"))
    rank = F.max(severity_rank(F.col("severity")))
    examples = F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, "examples"))), lambda x: x["examples"])), 1, MAX_EXAMPLES)
    out = patterns.groupBy(*keys, "id").agg(frequency.alias("frequency"), severity_of(rank).alias("severity"), rank.alias("_rank"), examples.alias("examples"), F.min(at).alias("first_seen"), *extra)
    w = Window.partitionBy(*keys).orderBy(F.desc("_rank"), F.desc("frequency"), "first_seen", "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_rank")


def merge_totals(totals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums of prompts; the score is the unweighted mean, rounded where there are several batches."""
    score = F.when(F.count("*") > 1, js_round(F.avg("overall_score"))).otherwise(F.first("overall_score"))
    return totals.groupBy(*(keys or [])).agg(F.sum("total_prompts").alias("total_prompts"), F.sum("prompts_with_issues").alias("prompts_with_issues"), score.alias("overall_score"))


def merge_with_cached(cached: DataFrame, new: DataFrame, order: str = "pos") -> DataFrame:
    """Cached patterns first, then new ones, merged; a single new batch without cached ones is left as it is."""
    c, n = cached.withColumn("_src", F.lit(0)), new.withColumn("_src", F.lit(1))
    if not cached.limit(1).count() and new.select(order).distinct().limit(2).count() <= 1:
        return new
    both = c.unionByName(n).withColumn("_order", F.struct("_src", order)).drop(order, "_src")
    return merge_patterns(both, "_order")


def apply_rules(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """Under any rule, patterns outside the enabled taxonomy go and severities are overridden; the order stays."""
    if not rules.limit(1).count():
        return patterns
    on = enabled(rules).select("id", F.col("severity").alias("_own"))
    return patterns.join(F.broadcast(on), "id").withColumn("severity", F.coalesce("_own", "severity")).drop("_own")


def enabled(rules: DataFrame) -> DataFrame:
    """(id, severity) of the taxonomy's issues that no rule disables; severity only where a rule sets it."""
    t = taxonomy(rules.sparkSession).select("ord", "id")
    return t.join(F.broadcast(rules), "id", "left").filter("enabled is distinct from false").select("ord", "id", "severity")


def ruled_taxonomy(rules: DataFrame) -> DataFrame:
    """The taxonomy with the rules applied."""
    own = rules.selectExpr("id", "enabled", "severity own")
    t = taxonomy(rules.sparkSession).join(F.broadcast(own), "id", "left").filter("enabled is distinct from false")
    return t.withColumn("severity", F.coalesce("own", "severity")).drop("own", "enabled")


def unknown_rules(rules: DataFrame) -> DataFrame:
    """Rules for ids that the taxonomy doesn't have: warnings."""
    return rules.join(F.broadcast(taxonomy(rules.sparkSession)), "id", "left_anti")


def rules_list(rules: DataFrame) -> DataFrame:
    """Each issue with its effective severity, whether it is enabled, and whether a rule changed it."""
    own = rules.selectExpr("id", "enabled", "severity own")
    t = taxonomy(rules.sparkSession).join(F.broadcast(own), "id", "left")
    on = F.coalesce("enabled", F.lit(True))
    return t.select("ord", "id", "name", F.coalesce("own", "severity").alias("severity"), on.alias("enabled"), (on & (F.col("own").isNotNull() | F.col("enabled").isNotNull())).alias("overridden"))


def only_severe(patterns: DataFrame) -> DataFrame:
    """Patterns of high severity."""
    return patterns.filter("severity = 'high'")


def about_context(patterns: DataFrame) -> DataFrame:
    """Patterns that speak of missing context or vagueness."""
    low = lambda c: F.lower(c)
    hit = (F.col("id") == "no-context") | low("name").contains("context") | low("name").contains("vague") | low("id").contains("context") | low("id").contains("vague")
    return patterns.filter(hit)


def issue_flags(prompts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns, and one boolean per issue, named with underscores."""
    return prompts.select(*keep, *(c.alias(k.replace("-", "_")) for k, c in predicates(F.col(text)).items()))


def heuristic_results(prompts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Kept columns, issues and score of the offline provider: 100 less 20 per issue of high, 10 of medium and 5 of low severity, 0 at least.

    That these predicates decide on issues, and this score, are our own additions for runs without a model.
    """
    found = predicates(F.col(text))
    cost = {"high": 20, "medium": 10, "low": 5}
    from ..schemas import TAXONOMY

    price = {r[0]: cost[r[2]] for r in TAXONOMY}
    ids = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in found.items())))
    loss = sum((F.when(c, F.lit(price[k])).otherwise(F.lit(0)) for k, c in found.items()), F.lit(0))
    return prompts.select(*keep, ids.alias("issues"), F.greatest(F.lit(0), F.lit(100) - loss).cast("double").alias("score"), js_trim(F.col(text)).alias("content"))
