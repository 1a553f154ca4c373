"""Query catalogue over the test tables, each with the SQL that must give the same rows.

Stand-ins: user turns of conversations and documents for prompts, events for time series, labels for stored
results of documents, embeddings with their label for clustered prompts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import issues as ix
from .functions import metrics, redact, text
from .operators import batching, clustering, compare, enhanced, issues, prompts, stats
from .plans import responses
from .schemas import CATEGORIES, TAXONOMY
from .sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{d}/{name}.parquet")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """User turns that aren't blank, with one ordinal."""
    c = t(spark, d, "conversations").filter((F.col("role") == "user") & (text.js_trim(F.col("text")) != ""))
    return c.withColumn("pos", F.col("conv_id") * 10000 + F.col("turn"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """(date, score, prompts, kinds) of events by day."""
    e = t(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 6).alias("score"), F.count("*").alias("prompts"), F.sort_array(F.collect_set("event_type")).alias("kinds"))


def q(s: str) -> str:
    """SQL literal."""
    return "'" + s.replace("'", "''") + "'"


TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
USER = f"SELECT conv_id, turn, text, conv_id * 10000 + turn AS pos, {TRIM} AS t FROM conversations WHERE role = 'user' AND {TRIM} <> ''"
DAILY = "SELECT CAST(ts AS DATE) AS date, round(avg(value), 6) AS score, count(*) AS prompts, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY ALL"
WORDS = r"len(regexp_split_to_array(t, '\s+'))"


def n_of(col: str, pattern: str) -> str:
    """SQL count of matches."""
    return f"len(regexp_extract_all({col}, {q(pattern)}))"


def rnd(x: str, k: int) -> str:
    """SQL rounding with halves up."""
    return f"(floor(({x}) * {10.0**k} + 0.5) / {10.0**k})"


@query(f"SELECT conv_id, turn, text FROM ({USER})")
def user_prompts(spark, d):
    """Role and blank filters, projection."""
    return turns(spark, d).select("conv_id", "turn", "text")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1')")
def project_filter(spark, d):
    """Case-insensitive part of a project's name."""
    return prompts.of_project(t(spark, d, "documents"), " SRC1 ", "source").select("doc_id", "source")


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'")
def date_filter(spark, d):
    """One day, as a range that the scan can use."""
    return prompts.on_date(t(spark, d, "events"), "ts", "2024-01-10").select("event_id", "event_type")


@query("SELECT event_id, value FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def date_range_filter(spark, d):
    """Days from and to, both included."""
    return prompts.in_range(t(spark, d, "events"), "ts", "2024-01-05", "2024-01-12").select("event_id", "value")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, min(event_id) AS low, list_sort(list_distinct(list(event_type))) AS projects FROM events GROUP BY 1")
def group_by_day(spark, d):
    """Days with their number of rows and sorted projects."""
    e = t(spark, d, "events").select(F.to_date("ts").cast("string").alias("date"), "event_type", "event_id")
    return prompts.by_day(e, "date", "event_type", ["event_id"]).select("date", "n", F.col("prompts")[0]["event_id"].alias("low"), "projects")


@query("SELECT DISTINCT source AS project FROM documents")
def distinct_projects(spark, d):
    """Projects, once each."""
    return t(spark, d, "documents").select(F.col("source").alias("project")).distinct()


@query(
    """SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, greatest(0.0, least(10.0, (doc_id % 1300 - 100) / 10.0)) AS score,
       array_to_string(list_transform(string_split(lang || '-' || source, '-'), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
       CASE WHEN regexp_replace(regexp_replace(lower(substr(text, 1, 40)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') = '' THEN 'issue-' || doc_id
            ELSE regexp_replace(regexp_replace(lower(substr(text, 1, 40)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') END AS slug,
       sha256(text) AS hash, sha256(concat_ws(chr(0), text, '2024-01-01', coalesce(source, ''), 'm', 'full', 's')) AS prompt_key FROM documents"""
)
def scalar_functions(spark, d):
    """Token estimate, score scale, title, slug, hashes."""
    x, s = F.col("text"), F.lit
    return t(spark, d, "documents").select(
        "doc_id", text.estimate_tokens(x).alias("tokens"), text.normalize_score((F.col("doc_id") % 1300 - 100).cast("double")).alias("score"), text.title_case(F.concat_ws("-", "lang", "source")).alias("title"),
        text.slug(F.substring("text", 1, 40), F.col("doc_id")).alias("slug"), text.text_hash(x).alias("hash"), text.prompt_key(x, s("2024-01-01"), F.col("source"), s("m"), s("full"), s("s")).alias("prompt_key"),
    )


@query("SELECT conv_id, sha256('m:full:' || string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn)) AS key FROM conversations WHERE role = 'user' GROUP BY conv_id")
def batch_keys(spark, d):
    """Key of each conversation's ordered prompts."""
    c = t(spark, d, "conversations").filter("role = 'user'")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda p: p["text"])
    return c.groupBy("conv_id").agg(text.batch_key(ordered, F.lit("m")).alias("key"))


@query(
    """SELECT doc_id, CASE WHEN length(text) <= 50 THEN text WHEN instr(substr(text, 1, 50), ' ') > 1 THEN regexp_extract(substr(text, 1, 50), '(?s)^(.*) ', 1) || '...'
       ELSE substr(text, 1, 50) || '...' END AS short FROM documents"""
)
def truncated(spark, d):
    """Texts cut at a space."""
    return t(spark, d, "documents").select("doc_id", text.truncate_text(F.col("text"), 50).alias("short"))


def _chain(col: str, rules) -> str:
    for _, p, r in rules:
        col = f"regexp_replace({col}, {q(p)}, {q(r.replace('$1', chr(92) + '1'))}, 'g')"
    return col


_SECRETS = redact.FIRST[:6]
_PERSONAL = redact.FIRST[6:] + redact.BIRTH


@query(f"SELECT doc_id, md5({_chain('text', _SECRETS)}) AS redacted FROM documents")
def redact_secrets(spark, d):
    """The rules for keys and tokens."""
    return t(spark, d, "documents").select("doc_id", F.md5(redact.apply_rules(F.col("text"), _SECRETS)).alias("redacted"))


@query(f"SELECT doc_id, md5({_chain('text', _PERSONAL)}) AS redacted, {n_of(_chain('text', _PERSONAL), r'\\[REDACTED_[^\\]]+\\]'.replace(chr(92) * 2, chr(92)))} AS n FROM documents")
def redact_personal(spark, d):
    """The rules for mail, cards, identity numbers, postal codes, birth dates; and their count."""
    x = redact.rules_applied(t(spark, d, "documents").select("doc_id", "text"), "text", _PERSONAL)
    return x.select("doc_id", F.md5("text").alias("redacted"), redact.count_redactions(F.col("text")).cast("long").alias("n"))


@query()
def sanitize_all(spark, d):
    """All 25 rules over documents and user turns; lookaheads keep it from SQL."""
    docs = t(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    both = docs.unionByName(turns(spark, d).select(F.lit("conversations").alias("origin"), F.col("pos").alias("id"), "text"))
    return redact.sanitized(both, "text", "redacted").drop("text").withColumn("n", redact.count_redactions(F.col("redacted")))


_P = metrics.PATTERNS
_VC = f"({n_of('text', _P['verbs'])} / {WORDS} * 100.0)"


@query(
    f"""SELECT doc_id, {n_of('text', _P['files'])} AS file_paths, {n_of('text', _P['calls'])} AS functions, regexp_matches(text, {q(_P['errors'])}) AS has_error, regexp_matches(text, {q(_P['code'])}) AS has_code,
    least(100.0, {rnd(_VC, 1)}) AS verb_clarity, {WORDS} AS words, length(text) AS characters,
    CAST(least(100.0, floor(least(30, 15 * {n_of('text', _P['files'])}) + least(20, 10 * {n_of('text', _P['calls'])}) + CASE WHEN regexp_matches(text, {q(_P['errors'])}) THEN 15 ELSE 0 END
    + CASE WHEN regexp_matches(text, {q(_P['code'])}) THEN 15 ELSE 0 END + least(20.0, {_VC} / 10.0 * 20.0) + 0.5)) AS INTEGER) AS overall FROM (SELECT *, {TRIM} AS t FROM documents)"""
)
def specificity(spark, d):
    """Specificity of every document."""
    return t(spark, d, "documents").select("doc_id", metrics.specificity(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(
    rf"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\b[a-z]+\b') AS ws, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> '') AS ss FROM documents),
    c AS (SELECT doc_id, text, len(ws) AS n, len(list_distinct(ws)) AS u, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS chars, len(ss) AS sentences FROM w)
    SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE {rnd('u / n', 3)} END AS unique_ratio, CASE WHEN n = 0 THEN 0.0 ELSE {rnd('chars / n', 1)} END AS word_length,
    CASE WHEN n = 0 THEN 0.0 ELSE {rnd(n_of('text', _P['terms']) + ' / n * 100', 1)} END AS term_density, sentences, CASE WHEN sentences = 0 THEN 0.0 ELSE {rnd('n / sentences', 1)} END AS sentence_length FROM c"""
)
def lexical_complexity(spark, d):
    """Lexical metrics of every document."""
    return t(spark, d, "documents").select("doc_id", metrics.lexical(F.col("text")).alias("s")).select("doc_id", "s.*")


def _some(*parts: str) -> str:
    return "(" + " OR ".join(f"contains(l, {q(p)})" for p in parts) + ")"


def _has(p: str) -> str:
    return f"regexp_matches(l, {q(p)})"


ISSUE_SQL = {
    "vague": f"length(t) < 50 AND w <= 5 AND {_some('create', 'do', 'fix', 'help', 'make')} AND NOT {_has(ix._CODE_FILE)}",
    "no-context": f"{_some('it', 'that', 'the bug', 'this')} AND NOT {_has(ix._CODE_FILE)} AND NOT {_some('class', 'component', 'function', 'method')}",
    "too-broad": f"length(t) > 100 AND {n_of('l', chr(92) + 'band' + chr(92) + 'b')} >= 2 AND {_some('also', 'build', 'create', 'then')}",
    "no-goal": f"length(t) < 30 AND w <= 4 AND NOT {_has(chr(92) + 'b(?:add|build|create|fix|how|what|when|where|why)' + chr(92) + 'b')} AND NOT contains(l, '?')",
    "imperative": f"length(t) < 20 AND w <= 3 AND {_has('^(?:add|change|delete|modify|remove|update)' + chr(92) + 'b')} AND NOT contains(l, '?')",
    "missing-technical-details": f"NOT {_has(ix._ANY_FILE)} AND NOT {_some('class ', 'const ', 'def ', 'function', 'let ', 'var ')} AND NOT {_has(r'\.\w+\(')} AND NOT {_some('crash', 'error', 'exception', 'failed', 'null', 'undefined')} AND w >= 3",
    "unclear-priorities": f"{n_of('l', chr(92) + 'b(?:and|or|also)' + chr(92) + 'b')} >= 2 AND NOT {_has(ix.ORDERING)} AND w >= 10",
    "insufficient-constraints": f"NOT {_has(ix.LIMITS)} AND NOT {_has(ix.UNITS)} AND {_some('add', 'improve', 'make', 'optimize')} AND w >= 4",
}
LOWERED = f"SELECT *, lower(t) AS l, {WORDS} AS w FROM ({USER})"
FOUND = " UNION ALL ".join(f"SELECT conv_id, turn, pos, t, {i} AS i, {q(k)} AS id FROM ({LOWERED}) WHERE {c}" for i, (k, c) in enumerate(ISSUE_SQL.items()))
DIM = "(VALUES " + ", ".join(f"({i}, {', '.join(q(x) for x in r[:4])})" for i, r in enumerate(TAXONOMY)) + ") AS tax(ord, id, name, severity, suggestion)"


@query("SELECT conv_id, turn, " + ", ".join(f"({c}) AS {k.replace('-', '_')}" for k, c in ISSUE_SQL.items()) + f" FROM ({LOWERED})")
def issue_flags(spark, d):
    """Which issues each prompt shows."""
    return issues.issue_flags(turns(spark, d), "text", ["conv_id", "turn"])


def _results(spark, d):
    return issues.heuristic_results(turns(spark, d), "text", ["conv_id", "turn", "pos"])


@query(f"SELECT id, count(*) AS frequency FROM ({FOUND}) GROUP BY id")
def issue_counts(spark, d):
    """How often each issue is met."""
    return issues.count_issues(_results(spark, d)).select("id", "frequency")


_TOP = f"SELECT id, count(*) AS frequency, min(pos * 10 + i) AS seen FROM ({FOUND}) GROUP BY id ORDER BY frequency DESC, seen LIMIT 5"


@query(f"SELECT id, frequency, name, severity, suggestion FROM ({_TOP}) JOIN {DIM} USING (id)")
def issue_top5(spark, d):
    """The flagship: the five most frequent issues with their metadata."""
    return issues.aggregate_minimal(_results(spark, d))[0].select("id", "frequency", "name", "severity", "suggestion")


_COST = "CASE severity WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END"


@query(
    f"""WITH loss AS (SELECT pos, sum({_COST}) AS c FROM ({FOUND}) JOIN {DIM} USING (id) GROUP BY pos), s AS (SELECT greatest(0, 100 - coalesce(c, 0))::DOUBLE AS score, c FROM ({USER}) LEFT JOIN loss USING (pos))
    SELECT count(*) AS total_prompts, count(c) AS prompts_with_issues, round(greatest(0.0, least(10.0, avg(score) / 10.0)), 6) AS overall_score FROM s"""
)
def issue_totals(spark, d):
    """Prompts, prompts with issues, mean score."""
    return issues.aggregate_minimal(_results(spark, d))[1].withColumn("overall_score", F.round("overall_score", 6))


@query(
    rf"""WITH r AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM ({FOUND})),
    m AS (SELECT id, regexp_replace(t, '\s+', ' ', 'g') AS e, min(r) AS r FROM r WHERE r <= 3 GROUP BY ALL) SELECT id, list(e ORDER BY r) AS examples FROM m GROUP BY id"""
)
def issue_examples(spark, d):
    """First three matches of each issue, then the distinct."""
    return issues.real_examples(turns(spark, d), "text", ["pos"])


_RULES = [("no-context", True, "low"), ("too-broad", False, None), ("nonsense", True, None), ("unclear-priorities", None, "high")]
_RULES_SQL = "(VALUES ('no-context', true, 'low'), ('too-broad', false, NULL), ('nonsense', true, NULL), ('unclear-priorities', NULL, 'high')) AS rules(id, enabled, own)"


def _rules(spark):
    return spark.createDataFrame(_RULES, "id string, enabled boolean, severity string")


@query(f"SELECT id, frequency, name, coalesce(own, severity) AS severity FROM ({_TOP}) JOIN {DIM} USING (id) LEFT JOIN {_RULES_SQL} USING (id) WHERE enabled IS DISTINCT FROM false")
def rules_override(spark, d):
    """Rules applied to the ranked issues."""
    return issues.apply_rules(issues.aggregate_minimal(_results(spark, d))[0], _rules(spark)).select("id", "frequency", "name", "severity")


@query(f"SELECT ord, id, name, coalesce(own, severity) AS severity, coalesce(enabled, true) AS enabled, coalesce(enabled, true) AND (own IS NOT NULL OR enabled IS NOT NULL) AS overridden FROM {DIM} LEFT JOIN {_RULES_SQL} USING (id)")
def rules_list(spark, d):
    """All issues with what the rules do to them."""
    return issues.rules_list(_rules(spark))


@query(f"SELECT id FROM {DIM} LEFT JOIN {_RULES_SQL} USING (id) WHERE enabled IS DISTINCT FROM false")
def enabled_rules(spark, d):
    """Ids that no rule disables."""
    return issues.enabled(_rules(spark)).select("id")


@query(f"SELECT id FROM {_RULES_SQL} WHERE id NOT IN (SELECT id FROM {DIM})")
def unknown_rules(spark, d):
    """Rules for ids that don't exist."""
    return issues.unknown_rules(_rules(spark)).select("id")


_CAT = "(VALUES " + ", ".join(f"({', '.join(q(x) for x in r)})" for r in CATEGORIES) + ") AS cat(id, cname, severity, suggestion)"


def _individual(spark, d):
    """Single-prompt results made from turns: a few categories by length and turn."""
    x = turns(spark, d)
    n = F.length("text")
    c = F.array_compact(F.array(F.when(n % 2 == 0, F.lit("vague-request")), F.when(n % 3 == 0, F.lit("missing-context")), F.when(n % 5 == 0, F.lit("odd-one")), F.when(n % 7 == 0, F.lit("other"))))
    return x.select("pos", F.when(F.size(c) > 0, "problems").otherwise("ok").alias("status"), c.alias("categories"), F.substring("text", 1, 30).alias("example"), F.concat(F.lit("s"), (n % 4).cast("string")).alias("suggestion"))


_IND = " UNION ALL ".join(f"SELECT pos, {i} AS i, {q(k)} AS id, substr(text, 1, 30) AS example, 's' || (length(text) % 4) AS s FROM ({USER}) WHERE length(text) % {m} = 0" for i, (k, m) in enumerate((("vague-request", 2), ("missing-context", 3), ("odd-one", 5), ("other", 7))))


@query(
    f"""WITH g AS (SELECT id, count(*) AS frequency, list(example ORDER BY pos, i)[1:3] AS examples, arg_min(s, pos * 10 + i) AS suggestion FROM ({_IND}) GROUP BY id)
    SELECT id, frequency, examples, coalesce(cname, id) AS name, coalesce(severity, 'low') AS severity, g.suggestion AS suggestion FROM g LEFT JOIN {_CAT} USING (id)"""
)
def individual_aggregate(spark, d):
    """Single-prompt results counted by category."""
    return issues.aggregate_individual(_individual(spark, d))[0].select("id", "frequency", "examples", "name", "severity", "suggestion")


def _batches(spark, d):
    r = _results(spark, d).withColumn("pos", F.floor(F.col("conv_id") / 10))
    flat = r.select("pos", F.explode("issues").alias("id")).groupBy("pos", "id").agg(F.count("*").cast("double").alias("frequency"))
    return issues.with_metadata(flat).withColumn("examples", F.array(F.concat("id", F.lit("#"), F.col("pos").cast("string"))))


@query(
    f"""WITH b AS (SELECT conv_id // 10 AS b, id, count(*)::DOUBLE AS f FROM ({FOUND}) GROUP BY ALL),
    m AS (SELECT id, CASE WHEN count(*) > 1 THEN floor(avg(f) + 0.5) ELSE min(f) END AS frequency, list(id || '#' || b ORDER BY b)[1:3] AS examples FROM b GROUP BY id)
    SELECT id, frequency, severity, examples FROM m JOIN {DIM} USING (id) ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, frequency DESC, id LIMIT 5"""
)
def merge_batches(spark, d):
    """Patterns of batches of ten conversations as one result."""
    return issues.merge_patterns(_batches(spark, d)).select("id", "frequency", "severity", "examples")


def _on(spark, d, day):
    e = prompts.on_date(t(spark, d, "events"), "ts", day).filter("user_id % 3 = 0 or event_type <> 'click'").groupBy(F.col("event_type").alias("id")).agg(F.count("*").alias("frequency"))
    return e.select("id", F.upper("id").alias("name"), "frequency", F.when(F.col("frequency") % 2 == 0, "high").otherwise("low").alias("severity"))


def _on_sql(day):
    return f"(SELECT event_type AS id, upper(event_type) AS name, count(*) AS frequency, CASE WHEN count(*) % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM events WHERE CAST(ts AS DATE) = DATE '{day}' AND (user_id % 3 = 0 OR event_type <> 'click') GROUP BY event_type)"


@query(
    f"""SELECT coalesce(b.id, a.id) AS id, coalesce(b.name, a.name) AS name, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'resolved' ELSE 'changed' END AS status, b.frequency AS before_frequency, a.frequency AS after_frequency,
    b.severity AS before_severity, a.severity AS after_severity FROM {_on_sql('2024-01-03')} b FULL JOIN {_on_sql('2024-01-10')} a ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.frequency <> b.frequency OR a.severity <> b.severity"""
)
def compare_two_days(spark, d):
    """New, resolved and changed patterns between two days."""
    return compare.compare_patterns(_on(spark, d, "2024-01-03"), _on(spark, d, "2024-01-10"))


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def cache_hits(spark, d):
    """Documents with a stored result."""
    return store.hits(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def cache_misses(spark, d):
    """Documents without."""
    return store.misses(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")


@query(f"SELECT count(x) AS hits, count(*) AS total, {rnd('count(x) * 100.0 / count(*)', 1)} AS rate FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 1 AS x FROM labels) USING (doc_id)")
def hit_rate(spark, d):
    """Share of documents with a stored result."""
    return store.hit_rate(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")


@query(f"SELECT CAST(date AS VARCHAR) AS date, score, prompts FROM ({DAILY}) WHERE len(list_filter(kinds, lambda k: contains(lower(k), 'click'))) > 0 AND score >= 5 AND score <= 500")
def history_list(spark, d):
    """Days with a kind of event and a score within bounds."""
    h = daily(spark, d).withColumnRenamed("kinds", "projects")
    return store.list_history(h, project="CLICK", min_score=5, max_score=500).select(F.col("date").cast("string").alias("date"), "score", "prompts")


@query(f"SELECT count(*) AS entries, round(avg(score), 5) AS avg_score, min(score) AS min_score, max(score) AS max_score, ['events'] AS providers, CAST(sum(prompts) AS BIGINT) AS prompts FROM ({DAILY})")
def history_summary(spark, d):
    """All days in one row."""
    return compare.history_summary(daily(spark, d).withColumn("provider", F.lit("events"))).withColumn("avg_score", F.round("avg_score", 5))


@query(f"SELECT CAST(date AS VARCHAR) AS date, {rnd('avg(score) OVER (ORDER BY date ROWS 6 PRECEDING)', 2)} AS moving_average FROM ({DAILY})")
def moving_average(spark, d):
    """Seven days' trailing mean."""
    return stats.moving_average(daily(spark, d), "score", "date", 7).select(F.col("date").cast("string").alias("date"), "moving_average")


_FIT = f"""SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, max(x) AS last_x, max(date) AS last_day
    FROM (SELECT date, score AS y, CAST(date - min(date) OVER () AS DOUBLE) AS x FROM ({DAILY}))"""


@query(f"SELECT n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, last_x, CAST(last_day AS VARCHAR) AS last_day, CASE WHEN slope > 0.1 THEN 'improving' WHEN slope < -0.1 THEN 'declining' ELSE 'stable' END AS direction, CASE WHEN r2 > 0.7 THEN 'high' WHEN r2 > 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM ({_FIT})")
def trend(spark, d):
    """Line through the daily scores."""
    return stats.trend(daily(spark, d), "date", "score").withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "r2")} | {"last_day": F.col("last_day").cast("string")})


@query(f"SELECT days, round(intercept + slope * (last_x + days), 5) AS projected FROM ({_FIT}), (VALUES (1), (7), (30)) AS v(days)")
def projection(spark, d):
    """The line, some days on."""
    return stats.projection(stats.trend(daily(spark, d), "date", "score"), [1, 7, 30]).withColumn("projected", F.round("projected", 5))


@query(
    f"""SELECT CAST(CAST(DATE '2024-02-01' + k::INTEGER AS DATE) AS VARCHAR) AS day, {rnd('p', 2)} AS predicted, {rnd('greatest(0.0, p - (1 - r2) * 2)', 2)} AS lower, {rnd('least(10.0, p + (1 - r2) * 2)', 2)} AS upper
    FROM (SELECT k, r2, intercept + slope * (last_x + k) AS p FROM ({_FIT}), (SELECT unnest(range(1, 8)) AS k))"""
)
def forecast(spark, d):
    """The next seven days after a date."""
    return stats.forecast(stats.trend(daily(spark, d), "date", "score"), 7, "2024-02-01").withColumn("day", F.col("day").cast("string"))


@query(
    f"""WITH r AS (SELECT score AS y, row_number() OVER (ORDER BY date DESC) AS r FROM ({DAILY})), a AS (SELECT avg(y) FILTER (r <= 3) AS x, avg(y) FILTER (r > 3) AS e FROM r)
    SELECT CASE WHEN x - e > 0.5 THEN 'improving' WHEN x - e < -0.5 THEN 'declining' ELSE 'stable' END AS status, {rnd('x', 2)} AS recent, {rnd('e', 2)} AS earlier, {rnd('x - e', 2)} AS delta, {rnd('(x - e) / e * 100', 1)} AS percent FROM a"""
)
def improvement(spark, d):
    """The last three days against those before."""
    return stats.improvement(daily(spark, d), "date", "score")


def _quantile(p: float) -> str:
    """The quantile rule over a sorted list v of n values."""
    at = f"(n::DOUBLE * {p})"
    return f"CASE WHEN {at} <> floor({at}) THEN v[ceil({at})::BIGINT] WHEN n % 2 = 0 THEN (v[{at}::BIGINT] + v[{at}::BIGINT + 1]) / 2 ELSE v[{at}::BIGINT + 1] END"


_QS = ", ".join(f"{_quantile(p / 100)} AS p{p}" for p in stats.PERCENTILES)


@query(f"SELECT {_QS} FROM (SELECT list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders)")
def percentiles(spark, d):
    """Percentiles of prices by the rank rule."""
    return stats.quantiles(t(spark, d, "orders"), "o_totalprice", {f"p{p}": p / 100 for p in stats.PERCENTILES})


@query(
    f"""SELECT n, round(mean, 4) AS mean, round(sd, 4) AS sd, lowest, highest, round(value_range, 4) AS value_range, round(skew, 6) AS skew, round(kurt, 6) AS kurt, {_QS}, {_quantile(0.5)} AS median
    FROM (SELECT list_sort(list(l_extendedprice)) AS v, count(*) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest,
    max(l_extendedprice) - min(l_extendedprice) AS value_range, skewness(l_extendedprice) AS skew, kurtosis(l_extendedprice) AS kurt FROM lineitem)"""
)
def describe(spark, d):
    """Descriptive statistics of line prices."""
    out = stats.describe(t(spark, d, "lineitem"), "l_extendedprice").drop("variance")
    return out.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4), "value_range": F.round("value_range", 4), "skew": F.round("skew", 6), "kurt": F.round("kurt", 6)})


@query(f"WITH s AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM events), b AS (SELECT {_quantile(0.25)} AS a, {_quantile(0.75)} AS c FROM s) SELECT event_id, round(a - (c - a) * 1.5, 6) AS lower, round(c + (c - a) * 1.5, 6) AS upper FROM events, b WHERE value < a - (c - a) * 1.5 OR value > c + (c - a) * 1.5")
def outliers_iqr(spark, d):
    """Events beyond the quartile fences."""
    out = stats.outliers(t(spark, d, "events"), "value").filter("is_outlier")
    return out.select("event_id", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query("SELECT event_id FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs((value - m) / s) > 3")
def outliers_zscore(spark, d):
    """Events more than three deviations from the mean."""
    return stats.outliers(t(spark, d, "events"), "value", "zscore").filter("is_outlier").select("event_id")


@query(
    """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
    SELECT f.bin, round(lo + f.bin * (hi - lo) / 10, 6) AS lower, coalesce(n, 0) AS n FROM b, (SELECT unnest(range(0, 10))::INTEGER AS bin) f LEFT JOIN c ON c.bin = f.bin"""
)
def histogram(spark, d):
    """Ten bins of prices."""
    return stats.histogram(t(spark, d, "orders"), "o_totalprice", 10).withColumn("lower", F.round("lower", 6))


_STOP = ", ".join(q(w) for w in clustering.STOP_WORDS)
_KW = rf"""WITH w AS (SELECT lang, doc_id, unnest(ws) AS keyword, generate_subscripts(ws, 1) AS i FROM (SELECT lang, doc_id, regexp_extract_all(lower(text), '\b[a-z]{{3,}}\b') AS ws FROM documents)),
    n AS (SELECT lang, keyword, count(*) AS n, min((doc_id, i)) AS seen FROM w WHERE keyword NOT IN ({_STOP}) GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, seen) AS INTEGER) AS rank FROM n)"""


@query(f"{_KW} SELECT lang, keyword, n, rank FROM k WHERE rank <= 5")
def keywords_top5(spark, d):
    """Frequent words of each language."""
    return clustering.keywords(t(spark, d, "documents"), "text", ["lang"], ["doc_id"])


@query(
    f"""{_KW}, l AS (SELECT lang, list(keyword ORDER BY rank) AS keywords FROM k WHERE rank <= 5 GROUP BY lang), r AS (SELECT lang, count(*) AS n, arg_min(text, (length(text), doc_id)) AS representative FROM documents GROUP BY lang)
    SELECT lang, n, upper(keywords[1][1]) || keywords[1][2:] || ' Tasks' AS label, keywords, representative FROM r JOIN l USING (lang)"""
)
def cluster_labels(spark, d):
    """Label, keywords and shortest text of each language's documents."""
    return clustering.labelled(t(spark, d, "documents"), "text", "lang", ["doc_id"])


@query(f"SELECT count(*) AS clusters, {rnd('avg(n)', 1)} AS avg_size, max(n) AS largest, min(n) AS smallest FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)")
def cluster_summary(spark, d):
    """Sizes of the labelled clusters."""
    return clustering.cluster_summary(t(spark, d, "embeddings"), "label")


_E = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings"


@query(f"WITH e AS ({_E}), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL) SELECT label AS cluster, count(DISTINCT vec_id) AS n, round(sum((x - m) ** 2), 4) AS inertia FROM e JOIN c USING (label, i) GROUP BY label")
def inertia_by_label(spark, d):
    """Squared distances to each cluster's mean."""
    return clustering.inertia(t(spark, d, "embeddings"), "embedding", "label").withColumn("inertia", F.round("inertia", 4))


@query(
    f"""WITH e AS ({_E}), l AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM e GROUP BY vec_id), u AS (SELECT vec_id, label, i, x / norm AS x FROM e JOIN l USING (vec_id)), s AS (SELECT label, i, sum(x) AS t, count(*) AS n FROM u GROUP BY ALL),
    p AS (SELECT u.vec_id, u.label, s.label AS other, s.n, sum(u.x * s.t) AS d FROM u JOIN s USING (i) GROUP BY ALL),
    a AS (SELECT vec_id, label, max(CASE WHEN other = label THEN CASE WHEN n > 1 THEN (n - d) / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN other <> label THEN 1 - d / n END) AS b FROM p GROUP BY ALL)
    SELECT vec_id AS id, label AS cluster, round(a, 6) AS a, round(b, 6) AS b, round((b - a) / greatest(a, b), 6) AS silhouette FROM a"""
)
def silhouette_by_label(spark, d):
    """Cosine silhouette with the labels as clusters."""
    return clustering.silhouette(t(spark, d, "embeddings"), "vec_id", "embedding", "label").withColumns({c: F.round(c, 6) for c in ("a", "b", "silhouette")})


@query("SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def distances(spark, d):
    """Distances of all vectors to one."""
    e = t(spark, d, "embeddings")
    one = e.filter("vec_id = 0").select(F.col("embedding").alias("o"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(text.cosine_distance(F.col("embedding"), F.col("o")), 6).alias("cosine"), F.round(text.euclidean_distance(F.col("embedding"), F.col("o")), 6).alias("euclidean"))


@query(
    """WITH RECURSIVE d AS (SELECT source, doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
    f AS (SELECT source, doc_id, tokens, r, 0::BIGINT AS batch, tokens AS total, 1 AS n, tokens > 1000 AS alone FROM d WHERE r = 1
      UNION ALL SELECT d.source, d.doc_id, d.tokens, d.r, CASE WHEN d.tokens > 1000 OR f.alone OR f.total + d.tokens > 1000 OR f.n >= 50 THEN f.batch + 1 ELSE f.batch END,
      CASE WHEN d.tokens > 1000 OR f.alone OR f.total + d.tokens > 1000 OR f.n >= 50 THEN d.tokens ELSE f.total + d.tokens END, CASE WHEN d.tokens > 1000 OR f.alone OR f.total + d.tokens > 1000 OR f.n >= 50 THEN 1 ELSE f.n + 1 END, d.tokens > 1000
      FROM f JOIN d ON d.source = f.source AND d.r = f.r + 1) SELECT source, doc_id, tokens, batch FROM f"""
)
def greedy_batches(spark, d):
    """Documents of each source packed under 1000 tokens."""
    return batching.greedy_batches(t(spark, d, "documents").select("source", "doc_id", "text"), "text", "source", ["doc_id"], 3000, 50).select("source", "doc_id", "tokens", "batch")


@query()
def kmeans(spark, d):
    """Clusters of the embeddings, with silhouettes; seeded, so rows only."""
    _, rows = clustering.kmeans(t(spark, d, "embeddings"), "embedding", 8)
    return clustering.silhouette(rows, "vec_id", "embedding", "cluster")


@query()
def elbow(spark, d):
    """Number of clusters by the bend of inertia."""
    k, costs = clustering.elbow(t(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame([(k, [float(c) for c in costs])], "k int, inertias array<double>")


@query()
def response_parse(spark, d):
    """Model answers of every shape, the broken ones mended."""
    rows = [(i, r) for i, r in enumerate(responses.SAMPLES)]
    return responses.parse(spark.createDataFrame(rows, "id int, response string"), "response")


@query("SELECT DISTINCT user_id, event_type FROM events")
def first_events(spark, d):
    """Events once per user and type: the deduplication of the watcher, in batch."""
    e = t(spark, d, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("sessionId"), F.lit("x").alias("timestamp"))
    return prompts.drop_repeated(e).select(F.col("project").alias("user_id"), F.col("sessionId").alias("event_type"))


_MODELS = "('ollama (llama3.2)'), ('Ollama (Llama3:8b-instruct)'), ('ollama (llama3:70b)'), ('Anthropic'), ('claude (x) (y)'), ('google gemini'), ('gemini ()'), ('qwen2.5:14b'), ('my mixtral build'), ('other')"
_STRATEGY = "CASE " + " ".join(f"WHEN m = {q(k)} THEN {q(v)}" for k, v in batching.MODELS.items()) + " " + " ".join(f"WHEN contains(m, {q(k)}) THEN {q(v)}" for k, v in batching.MODELS.items()) + " ELSE 'micro' END"


@query(
    rf"""WITH p AS (SELECT provider FROM (VALUES {_MODELS}) AS v(provider)), n AS (SELECT *, lower(provider) AS low, CASE WHEN regexp_matches(provider, '\([^)]+\)') THEN regexp_extract(provider, '\(([^)]+)\)', 1) ELSE provider END AS model FROM p),
    k AS (SELECT *, lower(model) AS m FROM n) SELECT provider, model, CASE WHEN contains(low, 'ollama') THEN 'ollama' WHEN contains(low, 'anthropic') OR contains(low, 'claude') THEN 'anthropic' WHEN contains(low, 'google') OR contains(low, 'gemini') THEN 'google' ELSE 'ollama' END AS kind, {_STRATEGY} AS strategy FROM k"""
)
def provider_models(spark, d):
    """Model, family and batch strategy of providers by their names."""
    names = spark.sql(f"SELECT provider FROM VALUES {_MODELS} AS v(provider)")
    named = names.withColumn("model", text.model_of(F.col("provider"))).withColumn("kind", text.provider_kind(F.col("provider")))
    return named.withColumn("strategy", batching.strategy_column(F.col("model")))


@query("SELECT (SELECT count(*) FROM documents) AS n, (SELECT list_sort(list_distinct(list(source))) FROM documents) AS projects, (SELECT list(short ORDER BY doc_id) FROM (SELECT doc_id, CASE WHEN length(text) <= 150 THEN text WHEN instr(substr(text, 1, 150), ' ') > 1 THEN regexp_extract(substr(text, 1, 150), '(?s)^(.*) ', 1) || '...' ELSE substr(text, 1, 150) || '...' END AS short FROM documents ORDER BY doc_id LIMIT 3)) AS sample")
def dry_run(spark, d):
    """What a run would analyse: number, projects, the first three prompts cut."""
    return prompts.dry_run(t(spark, d, "documents").select(F.col("doc_id").alias("timestamp"), F.col("text").alias("content"), F.col("source").alias("project")))


@query(f"SELECT id, name FROM {DIM} WHERE severity = 'high'")
def severe_patterns(spark, d):
    """The quiet filter."""
    return issues.only_severe(issues.taxonomy(spark)).select("id", "name")


@query(f"SELECT id, name FROM {DIM} WHERE contains(lower(id), 'context') OR contains(lower(name), 'context') OR contains(lower(id), 'vague') OR contains(lower(name), 'vague')")
def context_patterns(spark, d):
    """Patterns that speak of context or vagueness."""
    return issues.about_context(issues.taxonomy(spark)).select("id", "name")


@query(
    f"""WITH b AS (SELECT conv_id // 10 AS b, id, count(*)::DOUBLE AS f FROM ({FOUND}) GROUP BY ALL),
    m AS (SELECT id, CASE WHEN count(*) > 1 THEN floor(avg(f) + 0.5) ELSE min(f) END AS frequency, list(id || '#' || b ORDER BY b % 2, b)[1:3] AS examples FROM b GROUP BY id)
    SELECT id, frequency, severity, examples FROM m JOIN {DIM} USING (id) ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, frequency DESC, id LIMIT 5"""
)
def merge_with_cached(spark, d):
    """Cached batches, those of even number, before new ones, as one result."""
    b = _batches(spark, d)
    return issues.merge_with_cached(b.filter("pos % 2 = 0"), b.filter("pos % 2 = 1")).select("id", "frequency", "severity", "examples")


@query("SELECT id, conv_id // 10 AS batch FROM (" + FOUND + ") WHERE conv_id // 10 = 1 GROUP BY ALL")
def merge_single(spark, d):
    """One new batch without cached ones is left as it is, without limits."""
    b = _batches(spark, d)
    return issues.merge_with_cached(b.filter("false"), b.filter("pos = 1")).select("id", F.col("pos").alias("batch"))


_NOW = 1_700_000_000_000
_CACHED = ["o_orderkey % 500 AS key", "o_orderpriority AS model", "o_orderkey % 3 AS prompt_count", f"{_NOW} - (o_orderkey % 17) * 86400000 AS cached_at", "o_orderkey AS result"]
_CACHE = f"SELECT {', '.join(_CACHED)} FROM orders"


@query(f"WITH c AS ({_CACHE}), r AS (SELECT c_custkey AS ask, c_custkey % 500 AS key, '1-URGENT' AS model, c_custkey % 3 AS prompt_count FROM customer) SELECT ask, result FROM r JOIN c ON r.key = c.key AND r.model = c.model AND r.prompt_count = c.prompt_count AND {_NOW} - cached_at <= {store.TTL_MS}")
def fresh_batches(spark, d):
    """Requests with a cached result of the same key, model and number that isn't too old."""
    asked = t(spark, d, "customer").selectExpr("c_custkey ask", "c_custkey % 500 key", "'1-URGENT' model", "c_custkey % 3 prompt_count")
    return store.fresh_batches(asked, t(spark, d, "orders").selectExpr(*_CACHED), _NOW).select("ask", "result")


@query(f"SELECT key, max(cached_at) AS cached_at, count(*) FILTER ({_NOW} - cached_at <= {store.TTL_MS}) AS live FROM ({_CACHE}) GROUP BY key")
def cache_entries(spark, d):
    """The newest entry of each key, and how many are within their time to live."""
    c = t(spark, d, "orders").selectExpr(*_CACHED)
    live = store.unexpired(c, _NOW).groupBy("key").agg(F.count("*").alias("live"))
    return store.newest(c).select("key", "cached_at").join(live, "key", "left").select("key", "cached_at", F.coalesce("live", F.lit(0)).alias("live"))


@query(r"SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - 7 AS VARCHAR) AS week, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS month FROM orders")
def days_before(spark, d):
    """A week and a month before each order."""
    day = F.to_date("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", compare.week_ago(day).cast("string").alias("week"), compare.month_ago(day).cast("string").alias("month"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') END AS date, event_type AS project, event_type AS other FROM events")
def days_and_projects(spark, d):
    """Days of times as text, and projects of paths."""
    e = t(spark, d, "events")
    stamp = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("no time "), F.col("event_id").cast("string"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    inside, alone = F.concat(F.lit("/home/projects/"), "event_type", F.lit("/projects/x.jsonl")), F.concat(F.lit("/logs/"), "event_type", F.lit(".jsonl"))
    return e.select("event_id", text.extract_date(stamp).alias("date"), text.project_of(inside).alias("project"), text.project_of(alone).alias("other"))


@query(f"SELECT id, CASE severity WHEN 'high' THEN '🔴' WHEN 'medium' THEN '🟡' ELSE '🟢' END AS icon FROM {DIM}")
def severity_icons(spark, d):
    """The mark of each issue."""
    return issues.taxonomy(spark).select("id", text.severity_icon(F.col("severity")).alias("icon"))


@query(
    f"""WITH s AS ({SQL["specificity"]}), l AS ({SQL["lexical_complexity"]}), f AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20), w AS (SELECT *, {TRIM} AS t FROM documents)
    SELECT (SELECT count(*) FROM documents) AS total, (SELECT {rnd("avg(overall)", 1)} FROM s JOIN f USING (doc_id)) AS specificity, (SELECT list(overall ORDER BY doc_id) FROM s JOIN f USING (doc_id)) AS scores,
    (SELECT {rnd("avg(unique_ratio)", 3)} FROM l JOIN f USING (doc_id)) AS complexity, (SELECT {rnd(f"avg({WORDS})", 1)} FROM w) AS words, (SELECT count(*) * 100 FROM documents) AS tokens"""
)
def enhanced_statistics(spark, d):
    """Specificity and complexity of the first twenty documents, words of all."""
    return enhanced.statistics(t(spark, d, "documents"), "text", ["doc_id"])


@query("SELECT * FROM (" + SQL["trend"] + ") WHERE n >= 2")
def trend_of_history(spark, d):
    """The trend that enriches a result, if history has two entries."""
    found = enhanced.trend_of(daily(spark, d), "date", "score")
    return found.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "r2")} | {"last_day": F.col("last_day").cast("string")})


@query("SELECT label AS cluster, count(*) AS n, min(vec_id) AS first_seen, list(vec_id ORDER BY vec_id) AS members FROM embeddings GROUP BY label")
def clusters_of_labels(spark, d):
    """Clusters with their members, by first appearance."""
    return clustering.clusters(t(spark, d, "embeddings"), "label", "vec_id").withColumnRenamed("label", "cluster")
