"""Command line: python -m quillspark.cli analyze LOGS --date 2025-01-20 --format md --output report.md

With --history, results of analyze are kept by day, and history and compare read them. With --results, prompts with
a stored result aren't analysed again, and watch, which follows the logs, needs it.
"""

from __future__ import annotations

import argparse
import os
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.compare import compare_patterns
from .operators.issues import apply_rules, only_severe, rules_list
from .operators.prompts import dry_run
from .plans import report
from .plans.pipeline import analyze, keyed
from .plans.provider import create_provider, first_available, services
from .schemas import RULES
from .sources import config, store
from .sources.logs import exists, list_projects, read_logs, read_warnings
from .sources.store import misses
from .streaming.watch import watch

OK, ERROR, NO_DATA, NO_PROVIDER = 0, 1, 2, 3


def resolve(day: str, today: date | None = None) -> str:
    """'today', 'yesterday' or an ISO date, as an ISO date."""
    today = today or date.today()
    named = {"today": today, "yesterday": today - timedelta(days=1)}
    return (named.get(day.strip().lower()) or date.fromisoformat(day.strip())).isoformat()


def parser() -> argparse.ArgumentParser:
    """Arguments."""
    p = argparse.ArgumentParser(prog="quillspark")
    p.add_argument("command", choices=["analyze", "projects", "rules", "dry-run", "history", "compare", "watch"])
    p.add_argument("logs", nargs="?", default="")
    p.add_argument("--date")
    p.add_argument("--from", dest="first")
    p.add_argument("--to", dest="last")
    p.add_argument("--project")
    p.add_argument("--format", choices=["text", "md", "json"], default="text")
    p.add_argument("--output")
    p.add_argument("--compact", action="store_true")
    p.add_argument("--history", help="folder of the history")
    p.add_argument("--results", help="folder of the results by prompt")
    p.add_argument("--provider", help="with history: of this provider")
    p.add_argument("--min-score", type=float)
    p.add_argument("--max-score", type=float)
    p.add_argument("--quiet", action="store_true", help="with watch: severe patterns alone")
    p.add_argument("--seconds", type=float, help="with watch: end after so many")
    return p


def conflicts(a: argparse.Namespace) -> list[str]:
    """What doesn't go together."""
    out = []
    if a.date and (a.first or a.last):
        out.append("--date excludes --from and --to")
    if bool(a.first) != bool(a.last):
        out.append("--from and --to come together")
    if a.compact and a.format != "json":
        out.append("--compact needs --format json")
    if a.command not in ("rules", "history", "compare") and not a.logs:
        out.append("the folder of the logs is missing")
    if a.command in ("history", "compare") and not a.history:
        out.append(f"{a.command} needs --history")
    if a.command == "compare" and not (a.first and a.last):
        out.append("compare needs --from and --to")
    if a.command == "watch":
        out += [f"watch excludes --{k}" for k, v in (("date", a.date), ("from", a.first), ("to", a.last), ("output", a.output)) if v]
        out += [] if a.results else ["watch needs --results"]
    if a.command != "watch" and (a.quiet or a.seconds is not None):
        out.append("--quiet and --seconds are for watch")
    if a.command != "history" and (a.provider or a.min_score is not None or a.max_score is not None):
        out.append("--provider, --min-score and --max-score are for history")
    return out


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Results by prompt."""
    return spark.read.schema("hash string, date string").parquet(path)


def compare(spark: SparkSession, a: argparse.Namespace) -> int:
    """Changes between two days of history."""
    days = [store.load_history(spark, a.history, resolve(x)) for x in (a.first, a.last)]
    scores = [d.select("score").first() for d in days]
    if None in scores:
        print("No entry of " + " and ".join(x for x, s in zip((a.first, a.last), scores) if s is None))
        return NO_DATA
    changes = compare_patterns(*(d.select(F.explode("patterns").alias("p")).select("p.*") for d in days))
    print(report.comparison_markdown([r.asDict() for r in changes.orderBy("status", "id").collect()], scores[0][0], scores[1][0]))
    return OK


def follow(spark: SparkSession, a: argparse.Namespace, context: dict | None, rules: DataFrame) -> int:
    """Watch the logs until interrupted, or for --seconds."""
    try:
        provider = first_available([create_provider(s) for s in services() or ["offline"]])
    except RuntimeError as e:
        print(e)
        return NO_PROVIDER

    def analyse(batch: DataFrame) -> DataFrame:
        batch = batch.persist()
        patterns = apply_rules(analyze(batch, provider, context=context)[0], rules)
        for r in (only_severe(patterns) if a.quiet else patterns).orderBy("date", "rank").collect():
            print(f"{r.date} {r.severity}: {r.name}", flush=True)
        return batch.select("hash", "date").distinct()

    query = watch(spark, a.logs, analyse, lambda: stored(spark, a.results) if exists(spark, a.results) else None, lambda d: store.save_results(d, a.results), a.results.rstrip("/") + ".checkpoint", a.project, lambda d: keyed(d, provider.name))
    try:
        query.awaitTermination(a.seconds) if a.seconds is not None else query.awaitTermination()
    except KeyboardInterrupt:
        pass
    query.stop()
    return OK


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; the exit code."""
    a = parser().parse_args(argv)
    wrong = conflicts(a)
    if wrong:
        print("\n".join(wrong))
        return ERROR
    spark = spark or SparkSession.builder.appName("quillspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    own, warnings = config.load_for(os.getcwd())
    merged = config.merge(config.from_environment(), own)
    rules = spark.createDataFrame(config.rule_rows(merged.rules), RULES)
    if a.command == "rules":
        print(report.rules_lines([r.asDict() for r in rules_list(rules).orderBy("ord").collect()]))
        return OK
    if a.command == "history":
        print("\n".join(store.broken_history(spark, a.history)), end="")
        found = store.list_history(store.read_history(spark, a.history), a.provider, a.project, a.min_score, a.max_score)
        print(report.history_lines([r.asDict() for r in found.select("date", "score", "prompts").collect()]))
        return OK
    if a.command == "compare":
        return compare(spark, a)
    for w in [*warnings, *read_warnings(spark, a.logs, a.first, a.last)]:
        print(w)
    context = merged.context or None
    if a.command == "watch":
        return follow(spark, a, context, rules)
    if a.command == "projects":
        print("\n".join(list_projects(spark, a.logs)))
        return OK
    first, last = (resolve(a.first), resolve(a.last)) if a.first else (None, None)
    prompts, rejects = read_logs(spark, a.logs, resolve(a.date) if a.date else None, first, last, a.project)
    for r in rejects.collect():
        print(f"{r.path}: {r.rejected} lines left out")
    if a.command == "dry-run":
        r = dry_run(prompts).first()
        print("\n".join([f"{r.n} prompts" if r else "No prompts", *([f"Projects: {', '.join(r.projects)}", *(f"- {x}" for x in r.sample)] if r else [])]))
        return OK
    if not prompts.limit(1).count():
        print("No prompts")
        return NO_DATA
    try:
        provider = first_available([create_provider(s) for s in services() or ["offline"]])
    except RuntimeError as e:
        print(e)
        return NO_PROVIDER
    if a.results:
        keyed_prompts = keyed(prompts, provider.name)
        prompts = misses(keyed_prompts, stored(spark, a.results)) if exists(spark, a.results) else keyed_prompts
        if not prompts.limit(1).count():
            print("All prompts are analysed")
            return OK
    patterns, totals = analyze(prompts, provider, context=context)
    patterns, totals = patterns.cache(), totals.cache()
    if a.results:
        store.save_results(prompts.select("hash", "date").distinct(), a.results)
    if a.history:
        store.save_history(store.entries(patterns, totals, prompts, provider.name), a.history)
    days = [r.date for r in totals.select("date").orderBy("date").collect()]
    results = [report.collect_result(apply_rules(patterns.filter(patterns.date == d), rules), totals.filter(totals.date == d), d) for d in days]
    if a.output:
        report.write_result(a.output, results if len(results) > 1 else results[0], "json" if a.format == "json" else "md", a.compact)
    else:
        show = {"text": report.as_text, "md": report.as_markdown, "json": lambda r: report.as_json(r, a.compact)}[a.format]
        print("\n".join(map(show, results)))
    return OK


if __name__ == "__main__":
    raise SystemExit(main())
