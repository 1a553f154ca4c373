"""Reports of collected results: text, Markdown, JSON, ASCII charts; and their files."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import histogram

ICONS = {"high": "🔴", "medium": "🟡", "low": "🟢"}


def grade(score: float) -> str:
    """green from 8 on, yellow from 6 on, else red."""
    return "green" if score >= 8 else "yellow" if score >= 6 else "red"


def delta_mark(delta: float) -> str:
    """Arrow and signed change."""
    return f"{'↑' if delta > 0 else '↓' if delta < 0 else '→'} {delta:+.1f}"


def collect_result(patterns: DataFrame, totals: DataFrame, date: str) -> dict:
    """One result as a dict; patterns are at most five rows."""
    order = "rank" if "rank" in patterns.columns else "first_seen"
    keep = [c for c in ("id", "name", "frequency", "severity", "examples", "suggestion", "before", "after") if c in patterns.columns]
    rows = [r.asDict(recursive=True) for r in patterns.orderBy(order).select(*keep).collect()]
    t = totals.first()
    stats = t.asDict() if t else {"total_prompts": 0, "prompts_with_issues": 0, "overall_score": 0.0}
    return {"date": date, "patterns": rows, "stats": {k: stats[k] for k in ("total_prompts", "prompts_with_issues", "overall_score")}, "top_suggestion": rows[0]["suggestion"] if rows else "Your prompts look good!"}


def as_json(result: object, compact: bool = False) -> str:
    """JSON, indented by two unless compact."""
    return json.dumps(result, ensure_ascii=False, default=str, **({"separators": (",", ":")} if compact else {"indent": 2}))


def as_markdown(result: dict) -> str:
    """Report of one result."""
    s = result["stats"]
    out = [f"# Prompts of {result['date']}", "", "| | |", "|-|-|", f"| Prompts | {s['total_prompts']} |", f"| With issues | {s['prompts_with_issues']} |", f"| Score | {s['overall_score']:.1f} / 10 |", ""]
    for p in result["patterns"]:
        out += [f"## {ICONS[p['severity']]} {p['name']} ({p['frequency']:g})", "", p["suggestion"], ""]
        out += [f"- `{e}`" for e in p.get("examples") or []]
        if p.get("before"):
            out += ["", f"Before: {p['before']}", "", f"After: {p['after']}"]
        out.append("")
    return "\n".join([*out, f"**{result['top_suggestion']}**", ""])


def as_text(result: dict, width: int = 72) -> str:
    """Report for a terminal, without colours."""
    s = result["stats"]
    line = "-" * width
    out = [line, f"Prompts of {result['date']}", line, f"{s['total_prompts']} prompts, {s['prompts_with_issues']} with issues, score {s['overall_score']:.1f} ({grade(s['overall_score'])})", ""]
    for p in result["patterns"]:
        out += [f"{ICONS[p['severity']]} {p['name']} x{p['frequency']:g}", f"   {p['suggestion']}"] + [f"   > {shorten(e, width - 5)}" for e in (p.get("examples") or [])[:3]]
    return "\n".join([*out, "", result["top_suggestion"]])


def comparison_markdown(changes: list[dict], before: float, after: float) -> str:
    """Report of compare_patterns rows and the scores of both days."""
    out = ["# Comparison", "", f"Score {before:.1f} -> {after:.1f} ({delta_mark(after - before)})", ""]
    for title, status in (("New", "new"), ("Resolved", "resolved"), ("Changed", "changed")):
        some = [c for c in changes if c["status"] == status]
        if some:
            out += [f"## {title}", ""] + [f"- {c['name']}: {c['before_frequency'] or 0} -> {c['after_frequency'] or 0}" for c in some] + [""]
    return "\n".join(out)


def history_lines(rows: list[dict]) -> str:
    """One line per history entry."""
    return "\n".join(f"{r['date']}  {r['score']:.1f}  {r['prompts']} prompts" for r in rows) or "No history yet"


def rules_lines(rows: list[dict]) -> str:
    """One line per rule."""
    return "\n".join(f"{'on ' if r['enabled'] else 'off'} {ICONS[r['severity']]} {r['id']}: {r['name']}{' *' if r['overridden'] else ''}" for r in rows)


def shorten(s: str, most: int) -> str:
    """At most so many characters, cut at the last space, with three dots."""
    if len(s) <= most:
        return s
    head = s[:most]
    return (head[: head.rfind(" ")] if head.rfind(" ") > 0 else head) + "..."


def write_atomic(path: str, text: str) -> None:
    """Write a report file by way of a temporary one beside it; folders are made."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, tmp = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, target)


def path_for(base: str, date: str | None = None) -> str:
    """report.md -> report-2024-01-01.md."""
    if not date:
        return base
    p = Path(base)
    return str(p.with_name(f"{p.stem}-{date}{p.suffix}"))


def write_result(path: str, result: dict | list[dict], kind: str = "md", compact: bool = False) -> None:
    """One file of a result; several results make one JSON array, or one Markdown file a day."""
    if kind == "json":
        write_atomic(path, as_json(result, compact))
    elif isinstance(result, list):
        for r in result:
            write_atomic(path_for(path, r["date"]), as_markdown(r))
    else:
        write_atomic(path, as_markdown(result))


def bar_chart(rows: list[tuple[str, float]], width: int = 40) -> str:
    """A bar per label."""
    top = max((v for _, v in rows), default=0) or 1
    pad = max((len(k) for k, _ in rows), default=0)
    return "\n".join(f"{k:<{pad}} |{'█' * round(v / top * width)} {v:g}" for k, v in rows)


def line_chart(values: list[float], height: int = 8) -> str:
    """A dot per value."""
    if not values:
        return "(no data)"
    lo, hi = min(values), max(values)
    at = [round((v - lo) / (hi - lo) * (height - 1)) if hi > lo else 0 for v in values]
    return "\n".join(f"{lo + (hi - lo) * r / (height - 1 or 1):8.2f} |" + "".join("•" if a == r else " " for a in at) for r in range(height - 1, -1, -1))


def histogram_chart(df: DataFrame, column: str, bins: int = 10) -> str:
    """Histogram of the real values."""
    rows = histogram(df, column, bins).orderBy("bin").collect()
    return bar_chart([(f"{r['lower']:.1f}", float(r["n"])) for r in rows])


def trend_chart(series: DataFrame, day: str, score: str) -> str:
    """Line of daily scores in order of day."""
    return line_chart([float(r[score]) for r in series.orderBy(day).collect()])


def stats_lines(described: dict) -> str:
    """Descriptive statistics, one per line."""
    return "\n".join(f"{k:<12} {v:.3f}" for k, v in described.items() if isinstance(v, int | float))


def trend_lines(fit: dict) -> str:
    """A trend in words."""
    return f"{fit['direction']} by {fit['slope']:+.3f} a day (r2 {fit['r2']:.2f}, confidence {fit['confidence']})"


def cluster_lines(rows: list[dict]) -> str:
    """One line per cluster."""
    return "\n".join(f"{r['label']}: {r['n']} prompts, e.g. {shorten(r['representative'], 60)}" for r in rows)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON text, in the cluster."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
