"""From validated log lines to prompts: filters, projection, order and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_date, js_trim, truncate_text


def user_messages(lines: DataFrame) -> DataFrame:
    """Lines typed 'user' by a 'user', with content that isn't blank."""
    return lines.filter((F.col("type") == "user") & (F.col("message.role") == "user") & (js_trim(F.col("message.content")) != ""))


def to_prompts(lines: DataFrame) -> DataFrame:
    """(content, timestamp, sessionId, project, date); project is a column of lines."""
    return lines.select(F.col("message.content").alias("content"), "timestamp", "sessionId", "project", extract_date(F.col("timestamp")).alias("date"))


def on_date(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Rows of one day of the session's time zone; a range on ts, so that it reaches the scan. Invalid times are dropped."""
    t = df[ts] if dict(df.dtypes)[ts].startswith("timestamp") else F.try_to_timestamp(df[ts])
    return df.filter((t >= F.to_timestamp(F.lit(day))) & (t < F.to_timestamp(F.date_add(F.lit(day).cast("date"), 1))))


def in_range(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Rows from first to last, both included; none if first is after last."""
    t = df[ts] if dict(df.dtypes)[ts].startswith("timestamp") else F.try_to_timestamp(df[ts])
    return df.filter((t >= F.to_timestamp(F.lit(first))) & (t < F.to_timestamp(F.date_add(F.lit(last).cast("date"), 1))))


def of_project(df: DataFrame, name: str, column: str = "project", case_sensitive: bool = False) -> DataFrame:
    """Rows whose project contains the name; case counts in the watcher alone."""
    if case_sensitive:
        return df.filter(F.col(column).contains(name))
    return df.filter(F.lower(column).contains(name.strip().lower()))


def by_day(prompts: DataFrame, day: Column | str = "date", project: Column | str = "project", order: list[str] | None = None) -> DataFrame:
    """(date, n, prompts in order, sorted distinct projects) per day. A day's prompts make one row: for reports."""
    order = order or ["timestamp"]
    item = F.struct(*order, *[c for c in ("content", "sessionId") if c in prompts.columns])
    day = F.col(day) if isinstance(day, str) else day
    project = F.col(project) if isinstance(project, str) else project
    return prompts.groupBy(day.alias("date")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("prompts"), F.sort_array(F.collect_set(project)).alias("projects"))


def dry_run(prompts: DataFrame) -> DataFrame:
    """One row: number of prompts, sorted projects, the first three prompts cut to 150 characters."""
    first = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("timestamp", "content"))), 1, 3), lambda p: truncate_text(p["content"], 150))
    few = prompts.orderBy("timestamp", "content").limit(3).agg(first.alias("sample"))
    return prompts.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("project")).alias("projects")).crossJoin(few)


def drop_repeated(events: DataFrame) -> DataFrame:
    """First event of each (project, sessionId, timestamp)."""
    return events.dropDuplicates(["project", "sessionId", "timestamp"])
