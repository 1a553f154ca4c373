"""Watch mode: new prompts are parsed as in batch, deduplicated, looked up, analysed and stored."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import js_trim, project_of
from ..operators.prompts import of_project, to_prompts, user_messages
from ..sources.logs import parse_lines
from ..sources.store import misses
from .tail import TailSource

_LOG = logging.getLogger(__name__)


def events(lines: DataFrame, project: str | None = None) -> DataFrame:
    """Prompts of streamed lines (value, path); here the project's name is matched with its case."""
    parsed = parse_lines(lines.filter(js_trim(F.col("value")) != "")).withColumn("project", project_of(F.col("path")))
    out = to_prompts(user_messages(parsed.filter("valid").select("parsed.*", "project")))
    return of_project(out, project, case_sensitive=True) if project else out


def deduplicated(prompts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First event of each (project, sessionId, timestamp) within the delay; state is dropped beyond it."""
    return prompts.withColumn("ts", F.try_to_timestamp("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["project", "sessionId", "timestamp"])


def tail(spark: SparkSession, base: str) -> DataFrame:
    """Stream of the lines appended below base."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail_jsonl").load(base)


def watch(spark: SparkSession, base: str, analyse: Callable[[DataFrame], DataFrame], results: Callable[[], DataFrame | None], save: Callable[[DataFrame], None], checkpoint: str, project: str | None = None, key: Callable[[DataFrame], DataFrame] | None = None, interval: str = "500 milliseconds", on_error: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """Start watching. Each micro-batch: keys are added, prompts with a stored result left out, the rest analysed and saved.

    An error in one batch is logged, on_error hears of it with the number of the batch, and the next batch goes on; its prompts are
    not asked for again.
    """
    stream = deduplicated(events(tail(spark, base), project))

    def each(batch: DataFrame, number: int) -> None:
        try:
            rows = key(batch) if key else batch
            known = results()
            new = misses(rows, known) if known is not None else rows
            if new.limit(1).count():
                save(analyse(new))
        except Exception as e:
            _LOG.exception("batch %d failed", number)
            if on_error:
                on_error(number, e)

    return stream.writeStream.foreachBatch(each).trigger(processingTime=interval).option("checkpointLocation", checkpoint).start()
