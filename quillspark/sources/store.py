"""Stored results: history by day, results by prompt, results by batch. Parquet, partitioned by date where there is one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import sanitize
from ..schemas import ALL_GOOD
from .logs import exists

TTL_MS = 7 * 24 * 3600 * 1000


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the folder in spark.checkpoint.dir and read from there, so that what made it isn't run again.

    Where the setting is unset, a temporary folder serves if the master is local; a cluster must name a shared one.
    """
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_history(entries: DataFrame, path: str) -> None:
    """Write entries (date, provider, prompts, projects, score, patterns, top_suggestion), each date in place of what it had; examples are redacted again first.

    patterns is an array of structs with an array field examples.
    """
    fields = [f.name for f in entries.schema["patterns"].dataType.elementType.fields]
    clean = F.transform("patterns", lambda p: F.struct(*((F.transform(p["examples"], sanitize) if n == "examples" else p[n]).alias(n) for n in fields)))
    _overwrite(entries.withColumn("patterns", clean), path)


def _overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


_PATTERN = "struct<id:string,name:string,frequency:double,severity:string,examples:array<string>,suggestion:string,before:string,after:string>"
HISTORY = f"provider string, prompts long, projects array<string>, score double, patterns array<{_PATTERN}>, top_suggestion string, date date"


def entries(patterns: DataFrame, totals: DataFrame, prompts: DataFrame, provider: str) -> DataFrame:
    """Entries of history from patterns, totals and prompts by day; a day's patterns in their order, which are five at most."""
    at = ["rank", *(c for c in ("id", "name", "frequency", "severity", "examples", "suggestion", "before", "after"))]
    item = F.struct(*(F.col(c) if c in patterns.columns else F.lit(None).cast("string").alias(c) for c in at))
    found = patterns.groupBy("date").agg(F.transform(F.sort_array(F.collect_list(item)), lambda p: F.struct(*(p[c].cast("double").alias(c) if c == "frequency" else p[c].alias(c) for c in at[1:]))).alias("patterns"))
    places = prompts.groupBy("date").agg(F.sort_array(F.collect_set("project")).alias("projects"))
    out = totals.join(found, "date", "left").join(places, "date", "left")
    none = F.array().cast(f"array<{_PATTERN}>")
    out = out.select(F.lit(provider).alias("provider"), F.col("total_prompts").alias("prompts"), F.coalesce("projects", F.array().cast("array<string>")).alias("projects"), F.col("overall_score").alias("score"), F.coalesce("patterns", none).alias("patterns"), F.col("date").cast("date").alias("date"))
    return out.withColumn("top_suggestion", F.coalesce(F.try_element_at("patterns", F.lit(1))["suggestion"], F.lit(ALL_GOOD)))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All entries that are whole; those without a provider, a score or patterns are left out. A missing store has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).parquet(path).filter("provider is not null and score is not null and patterns is not null and date is not null")


def broken_history(spark: SparkSession, path: str) -> list[str]:
    """Warnings for days whose entry isn't whole."""
    if not exists(spark, path):
        return []
    bad = spark.read.schema(HISTORY).parquet(path).filter("provider is null or score is null or patterns is null").select(F.col("date").cast("string")).distinct().orderBy("date")
    return [f"the entry of {r.date} is not whole and is left out" for r in bad.limit(100).collect()]


def load_history(spark: SparkSession, path: str, date: str) -> DataFrame:
    """Entry of one day: a read of its partition alone; no row if it is missing or not whole."""
    return read_history(spark, path).filter(F.col("date") == F.lit(date).cast("date"))


def list_history(history: DataFrame, provider: str | None = None, project: str | None = None, min_score: float | None = None, max_score: float | None = None) -> DataFrame:
    """Entries with proper dates, newest first; the project is part of a name, whatever its case."""
    out = history.filter(F.col("date").cast("string").rlike(r"^[0-9]{4}(?:-[0-9]{2}){2}$"))
    if provider is not None:
        out = out.filter(F.col("provider") == provider)
    if project is not None:
        out = out.filter(F.exists("projects", lambda p: F.lower(p).contains(project.lower())))
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    if max_score is not None:
        out = out.filter(F.col("score") <= max_score)
    return out.orderBy(F.desc("date"))


def hits(prompts: DataFrame, results: DataFrame, key: str = "hash", text: str | None = None) -> DataFrame:
    """Prompts that have a stored result; equal contents once."""
    out = prompts.join(results.select(key).distinct(), key, "left_semi")
    return out.dropDuplicates([text]) if text else out


def misses(prompts: DataFrame, results: DataFrame, key: str = "hash") -> DataFrame:
    """Prompts without a stored result, repeated ones as often as they come."""
    return prompts.join(results.select(key), key, "left_anti")


def hit_rate(prompts: DataFrame, results: DataFrame, key: str = "hash") -> DataFrame:
    """(hits, total, rate): rate in percent to one place."""
    known = results.select(key).distinct().withColumn("_hit", F.lit(1))
    both = prompts.join(known, key, "left")
    n, h = F.count("*"), F.count("_hit")
    return both.agg(h.alias("hits"), n.alias("total"), F.coalesce(F.floor(F.try_divide(h * 100.0, n) * 10 + 0.5) / 10, F.lit(0.0)).alias("rate"))


def save_results(results: DataFrame, path: str) -> None:
    """Add results per prompt (hash, date, ...) to the partitions of their dates."""
    results.write.mode("append").partitionBy("date").parquet(path)


def fresh_batches(requests: DataFrame, cache: DataFrame, now_ms: int, ttl_ms: int = TTL_MS) -> DataFrame:
    """Requests (key, model, prompt_count) with the cached result that has the same key, model and count and isn't too old."""
    c = cache.select("key", F.col("model").alias("_m"), F.col("prompt_count").alias("_n"), "cached_at", "result")
    live = (F.lit(now_ms) - F.col("cached_at") <= ttl_ms) & (F.col("_m") == F.col("model")) & (F.col("_n") == F.col("prompt_count"))
    return requests.join(c, "key").filter(live).drop("_m", "_n")


def save_batches(entries: DataFrame, path: str) -> None:
    """Add entries (key, model, prompt_count, cached_at, system_hash, result) to the cache; of one key, readers take the newest."""
    entries.write.mode("append").parquet(path)


def newest(cache: DataFrame) -> DataFrame:
    """One entry per key, the newest."""
    return cache.groupBy("key").agg(F.max_by(F.struct(*[c for c in cache.columns if c != "key"]), "cached_at").alias("e")).select("key", "e.*")


def unexpired(cache: DataFrame, now_ms: int, ttl_ms: int = TTL_MS) -> DataFrame:
    """Entries within their time to live."""
    return cache.filter(F.lit(now_ms) - F.col("cached_at") <= ttl_ms)


def of_system(cache: DataFrame, system_hash: str) -> DataFrame:
    """Entries made under the current instructions: with others the cache starts anew."""
    return cache.filter(F.col("system_hash") == system_hash)


def cleanup_results(spark: SparkSession, path: str, before: str) -> int:
    """Delete the partitions strictly before a date; how many there were."""
    if not exists(spark, path):
        return 0
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("date=") and s.getPath().getName()[5:] < before]
    for q in old:
        fs.delete(q, True)
    return len(old)


def clear(spark: SparkSession, path: str) -> None:
    """Delete a whole store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
