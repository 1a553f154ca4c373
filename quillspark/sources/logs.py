"""Log files of JSON lines: scan, strict validation, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import js_trim, project_of
from ..operators.prompts import in_range, of_project, on_date, to_prompts, user_messages
from ..schemas import PROMPT

SUPPORTED = ("1.0",)
_ROLES = ("user", "assistant", "system")


def _string_at(v: Column, path: str) -> Column:
    """The string at a path of a variant; null if it isn't one."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with parsed (type, message, timestamp, sessionId, cwd) and valid, schema_version.

    Types are checked as they are in the JSON: from_json would turn a number or an array into a string.
    """
    v = F.try_parse_json(value)
    f = {p: _string_at(F.col("_v"), f"$.{p}") for p in ("type", "message.role", "message.content", "timestamp", "sessionId", "cwd")}
    out = lines.withColumn("_v", v).withColumns({"_" + k.replace(".", "_"): c for k, c in f.items()})
    good = F.col("_type").isin(*_ROLES) & F.col("_message_role").isin(*_ROLES) & F.col("_message_content").isNotNull() & F.col("_timestamp").isNotNull() & F.col("_sessionId").isNotNull() & F.col("_cwd").isNotNull()
    good = F.coalesce(good, F.lit(False))
    parsed = F.struct(F.col("_type").alias("type"), F.struct(F.col("_message_role").alias("role"), F.col("_message_content").alias("content")).alias("message"), F.col("_timestamp").alias("timestamp"), F.col("_sessionId").alias("sessionId"), F.col("_cwd").alias("cwd"))
    out = out.withColumns({"valid": good, "schema_version": F.when(good, F.lit("1.0")), "parsed": F.when(good, parsed)})
    return out.drop("_v", *("_" + k.replace(".", "_") for k in f))


def schema_supported(version: str | None) -> bool:
    """Whether entries of that version can be read."""
    return version in SUPPORTED


def schema_warning(version: str | None) -> str | None:
    """What to say of a version that cannot be read."""
    return None if schema_supported(version) else f"Unsupported log schema {version or '(none found)'}; supported: {', '.join(SUPPORTED)}"


def scan(spark: SparkSession, base: str) -> DataFrame:
    """(value, path, project) of all lines of all .jsonl files below base; no rows if there are none."""
    if not exists(spark, base) or not _any_file(spark, base):
        return spark.createDataFrame([], "value string, path string, project string")
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("ignoreMissingFiles", True).text(base)
    return text.select("value", F.col("_metadata.file_path").alias("path")).withColumn("project", project_of(F.col("path")))


def read_logs(spark: SparkSession, base: str, date: str | None = None, first: str | None = None, last: str | None = None, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(prompts in order of time, rejects per file). Blank lines are no rejects."""
    lines = parse_lines(scan(spark, base).filter(js_trim(F.col("value")) != ""))
    rejects = lines.groupBy("path").agg(F.count_if(~F.col("valid")).alias("rejected")).filter("rejected > 0")
    prompts = to_prompts(user_messages(lines.filter("valid").select("parsed.*", "project")))
    if date:
        prompts = on_date(prompts, "timestamp", date)
    if first and last:
        prompts = in_range(prompts, "timestamp", first, last)
    if project:
        prompts = of_project(prompts, project)
    return prompts.orderBy(F.try_to_timestamp("timestamp"), "sessionId", "content"), rejects


def read_warnings(spark: SparkSession, base: str, first: str | None = None, last: str | None = None) -> list[str]:
    """What is wrong with a scan before it begins."""
    out = []
    if not exists(spark, base):
        out.append(f"No log folder at {base}")
    elif not _any_file(spark, base):
        out.append(f"No .jsonl files below {base}")
    if first and last and first > last:
        out.append(f"The range begins ({first}) after it ends ({last})")
    return out


def list_projects(spark: SparkSession, base: str) -> list[str]:
    """Folders of base that aren't hidden, sorted."""
    if not exists(spark, base):
        return []
    fs, path = _fs(spark, base)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and not s.getPath().getName().startswith("."))


def exists(spark: SparkSession, base: str) -> bool:
    """Whether the folder is there."""
    fs, path = _fs(spark, base)
    return fs.exists(path)


def _fs(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _any_file(spark: SparkSession, base: str) -> bool:
    fs, path = _fs(spark, base)
    found = fs.listFiles(path, True)
    while found.hasNext():
        if found.next().getPath().getName().endswith(".jsonl"):
            return True
    return False


def empty_prompts(spark: SparkSession) -> DataFrame:
    """Prompts without rows."""
    return spark.createDataFrame([], PROMPT)
