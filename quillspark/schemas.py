"""Types of the data model, and the dimension rows of the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LOG_LINE = "type string, message struct<role:string,content:string>, timestamp string, sessionId string, cwd string"
PROMPT = "content string, timestamp string, sessionId string, project string, date string"
PATTERN = "struct<id:string,name:string,frequency:double,severity:string,examples:array<string>,suggestion:string,beforeAfter:struct<before:string,after:string>>"
RESULT = f"date string, patterns array<{PATTERN}>, stats struct<totalPrompts:bigint,promptsWithIssues:bigint,overallScore:double>, topSuggestion string"
HISTORY = f"result struct<date:string,patterns:array<{PATTERN}>,stats:struct<totalPrompts:bigint,promptsWithIssues:bigint,overallScore:double>,topSuggestion:string>, metadata struct<provider:string,promptCount:bigint,projects:array<string>>"
RULES = "id string, enabled boolean, severity string"
FLAT_PATTERN = "id string, name string, frequency double, severity string, examples array<string>, suggestion string, before string, after string"

ALL_GOOD = "Your prompts look good!"
MAX_PATTERNS, MAX_EXAMPLES = 5, 3

#: id, name, severity, suggestion, example before, example after, in the order of the taxonomy.
TAXONOMY = [
    ("vague", "Vague Request", "high", "Say exactly what is wanted: name the functions, files, messages or behaviour", "Help with my project", "Find out why parse_row() in loader.py drops the last column of quoted lines"),
    ("no-context", "Missing Context", "high", "Give the background: where the code lives, what was seen and what was tried", "Please fix it", "Fix the redirect loop in session.py that begins when the cookie has expired"),
    ("too-broad", "Too Broad", "medium", "Ask for one thing at a time, or put the parts in order", "Make a shop with login, search and payment", "Write the form that takes an address and checks the postal code"),
    ("no-goal", "No Clear Goal", "high", "Say what the result should be and how to tell that it is right", "See this module", "Check export.py for rows that are written twice and list them"),
    ("imperative", "Command Without Context", "low", "Add why it is needed and where it will be used", "Add a field", "Add a 'country' field to the order form, since taxes depend on it"),
    ("missing-technical-details", "Missing Technical Details", "medium", "Add paths, signatures, messages, traces or pieces of code", "It stops now and then", "read_block() in disk.py stops with 'unexpected end' on files over 2 GB"),
    ("unclear-priorities", "Unclear Priorities", "low", "Number the requests, or ask them one by one", "Do the tests and the docs and also the release", "First write the tests; after that update the docs; the release comes last"),
    ("insufficient-constraints", "Insufficient Constraints", "low", "State limits: edge cases, speed, what must stay compatible", "Make the page better", "Bring the page under 200 ms for 1000 rows without changing its address"),
]
#: Categories of single-prompt analysis: id, name, severity, suggestion.
CATEGORIES = [
    ("vague-request", "Vague Request", "high", "Name the functions, the files and the exact fault"),
    ("missing-context", "Missing Context", "high", "Give paths, names, messages or code"),
    ("too-broad", "Too Broad", "medium", "One task at a time, each small enough to check"),
    ("unclear-goal", "Unclear Goal", "high", "Say what success looks like"),
    ("other", "Other Issues", "low", "Read the prompt again for clarity"),
]
DEFAULT_SUGGESTION = "Review this pattern"
DEFAULT_CATEGORY_SUGGESTION = "Improve prompt quality"

#: Strategy -> (tokens, prompts) per batch.
STRATEGIES = {"micro": (500, 3), "small": (1500, 10), "standard": (3000, 50)}
PROMPT_OVERHEAD = 2000


def taxonomy(spark: SparkSession) -> DataFrame:
    """The eight issues, small enough to broadcast whatever the data."""
    rows = [(i, *r) for i, r in enumerate(TAXONOMY)]
    return spark.createDataFrame(rows, "ord int, id string, name string, severity string, suggestion string, before string, after string")


def categories(spark: SparkSession) -> DataFrame:
    """Metadata of the categories."""
    return spark.createDataFrame(CATEGORIES, "id string, name string, severity string, suggestion string")


def struct_of(ddl: str) -> T.StructType:
    """Type of a DDL string."""
    return T.StructType.fromDDL(ddl)
