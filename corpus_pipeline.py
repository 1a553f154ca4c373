"""Training-data pipeline over documents: language, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and is
written as Parquet and read again as the next one's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import language_id as _language_id
from quillspark.llm import mixing as _mixing
from quillspark.llm import ngram_join as _ngram_join
from quillspark.llm import packing as _packing
from quillspark.llm import pii as _pii
from quillspark.llm._store import discard, materialise, numbered, pick, restrict


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that string-kernel language identification does not reject.

    Null, empty and letterless texts are rejected; a null doc_id doesn't matter; repeated rows go the same way each;
    very long texts are read whole; without rows, none are returned. Other columns may bear any names.
    """
    return _language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by the n-gram Jaccard join: that with the smallest doc_id.

    Documents with a null, empty or wordless text or a null doc_id are in no group and stay. Of rows with one doc_id
    that stays, one does: that with the smallest text (a null one last), then the smallest other columns.
    Very long texts are read whole; without rows, none are returned. Other columns may bear any names.
    """
    groups = _ngram_join.duplicate_groups(docs)
    dropped = materialise(groups.filter("doc_id <> group_id").select("doc_id"), "dropped")
    kept = restrict(docs, dropped, "doc_id", "left_anti")
    ids = pick(docs, "doc_id").filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = materialise(ids, "repeated")
    if repeated.isEmpty():
        return kept
    # Only rows with a repeated doc_id are shuffled.
    several = numbered(restrict(kept, repeated, "doc_id"))
    names, at = docs.columns, docs.columns.index("text")
    order = [F.col(f"_{at}").asc_nulls_last(), *(F.col(f"_{i}").cast("string") for i in range(len(names)) if i != at)]
    first = several.withColumn("turn", F.row_number().over(Window.partitionBy(f"_{names.index('doc_id')}").orderBy(*order))).filter("turn = 1").drop("turn")
    return numbered(restrict(kept, repeated, "doc_id", "left_anti")).union(first).toDF(*names)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the entities of the skip-chain random field replaced by their labels, and n_chars, if there is one, the new length.

    Null and empty texts stay as they are; rows with a null doc_id and repeated rows are redacted each; very long texts are
    read whole; without rows, none are returned. Other columns may bear any names.
    """
    return _pii.redact_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the blocks that Sainte-Laguë apportionment takes.

    A null source counts as ''; null and empty texts have no tokens and go with the block at their place; rows of one source and
    doc_id, or of one text where doc_id is null, are taken or left as one; a very long text counts as one block; without
    rows, none are returned. Other columns may bear any names.
    """
    return _mixing.take(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id) of every piece.

    Null and empty texts have no piece; rows with a null doc_id and repeated rows are packed each; very long texts are
    cut in pieces; without rows, none are returned. Other columns may bear any names.
    """
    return _packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: Language identification is not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents; the result is read from the last one's files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)  # what the stage has read is no longer needed
        before = docs
    return docs
