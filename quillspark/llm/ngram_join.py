"""Operator 2: Jaccard join of documents on word n-grams, by token-combination prefixes.

The query returns one row per document: its class, of the documents connected through similar
pairs, and the number of documents that it is similar to. All links count, but aren't written
out as pairs, whose number grows with the square of a group of copies.

Defined results of pairs: rows with a null doc_id, a null text or no word are in no pair;
repeated rows count once; a document is never paired with itself; documents with
equal n-gram sets are pairs of similarity 1; a text of fewer than n words has one
gram of all its words; very long texts are read whole; a table without rows gives no pair; other
columns are not read. In the rows per document, one without words is a class of its own without
links; a null doc_id has no row.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame

from . import _setjoin
from ._vec import ngrams, words

#: Production parameters: word bigrams, similar from 0.65 on.
N = 2
THRESHOLD = 0.65


def grams(texts, n: int = N):
    """Word n-gram hashes of texts, as ``ngrams`` returns them."""
    h, at = words(texts)
    return ngrams(h, at, n)


def job(n: int = N, threshold: float = THRESHOLD) -> _setjoin.Join:
    """The join of n-gram sets."""
    return _setjoin.Join(partial(grams, n=n), threshold)


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs (doc_a, doc_b, jaccard), doc_a < doc_b, with a Jaccard similarity of n-grams >= threshold."""
    return _setjoin.pairs(docs, job(n, threshold))


def similar_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of every document: the smallest doc_id of its class, and how many documents it is similar to."""
    return _setjoin.classes(docs, job(n, threshold))


def duplicate_groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id) by connection through similar pairs; group_id is the smallest doc_id of the group."""
    return _setjoin.groups(docs, job(n, threshold))


PAIRS_ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents
           WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - {N} + 1, 1) + 1),
             lambda i: array_to_string(ws[i:i + {N} - 1], ' '))) AS gram FROM w WHERE len(ws) > 0),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c
      FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_a, doc_b, round(c / (x.n + y.n - c), 6) AS jaccard
FROM p JOIN z x ON x.doc_id = doc_a JOIN z y ON y.doc_id = doc_b
WHERE c / (x.n + y.n - c) >= {THRESHOLD} - 1e-12
"""

ORACLE = _setjoin.classes_sql(PAIRS_ORACLE)
