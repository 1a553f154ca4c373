"""Operator 3: document fingerprints by SpotSigs.

After each anchor, a common word, comes a chain of the next CHAIN content words
(words that are not anchors); anchor and chain make one spot signature. The
signatures of a document form its fingerprint. The list of the fingerprints that hold a
signature is in order of size and compared by stretches from a size to that size over the
threshold, the narrowest partition by length that loses no pair; signatures are indexed from rare to
common ones, as far as the threshold demands, and pairs dropped as soon as the positions of what they share
exclude it (see ``_setjoin``).

The query returns one row per document: its class, of the documents connected through similar
pairs, and the number of documents that it is similar to. All links count, but aren't written
out as pairs.

Defined results of pairs: a text without any full chain has, as only signature, the hash of
its word sequence, so copies of it are still found; rows with a null doc_id, a null
text or no word are in no pair; repeated rows count once; ties don't arise, as all pairs are returned;
very long texts are read whole; a table without rows gives no pair; other columns are not read. In the rows per
document, one without words is a class of its own without links; a null doc_id has no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _setjoin
from ._vec import mix, words

#: Anchors: the commonest function words of the four languages.
ANCHORS = (
    "the of and to in is that it for was with as be by are this from at on a "
    "der die das und den von zu ist im nicht mit dem sich ein eine auf für "
    "le la les de des et que qui un une est dans pour pas sur en du au avec par il elle "
    "el los las del y se por con para una su no al lo como más"
).split()
CHAIN = 2
#: Production threshold of similarity.
THRESHOLD = 0.5
#: Signatures that similar fingerprints must have in common; they are few, so few are asked for.
COMMON = 4

_anchor_hashes: list[np.ndarray] = []


def anchor_hashes() -> np.ndarray:
    """Sorted hashes of the anchors, computed once in each process."""
    if not _anchor_hashes:
        _anchor_hashes.append(np.unique(words(pa.array([" ".join(ANCHORS)]))[0]))
    return _anchor_hashes[0]


def spots(texts: pa.Array, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spot signatures of texts, repeats included, the first and last content word of each, and where each text's begin."""
    h, at = words(texts)
    known = anchor_hashes()
    is_anchor = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    content = np.flatnonzero(~is_anchor)
    anchors = np.flatnonzero(is_anchor)
    nxt = np.searchsorted(content, anchors)  # where each anchor's chain begins among the content words
    doc_end = at[1:][np.searchsorted(at[1:], anchors, side="right")] if len(anchors) else anchors
    last = nxt + chain - 1
    ok = last < len(content)
    ok[ok] = content[last[ok]] < doc_end[ok]
    anchors, nxt = anchors[ok], nxt[ok]
    sig, first, last = h[anchors], h[content[nxt]], h[content[nxt + chain - 1]]
    for k in range(chain):
        sig = mix(sig * np.uint64(0x9FB21C651E98DF25) + h[content[nxt + k]])
    doc = np.searchsorted(at, anchors, side="right") - 1
    bare = np.setdiff1d(np.flatnonzero(np.diff(at)), doc)
    whole = np.zeros(len(bare), np.uint64)
    for j, i in enumerate(bare.tolist()):
        w = h[at[i] : at[i + 1]]
        whole[j] = mix(w * np.uint64(0xD1342543DE82EF95) + mix(np.arange(len(w), dtype=np.uint64))).sum(dtype=np.uint64)
    doc = np.concatenate([doc, bare])
    order = np.argsort(doc, kind="stable")
    ends = np.concatenate([first, h[at[bare]]]), np.concatenate([last, h[at[bare + 1] - 1]])
    return np.concatenate([sig, mix(whole)])[order], ends[0][order], ends[1][order], np.searchsorted(doc[order], np.arange(len(at)))


def job(threshold: float = THRESHOLD) -> _setjoin.Join:
    """The signatures of lines that many documents share go in combinations."""
    return _setjoin.Join(spots, threshold, common=COMMON)


def fingerprint_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs (doc_a, doc_b, jaccard), doc_a < doc_b, whose fingerprints have a Jaccard similarity >= threshold."""
    return _setjoin.pairs(docs, job(threshold))


def fingerprint_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of every document: the smallest doc_id of its class, and how many documents it is similar to."""
    return _setjoin.classes(docs, job(threshold))


PAIRS_ORACLE = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents
           WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, ws, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
k AS (SELECT doc_id, i, word, word IN ({", ".join(f"'{a}'" for a in ANCHORS)}) AS anchor FROM w),
c AS (SELECT doc_id, i, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM k WHERE NOT anchor),
a AS (SELECT doc_id, i, word, count(*) FILTER (NOT anchor) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k QUALIFY anchor),
s AS (SELECT a.doc_id, a.word || ' ' || x.word || ' ' || y.word AS spot FROM a
      JOIN c x ON x.doc_id = a.doc_id AND x.r = a.before + 1 JOIN c y ON y.doc_id = a.doc_id AND y.r = a.before + 2),
g AS (SELECT DISTINCT doc_id, spot FROM s
      UNION ALL SELECT DISTINCT doc_id, '= ' || array_to_string(ws, ' ') FROM t WHERE len(ws) > 0 AND doc_id NOT IN (SELECT doc_id FROM s)),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT l.doc_id AS doc_a, r.doc_id AS doc_b, count(*) AS c FROM g l JOIN g r ON l.spot = r.spot AND l.doc_id < r.doc_id GROUP BY ALL)
SELECT doc_a, doc_b, round(p.c / (x.n + y.n - p.c), 6) AS jaccard
FROM p JOIN z x ON x.doc_id = doc_a JOIN z y ON y.doc_id = doc_b
WHERE p.c / (x.n + y.n - p.c) >= {THRESHOLD} - 1e-12
"""

ORACLE = _setjoin.classes_sql(PAIRS_ORACLE)
