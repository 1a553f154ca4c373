"""Operator 5: quality by votes of the nearest labelled documents in a latent-semantic space.

A document is the distribution of its byte trigrams and of its shape trigrams (letters
and digits reduced to their kind), with a count of immediately repeated words; the
square roots of the shares, weighted by inverse document frequency among the labelled
documents, are projected on the leading singular vectors of the labelled documents.
The labelled vectors are broadcast: their number is at most TRAIN_ROWS, whatever the
input. For every document the cosines with all of them are computed, in blocks, and
the NEIGHBOURS nearest vote for their label with their similarity as weight. A labelled
document is no neighbour of itself: those with its doc_id are left out.

Defined results: a null or empty text has score 0 and is not kept; ties in similarity
go to the labelled document with the smaller doc_id; a doc_id labelled several
times counts once, with its smallest label; every row is returned, repeated or not, with a null
doc_id or not; without labels every score is null and every text that isn't empty kept; very long texts are read whole; a
table without rows gives none. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import pick
from ._vec import lean, slices, utf8, words

BUCKETS = 1 << 13
#: Bound of the labelled rows that are trained on and broadcast.
TRAIN_ROWS = 3000
DIMENSIONS = 64
NEIGHBOURS = 15
#: Documents with at least this share of the votes are kept.
KEEP = 0.5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def features(texts: pa.Array) -> np.ndarray:
    """Square roots of feature shares, a row per text; texts without nulls."""
    buf, offsets = utf8(texts)
    codes = []
    for k, b in enumerate((buf, _SHAPE[buf])):
        c = b.astype(np.uint32)
        h = ((c[:-2] * np.uint32(65599) + c[1:-1]) * np.uint32(65599) + c[2:] + np.uint32(k)) * np.uint32(0x9E3779B1) if len(c) > 2 else np.zeros(0, np.uint32)
        codes.append((h >> np.uint32(32 - 12)).astype(np.int64) + k * (BUCKETS // 2))
    h, at = words(texts)
    out = np.zeros((len(texts), BUCKETS + 1), np.float32)  # the last is for repeated words
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        b = max(a, b - 2)
        for k, c in enumerate(codes):
            half = slice(k * (BUCKETS // 2), (k + 1) * (BUCKETS // 2))
            out[i, half] = np.bincount(c[a:b] - k * (BUCKETS // 2), minlength=BUCKETS // 2)
        w = h[at[i] : at[i + 1]]
        out[i, BUCKETS] = 3 * (w[1:] == w[:-1]).sum()
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    """Projection, labelled vectors of length 1, their labels and doc_ids."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray

    def scores(self, texts: pa.Array, ids: np.ndarray) -> np.ndarray:
        """Share of the neighbours' votes for label 1; ids of the texts."""
        out = np.zeros(len(texts))
        for i in range(0, len(texts), 128):
            part = texts.slice(i, 128)
            v = unit(features(part) @ self.projection)
            cos = v @ self.vectors.T
            at = np.minimum(np.searchsorted(self.ids, ids[i : i + len(part)]), len(self.ids) - 1)
            known = np.flatnonzero(self.ids[at] == ids[i : i + len(part)])
            cos[known, at[known]] = -2
            k = min(NEIGHBOURS, cos.shape[1])
            near = nearest(cos, k)
            w = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64)
            out[i : i + len(part)] = (w * self.labels[near]).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-12)
        return out


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest entries of each row; of equal entries the first columns."""
    kth = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
    above = cos > kth
    room = k - above.sum(axis=1, keepdims=True)
    tied = cos == kth
    return np.nonzero(above | (tied & (np.cumsum(tied, axis=1) <= room)))[1].reshape(len(cos), k)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def fit(texts: list[str], labels: list[int], ids: list[int]) -> Model:
    """Latent-semantic space of labelled texts, one for each id."""
    order = np.argsort(ids, kind="stable")
    texts, labels = [texts[i] for i in order], [labels[i] for i in order]
    x = np.concatenate([features(p) for _, p in slices(pa.array(texts, pa.string()))])
    idf = np.log1p(len(x) / (1 + (x > 0).sum(axis=0))).astype(np.float32)
    a = unit(x * idf)
    rng = np.random.default_rng(5)
    q = np.linalg.qr(a @ rng.standard_normal((BUCKETS + 1, DIMENSIONS + 16)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(a @ (a.T @ q))[0]
    right = np.linalg.svd(q.T @ a, full_matrices=False)[2][:DIMENSIONS]
    projection = (idf[:, None] * right.T).astype(np.float32)
    return Model(projection, unit(x @ projection), np.array(labels, np.float64), np.array(ids, np.int64)[order])


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> tuple[list[str], list[int], list[int]]:
    """At most bound labelled texts, by hash of doc_id, with labels and ids."""
    known = pick(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    if not n:
        return [], [], []
    order = F.xxhash64(F.lit(5), "doc_id")
    chosen = known.withColumn("o", order).orderBy("o", "doc_id").limit(bound)
    rows = docs.filter("text is not null and text <> ''").join(F.broadcast(chosen), "doc_id").select("o", "doc_id", "text", "quality").collect()
    rows = sorted({r.doc_id: r for r in sorted(rows, key=lambda r: r.text)}.values(), key=lambda r: (r.o, r.doc_id))
    return [r.text for r in rows], [int(r.quality) for r in rows], [r.doc_id for r in rows]


def classify(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, quality, keep) of every row; quality is the share of votes."""
    rows = pick(docs, "doc_id", "text")
    texts, known, ids = training_rows(rows, labels, bound)
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, known, ids) if texts else None)

    def run(batches):
        model = shared.value
        for b in batches:
            for row, part in slices(b.column(1)):
                some = np.diff(utf8(part)[1]) > 0
                own = b.column(0).slice(row, len(part))
                s = model.scores(part, np.where(np.asarray(own.is_valid()), np.asarray(own.fill_null(0)), np.iinfo(np.int64).min)) if model else np.ones(len(part))
                s = np.where(some, np.round(s, 6), 0.0)
                score = pa.array(s) if model else pa.nulls(len(part), pa.float64())
                yield pa.record_batch({"doc_id": own, "quality": score, "keep": pa.array(some & (s >= KEEP))})

    return rows.mapInArrow(lean(run), "doc_id long, quality double, keep boolean")
