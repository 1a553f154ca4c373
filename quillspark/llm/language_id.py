"""Operator 4: language identification by string kernels.

A text is the set of its blended spectrum: all byte n-grams, n = 1..SPECTRUM, of its
lower-cased letters, other characters being one space, hashed to BUCKETS places; n-grams that
share a place count as one. The kernel of two texts is the number of places present in
both over the geometric mean of their numbers.
LANDMARKS labelled texts span the Nyström approximation; one-versus-rest kernel ridge
regression is solved in its coordinates. As the kernel is a product of presence
vectors, landmarks, whitening and weights multiply out, once, to a matrix of n-grams by
languages, and each batch of documents is scored by one product with it.

The model is trained on at most TRAIN_PER_LANGUAGE labelled rows of each language,
chosen by hash of doc_id. A document is rejected if it has no letter, or if every language
disclaims it: its score is at most DISCLAIM, and lower than that of the language's own texts with
as many different n-grams by more than DEVIATIONS standard deviations. Mean and deviation, as functions of
the number of n-grams, come from the labelled rows, whole and cut to their first halves,
quarters and so on; few n-grams scatter widely, so little is held against them.

Defined results: a null or empty text, or one without letters, is rejected with a null
language; ties go to the first language in alphabetical order; rows without a
label or doc_id are scored, not trained on; every row, repeated or not, is returned;
without any labelled row nothing is learned, languages are null and only texts without
letters are rejected; very long texts are read whole; a table without rows gives none. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import map_rows, pick
from ._vec import lean, slices, utf8

SPECTRUM = 4
BUCKETS = 1 << 16
#: Bounds of what is trained on.
TRAIN_PER_LANGUAGE = 400
LANDMARKS = 128
RIDGE = 1e-3
DISCLAIM, DEVIATIONS = -0.1, 5.0

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram buckets present, offsets per text) of texts without nulls."""
    buf, offsets = utf8(pc.utf8_lower(texts))
    letter = _LETTER[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    before = np.append(True, letter[:-1]) if len(buf) else letter
    keep = letter | before | first[:-1]  # of a run of other characters, the first stays as a space
    at = np.append(0, np.cumsum(keep))[offsets]
    c = np.where(letter, buf, np.uint8(32))[keep].astype(np.uint32)
    lettered = np.append(0, np.cumsum(letter[keep]))
    codes = []
    h = np.zeros(len(c), np.uint32)
    for n in range(1, SPECTRUM + 1):
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        codes.append((h >> np.uint32(16)).astype(np.int64))
    out, cuts, seen = [], [0], np.zeros(BUCKETS, bool)
    for a, b in zip(at[:-1], at[1:]):
        if lettered[b] > lettered[a]:
            for n, x in enumerate(codes):
                seen[x[a : max(a, b - n)]] = True
            got = np.flatnonzero(seen)
            seen[got] = False
            out.append(got)
            cuts.append(cuts[-1] + len(got))
        else:
            cuts.append(cuts[-1])
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.array(cuts)


def product(x: np.ndarray, cuts: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Presence rows (as bucket lists) times a matrix of buckets by columns."""
    out = np.zeros((len(cuts) - 1, matrix.shape[1]), matrix.dtype)
    rows = np.flatnonzero(np.diff(cuts))
    if len(rows):
        out[rows] = np.add.reduceat(matrix[x], cuts[rows], axis=0)
    return out


@dataclass
class Model:
    """Languages, the weights of n-grams by languages with their constants, and the least score of a language's own texts by the binary logarithm of their number of n-grams."""

    languages: list[str]
    weights: np.ndarray
    constant: np.ndarray
    least: np.ndarray

    def claimed(self, scores: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which texts some language claims, by their scores and numbers of n-grams."""
        at = np.log2(np.maximum(n, 1))
        bound = np.stack([np.interp(at, np.arange(self.least.shape[1]), b) for b in self.least], axis=1)
        return (scores >= bound).any(axis=1)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score of each text and language, number of n-gram buckets present)."""
        x, cuts = presence(texts)
        n = np.diff(cuts)
        return product(x, cuts, self.weights) / np.sqrt(np.maximum(n, 1))[:, None] + self.constant, n


def fit(texts: list[str], labels: list[str]) -> Model:
    """Nyström landmarks and ridge regression on labelled texts with letters, given in the order of their hash."""
    languages = sorted(set(labels))
    parts = [presence(p) for _, p in slices(pa.array(texts, pa.string()))]
    x = np.concatenate([p for p, _ in parts])
    cuts = np.append(0, np.cumsum(np.concatenate([np.diff(c) for _, c in parts])))
    size = np.sqrt(np.maximum(np.diff(cuts), 1))
    rank: dict[str, int] = {}
    turn = [rank.update({y: rank.get(y, -1) + 1}) or rank[y] for y in labels]
    chosen = np.argsort(turn, kind="stable")[:LANDMARKS]  # languages take turns
    m = np.zeros((BUCKETS, len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        m[x[cuts[i] : cuts[i + 1]], j] = 1 / size[i]
    k = np.concatenate([product(x[cuts[i] : cuts[min(i + 64, len(cuts) - 1)]], cuts[i : i + 65] - cuts[i], m) for i in range(0, len(cuts) - 1, 64)]) / size[:, None]
    values, vectors = np.linalg.eigh(k[chosen].astype(np.float64))
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = np.hstack([k @ whiten, np.ones((len(k), 1))])
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = np.array([1 / labels.count(z) for z in labels]) * len(labels) / len(languages)  # languages weigh alike
    beta = np.linalg.solve(phi.T @ (phi * share[:, None]) + RIDGE * len(k) * np.diag(np.append(np.ones(phi.shape[1] - 1), 0) + 1e-9), phi.T @ (y * share[:, None]))
    found = Model(languages, (m @ (whiten @ beta[:-1]).astype(np.float32)).astype(np.float32), beta[-1].astype(np.float32), np.zeros((len(languages), 1)))
    found.least = least_scores(found, texts, labels)
    return found


def least_scores(model: Model, texts: list[str], labels: list[str]) -> np.ndarray:
    """Languages by binary logarithms of numbers of n-grams: mean less DEVIATIONS deviations of the own scores of labelled texts and their beginnings, DISCLAIM at most."""
    out = np.zeros((len(model.languages), BUCKETS.bit_length()))
    for j, language in enumerate(model.languages):
        mine = [t for t, y in zip(texts, labels) if y == language]
        mine = list({t[: len(t) >> k] for t in mine for k in range(8) if len(t) >> k})
        found = [model.scores(part) for _, part in slices(pa.array(mine, pa.string()))]
        own, n = np.concatenate([s[:, j] for s, _ in found]).astype(np.float64), np.concatenate([n for _, n in found])
        own, at = own[n > 0], np.rint(np.log2(n[n > 0])).astype(int)
        # Neighbouring bins count too, with less weight: bounds change gradually, and thin bins lean on them.
        near = np.exp(-((at[None, :] - np.arange(out.shape[1])[:, None]) ** 2).astype(float))
        near /= near.sum(axis=1, keepdims=True)
        mean = near @ own
        out[j] = np.minimum(DISCLAIM, mean - DEVIATIONS * np.sqrt(np.maximum(near @ own**2 - mean**2, 1e-4)))
    return out


def trained(texts: list[str], labels: list[str]) -> Model | None:
    """Model of the texts that have letters; None if none has."""
    some = [i for i, t in enumerate(texts) if len(presence(pa.array([t]))[0])]
    return fit([texts[i] for i in some], [labels[i] for i in some]) if some else None


def training_rows(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """At most per_language labelled texts of each language, by hash of doc_id."""
    rows = docs.filter("doc_id is not null and text is not null and lang is not null and length(trim(text)) > 0")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    order = F.xxhash64(F.lit(4), "doc_id")
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.5 * per_language / n + 20 / n))))
    some = rows.filter((F.pmod(order, F.lit(1 << 20)) / (1 << 20)) < share[F.col("lang")])
    taken: dict[str, int] = {}
    out: tuple[list[str], list[str]] = [], []
    for r in sorted(some.select(order.alias("o"), "doc_id", "lang", "text").collect(), key=lambda r: (r.o, r.doc_id, r.text)):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_language:
            out[0].append(r["text"])
            out[1].append(r["lang"])
    return out


def identify(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """(doc_id, language, score, margin, keep) of every row."""
    rows = pick(docs, "doc_id", "text", "lang")
    texts, labels = training_rows(rows, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(trained(texts, labels))

    def run(batches):
        for b in batches:
            for row, part in slices(b.column(1)):
                yield pa.record_batch({"doc_id": b.column(0).slice(row, len(part)), **decide(shared.value, part)})

    return rows.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, language string, score double, margin double, keep boolean")


def decide(model: Model | None, texts: pa.Array) -> dict[str, pa.Array]:
    """Columns language, score, margin and keep of texts without nulls."""
    if model is None:
        n = len(texts)
        return {"language": pa.nulls(n, pa.string()), "score": pa.nulls(n, pa.float64()), "margin": pa.nulls(n, pa.float64()), "keep": pa.array(np.diff(presence(texts)[1]) > 0)}
    s, n = model.scores(texts)
    some = n > 0
    best = s.argmax(axis=1)
    top = s[np.arange(len(s)), best].astype(np.float64)
    rest = np.sort(s, axis=1)[:, -2].astype(np.float64) if s.shape[1] > 1 else np.full(len(s), -1.0)
    keep = some & model.claimed(s, n)
    return {
        "language": pa.array(np.array(model.languages, object)[best], pa.string(), mask=~keep),
        "score": pa.array(np.round(top, 4), mask=~some),
        "margin": pa.array(np.round(top - rest, 4), mask=~some),
        "keep": pa.array(keep),
    }


def keep_identified(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """The rows of docs, all columns as they are, that some language claims."""
    texts, labels = training_rows(pick(docs, "doc_id", "text", "lang"), per_language)
    shared = docs.sparkSession.sparkContext.broadcast(trained(texts, labels))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            keep = [decide(shared.value, part)["keep"] for _, part in slices(b.column(at))]
            if keep:
                yield b.filter(pa.concat_arrays(keep))

    return map_rows(docs, lean(run))
