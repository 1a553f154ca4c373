"""Rows with every awkward case, and brute-force helpers."""

import re

import pyarrow as pa

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep boolean, rank int, jaccard double, TEXT string"
WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
BASE = "the quick brown fox jumps over the lazy dog while seven wizards box with jugs of liquor in the old harbour of a quiet town by the sea and nobody sees them at all"
FRENCH = "le petit chat boit du lait dans la cuisine pendant que les enfants jouent avec des cailloux sur le chemin de la vieille maison et que la pluie tombe"
LONG = " ".join(f"word{i % 997}x" for i in range(12000))


def docs(spark, clash=True):
    """A table with nulls, empty, long, equal, near-equal, repeated and odd texts."""
    near = BASE.replace("brown", "green")
    rows = [
        (1, BASE, "en", "a"), (2, near, "en", "a"), (3, BASE, None, None), (4, None, "en", "b"), (5, "", "fr", "b"), (None, BASE, "en", "a"), (6, FRENCH, "fr", "c"), (6, FRENCH, "fr", "c"), (7, LONG, "en", "c"),
        (8, LONG + " tail", "en", "c"), (9, "!!! ??? 12", None, "a"), (10, "fox", "en", "a"), (11, "fox", "en", "a"), (12, "😀 日本語 text é", None, "c"), (13, FRENCH.upper(), "fr", "c"), (14, "the of and", "en", "b"), (15, " \n\t ", "en", "b"),
    ]
    rows = [(i, t, g, s, len(t or ""), True, 1, 0.5, "other")[: 9 if clash else 8] for i, t, g, s in rows]
    return spark.createDataFrame(rows, SCHEMA if clash else SCHEMA.rpartition(",")[0])


def empty(spark):
    """The same without rows."""
    return spark.createDataFrame([], SCHEMA)


def local(df):
    """[(doc_id, text)] of a table."""
    at = df.columns.index("text")
    return [(r[0], r[at]) for r in df.collect()]


def gram_set(text, n):
    """Word n-grams of a text as a set of tuples."""
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_pairs(rows, make, t):
    """{(a, b): jaccard} of all pairs at or above t."""
    sets = {(i, x): make(x) for i, x in rows if i is not None and x is not None}
    out = {}
    keys = [k for k in sets if sets[k]]
    for p in keys:
        for q in keys:
            if p[0] < q[0]:
                j = len(sets[p] & sets[q]) / len(sets[p] | sets[q])
                if j >= t - 1e-12:
                    out[p[0], q[0]] = round(j, 6)
    return out


def array(*texts):
    """Arrow strings."""
    return pa.array(list(texts), pa.string())
