"""Operator 1: secret scan with a trigram inverted index.

From each rule's regular expression comes a Boolean query over trigrams that every
match must contain. A segment of documents is indexed by those trigrams (posting
lists of its documents, letters folded to lower case), each rule's postings are
intersected and united as its query says, and the remaining candidates are verified
with the expression itself. A rule without a mandatory trigram scans all texts.
Segments are slices of a task's input: the index needs no shuffle.

Letters fold as in the expressions, which are ASCII: A to Z alone have a small form.

Defined results: rows with a null or empty text have no finding; a row with a null
doc_id is reported with it; repeated rows are reported each; very long texts are read whole;
a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._store import pick
from ._vec import lean, slices, utf8

#: name -> expression, in the syntax that Python, RE2 and DuckDB share.
RULES = {
    "assigned_secret": r"""(?i)(?:token|secret|passwd|password|api_key|apikey|access_key)[ \t]{0,4}[=:][ \t]{0,4}["'][0-9a-z_\-+/=.]{16,100}["']""",
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[0-9A-Za-z]{36}",
    "slack_token": r"xox[abprs]-[0-9A-Za-z\-]{10,72}",
    "google_api_key": r"AIza[0-9A-Za-z_\-]{35}",
    "stripe_key": r"[rs]k_live_[0-9A-Za-z]{24}",
    "provider_key": r"sk-(?:ant-|proj-)?[0-9A-Za-z_\-]{32,120}",
    "private_key_block": r"-----BEGIN (?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----",
    "json_web_token": r"eyJ[0-9A-Za-z_\-]{10,}\.eyJ[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{10,}",
    "url_credentials": r"[a-z]{2,10}://[0-9A-Za-z._\-]{1,64}:[0-9A-Za-z._\-!$%]{1,64}@[0-9A-Za-z]",
    "bearer_token": r"(?i)bearer[ \t]{1,4}[0-9a-z_\-.=]{20,200}",
    "hex_digest_key": r"\b[0-9a-f]{40}\b",
}

#: A query is True (all documents), a trigram, or ('and' | 'or', queries).
Query = bool | bytes | tuple


def both(a: Query, b: Query) -> Query:
    """Conjunction."""
    return b if a is True else a if b is True else ("and", (a, b))


def either(parts: list[Query]) -> Query:
    """Disjunction; one part that demands nothing makes the whole demand nothing."""
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def contains(s: str) -> Query:
    """All trigrams of a folded string."""
    b = s.encode()
    q: Query = True
    for t in sorted({b[i : i + 3] for i in range(len(b) - 2)}):
        q = both(q, t)
    return q


EXACT = 64


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(the strings that the expression matches, if they are few; a query that every match fulfils)."""
    known: set[str] = {""}  # what the text read so far ends with, folded
    whole, query = True, True

    def flush() -> None:
        nonlocal query
        query = both(query, either([contains(s) for s in sorted(known)]))

    for kind, arg in tree:
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and (power := _repeated(arg)):
            # At least so many times: what comes before is followed by them, and what comes after is unknown.
            fits = len(known) * len(power) <= EXACT
            if not fits:
                flush()
            known = {a + b for a in (known if fits else {""}) for b in power}
            whole &= fits
            if arg[0] == arg[1]:
                continue
            flush()
            known, whole = {""}, False
            continue
        exact, need = _one(kind, arg)
        if exact is not None and len(known) * len(exact) <= EXACT:
            known = {a + b for a in known for b in exact}
            continue
        flush()
        query = both(query, need)
        if exact is not None:
            tails = {s[-2:] for s in known} if len({s[-2:] for s in known}) * len(exact) <= EXACT else {""}
            known = {a + b for a in tails for b in exact}
        else:
            known = {""}
        whole = False
    if whole:
        return known, True
    flush()
    return None, query


def _repeated(arg) -> set[str] | None:
    """The strings of the least number of repeats, if they are few and there is one."""
    low, _, sub = arg
    exact, _ = _walk(sub)
    if not low or exact is None or len(exact) ** min(low, 8) > EXACT:
        return None
    out = {""}
    for _ in range(low):
        out = {a + b for a in out for b in exact}
        if len(out) > EXACT:
            return None
    return out


def _fold(code: int) -> str:
    """A character in small letters, if it is one of ASCII."""
    return chr(code).lower() if code < 128 else chr(code)


def _one(kind, arg) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {_fold(arg)}, True
    if kind is op.IN:
        chars: set[str] = set()
        for k, a in arg:
            if k is op.LITERAL:
                chars.add(_fold(a))
            elif k is op.RANGE and a[1] - a[0] < 16:
                chars |= {_fold(c) for c in range(a[0], a[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 16 else (None, True)
    if kind is op.AT:
        return {""}, True
    if kind is op.SUBPATTERN:
        exact, need = _walk(arg[3])
        return exact, need
    if kind is op.BRANCH:
        found = [_walk(b) for b in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= EXACT:
            return set().union(*(e for e, _ in found)), True
        return None, either([either([contains(s) for s in sorted(e)]) if e is not None else q for e, q in found])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, sub = arg
        exact, need = _walk(sub)
        if low == high == 1 or (low, high) == (0, 1) and exact is not None:
            return (exact | {""} if low == 0 else exact), True if exact is not None else need
        if low == 0:
            return None, True
        return None, either([contains(s) for s in sorted(exact)]) if exact is not None else need
    return None, True


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression; True if no trigram is mandatory."""
    exact, need = _walk(parser.parse(pattern))
    return either([contains(s) for s in sorted(exact)]) if exact is not None else need


def trigrams(q: Query) -> set[bytes]:
    """The trigrams that a query speaks of."""
    return {q} if isinstance(q, bytes) else set() if isinstance(q, bool) else set().union(*map(trigrams, q[1]))


class Index:
    """Posting lists of one segment, for the trigrams that the rules ask for."""

    def __init__(self, texts: pa.Array, vocabulary: list[bytes]):
        buf, offsets = utf8(texts)
        self.size = len(texts)
        cls = np.zeros(256, np.int32)
        used = sorted({c for t in vocabulary for c in t})
        cls[used] = np.arange(1, len(used) + 1)
        cls[65:91] = cls[97:123]  # letters in either case are one class
        width = len(used) + 1
        table = np.full(width**3, -1, np.int32)
        for k, t in enumerate(vocabulary):
            table[(cls[t[0]] * width + cls[t[1]]) * width + cls[t[2]]] = k
        c = cls[buf]
        kind = table[(c[:-2] * width + c[1:-1]) * width + c[2:]] if len(c) > 2 else np.zeros(0, np.int32)
        hit = np.flatnonzero(kind >= 0)
        doc = np.searchsorted(offsets, hit, side="right") - 1
        inside = hit + 2 < offsets[doc + 1]
        keys = np.unique(kind[hit[inside]].astype(np.int64) * max(1, self.size) + doc[inside])
        cuts = np.searchsorted(keys, np.arange(len(vocabulary) + 1) * max(1, self.size))
        self.postings = {t: keys[a:b] % max(1, self.size) for t, a, b in zip(vocabulary, cuts[:-1], cuts[1:])}

    def candidates(self, q: Query) -> np.ndarray:
        """Rows whose trigrams fulfil the query."""
        if q is True:
            return np.arange(self.size)
        if isinstance(q, bytes):
            return self.postings[q]
        parts = [self.candidates(x) for x in q[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
        return out


@lru_cache(8)
def _compiled(rules: tuple[tuple[str, str], ...]):
    queries = {n: trigram_query(p) for n, p in rules}
    vocabulary = sorted(set().union(*map(trigrams, queries.values())))
    return [(n, p, re.compile(p, re.ASCII), queries[n]) for n, p in rules], vocabulary


def scan_texts(texts: pa.Array, rules: tuple[tuple[str, str], ...]):
    """(row, rule, matches) of an array of texts without nulls."""
    compiled, vocabulary = _compiled(rules)
    index = Index(texts, vocabulary)
    for name, source, pattern, query in compiled:
        if query is True:  # a full scan, by RE2
            rows = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, source)))
        else:
            rows = index.candidates(query)
        for r in rows.tolist():
            found = [m.group(0) for m in pattern.finditer(texts[r].as_py())]
            if found:
                yield r, name, found


def secret_scan(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, rule, n_matches, first_match) for each document and rule that matches in it."""
    chosen = tuple((RULES if rules is None else rules).items())

    def run(batches):
        for b in batches:
            for row, texts in slices(b.column(1)):
                found = sorted(scan_texts(texts, chosen), key=lambda x: x[0])
                if found:
                    ids = b.column(0).slice(row, len(texts)).take(pa.array([r for r, _, _ in found]))
                    yield pa.record_batch({"doc_id": ids, "rule": pa.array([n for _, n, _ in found]), "n_matches": pa.array([len(m) for _, _, m in found], pa.int64()), "first_match": pa.array([m[0] for _, _, m in found])})

    return pick(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, rule string, n_matches long, first_match string")


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE = " UNION ALL ".join(
    f"SELECT doc_id, {_sql(n)} AS rule, len(regexp_extract_all(text, {_sql(p)})) AS n_matches, regexp_extract(text, {_sql(p)}) AS first_match "
    f"FROM documents WHERE regexp_matches(text, {_sql(p)})"
    for n, p in RULES.items()
)
