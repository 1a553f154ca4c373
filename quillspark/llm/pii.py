"""Operator 10: personal data by a skip-chain conditional random field.

Tokens are runs of letters and digits, and single other characters; every token of every
text is a vertex. Neighbouring tokens are linked in a chain. Besides, tokens of the same or
nearly the same form are linked across any distance: each occurrence of a word with a
capital or a digit, or of a number, with the one before it and with the first one in the
document. Case, accents and a genitive s don't count, and what stands between hyphens,
apostrophes or separators is a token of its own. Words that the document also has in small letters
are no names and not linked, unless they are introduced as one.

Loopy belief propagation runs over both kinds of links: sweeps along the chains are exact,
in segments of SEGMENT tokens; messages across skip links and between segments are passed on
until none changes by TOLERANCE, so that the label of one occurrence supports the others'. As many
bare occurrences would outvote the one with evidence, what is observed at one counts at all: a name
that is introduced anywhere in the document is so, as a feature, wherever it occurs.

The weights are fitted by ``python -m quillspark.llm.pii`` to a generated corpus of TRAIN_TEXTS
texts (see ``pii_corpus``), by the gradient of the Bethe approximation, and kept in
pii_weights.npz; they don't depend on the input.

Defined results: rows with a null or empty text have no entity; a null doc_id is reported
as such; repeated rows are reported each; ties in belief go to the label first in LABELS;
positions count characters from 0; very long texts are read whole, as all others; a table without rows
gives none; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import inspect
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import pii_corpus
from ._store import map_rows, pick
from ._vec import lean, mix, slices, span_hashes
from .pii_corpus import FIRST_NAMES, LABELS, corpus

TRAIN_TEXTS = 9000
BATCH = 100
EPOCHS = 6
#: Most rounds of messages in training, whose texts are short.
ROUNDS = 12
#: Change of a message in a round below which propagation has converged.
TOLERANCE = 1e-3
DAMPING = 0.3
HASH = 1 << 16
#: Tokens of a chain that one sweep goes through, and those beside a cut that give its first messages.
SEGMENT, NEAR = 64, 8
#: Bytes of text whose tokens make one graph, but for a longer single text.
PART = 1 << 18
WEIGHTS = Path(__file__).with_name("pii_weights.npz")

_PARTICLES = "van von vom der den de la del della di da do dos du le zu zum zur ter ten y e al el bin ibn".split()
#: Titles that introduce names when they begin with a capital; "Name", and "name is", do as well.
_TITLES = "mr mrs ms dr prof dear herr frau señor señora monsieur madame".split()
_WORDS = "name is my token secret password passwd key api tel phone call fax mail email contact ssn iban card ip address version server from to no number passport id licence license the of under".split()
#: Most words of a name, initials and particles aside.
NAME_WORDS = 4
_RUN = ".@+-()/_:"
SPACE, SYMBOL, DIGIT, LOWER, UPPER, CASELESS = range(6)
_CODES = 0x20000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind of each code point, its small letter without accent); those beyond are letters without case."""
    kind, base = np.full(_CODES, SYMBOL, np.uint8), np.arange(_CODES, dtype=np.uint32)
    for c in range(_CODES):
        x = chr(c)
        if x.isspace():
            kind[c] = SPACE
        elif x.isdigit():
            kind[c] = DIGIT
        elif x.isalnum():
            kind[c] = LOWER if x.islower() else UPPER if x.isupper() or x.istitle() else CASELESS
            base[c] = ord(unicodedata.normalize("NFD", x)[0].lower()[0])
    kind[_CODES - 1] = CASELESS
    return kind, base


@dataclass
class Graph:
    """Tokens of some texts: of each its text, where it is, its features, and whether it is the first of its text; skip links between them."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    features: np.ndarray
    skip: np.ndarray


@dataclass
class _Tokens:
    """What is known of each token, before features."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    size: np.ndarray
    code: np.ndarray
    word: np.ndarray
    digits: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    hexa: np.ndarray
    cap: np.ndarray
    glued: np.ndarray
    followed: np.ndarray
    sentence: np.ndarray
    key: np.ndarray


def _tokens(texts: list[str]) -> tuple[_Tokens, np.ndarray]:
    """Tokens of texts laid out in one line, and where each text begins there."""
    kinds, bases = _tables()
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.minimum(code, _CODES - 1)
    kind, base = kinds[place], np.where(code < _CODES, bases[place], code)
    word, symbol = kind >= DIGIT, kind == SYMBOL
    before, after = np.append(False, word[:-1]), np.append(word[1:], False)
    start = np.flatnonzero(word & ~before | symbol)
    end = np.flatnonzero(word & ~after | symbol) + 1

    def count(x: np.ndarray) -> np.ndarray:
        c = np.zeros(len(x) + 1, np.int32)
        np.cumsum(x, out=c[1:])
        return c[end] - c[start]

    n, c = end - start, code[start]
    hexa = np.zeros(128, bool)
    hexa[[ord(x) for x in "0123456789abcdefABCDEF"]] = True
    genitive = (n > 4) & (base[end - 1] == ord("s"))
    key = span_hashes(base, start, end - genitive)
    doc = np.searchsorted(at, start, side="right") - 1
    same = np.append(False, doc[1:] == doc[:-1])
    glued = same & (start == np.append(-1, end[:-1]))
    # A sentence begins at the start of a line or after a stop, with quotes between or not.
    lines = np.cumsum(code == 10)
    stop = np.isin(c, [ord(x) for x in ".!?:|#*•"])
    sentence = ~same | np.append(True, stop[:-1]) | np.append(True, lines[start[1:]] != lines[start[:-1]])
    followed = kind[end] != SPACE
    return _Tokens(doc, start, end, n, c, kind[start] >= DIGIT, count(kind == DIGIT), count(kind == LOWER), count(kind == UPPER), count(hexa[np.minimum(code, 127)] & (code < 127)), kind[start] == UPPER, glued, followed, sentence, key), at


@lru_cache(1)
def _lexicon() -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """(sorted keys of words, number of each, numbers by word): 1 and up; first names share one number, so do particles."""
    number = {w: k + 1 for k, w in enumerate([*_TITLES, *_WORDS])}
    first, part = len(number) + 1, len(number) + 2
    words = number | {w: part for w in _PARTICLES if w not in number} | {w: first for w in FIRST_NAMES}
    keys = _tokens(list(words))[0].key
    order = np.argsort(keys)
    return keys[order], np.array(list(words.values()))[order], number | {"(first name)": first, "(particle)": part}


def _lookup(t: _Tokens) -> np.ndarray:
    """Number of each token in the lexicon, 0 for none."""
    keys, numbers, _ = _lexicon()
    at = np.minimum(np.searchsorted(keys, t.key), len(keys) - 1)
    return np.where((keys[at] == t.key) & t.word, numbers[at], 0)


def _introduced(t: _Tokens, lex: np.ndarray) -> tuple[list[int], list[int]]:
    """Tokens of names that follow a title or the like, and tokens of a first name and the words with capitals after it."""
    _, _, number = _lexicon()
    alpha = t.word & (t.digits == 0)
    n, title = len(lex), number["madame"]
    names: tuple[list[int], list[int]] = ([], [])

    def follow(i: int, out: list[int]) -> None:
        words, doc = 0, t.doc[i - 1] if i else -1
        while i < n and t.doc[i] == doc and words < NAME_WORDS:
            if not alpha[i]:
                joint = t.code[i] in (0x27, 0x2019, 0x2D) and t.glued[i] and i + 1 < n and t.glued[i + 1] and t.cap[i - 1]
                stop = t.code[i] == ord(".") and t.size[i - 1] == 1 and t.cap[i - 1] and t.glued[i]
                if not (joint or stop):
                    break
            elif t.cap[i]:
                if t.size[i] > 1 and not 0 < lex[i] <= title:
                    out.append(i)
                    # Parts of one word count once.
                    words += not (i and t.glued[i])
            elif lex[i] != number["(particle)"]:
                break
            i += 1

    for i in np.flatnonzero((lex > 0) & (lex <= title) & t.cap).tolist():
        j = i + 1
        follow(j + (j < n and t.code[j] in (ord("."), ord(":"), ord(",")) and t.glued[j]), names[0])
    for i in np.flatnonzero(lex == number["name"]).tolist():
        j = i + 1
        if j < n and (lex[j] == number["is"] or t.code[j] == ord(":")):
            follow(j + 1, names[0])
        elif t.cap[i]:
            follow(j, names[0])
    follows = np.append(t.cap[1:] & alpha[1:] & (t.doc[1:] == t.doc[:-1]) & ~t.sentence[1:] & (t.upper[1:] < np.maximum(t.size[1:], 2)), False)
    for i in np.flatnonzero((lex == number["(first name)"]) & t.cap & follows).tolist():
        names[1].append(i)
        follow(i + 1, names[1])
    return names


def _shape(t: _Tokens) -> np.ndarray:
    """Small number for the form of each token."""
    n = t.size
    digit = 1 + np.where(n <= 4, n - 1, 4 + (n > 8) + (n > 12) + (n > 19))
    case = np.where(t.upper == 0, 0, np.where(t.cap & (t.upper == 1), 1, np.where(t.lower == 0, 2, 3)))
    alpha = 10 + 4 * case + (n > 2) + (n > 8) + (n > 24)
    mixed = 30 + 4 * (t.hexa == n) + (n > 5) + (n > 15) + (n > 30)
    symbol = 40 + np.where(t.code < 128, t.code % 80, 79)
    return np.where(~t.word, symbol, np.where(t.digits == n, digit, np.where(t.digits == 0, alpha, mixed))).astype(np.int64)


def _runs(t: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(stretch without spaces that each token is in, number of what each stretch consists of)."""
    inside = t.word | np.isin(t.code, [ord(x) for x in _RUN]) & t.followed | np.isin(t.code, [ord("("), ord(")")])
    new = ~(t.glued & inside & np.append(False, inside[:-1]))
    new[:1] = True
    heads = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    last = np.append(heads[1:], len(new)) - 1
    tail = np.isin(t.code[last], [ord("."), ord(":")]) & ~t.word[last]

    def total(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.int64), heads)

    def marks(x: str) -> np.ndarray:
        return total((t.code == ord(x)) & ~t.word) - (tail & (t.code[last] == ord(x)))

    letters = np.where(t.word, t.size - t.digits, 0)
    mail = np.cumsum((t.code == ord("@")) & ~t.word)
    dot = (t.code == ord(".")) & ~t.word & (mail > (mail - (t.code == ord("@")))[heads][of])
    facts = (np.minimum(total(t.digits), 20), np.minimum(total(letters), 3), np.minimum(marks("@"), 2), np.minimum(marks("."), 4), np.minimum(marks("-"), 4), np.minimum(marks("/"), 3), np.minimum(marks(":"), 3), np.minimum(total(t.word & (t.digits == t.size)), 5), t.code[heads] == ord("+"), total(dot) - (tail & dot[last]) > 0)
    x = np.full(len(heads), 7, np.int64)
    for f in facts:
        x = x * 31 + f.astype(np.int64) + 1
    return of, np.where(inside[heads], x % (1 << 40) + 1, 0)


def build(texts: list[str]) -> Graph:
    """Graph of all tokens of texts."""
    t, at = _tokens(texts)
    n = len(t.doc)
    if not n:
        return Graph(*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool), np.zeros((0, 0), np.int64), np.zeros((0, 2), np.int64))
    lex = _lookup(t)
    alpha = t.word & (t.digits == 0)
    salt = mix(t.doc.astype(np.uint64) + np.uint64(1))
    mine = mix(t.key ^ salt)  # a form in a document
    named = np.zeros(n, np.int64)
    for kind, found in ((2, _introduced(t, lex)[1]), (1, _introduced(t, lex)[0])):
        named[_among(mine, mine[found]) & (t.cap | (t.digits > 0)) & alpha] = kind
    # O'Brien: what is joined to a name before it belongs to it.
    i = np.flatnonzero((named > 0) & t.glued)
    i = i[i >= 2]
    i = i[np.isin(t.code[i - 1], [0x27, 0x2019]) & t.glued[i - 1] & alpha[i - 2]]
    named[i - 1], named[i - 2] = named[i], named[i]
    seen = np.zeros(n, bool)
    cap = alpha & t.cap
    seen[cap] = _among(mine[cap], mine[alpha & (t.upper == 0) & (t.lower > 0)])
    number = t.word & (t.digits == t.size)
    linked = np.where(number, t.size >= 3, t.word & ((t.upper > 0) | (t.digits > 0)) & ((t.size >= 3) | (t.size == 2) & (named > 0)) & (~seen | (named > 0)))
    who = np.flatnonzero(linked)
    who = who[np.argsort(mine[who], kind="stable")]
    again = np.append(False, mine[who][1:] == mine[who][:-1]) if len(who) else np.zeros(0, bool)
    head = who[np.maximum.accumulate(np.where(~again, np.arange(len(who)), 0))] if len(who) else who
    before = np.append(-1, who)[: len(who)]
    links = np.concatenate([np.stack([before, who], axis=1)[again], np.stack([head, who], axis=1)[again & (before != head)]])
    links = links[links[:, 1] - links[:, 0] > 1]
    first = np.append(True, t.doc[1:] != t.doc[:-1])
    return Graph(t.doc, t.start - at[t.doc], t.end - at[t.doc], first, _features(t, lex, named, seen), links[np.argsort(links[:, 1], kind="stable")])


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y; both are hashes, of which first 20 bits are compared."""
    place = np.uint64((1 << 20) - 1)
    table = np.zeros(1 << 20, bool)
    table[x & place] = True
    y = y[table[y & place]]
    table[:] = False
    table[y & place] = True
    out = table[x & place]
    out[out] = np.isin(x[out], y)
    return out


def _features(t: _Tokens, lex: np.ndarray, named: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Hashed features of each token, one column per kind."""
    n, shape = len(t.doc), _shape(t)
    run_of, runs = _runs(t)
    run = runs[run_of]

    def at(x: np.ndarray, k: int) -> np.ndarray:
        out = np.full(n, -1, np.int64)
        if abs(k) < n:
            src, dst = (slice(k, n), slice(0, n - k)) if k >= 0 else (slice(0, n + k), slice(-k, n))
            out[dst] = np.where(t.doc[src] == t.doc[dst], x[src], -1)
        return out

    # The run before or after a token's own, by the token just outside it.
    start = np.flatnonzero(np.append(True, run_of[1:] != run_of[:-1]))
    stop = np.append(start[1:], n) - 1

    def beyond(j: np.ndarray) -> np.ndarray:
        jj = np.clip(j, 0, n - 1)
        return np.where((j >= 0) & (j < n) & (t.doc[jj] == t.doc), run[jj] * 200 + shape[jj], -1)

    own = shape * 2 + t.glued
    before, after = at(own, -1), at(own, 1)
    prev, nxt = beyond(start[run_of] - 1), beyond(stop[run_of] + 1)
    cols = [own, run, run * 131 + shape, lex * 512 + own, np.zeros(n, np.int64), prev * 131 + shape, nxt * 131 + shape, prev * 3 + run, nxt * 5 + run]
    cols += [before * 512 + own, own * 512 + after, (before * 512 + own) * 512 + after, (at(own, -2) * 512 + before) * 512 + own, (own * 512 + after) * 512 + at(own, 2)]
    cols += [(at(lex, k) + 1) * 512 + own for k in (-1, -2, -3, -4)]
    name = np.where(t.word & (t.digits == 0), 1 + t.cap + 2 * t.sentence + 4 * seen + 8 * named, 0)
    cols += [named * 512 + own, name, (at(named, -1) * 4 + at(named, 1)) * 64 + name]
    return np.stack([(mix(c.astype(np.int64).view(np.uint64) * np.uint64(64) + np.uint64(k)) & np.uint64(HASH - 1)).astype(np.int32) for k, c in enumerate(cols)], axis=1)


def scores(w: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Sum of the weights of each token's features; tokens with equal features are added up once."""
    h = np.zeros(len(features), np.uint64)
    for k in range(features.shape[1]):
        h = (h ^ features[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, some, which = np.unique(h, return_index=True, return_inverse=True)
    out = np.zeros((len(some), w.shape[1]), w.dtype)
    for k in range(features.shape[1]):
        out += w[features[some, k]]
    return out[which]


def propagate(unary: np.ndarray, first: np.ndarray, skip: np.ndarray, t: np.ndarray, s: np.ndarray, rounds: int | None = None, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loopy sum-product: (marginals of tokens; if asked for, of chain links, one for each token that isn't first, and of skip links).

    Segments of the chains are swept forwards and backwards; a segment is swept again only if a message into it
    has changed by TOLERANCE. Without a number of rounds it goes on until none does; messages
    that still swing after many rounds are damped more and more.
    """
    n, k = unary.shape
    position = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    cut = position % SEGMENT == 0
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, n))
    segment = np.cumsum(cut) - 1
    inner = np.flatnonzero(~first[begin])  # segments that continue another
    pt, ps = np.exp(t).astype(unary.dtype), np.exp(s).astype(unary.dtype)
    e = len(skip)
    src, dst = np.concatenate([skip[:, 0], skip[:, 1]]), np.concatenate([skip[:, 1], skip[:, 0]])
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    into = np.argsort(dst, kind="stable")
    heads = np.flatnonzero(np.append(True, dst[into][1:] != dst[into][:-1])) if e else np.zeros(0, np.int64)
    target = dst[into][heads]
    # To begin with, what unary evidence alone says, at the other end of a link and in the tokens next to a cut.
    p = np.exp(unary[src] - unary[src].max(axis=1, keepdims=True))
    m = np.concatenate([p[:e] @ ps, p[e:] @ ps.T])
    m /= m.sum(axis=1, keepdims=True)
    log_m = np.log(m + 1e-30)
    left, right = np.full((len(begin), k), 1 / k, unary.dtype), np.full((len(begin), k), 1 / k, unary.dtype)
    if len(inner):
        f, b = left[inner], right[inner]
        for i in range(min(NEAR, SEGMENT)):
            u = unary[begin[inner] - min(NEAR, SEGMENT) + i]
            f = (np.exp(u - u.max(axis=1, keepdims=True)) * f) @ pt
            f /= f.sum(axis=1, keepdims=True)
            row = min(NEAR, SEGMENT) - 1 - i
            some = np.flatnonzero(size[inner] > row)
            u = unary[begin[inner[some]] + row]
            g = (np.exp(u - u.max(axis=1, keepdims=True)) * b[some]) @ pt.T
            b[some] = g / g.sum(axis=1, keepdims=True)
        left[inner], right[inner - 1] = f, b
    local, ahead, behind = np.zeros_like(unary), np.zeros_like(unary), np.zeros_like(unary)
    belief = np.zeros_like(unary)
    active, waiting = np.ones(len(begin), bool), np.zeros(2 * e, bool)
    extra = np.zeros_like(unary)
    done, step = 0, 1 - DAMPING
    while n:
        if e:
            extra[target] = np.add.reduceat(log_m[into], heads, axis=0)
        todo = np.flatnonzero(active)
        todo = todo[np.argsort(-size[todo], kind="stable")]
        _sweep(unary, extra, todo, begin, size, left, right, pt, local, ahead, behind, belief)
        turn, active = active, np.zeros(len(begin), bool)
        if len(inner):
            last = begin[inner] - 1
            for held, fresh, place in ((left, ahead[last] @ pt, inner), (right, (local * behind)[begin[inner]] @ pt.T, inner - 1)):
                fresh /= fresh.sum(axis=1, keepdims=True)
                changed = np.abs(fresh - held[place]).max(axis=1) >= TOLERANCE
                held[place] = fresh
                active[place[changed]] = True
        if e:
            go = np.flatnonzero(turn[segment[src]] | waiting)
            cavity = np.log(belief[src[go]] + 1e-30) - log_m[back[go]]
            p = np.exp(cavity - cavity.max(axis=1, keepdims=True))
            fresh = np.where((go < e)[:, None], p @ ps, p @ ps.T)
            fresh /= fresh.sum(axis=1, keepdims=True)
            changed = np.abs(fresh - m[go]).max(axis=1) >= TOLERANCE
            m[go] = (1 - step) * m[go] + step * fresh
            log_m[go] = np.log(m[go] + 1e-30)
            waiting[go] = changed
            active[segment[dst[go[changed]]]] = True
        done += 1
        if not active.any() or done == rounds:
            break
        if rounds is None and done % (100 + e // 50) == 0:
            step /= 2
            if step < 0.01:
                break
    if not pairs:
        return belief, None, None
    to = np.flatnonzero(~first)
    chain = ahead[to - 1][:, :, None] * pt * (local * behind)[to][:, None, :]
    chain /= chain.sum(axis=(1, 2), keepdims=True)
    cavity = np.log(belief[src] + 1e-30) - log_m[back]
    p = np.exp(cavity - cavity.max(axis=1, keepdims=True))
    far = p[:e, :, None] * ps * p[e:, None, :]
    return belief, chain, far / far.sum(axis=(1, 2), keepdims=True)


def _sweep(unary, extra, todo, begin, size, left, right, pt, local, ahead, behind, belief) -> None:
    """Forward and backward messages of the segments todo, longest first: local evidence, what comes from before with it, what comes from behind."""
    start, length = begin[todo], size[todo]
    width = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left").tolist()  # segments longer than each step
    at = np.concatenate([np.zeros(0, np.int64), *(start[:a] + i for i, a in enumerate(width))])  # step by step
    u = unary[at] + extra[at]
    own = np.exp(u - u.max(axis=1, keepdims=True))
    forth, rest, back = np.empty_like(own), np.empty_like(own), pt.T
    cut = np.cumsum([0, *width])
    f = left[todo]
    for i, a in enumerate(width):
        f = np.multiply(own[cut[i] : cut[i] + a], f if i == 0 else f[:a] @ pt, out=forth[cut[i] : cut[i] + a])
        if i % 4 == 3:
            f /= f.sum(axis=1, keepdims=True)
    b = right[todo]
    for i in range(len(width) - 1, -1, -1):
        if i + 1 < len(width):
            a = width[i + 1]
            g = (own[cut[i + 1] : cut[i + 1] + a] * b[:a]) @ back
            if i % 4 == 3:
                g /= g.sum(axis=1, keepdims=True)
            b[:a] = g
        rest[cut[i] : cut[i + 1]] = b[: width[i]]
    both = forth * rest
    local[at], ahead[at], behind[at], belief[at] = own, forth, rest, both / both.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """Weights of features by labels, of label pairs in the chain, and of label pairs across skip links."""

    w: np.ndarray
    t: np.ndarray
    s: np.ndarray

    def labels(self, g: Graph) -> np.ndarray:
        """Best label of each token by its marginal."""
        return self.marginals(g).argmax(axis=1) if len(g.doc) else np.zeros(0, np.int64)

    def marginals(self, g: Graph) -> np.ndarray:
        """Belief of each token."""
        return propagate(scores(self.w, g.features), g.first, g.skip, self.t, self.s)[0]


def gold(g: Graph, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Label of each token from labelled spans per text."""
    y = np.zeros(len(g.doc), np.int64)
    for i, (d, a, b) in enumerate(zip(g.doc.tolist(), g.start.tolist(), g.end.tolist())):
        for s, e, k in spans[d]:
            if s <= a and b <= e:
                y[i] = k
    return y


def fit(texts: list[str], spans: list[list[tuple[int, int, int]]], epochs: int = EPOCHS) -> Model:
    """Weights by gradient ascent on the Bethe likelihood of BATCH texts at a time, with Adam and an L2 penalty."""
    k = len(LABELS)
    parts = []
    for i in range(0, len(texts), BATCH):
        g = build(texts[i : i + BATCH])
        y = gold(g, spans[i : i + BATCH])
        chain, skip = np.zeros((k, k)), np.zeros((k, k))
        to = np.flatnonzero(~g.first)
        np.add.at(chain, (y[to - 1], y[to]), 1)
        np.add.at(skip, (y[g.skip[:, 0]], y[g.skip[:, 1]]), 1)
        order = np.argsort(g.features, axis=None, kind="stable")
        flat = g.features.ravel()[order]
        heads = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        parts.append((g, np.eye(k)[y], chain, skip, order // g.features.shape[1], flat[heads], heads))
    params = [np.zeros((HASH, k)), np.zeros((k, k)), np.zeros((k, k))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps = epochs * len(parts)
    for step in range(1, steps + 1):
        g, hot, chain, skip, token, feature, heads = parts[step % len(parts)]
        w, t, s = params
        node, c, e = propagate(scores(w, g.features), g.first, g.skip, t, s, ROUNDS, pairs=True)
        grad = -0.01 * w
        grad[feature] += np.add.reduceat((hot - node)[token], heads, axis=0)
        grad_s = skip - e.sum(axis=0)
        rate = 0.15 * (1 - step / (steps + 1))
        for p, d, a, b in zip(params, [grad, chain - c.sum(axis=0) - 0.01 * t, (grad_s + grad_s.T) / 2 - 0.01 * s], first, second):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return Model(*params)


def settings() -> str:
    """Digest of what the weights depend on: the corpus, the features and the fitting."""
    parts = (_tokens, _lexicon, _lookup, _introduced, _shape, _runs, build, _among, _features, scores, propagate, _sweep, fit)
    known = repr((TRAIN_TEXTS, BATCH, EPOCHS, ROUNDS, TOLERANCE, DAMPING, HASH, SEGMENT, NEAR, NAME_WORDS, _RUN, _WORDS, _TITLES, _PARTICLES))
    return hashlib.sha256("".join([known, inspect.getsource(pii_corpus), *map(inspect.getsource, parts)]).encode()).hexdigest()


@lru_cache(1)
def trained() -> Model:
    """The fitted model."""
    held = np.load(WEIGHTS)
    w = np.zeros((HASH, len(LABELS)), np.float32)
    w[held["row"]] = held["w"]
    return Model(w, held["t"].astype(np.float32), held["s"].astype(np.float32))


def entities(model: Model, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Per text, (start, end, label) of its entities in order: neighbouring tokens of one label, with at most one space between."""
    g = build(texts)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    y = model.labels(g)
    some = np.flatnonzero(y)
    for d, a, b, k in zip(g.doc[some].tolist(), g.start[some].tolist(), g.end[some].tolist(), y[some].tolist()):
        found = out[d]
        if found and found[-1][2] == LABELS[k] and texts[d][found[-1][1] : a] in ("", " "):
            found[-1] = (found[-1][0], b, LABELS[k])
        else:
            found.append((a, b, LABELS[k]))
    return out


def find(model: Model, texts: pa.Array):
    """(row, text, entities) of the texts with entities; texts without nulls."""
    strings = texts.to_pylist()
    for r, found in enumerate(entities(model, strings)):
        if found:
            yield r, strings[r], found


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each entity replaced by its label in brackets."""
    out, at = [], 0
    for a, b, label in found:
        out += [text[at:a], f"[{label}]"]
        at = b
    return "".join(out) + text[at:]


_SCHEMA = "doc_id long, n_entities long, entities array<struct<start:long,end:long,label:string>>, redacted string"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_entities, entities, redacted) of the rows with personal data."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def run(batches):
        for b in batches:
            for row, part in slices(b.column(1), PART):
                hits = list(find(shared.value, part))
                if hits:
                    yield pa.record_batch(
                        {
                            "doc_id": b.column(0).slice(row, len(part)).take(pa.array([r for r, _, _ in hits])),
                            "n_entities": pa.array([len(f) for _, _, f in hits], pa.int64()),
                            "entities": pa.array([[dict(zip(("start", "end", "label"), x)) for x in f] for _, _, f in hits], kind),
                            "redacted": pa.array([redact(t, f) for _, t, f in hits], pa.string()),
                        }
                    )

    return pick(docs, "doc_id", "text").mapInArrow(lean(run), _SCHEMA)


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows of docs, in all columns as they are but text, redacted, and n_chars, if there, set to the new length."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    names = docs.columns
    at, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for whole in batches:
            for row, part in slices(whole.column(at), PART):
                b = whole.slice(row, len(part))
                found = list(find(shared.value, part))
                if found:
                    texts = b.column(at).to_pylist()
                    for r, t, f in found:
                        texts[r] = redact(t, f)
                    cols = list(b.columns)
                    cols[at] = pa.array(texts, b.column(at).type)
                    if length is not None:
                        changed = pc.not_equal(cols[at], b.column(at)).fill_null(False)
                        cols[length] = pc.if_else(changed, pc.utf8_length(cols[at]).cast(cols[length].type), cols[length])
                    b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
                yield b

    return map_rows(docs, lean(run))


def main() -> None:
    """Fit the weights and write them."""
    m = fit(*corpus(TRAIN_TEXTS, seed=10))
    row = np.flatnonzero(np.abs(m.w).max(axis=1) > 1e-3)
    np.savez_compressed(WEIGHTS, row=row.astype(np.int32), w=m.w[row].astype(np.float16), t=m.t, s=m.s, settings=settings())


if __name__ == "__main__":
    main()
