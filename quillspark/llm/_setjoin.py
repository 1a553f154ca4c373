"""Exact Jaccard self-join of documents seen as sets of 64-bit tokens.

1. One pass makes each document's set, names it by a digest and counts, over all
   documents, how many sets hold each token and each word, in tables of fixed size
   (BUCKETS) addressed by hash; a token's count is the smaller of its two places. The
   counts only sort tokens into classes and order them, so shared places cost time at
   most, never a result.
2. Documents with equal sets collapse into one set.
3. Class c holds the tokens of which a combination of c, but not of fewer, is expected in
   at most POSTING of the N sets if tokens are independent: those in up to
   N (POSTING / N)^(1 / c) sets. The bounds move with N.
   Each set, ordered from rare tokens to frequent ones, emits signatures from a prefix:
   tokens of class 1 singly, those of class c in combinations of c within groups.
   Groups divide the tokens of a class by hash, the more the larger the set, so the
   number of combinations is linear in the size of the set whatever the classes.
   The g tokens of a group survive the loss of g - c; the prefix is extended until the
   sum of max(0, g - c + 1) over singles and groups is the number of tokens that a partner
   may lack plus k. Each lacking token lowers that sum by one at most, so at least k
   signatures of two similar sets are equal. Grouping depends on the binary logarithm
   of the size; a set whose longer partners may be grouped otherwise emits the
   combinations of that grouping as well.
4. Signatures are sent, sorted and packed, to the partition of their hash. There each
   list of sets with one signature lies in order of length, and a set is compared with
   the stretch from its own length to its length / threshold. Pairs with k equal signatures,
   whose first common positions allow the threshold, are candidates. What is shared from
   the j-th common signature on is bounded by its positions, so those too far back to be
   among the first k are left out before counting.
   The two tokens of least hash under a seed, of classes 1 and 2, name a family of the set,
   which is one more signature; there is a family for each of three seeds. Sets of one family
   are compared with each other by it, once, and aren't met again by their many equal ordinary
   signatures. As class 2 grows with N, variants of one text stay families however many they are.
   Candidates leave a partition in portions, whose counts are added up later, so a task's memory
   doesn't grow with their number.
5. Candidates are grouped around the smallest set that they are candidates with, large
   groups split in blocks, so that each set travels once for many pairs; the overlap
   of the whole sets is counted there. Where only connection is asked for, pairs that those
   before have connected are passed over; where numbers of links are, they are added up there.

Nothing is capped or sampled, and no step changes its way with the size of the input but for
joins of facts about sets, which are broadcast up to BROADCAST_IDS rows and shuffled beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._store import discard, materialise, pick
from ._vec import lean, mix, slices, trim

BUCKETS = 1 << 20
CHUNK = 1 << 15
#: Places of the tables: two for tokens, one for words.
TABLES = 3
#: Signatures that a task sorts and packs at a time, and those that a partition gets on average.
FLUSH, PER_PARTITION = 1 << 20, 2 << 20
#: Pairs compared at a time in a partition.
EXPAND = 1 << 19

#: texts without nulls -> tokens as uint64, repeats allowed, the hashes of two words of each, and where each text's begin
SetMaker = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Join:
    """What to join: how sets are made, the threshold, how many sets a signature may be expected in, and how many signatures must be common (k)."""

    sets: SetMaker
    threshold: float
    posting: int = 1000
    common: int = 8


@dataclass
class Sets:
    """Distinct tokens of the sets of one slice, set by set, ascending in each: ids, digests, where each begins; the words of each token."""

    doc_id: pa.Array
    digest: np.ndarray
    at: np.ndarray
    token: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.at)


def _segments(token: np.ndarray, doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Order by (doc, keys, token); doc and keys are small numbers, for which a stable sort is a radix sort."""
    order = np.argsort(token)
    for key in (*keys, doc):
        for shift in range(0, max(1, int(key.max(initial=0)).bit_length()), 16):
            order = order[np.argsort((key[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def _sets(batches, maker: SetMaker) -> Iterator[Sets]:
    """The sets of slices of (doc_id, text) batches, without null ids and empty sets."""
    for b in batches:
        for row, texts in slices(b.column(1)):
            token, first, last, at = maker(texts)
            n = np.diff(at)
            good = np.asarray(b.column(0).slice(row, len(texts)).is_valid()) & (n > 0)
            doc = np.repeat(np.arange(len(texts)), n)
            order = _segments(token, doc)
            order = order[good[doc[order]]]
            s, d = token[order], doc[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            order, s, d = order[new], s[new], d[new]
            rows = np.flatnonzero(good)
            if not len(rows):
                continue
            cuts = np.append(np.flatnonzero(np.append(True, d[1:] != d[:-1])), len(d))
            h = np.add.reduceat(mix(s + np.uint64(0x632BE59BD9B4E019)), cuts[:-1]) + np.diff(cuts).astype(np.uint64)
            yield Sets(b.column(0).slice(row, len(texts)).take(pa.array(rows)), (mix(h) >> np.uint64(1)).astype(np.int64), cuts, s, first[order], last[order])


def bucket(h: np.ndarray) -> np.ndarray:
    """Place of a hash in the tables."""
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def second(h: np.ndarray) -> np.ndarray:
    """Its place in the other table of tokens."""
    return (h >> np.uint64(40) & np.uint64(BUCKETS - 1)).astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers as one compressed string, byte by byte in planes."""
    head, body = [len(columns)], []
    for c in columns:
        c = np.ascontiguousarray(c, np.uint64)
        width = max(1, (int(c.max(initial=0)).bit_length() + 7) // 8)
        head += [len(c), width]
        body.append(c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns of pack, in 4 bytes where they fit, else 8."""
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    head, at, out = raw[8 : 8 + 16 * n].view(np.int64).reshape(n, 2), 8 + 16 * n, []
    for rows, width in head.tolist():
        c = np.zeros((rows, 4 if width <= 4 else 8), np.uint8)
        c[:, :width] = raw[at : at + rows * width].reshape(width, rows).T
        out.append(c.view(np.uint32 if width <= 4 else np.uint64)[:, 0])
        at += rows * width
    return out


def profile(docs: DataFrame, job: Join) -> DataFrame:
    """One pass: rows (doc_id, set_id, n) of documents, and rows (chunk, counts) of the tables; chunk -1 has the number of sets."""

    def run(batches):
        table = np.zeros(TABLES * BUCKETS, np.int64)
        seen: set[int] = set()  # sets, not documents, are counted
        for x in _sets(batches, job.sets):
            names, n = x.digest.tolist(), x.size
            new = np.array([i not in seen and not seen.add(i) for i in names])
            of = np.repeat(np.arange(len(n)), n)
            mine = new[of]
            word = np.concatenate([x.first[mine], x.last[mine]])
            owner = np.concatenate([of[mine], of[mine]])
            both = np.unique(owner.astype(np.uint64) << np.uint64(20) | bucket(word).astype(np.uint64))  # a slice has fewer than 2**44 texts
            for k, place in enumerate((bucket(x.token[mine]), second(x.token[mine]), (both & np.uint64(BUCKETS - 1)).astype(np.int64))):
                table[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(place, minlength=BUCKETS)
            m = len(n)
            yield pa.record_batch({"doc_id": x.doc_id, "set_id": pa.array(x.digest), "n": pa.array(n, pa.int32()), "chunk": pa.nulls(m, pa.int32()), "counts": pa.nulls(m, pa.binary())})
        for k in range(TABLES * BUCKETS // CHUNK):
            part = table[k * CHUNK : (k + 1) * CHUNK]
            if part.any():
                yield _counts(k, part)
        if seen:
            yield _counts(-1, np.array([len(seen)]))

    return materialise(pick(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, set_id long, n int, chunk int, counts binary"), "sets")


def _counts(k: int, part: np.ndarray) -> pa.RecordBatch:
    null = pa.nulls(1, pa.int64())
    return pa.record_batch({"doc_id": null, "set_id": null, "n": pa.nulls(1, pa.int32()), "chunk": pa.array([k], pa.int32()), "counts": pa.array([pack(part)], pa.binary())})


def token_counts(prof: DataFrame) -> tuple[np.ndarray, int]:
    """(the tables added up over all tasks, as many counts however large the input; number of sets)."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + unpack(x)[0].astype(np.int64)
        if total:
            yield pa.record_batch({"chunk": pa.array(list(total), pa.int32()), "counts": pa.array([pack(x) for x in total.values()], pa.binary())})

    rows = prof.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(lean(add), "chunk int, counts binary").collect()
    table, n = np.zeros(TABLES * BUCKETS, np.int64), 0
    for r in rows:
        (part,) = unpack(r.counts)
        if r.chunk < 0:
            n = int(part[0])
        else:
            table[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = part
    return table, n


def frequencies(table: np.ndarray, n: int, posting: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each place of tokens in the first table and in the second; logarithm of the count of each place of words, in steps).

    What other tokens put into a place is about the mean; the bounds of the classes stay clear of its scatter.
    """
    classes = []
    for k in range(2):
        tokens = table[k * BUCKETS : (k + 1) * BUCKETS].astype(np.int64)
        mean = tokens.mean()
        est, noise = tokens - int(mean), int(6 * mean**0.5)
        share = min(1.0, posting / max(n, 1))
        classes.append(1 + (est > n * share + noise).astype(np.int8) + (est > n * share**0.5 + noise).astype(np.int8))
    words = table[2 * BUCKETS :].astype(np.int64)
    return classes[0], classes[1], np.log(np.maximum(words - int(words.mean()), 1)).astype(np.float32)


def lacking(n: np.ndarray, share: float) -> np.ndarray:
    """Of n tokens, how many a partner may lack if it must hold at least share * n of them."""
    return n - np.ceil(share * n - 1e-9).astype(np.int64)


def tiny(t: float) -> tuple[int, int]:
    """(sets up to this size may have too few combinations; partners of those are up to this size): they emit single tokens of any class."""
    low = 1
    while np.ceil(t * low - 1e-9) < 4:  # one group of class 2 and one of class 3 cost up to 3 tokens
        low += 1
    return low - 1, int((low - 1) / t + 1e-9)


def _room(level: int, t: float) -> int:
    """Tokens that groups may cost a set of 2**level tokens, or its shorter partner, so that enough combinations remain."""
    return int(min(t, 2 * t * t / (1 + t)) * 2**level + 1e-9) - 1


def n_groups(level: int, t: float) -> tuple[int, int]:
    """Groups of class 2 and of class 3. A group of class c may cost c - 1 tokens: together within the room."""
    room = max(3, _room(level, t))
    return max(1, room // 2), max(1, (room - max(1, room // 2)) // 2)


#: Seeds of single tokens of small sets and of the tokens that name a family, for each family of a set.
_PLAIN, _FAMILY = np.uint64(0x5851F42D4C957F2D), (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))
_NONE = np.uint64(2**64 - 1)


@dataclass
class Signatures:
    """Signatures of the sets of one slice: which set, signature, position and kind (bit 0: of the shorter side's prefix; bit 1: of a family, its number being the position); of each set k and its families, 0 for none."""

    owner: np.ndarray
    sig: np.ndarray
    pos: np.ndarray
    kind: np.ndarray
    k: np.ndarray
    family: np.ndarray


def _level(n: float) -> int:
    """Binary logarithm of a size, which groups depend on."""
    return max(0, int(n).bit_length() - 1)


def combinations(s: np.ndarray, classes: np.ndarray, begin: int, level: int, t: float, need: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, position, is it of the prefix that needs `need`) of combinations of the ordered tokens from begin on, in the prefix in which `upto` of them and singles survive."""
    rest, cls = s[begin:], classes[begin:]
    m2, m3 = n_groups(level, t)
    h = mix(rest ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64))
    group = np.where(cls == 2, h % np.uint64(m2), np.uint64(m2) + h % np.uint64(m3)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    g = group[order]
    begins = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    turn = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
    survive = np.zeros(len(g), np.int64)
    survive[order] = turn >= cls[order] - 1
    total = begin + np.cumsum(survive)
    ends = [int(np.searchsorted(total, x)) + 1 if begin < x else 0 for x in (need, upto)]
    order = order[order < ends[1]]
    g, c = group[order], cls[order]
    salt = np.uint64(level + 1)
    out = []
    most = int(np.unique(g, return_counts=True)[1].max(initial=0))
    for a in range(1, most):
        same = np.flatnonzero(g[:-a] == g[a:])
        two = same[c[same] == 2]
        x, y = order[two], order[two + a]
        out.append((mix(mix(rest[x] * np.uint64(0xC2B2AE3D27D4EB4F) + rest[y]) + salt), y, m2))
        for b in range(a + 1, most):
            three = np.flatnonzero((g[:-b] == g[b:]) & (c[:-b] == 3)) if len(g) > b else np.zeros(0, np.int64)
            x, y, z = order[three], order[three + a], order[three + b]
            out.append((mix(mix(mix(rest[x] * np.uint64(0xC2B2AE3D27D4EB4F) + rest[y]) * np.uint64(0xC2B2AE3D27D4EB4F) + rest[z]) + salt), z, m2 + 2 * m3))
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
    last = np.concatenate([y for _, y, _ in out])
    # Before a combination, one token of each group of class 2 and two of each of class 3 may be shared unseen.
    unseen = np.concatenate([np.full(len(y), u) for _, y, u in out])
    return np.concatenate([x for x, _, _ in out]), np.maximum(begin + last - unseen, 0), last < ends[0]


def signatures(x: Sets, classes: np.ndarray, weight: np.ndarray, t: float, common: int) -> Signatures:
    """Signatures of the sets, given the class of each token and its weight in the order of a class (0 to 2**14 - 1)."""
    n, at = x.size, x.at
    of = np.repeat(np.arange(len(n)), n)
    order = np.argsort(((classes.astype(np.int64) - 1) << 14 | weight).astype(np.uint16), kind="stable")
    for shift in range(0, max(1, len(n).bit_length()), 16):
        order = order[np.argsort((of[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    s, c = x.token[order], classes[order]
    rank = np.arange(len(s)) - at[of]
    c1 = np.add.reduceat(c == 1, at[:-1], dtype=np.int64)
    long, short = lacking(n, t), lacking(n, 2 * t / (1 + t))
    low, high = tiny(t)
    # The prefix is extended for k only as far as rare tokens reach.
    k = np.where(n <= high, 1, np.clip(c1 - long, 1, common))
    ends = np.where(n <= low, 0, np.minimum(c1, long + k))
    one = np.flatnonzero(rank < ends[of])
    owner, sig, pos, kind = [of[one]], [s[one]], [rank[one]], [(rank[one] < (short + k)[of[one]]).astype(np.int64)]
    for i in np.flatnonzero((n > low) & (c1 < long + k)).tolist():
        own, begin = slice(at[i], at[i + 1]), int(c1[i])
        levels = range(_level(n[i]), _level(n[i] / t + 1e-9) + 1)
        for level in levels:  # longer partners may be grouped by a higher level
            need = int(short[i] + k[i])
            h, p, is_short = combinations(s[own], c[own], begin, level, t, need, int(long[i] + k[i]) if level == levels[0] else need)
            owner, sig, pos, kind = owner + [np.full(len(h), i)], sig + [h], pos + [p], kind + [is_short.astype(np.int64)]
    small = np.flatnonzero((n <= high)[of] & (rank <= long[of]))
    owner, sig, pos, kind = owner + [of[small]], sig + [mix(s[small] ^ _PLAIN)], pos + [rank[small]], kind + [(rank[small] <= short[of[small]]).astype(np.int64)]
    family = np.zeros((len(n), len(_FAMILY)), np.uint64)
    for j, seed in enumerate(_FAMILY):
        h = mix(s ^ seed)
        h[c == 3] = _NONE
        one = np.minimum.reduceat(h, at[:-1])
        h[h == one[of]] = _NONE
        two = np.minimum.reduceat(h, at[:-1])
        some = np.flatnonzero((two != _NONE) | (c1 > 0))  # a single token names a family only if it is rare
        family[some, j] = mix(mix(one[some]) + two[some]) >> np.uint64(32) | np.uint64(1)
        owner, sig, pos, kind = owner + [some], sig + [mix(family[some, j] + seed)], pos + [np.full(len(some), j)], kind + [np.full(len(some), 3)]
    return Signatures(np.concatenate(owner), np.concatenate(sig), np.concatenate(pos), np.concatenate(kind), k, family)


def _emit(docs: DataFrame, job: Join, table: np.ndarray, n_sets: int, parts: int) -> DataFrame:
    """Rows (p, packed) of signatures by partition: of each, 48 bits, set, position and kind; of each set its id, size, k and families."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(table, n_sets, job.posting))

    def flush(held: list[tuple[np.ndarray, ...]]):
        sig, owner, meta, *facts = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.argsort(sig)
        sig, owner, meta = sig[order], owner[order], meta[order]
        cuts = np.searchsorted((sig >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[p], cuts[p + 1])
            used, local = np.unique(owner[own], return_inverse=True)
            yield p, pack(np.diff(sig[own], prepend=np.uint64(0)), local, meta[own], *(f[used] for f in facts))

    def run(batches):
        (one, two, words), seen, held, n, sets = shared.value, set(), [], 0, 0

        def out():
            rows = list(flush(held))
            return pa.record_batch({"p": pa.array([p for p, _ in rows], pa.int32()), "packed": pa.array([x for _, x in rows], pa.binary())})

        for x in _sets(batches, job.sets):
            new = np.array([i not in seen and not seen.add(i) for i in x.digest.tolist()])
            classes = np.minimum(one[bucket(x.token)], two[second(x.token)])
            weight = np.minimum(256 * (words[bucket(x.first)] + words[bucket(x.last)]), (1 << 14) - 1).astype(np.int64)
            g = signatures(x, classes, weight, job.threshold, job.common)
            own = new[g.owner]
            place = (sets + np.cumsum(new) - 1)[g.owner[own]].astype(np.uint32)
            held.append((g.sig[own] >> np.uint64(16), place, (g.pos << 2 | g.kind)[own].astype(np.uint32), x.digest[new], x.size[new], g.k[new], *g.family[new].T))
            n, sets = n + int(own.sum()), sets + int(new.sum())
            if n >= FLUSH:
                yield out()
                n = sets = 0
        if n:
            yield out()

    return pick(docs, "doc_id", "text").mapInArrow(lean(run), "p int, packed binary")


def met(blobs: list[bytes], t: float) -> Iterator[dict[str, np.ndarray]]:
    """Portions of the pairs of sets of one partition, a the shorter: how many signatures they share here (c), how many they must (k), and a bound on their overlap (most).

    A pair may come in several portions, over which c is to be added up. Rows with a negative c are members of families: a is the key under
    which set b is to be compared, na and nb its first two families, and -c - 1 its side there plus SIDES times the number of the family.
    """
    cols = [unpack(blobs.pop()) for _ in range(len(blobs))]
    sizes = np.cumsum([0] + [len(c[3]) for c in cols])
    sig = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in cols])
    who = np.concatenate([c[1].astype(np.uint32) + np.uint32(s) for c, s in zip(cols, sizes)])
    meta = np.concatenate([c[2].astype(np.uint32) for c in cols])
    ids, n, k = (np.concatenate([c[j] for c in cols]).astype(np.int64) for j in range(3, 6))
    family = [np.concatenate([c[j] for c in cols]).astype(np.uint32) for j in range(6, 6 + len(_FAMILY))]
    del cols
    # Sets in the order of their length, each once, wherever it was met.
    order = np.lexsort((ids, n))
    fresh = np.append(True, ids[order][1:] != ids[order][:-1])
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(fresh) - 1
    order = order[fresh]
    ids, n, k, family = ids[order], n[order], k[order], [f[order] for f in family]
    who = place[who]
    # Signatures of one set alone are of no use.
    order = np.argsort(sig)
    x = sig[order]
    twice = np.zeros(len(x) + 1, bool)
    twice[1:-1] = x[1:] == x[:-1]
    order = order[twice[1:] | twice[:-1]]
    order = order[np.lexsort((who[order], sig[order]))]
    sig, who, meta = sig[order], who[order], meta[order].astype(np.int64)
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
    sig, who, meta = sig[fresh], who[fresh], meta[fresh]
    # Each list lies in order of length: a set meets those after it up to its length / t.
    run = np.cumsum(np.append(True, sig[1:] != sig[:-1])[: len(sig)]) << 32
    upto = np.searchsorted(run | n[who], run | np.floor((n[who] + 1e-9) / t).astype(np.int64), side="right")
    kind, pos = meta >> 1 & 1, meta >> 2
    count = np.where((meta & 1 == 1) & (kind == 0), upto - np.arange(len(who)) - 1, 0)
    key, w, side = _members(sig, np.flatnonzero(kind), who, upto, n, t, pos, family)
    none = np.zeros(len(w), np.int64)
    yield {"a": key, "b": ids[w], "na": family[0][w].view(np.int32), "nb": family[1][w].view(np.int32), "k": none, "c": -1 - side, "most": none}
    del key, w, side, none
    crowds = _crowds(sig, count, who, family[0])
    for begin, end, _ in crowds:
        count[begin:end] = 0
    del sig, run

    def expanded():
        """Pairs of rows of one list, the shorter set's first."""
        total = np.cumsum(count)
        row = 0
        while row < len(count):
            stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + EXPAND, side="right")))
            c = count[row:stop]
            if (m := int(c.sum())) > 0:
                a = np.repeat(np.arange(row, stop), c)
                yield a, a + 1 + np.arange(m) - np.repeat(np.cumsum(c) - c, c)
            row = stop
        for begin, end, rest in crowds:  # pairs within the crowd are left to its family
            every, step = np.arange(begin, end), max(1, EXPAND // (end - begin))
            outside = np.zeros(end - begin, bool)
            outside[rest - begin] = True
            for i in range(0, len(rest), step):
                x, y = np.repeat(every, len(rest[i : i + step])), np.tile(rest[i : i + step], end - begin)
                ok = ~outside[x - begin] | (x < y)
                a, b = np.minimum(x[ok], y[ok]), np.maximum(x[ok], y[ok])
                ok = (meta[a] & 1 == 1) & (kind[a] == 0) & (b < upto[a])
                yield a[ok], b[ok]

    def portion(key, c, most):
        wa, wb = key >> 32, key & 0xFFFFFFFF
        return {"a": ids[wa], "b": ids[wb], "na": n[wa], "nb": n[wb], "k": np.minimum(k[wa], k[wb]), "c": c, "most": most}

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in expanded():
        ok = kind[a] == kind[b]
        a, b = a[ok], b[ok]
        wa, wb = who[a], who[b]
        most = np.minimum(n[wa] - pos[a], n[wb] - pos[b])
        ok = most >= t / (1 + t) * (n[wa] + n[wb]) - 1e-9 - (np.minimum(k[wa], k[wb]) - 1)
        for f in family:
            ok &= (f[wa] != f[wb]) | (f[wa] == 0)
        found.append(_tally((wa << 32 | wb)[ok], np.ones(int(ok.sum()), np.int64), most[ok]))
        if sum(len(x[0]) for x in found) > 2 * EXPAND:
            found = [_tally(*map(np.concatenate, zip(*found)))]
            if len(found[0][0]) > EXPAND:
                yield portion(*found.pop())
    if found:
        yield portion(*_tally(*map(np.concatenate, zip(*found))))


#: Sets in a list from which on a family that most of them belong to is set apart.
CROWD = 64


def _crowds(sig: np.ndarray, count: np.ndarray, who: np.ndarray, family: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(begin, end, rows that don't belong to the family of most sets) of the long lists with pairs of which one family has the most."""
    heads = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(sig))
    out = []
    for i in np.flatnonzero(ends - heads >= CROWD).tolist():
        own = family[who[heads[i] : ends[i]]]
        middle = np.partition(own, len(own) // 2)[len(own) // 2]  # that of more than half, if one is
        if middle and count[heads[i] : ends[i]].any() and (own == middle).sum() * 2 > len(own):
            out.append((int(heads[i]), int(ends[i]), heads[i] + np.flatnonzero(own != middle)))
    return out


#: Sides of a family's key: the first of two blocks, the second, or the only one.
FIRST, SECOND, ONLY, SIDES = 0, 1, 2, 3


def _members(sig: np.ndarray, at: np.ndarray, who: np.ndarray, upto: np.ndarray, n: np.ndarray, t: float, turn: np.ndarray | None = None, family: list[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set, side plus SIDES times the family's number) of the sets of families with a partner of fitting length; at: their rows.

    Families go in blocks of BLOCK sets, and each two blocks with fitting lengths have a key, unless they have an earlier one of the families in common.
    turn: the number of the family of each row; family: the families of each set.
    """
    keys, sets, sides = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    turn = np.zeros(len(sig), np.int64) if turn is None else turn
    partner = upto[at] > at + 1
    partner[1:] |= (sig[at[1:]] == sig[at[:-1]]) & (upto[at[:-1]] > at[1:])
    at = at[partner]
    heads = np.flatnonzero(np.append(True, sig[at][1:] != sig[at][:-1])) if len(at) else at
    ends = np.append(heads[1:], len(at))
    fresh = np.ones(len(heads), bool)
    for i, f in enumerate(family):
        if len(heads):
            x = f[who[at]]
            fresh &= (turn[at[heads]] <= i) | (x[heads] == 0) | (np.minimum.reduceat(x, heads) != np.maximum.reduceat(x, heads))
    for a, b in zip(heads[fresh].tolist(), ends[fresh].tolist()):
        own, number = who[at[a:b]], int(turn[at[a]])
        if number:
            own = own[np.lexsort((n[own], *(f[own] for f in family[:number][::-1])))]
        blocks = [own[i : i + BLOCK] for i in range(0, b - a, BLOCK)]
        spans = [(int(n[x].min()), int(n[x].max())) for x in blocks]
        same = [[int(f[x[0]]) if (f[x] == f[x[0]]).all() else 0 for f in family[:number]] for x in blocks]
        head = mix(sig[at[a : a + 1]])
        for i, x in enumerate(blocks):
            for j in range(i, len(blocks)):
                y = blocks[j]
                if spans[j][0] > (spans[i][1] + 1e-9) / t or spans[i][0] > (spans[j][1] + 1e-9) / t or any(p and p == q for p, q in zip(same[i], same[j])):
                    continue
                key = int(mix(head + np.uint64(i << 32 | j))[0].view(np.int64))
                both = x if i == j else np.concatenate([x, y])
                keys.append(np.full(len(both), key))
                sets.append(both)
                sides.append(SIDES * number + (np.full(len(x), ONLY) if i == j else np.repeat([FIRST, SECOND], [len(x), len(y)])))
    return np.concatenate(keys), np.concatenate(sets), np.concatenate(sides)


def _tally(key: np.ndarray, c: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the sum of c and the greatest of most."""
    if not len(key):
        return key, c, most
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[heads], np.add.reduceat(c[order], heads), np.maximum.reduceat(most[order], heads)


_MET = {"a": pa.int64(), "b": pa.int64(), "na": pa.int32(), "nb": pa.int32(), "k": pa.int32(), "c": pa.int32(), "most": pa.int32()}


def _meet(docs: DataFrame, job: Join, prof: DataFrame) -> DataFrame:
    """What ``met`` finds in all partitions."""
    table, n_sets = token_counts(prof)
    size = prof.agg(F.sum("n"), F.count("n")).first()
    parts = 1 + int(((1 - job.threshold) * (size[0] or 0) + job.common * size[1]) // PER_PARTITION)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for b in batches for x in b.column(b.schema.get_field_index("packed")).to_pylist()]
        for out in met(blobs, job.threshold):
            for i in range(0, len(out["a"]), EXPAND):
                yield pa.record_batch({c: pa.array(out[c][i : i + EXPAND]).cast(kind) for c, kind in _MET.items()})
            del out
        trim()

    sent = _emit(docs, job, table, n_sets, parts)
    return materialise(sent.groupBy("p").applyInArrow(solve, "a long, b long, na int, nb int, k int, c int, most int"), "met")


def _candidates(found: DataFrame, t: float) -> DataFrame:
    """Distinct (a, b), a the shorter set, of no common family, that may reach the threshold."""
    pairs = found.filter("c > 0").groupBy("a", "b", "na", "nb", "k").agg(F.sum("c").alias("c"), F.max("most").alias("most"))
    return pairs.filter((F.col("c") >= F.col("k")) & (F.col("most") >= F.lit(t / (1 + t)) * (F.col("na") + F.col("nb")) - 1e-9)).select("a", "b")


#: Sets in one block of a group of candidates.
BLOCK = 256


def _blocked(cand: DataFrame) -> DataFrame:
    """Candidates with a key each: those around one set share it, but for sets beyond BLOCK, which go in blocks."""
    ends = cand.select(F.col("a").alias("v"), F.least("a", "b").alias("m")).unionByName(cand.select(F.col("b").alias("v"), F.least("a", "b").alias("m")))
    hub = materialise(ends.groupBy("v").agg(F.min("m").alias("hub")), "hubs")
    # Pairs are many more than sets: up to the bound, what is known of sets comes to the pairs, not the other way round.
    wrap = F.broadcast if hub.limit(_store.BROADCAST_IDS + 1).count() <= _store.BROADCAST_IDS else lambda x: x
    keyed = cand.join(wrap(hub.withColumnRenamed("v", "a")), "a")
    size = wrap(keyed.select("hub", F.explode(F.array("a", "b")).alias("v")).distinct().groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    return keyed.join(size, "hub").select("a", "b", F.xxhash64("hub", F.least(part("a"), part("b")), F.greatest(part("a"), part("b"))).alias("key"))


def _filter(ids: DataFrame, n: int) -> np.ndarray:
    """Bits of a Bloom filter of one hash over doc_id: about 16 for each of n ids, 2**30 (128 MB) at most. It spares work, and decides nothing."""
    bits = min(30, max(16, (16 * n).bit_length()))

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = _place(np.asarray(b.column(0)), bits)
            for c in np.unique(at >> 20).tolist():
                held.setdefault(c, np.zeros(1 << min(20, bits), bool))[at[at >> 20 == c] & 0xFFFFF] = True
        if held:
            yield pa.record_batch({"chunk": pa.array(list(held), pa.int32()), "bits": pa.array([pack(np.packbits(x)) for x in held.values()], pa.binary())})

    rows = ids.select("doc_id").mapInArrow(lean(run), "chunk int, bits binary")

    def unite(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[c] = held.get(c, 0) | unpack(x)[0]
        if held:
            yield pa.record_batch({"chunk": pa.array(list(held), pa.int32()), "bits": pa.array([pack(x) for x in held.values()], pa.binary())})

    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in rows.repartition("chunk").mapInArrow(lean(unite), "chunk int, bits binary").collect():
        part = unpack(r.bits)[0].astype(np.uint8)
        out[r.chunk << 17 : (r.chunk << 17) + len(part)] = part
    return out


def _place(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bit of each id in the filter."""
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


#: What is asked for: all pairs; as many as connect what all connect; those, and numbers of links.
PAIRS, SPANNING, LINKS = "pairs", "spanning", "links"


def _verify(docs: DataFrame, job: Join, found: DataFrame, cand: DataFrame, members: DataFrame, ask: str) -> DataFrame:
    """(a, b, jaccard, links) of the candidates, and of the pairs within families, at or above the threshold, or as many of them as connect what all connect.

    links is null there; where it is asked for, rows with a null b add that many documents to those that set a is linked with.
    """
    cand = materialise(_blocked(cand), "blocks")
    needed = cand.select("key", F.explode(F.array("a", "b")).alias("set_id"), F.lit(-1).alias("side"), F.lit(0).alias("f0"), F.lit(0).alias("f1")).distinct()
    needed = needed.unionByName(found.filter("c < 0").select(F.col("a").alias("key"), F.col("b").alias("set_id"), (-1 - F.col("c")).alias("side"), F.col("na").alias("f0"), F.col("nb").alias("f1")))
    first = members.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"))
    needed = materialise(needed.join(first, "set_id"), "needed")
    n = needed.count()
    wrap = F.broadcast if n <= _store.BROADCAST_IDS else lambda x: x
    bloom = _filter(needed, n)
    bits = len(bloom).bit_length() + 2
    wanted = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        def chosen():
            for b in batches:
                at = _place(np.asarray(b.column(0).fill_null(0)), bits)
                b = b.filter(pa.array((wanted.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
                if b.num_rows:
                    yield b

        for x in _sets(chosen(), job.sets):
            tokens = pa.Array.from_buffers(pa.binary(), len(x.digest), [None, pa.py_buffer((8 * x.at).astype(np.int32)), pa.py_buffer(x.token)])
            yield pa.record_batch({"doc_id": x.doc_id, "set_id": pa.array(x.digest), "tokens": tokens})

    whole = pick(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, set_id long, tokens binary")
    whole = whole.join(wrap(needed), ["doc_id", "set_id"]).select("key", "set_id", "side", "f0", "f1", "weight", "tokens")
    least = job.threshold - 1e-12

    def overlap(key, pairs, sets):
        col = {c: sets.column(c).to_pylist() for c in sets.column_names}
        held = {i: np.frombuffer(x, np.uint64) for i, x in zip(col["set_id"], col["tokens"])}
        weight, links = dict(zip(col["set_id"], col["weight"])), dict.fromkeys(held, 0)
        out, root = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], {}

        def top(i):
            while (up := root.get(i, i)) != i:
                root[i] = root.get(up, up)
                i = up
            return i

        for a, b in sorted(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())):
            if ask == SPANNING and top(a) == top(b):
                continue
            x, y = held[a], held[b]  # x is the shorter
            shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if (j := shared / (len(x) + len(y) - shared)) >= least:
                links[a], links[b] = links[a] + weight[b], links[b] + weight[a]
                if ask == PAIRS or top(a) != top(b):
                    out.append(([a], [b], [j]))
                root[top(b)] = top(a)
        place = {i: k for i, k in sorted(((i, k) for k, i in enumerate(col["set_id"])), key=lambda x: col["side"][x[1]])}
        family = sorted((i for i, k in place.items() if col["side"][k] >= 0), key=lambda i: (len(held[i]), i))
        if len(family) > 1:
            ids, at = np.array(family), [place[i] for i in family]
            sizes = np.array([len(held[i]) for i in family])
            number = np.unique(np.concatenate([held[i] for i in family]), return_inverse=True)[1]
            cut = np.append(0, np.cumsum(sizes))
            sides, w = np.array([col["side"][k] for k in at]), np.array([weight[i] for i in family])
            kinds, turn = sides % SIDES, int(sides.max()) // SIDES
            before = [np.array([col[c][k] for k in at]) for c in ("f0", "f1")[:turn]]
            mark = np.zeros(int(number.max()) + 1, bool)
            upto = np.searchsorted(sizes, (sizes + 1e-9) / job.threshold, side="right")
            group, linked = np.arange(len(family)), np.zeros(len(family), np.int64)
            for x in range(len(family)):
                others = np.arange(x + 1, upto[x])
                others = others[(kinds[others] != kinds[x]) | (kinds[others] == ONLY)]
                for f in before:  # compared there
                    others = others[(f[others] != f[x]) | (f[x] == 0)]
                if ask == SPANNING:
                    others = others[group[others] != group[x]]
                if not len(others):
                    continue
                mark[number[cut[x] : cut[x + 1]]] = True
                stretch = slice(cut[others[0]], cut[others[-1] + 1])
                shared = np.add.reduceat(mark[number[stretch]].astype(np.int64), cut[others[0] : others[-1] + 1] - cut[others[0]])[others - others[0]]
                mark[number[cut[x] : cut[x + 1]]] = False
                j = shared / (sizes[x] + sizes[others] - shared)
                others, j = others[j >= least], j[j >= least]
                linked[x] += w[others].sum()
                linked[others] += w[x]
                if ask != PAIRS:
                    far = group[others] != group[x]
                    old, one = np.unique(group[others[far]], return_index=True)
                    others, j = others[far][one], j[far][one]
                    group[np.isin(group, old)] = group[x]
                out.append((np.full(len(others), ids[x]), ids[others], j))
            for i, m in zip(family, linked.tolist()):
                links[i] += m
        a, b, j = (np.concatenate(c) for c in zip(*out))
        done = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "jaccard": pa.array(j, pa.float64()), "links": pa.nulls(len(a), pa.int64())})
        if ask == LINKS and (more := {i: m for i, m in links.items() if m}):
            m = len(more)
            done = pa.concat_tables([done, pa.table({"a": pa.array(list(more), pa.int64()), "b": pa.nulls(m, pa.int64()), "jaccard": pa.nulls(m, pa.float64()), "links": pa.array(list(more.values()), pa.int64())})])
        return done

    scored = cand.select("key", "a", "b").groupBy("key").cogroup(whole.groupBy("key")).applyInArrow(overlap, "a long, b long, jaccard double, links long")
    done = materialise(scored, "similar")
    discard(needed)
    discard(cand)
    return done


def similar_sets(docs: DataFrame, job: Join, ask: str = PAIRS) -> tuple[DataFrame, DataFrame]:
    """(members, similar): members has (doc_id, set_id) of every document with tokens, similar what ``_verify`` finds of distinct sets."""
    prof = profile(docs, job)
    found = _meet(docs, job, prof)
    members = materialise(prof.filter("set_id is not null").select("doc_id", "set_id").distinct(), "members")
    discard(prof)
    cand = materialise(_candidates(found, job.threshold), "candidates")
    similar = _verify(docs, job, found, cand, members, ask)
    discard(found)
    discard(cand)
    return members, similar


def pairs(docs: DataFrame, job: Join) -> DataFrame:
    """All pairs (doc_a, doc_b, jaccard) of documents, doc_a < doc_b, at or above the threshold."""
    members, similar = similar_sets(docs, job)
    left, right = members.selectExpr("doc_id x", "set_id a"), members.selectExpr("doc_id y", "set_id b")
    paired = materialise(members.join(similar.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "set_id", "left_semi"), "paired")
    wrap = F.broadcast if paired.limit(_store.BROADCAST_IDS + 1).count() <= _store.BROADCAST_IDS else lambda x: x
    across = similar.join(wrap(paired.selectExpr("doc_id x", "set_id a")), "a").join(wrap(paired.selectExpr("doc_id y", "set_id b")), "b").select("x", "y", "jaccard")
    within = left.join(right, F.col("a") == F.col("b")).select("x", "y", F.lit(1.0).alias("jaccard"))
    both = across.unionByName(within.filter("x < y")).filter("x <> y")
    out = both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))
    return out


def _connected(members: DataFrame, similar: DataFrame) -> DataFrame:
    """(doc_id, group_id) of the documents of members: connected ones share as group_id the smallest doc_id among them."""
    # A document met with several texts ties their sets together, as a pair of equal sets does.
    first = members.groupBy("set_id").agg(F.min("doc_id").alias("u"))
    edges = first.join(members, "set_id").selectExpr("u", "doc_id v")
    links = similar.join(first.selectExpr("set_id a", "u ua"), "a").join(first.selectExpr("set_id b", "u ub"), "b").selectExpr("ua u", "ub v")
    found = components(edges.unionByName(links).filter("u <> v"))
    done = materialise(members.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id")), "groups")
    discard(found)
    return done


def groups(docs: DataFrame, job: Join) -> DataFrame:
    """(doc_id, group_id): connected documents share as group_id the smallest doc_id among them; documents without tokens are absent."""
    members, similar = similar_sets(docs, job, SPANNING)
    done = _connected(members, similar)
    for x in (members, similar):
        discard(x)
    return done


def classes(docs: DataFrame, job: Join) -> DataFrame:
    """(doc_id, class_id, links) of every document: class_id as group_id of ``groups``, links the number of documents with an equal or a similar set.

    A document without tokens is a class of its own without links. One met with several texts has the links of each, those between them included.
    """
    members, similar = similar_sets(docs, job, LINKS)
    grouped = _connected(members, similar.filter("b is not null"))
    near = similar.filter("b is null").groupBy("a").agg(F.sum("links").alias("near"))
    copies = members.groupBy("set_id").agg((F.count("*") - 1).alias("copies"))
    each = copies.join(near, F.col("set_id") == F.col("a"), "left").select("set_id", (F.col("copies") + F.coalesce("near", F.lit(0))).alias("links"))
    linked = members.join(each, "set_id").groupBy("doc_id").agg(F.sum("links").alias("links"))
    ids = pick(docs, "doc_id").filter("doc_id is not null").distinct()
    out = ids.join(grouped, "doc_id", "left").join(linked, "doc_id", "left")
    done = materialise(out.select("doc_id", F.coalesce("group_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    for x in (members, similar, grouped):
        discard(x)
    return done


def classes_sql(pairs_sql: str) -> str:
    """SQL of ``classes``, given that of the pairs."""
    return f"""
WITH RECURSIVE pairs AS ({pairs_sql}),
e AS (SELECT doc_a AS u, doc_b AS v FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
d AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT doc_id, doc_id AS class_id FROM d UNION SELECT e.v, r.class_id FROM r JOIN e ON e.u = r.doc_id WHERE r.class_id < e.v),
c AS (SELECT doc_id, min(class_id) AS class_id FROM r GROUP BY doc_id),
l AS (SELECT u, count(*) AS links FROM e GROUP BY u)
SELECT c.doc_id, c.class_id, coalesce(l.links, 0) AS links FROM c LEFT JOIN l ON l.u = c.doc_id
"""


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id) of the vertices of (u, v), by alternating large-star and small-star steps until stars remain."""
    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(low, "u").filter("v > u").selectExpr("v", "m u").filter("u <> v").select("u", "v").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        return joined.select(F.col("m").alias("u"), F.col("v")).unionByName(low.selectExpr("m u", "u v")).filter("u <> v").distinct()

    e = materialise(edges.select("u", "v").distinct(), "edges")
    before = None
    while True:
        nxt = materialise(small(large(e)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        sums = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = nxt
        if tuple(sums) == before:
            break
        before = tuple(sums)
    stars = materialise(e.selectExpr("v doc_id", "u group_id").unionByName(e.selectExpr("u doc_id", "u group_id").distinct()).distinct(), "stars")
    discard(e)
    return stars
