"""Array kernels over batches of text: one byte buffer per slice, no per-word Python.

A slice of texts is lower-cased by Arrow, laid out as one UTF-8 buffer, and
split into words with comparisons on bytes. A word is a run of ``[0-9a-z]`` or
of any non-ASCII character; in SQL:
``regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')``. Hashes are 64
bits wide; two unequal words share one with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text per slice. A longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[128:] = True


def lean(run: Callable) -> Callable:
    """A function over batches that, when its task ends, returns to the system the memory that its worker no longer uses."""

    def inner(batches):
        yield from run(batches)
        trim()

    return inner


def trim() -> None:
    """Return to the system the memory that the worker no longer uses."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts without nulls) of about ``limit`` bytes each; a null reads as ''."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    ends = np.cumsum(sizes)
    row, n = 0, len(texts)
    while row < n:
        base = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield row, texts.slice(row, stop - row)
        row = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings without nulls."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, m in (("up", _MULT), ("down", _MULT_INV)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they lie."""
    up, down = powers(len(buf))
    acc = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=acc[1:])
    h = (acc[end] - acc[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word offsets per text) of the words of each text."""
    w = _WORD[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    prev = np.empty(len(buf), bool)
    nxt = np.empty(len(buf), bool)
    if len(buf):
        prev[0], nxt[-1] = False, False
        prev[1:], nxt[:-1] = w[:-1], w[1:]
    start = np.flatnonzero(w & (~prev | first[:-1]))
    end = np.flatnonzero(w & (~nxt | first[1:])) + 1
    return start, end, np.searchsorted(start, offsets).astype(np.int64)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, word offsets per text) of texts without nulls."""
    buf, offsets = utf8(pc.utf8_lower(texts))
    start, end, at = word_spans(buf, offsets)
    return span_hashes(buf, start, end), at


def ngrams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of texts, repeats included, the first and last word of each, and where each text's begin.

    A text of fewer than n words has one gram of all its words; one of none has none.
    """
    full = h
    for k in range(1, n):
        full = mix(full[:-1] * np.uint64(0x9FB21C651E98DF25) + h[k:]) if len(full) > 1 else full[:0]
    words = np.diff(at)
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    cut = np.append(0, np.cumsum(count))
    begin = np.arange(cut[-1]) + np.repeat(at[:-1] - cut[:-1], count)
    out, last = np.zeros(cut[-1], np.uint64), begin + n - 1
    long = np.repeat(words >= n, count)
    out[long] = full[begin[long]]
    for i in np.flatnonzero((words > 0) & (words < n)).tolist():
        short = h[at[i] : at[i] + 1]
        for k in range(1, words[i]):
            short = mix(short * np.uint64(0x9FB21C651E98DF25) + h[at[i] + k])
        out[cut[i]], last[cut[i]] = short[0], at[i + 1] - 1
    return out, h[begin], h[last], cut
