"""Operator 6: token counts of a unigram tokenizer, without making the tokens.

A byte-level Aho-Corasick automaton enumerates the vocabulary pieces that end at
each place of a text; dynamic programming carries the best score and its number of
pieces. Ties and unknown characters follow the unigram model of the public
``tokenizers`` library: of equal scores the piece that begins first stays; a
character without a piece of its own may be taken alone at the lowest score less
10, and counts as its bytes. Many words advance through the automaton together,
one byte per step, as arrays; a word repeated within a slice is done once.

The text is counted as that library does it with a leading space and spaces in
place of the word mark. Pieces never hold a word mark after another character (this
is checked on loading), so words can be counted one by one; line feeds, if in no
piece, separate too.

Defined results: an empty text has 0 tokens, a null text null; every row keeps its
doc_id, null or repeated; other columns are not read.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._store import pick
from ._vec import lean, slices, span_hashes, utf8

#: The vocabulary file; a parameter of every function that counts.
VOCABULARY = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
#: Longer words go through the automaton singly.
LONG_WORD = 64
MARK = "▁"


def load_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, without its control pieces; the first is the unknown piece."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not m.is_control(i)]


class Counter:
    """Counts tokens with a unigram vocabulary that has all 256 byte pieces."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.unknown = min(s for _, s in vocabulary) - 10.0
        self.pieces = {p.replace(MARK, " "): s for p, s in reversed(vocabulary) if p}
        self.by_word = not any(a != " " and b == " " for p in self.pieces for a, b in zip(p, p[1:]))
        self.by_line = not any("\n" in p for p in self.pieces)
        self._arrays()
        self._long = None

    def _arrays(self) -> None:
        children: list[dict[int, int]] = [{}]
        own: list[tuple[int, float] | None] = [None]
        for p, score in self.pieces.items():
            at = 0
            b = p.encode()
            for c in b:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    own.append(None)
                at = children[at][c]
            own[at] = (len(b), score)
        used = sorted({c for ch in children for c in ch})
        self.cls = np.zeros(256, np.int64)  # class 0: in no piece
        self.cls[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        goto = np.zeros((len(children), self.width), np.int32)
        fail = np.zeros(len(children), np.int32)
        outs: list[tuple[tuple[int, float], ...]] = [()] * len(children)
        level = [0]
        while level:
            below = []
            for s in level:
                outs[s] = ((own[s],) if own[s] else ()) + (outs[fail[s]] if s else ())
                if s:
                    goto[s] = goto[fail[s]]
                for c, child in children[s].items():
                    k = self.cls[c]
                    fail[child] = goto[s, k] if s else 0
                    goto[s, k] = child
                    below.append(child)
            level = below
        self.goto = goto.ravel()
        self.n_out = np.array([len(o) for o in outs], np.int8)
        depth = int(self.n_out.max())
        self.out_len = np.zeros((depth, len(outs)), np.int32)
        self.out_score = np.zeros((depth, len(outs)))
        self.last = np.zeros(len(outs), np.int32)
        for s, o in enumerate(outs):
            for k, (n, score) in enumerate(o):
                self.out_len[k, s], self.out_score[k, s] = n, score
            if o:
                self.last[s] = o[-1][0]

    def _short(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each span, all advancing together; spans are given from long to short."""
        n, top = len(start), int(size[0])
        best = np.full((top + 1, n), -np.inf)
        best[0] = 0.0
        count = np.zeros((top + 1, n), np.int32)
        state = np.zeros(n, np.int64)
        lead = np.zeros(n, np.int64)
        fits = np.searchsorted(-size, -np.arange(top + 2), side="right")  # of how many spans the size is >= i
        padded = np.append(buf, np.uint8(0))
        for i in range(top):
            m = int(fits[i + 1])
            b = padded[start[:m] + i]
            state = self.goto[state[:m] * self.width + self.cls[b]].astype(np.int64)
            lead = np.where((b & 0xC0) == 0x80, lead[:m], i)
            ends = (i + 1 == size[:m]) | ((padded[start[:m] + i + 1] & 0xC0) != 0x80)
            top_score, top_count = best[i + 1], count[i + 1]
            outs = self.n_out[state]
            for k in range(int(outs.max(initial=0))):
                at = np.flatnonzero(outs > k)
                s = state[at]
                begin = i + 1 - self.out_len[k, s]
                score = best[begin, at] + self.out_score[k, s]
                better = score > top_score[at]
                at, begin = at[better], begin[better]
                top_score[at] = score[better]
                top_count[at] = count[begin, at] + 1
            width = i + 1 - lead
            at = np.flatnonzero(ends & (self.last[state] != width))
            if len(at):
                begin = lead[at]
                score = best[begin, at] + self.unknown
                better = score > top_score[at]
                at, begin = at[better], begin[better]
                top_score[at] = score[better]
                top_count[at] = count[begin, at] + width[at]
        return count[size, np.arange(n)]

    def count_long(self, word: str) -> int:
        """Tokens of one word of any length."""
        import ahocorasick

        if self._long is None:
            self._long = ahocorasick.Automaton()
            for p, s in self.pieces.items():
                self._long.add_word(p, (len(p), s))
            self._long.make_automaton()
        best, count = [0.0] + [-np.inf] * len(word), [0] * (len(word) + 1)
        at, found = 0, []

        def settle(upto: int) -> None:
            nonlocal at, found
            while at < upto:
                at += 1
                single = False
                for n, s in found if at == upto else ():
                    single |= n == 1
                    score = best[at - n] + s
                    if score > best[at]:
                        best[at], count[at] = score, count[at - n] + 1
                if not single and best[at - 1] + self.unknown > best[at]:
                    best[at], count[at] = best[at - 1] + self.unknown, count[at - 1] + len(word[at - 1].encode())
            found = []

        end = 0
        for e, piece in self._long.iter(word):
            if e + 1 != end:
                settle(end)
                end = e + 1
            found.append(piece)
        settle(end)
        settle(len(word))
        return count[-1]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; texts without nulls."""
        texts = pc.replace_substring(texts, MARK, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        buf, offsets = utf8(texts)
        if not len(buf):
            return np.zeros(len(offsets) - 1, np.int64)
        mask = np.zeros(len(buf) + 1, bool)
        if self.by_word:
            space = buf == 32
            mask[1:-1] = space[1:] & ~space[:-1]
        if self.by_line:
            line = buf == 10
            mask[:-1] |= line
            mask[1:] |= line
        mask[offsets] = True
        cut = np.flatnonzero(mask)
        start, end = cut[:-1], cut[1:]
        at = np.searchsorted(start, offsets)
        _, first, back = np.unique(span_hashes(buf, start, end), return_index=True, return_inverse=True)
        s, size = start[first], (end - start)[first]
        tokens = np.zeros(len(first), np.int64)
        order = np.argsort(-size, kind="stable")
        longs = int(np.searchsorted(-size[order], -LONG_WORD, side="left"))
        for j in order[:longs]:
            tokens[j] = self.count_long(bytes(buf[s[j] : s[j] + size[j]]).decode())
        while longs < len(order):
            n = max(1, (1 << 21) // (int(size[order[longs]]) + 1))
            part = order[longs : longs + n]
            tokens[part] = self._short(buf, s[part], size[part])
            longs += n
        total = np.append(0, np.cumsum(tokens[back]))
        return total[at[1:]] - total[at[:-1]]


@lru_cache(4)
def counter(path: str = VOCABULARY) -> Counter:
    """The counter of a vocabulary file, built once in each process."""
    return Counter(load_vocabulary(path))


def counted(texts: pa.Array, path: str = VOCABULARY) -> pa.Array:
    """Token counts of an array of texts; null where the text is."""
    out = np.zeros(len(texts), np.int64)
    for row, part in slices(texts):
        out[row : row + len(part)] = counter(path).count(part)
    return pa.array(out, mask=np.asarray(pc.is_null(texts)))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def run(batches):
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "n_tokens": counted(b.column(1), vocabulary)})

    return pick(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long")
