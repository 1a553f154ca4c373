"""Operators 2 and 3 against all pairs."""

from collections import Counter
from functools import partial

import duckdb
import numpy as np
import pytest

from quillspark.llm import _setjoin, _store, ngram_join, spotsigs
from quillspark.llm.queries import queries

from .util import BASE, FRENCH, WORD, brute_pairs, docs, empty, gram_set, local


def as_sets(*tokens):
    """Sets of one slice from arrays of tokens."""
    each = [np.unique(np.asarray(x, np.uint64)) for x in tokens]
    token = np.concatenate(each)
    return _setjoin.Sets(None, np.arange(len(each)), np.append(0, np.cumsum([len(x) for x in each])), token, token, token)


def signed(x, t, common, classes):
    """Signatures of sets whose tokens have the classes that a function of the token gives."""
    return _setjoin.signatures(x, classes(x.token), (x.token % np.uint64(50)).astype(np.int64), t, common)


@pytest.mark.parametrize("t", [0.3, 0.5, 0.65, 0.9])
def test_similar_sets_share_enough_signatures(t):
    """Whatever the classes of the tokens, two similar sets share the promised number, within their prefixes and positions."""
    r = np.random.default_rng(1)
    tried = 0
    for trial in range(1500):
        universe = r.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2)
        kinds = trial % 4
        classes = (lambda s: (1 + s // np.uint64(2) % np.uint64(3)).astype(np.int8)) if kinds == 0 else lambda s: np.full(len(s), kinds, np.int8)
        n = int(r.integers(1, 25 if trial % 2 else 220))
        x = r.choice(universe, n, replace=False)
        y = np.concatenate([x[r.random(n) < r.choice([0.95, (1 + t) / 2, t + 0.05])], r.choice(universe, int(r.integers(0, 4 + n // 8)), replace=False)])
        x, y = np.unique(x), np.unique(y)
        if not len(y) or len(np.intersect1d(x, y)) / len(np.union1d(x, y)) < t:
            continue
        tried += 1
        x, y = sorted((x, y), key=len)
        g = signed(as_sets(x, y), t, 8, classes)
        need = t / (1 + t) * (len(x) + len(y)) - 1e-9
        k = min(g.k)
        mine, other = ({s: p for o, s, p, kind in zip(g.owner, g.sig, g.pos, g.kind) if o == i and kind >> 1 == 0 and (i or kind & 1)} for i in (0, 1))
        most = sorted((min(len(x) - mine[s], len(y) - other[s]) for s in mine.keys() & other.keys()), reverse=True)
        assert most and most[0] >= need and sum(m >= need - (k - 1) for m in most) >= k
    assert tried > 300


@pytest.mark.parametrize("n", [300, 5000])
@pytest.mark.parametrize("kind", [1, 2, 3])
def test_combinations_stay_linear(n, kind):
    """However frequent its tokens, a set's signatures are a small multiple of what its partners may lack."""
    g = signed(as_sets(np.random.default_rng(n).integers(0, 2**63, n)), 0.65, 8, lambda s: np.full(len(s), kind, np.int8))
    assert len(g.sig) < {1: 1.2, 2: 4, 3: 16}[kind] * 0.35 * n + 20


def test_classes_move_with_the_number_of_sets():
    """A token's class depends on its share of the sets, beyond the posting that single tokens may have."""
    table = np.zeros(_setjoin.TABLES * _setjoin.BUCKETS, np.int64)
    table[:4] = table[_setjoin.BUCKETS : _setjoin.BUCKETS + 4] = 900, 1100, 30_000, 40_000
    one, two, _ = _setjoin.frequencies(table, 10**6, 1000)
    assert one[:4].tolist() == two[:4].tolist() == [1, 2, 2, 3]  # the square root is at 31623
    table *= 60
    assert _setjoin.frequencies(table, 60 * 10**6, 1000)[0][:4].tolist() == [2, 2, 3, 3] and _setjoin.frequencies(table, 60 * 10**6, 60_000)[0][:4].tolist() == [1, 2, 2, 3]


def test_packing_of_columns():
    r = np.random.default_rng(2)
    columns = [np.zeros(0, np.int64), r.integers(0, 2**63, 100).astype(np.uint64), np.arange(300), np.array([2**64 - 1], np.uint64)]
    assert all(np.array_equal(np.asarray(a, np.uint64), b) for a, b in zip(columns, _setjoin.unpack(_setjoin.pack(*columns)), strict=True))


def spot_set(text):
    w = WORD.findall(text.lower())
    content = [i for i, x in enumerate(w) if x not in spotsigs.ANCHORS]
    out = set()
    for i, x in enumerate(w):
        if x in spotsigs.ANCHORS:
            chain = [w[j] for j in content if j > i][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((x, *chain))
    return out or ({("=", *w)} if w else set())


def collected(df):
    rows = df.collect()
    assert len({(r.doc_a, r.doc_b) for r in rows}) == len(rows)
    return {(r.doc_a, r.doc_b): r.jaccard for r in rows}


def test_ngram_join(spark):
    d = docs(spark)
    want = brute_pairs(local(d), lambda x: gram_set(x, ngram_join.N), ngram_join.THRESHOLD)
    assert collected(ngram_join.jaccard_join(d)) == want and (1, 3) in want and (7, 8) in want and (10, 11) in want
    assert collected(ngram_join.jaccard_join(empty(spark))) == {}


@pytest.mark.parametrize("posting", [0, 1, 3])
def test_ngram_join_with_frequent_tokens(spark, posting):
    """With most tokens in class 2 or 3, only combinations are indexed, and small sets by single tokens."""
    r = np.random.default_rng(posting)
    base = [f"w{i}" for i in range(60)]
    texts = ["a b c d e f g h i j k l", "a b c d e f g h i j k m", "a b c d e x g h i j k l", "q w e r t y u i o p", "a b", "a b", "a b c"]
    for _ in range(30):
        w = list(base)
        for j in r.integers(0, 60, int(r.integers(0, 9))):
            w[j] = base[int(r.integers(0, 60))]
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_pairs(list(enumerate(texts)), lambda x: gram_set(x, 2), 0.5)
    assert collected(_setjoin.pairs(d, _setjoin.Join(partial(ngram_join.grams, n=2), 0.5, posting))) == want and len(want) > 100


def test_long_text_of_frequent_tokens(spark):
    """Every token of two long texts is frequent: combinations don't explode."""
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(words), " ".join(words[:4900] + ["x"] * 100)] + [" ".join(words[i : i + 40]) for i in range(0, 5000, 20)] * 2
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collected(_setjoin.pairs(d, _setjoin.Join(partial(ngram_join.grams, n=2), 0.65, 1)))
    assert got[0, 1] == round(4899 / 5001, 6) and len(got) == 251


def test_bounds_of_broadcasts_and_slices(spark, monkeypatch):
    """Beyond what is broadcast, and with signatures in many small portions, results are the same."""
    d = docs(spark)
    want = collected(ngram_join.jaccard_join(d))
    monkeypatch.setattr(_store, "BROADCAST_IDS", 1)
    monkeypatch.setattr(_setjoin, "FLUSH", 50)
    monkeypatch.setattr(_setjoin, "PER_PARTITION", 3000)
    monkeypatch.setattr(_setjoin, "EXPAND", 7)
    assert collected(ngram_join.jaccard_join(d)) == want and want


def test_families_leave_no_pair_out(spark):
    """Many variants of one text: pairs within the family, across families and with copies."""
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(420):
        w = list(base if k < 300 else base[:80] + [f"v{i}" for i in range(40)])
        for j in r.integers(0, 120, int(r.integers(0, 9))):
            w[j] = f"x{r.integers(0, 10**6)}"
        texts += [" ".join(w)] * (1 + (k % 10 == 0))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_pairs(list(enumerate(texts)), lambda x: gram_set(x, 2), 0.65)
    assert collected(ngram_join.jaccard_join(d)) == want and 20000 < len(want) < 420 * 462
    low = {i: i for i in range(len(texts))}
    for a, b in sorted(want):
        low[b] = min(low[b], low[a])
    got = {x.doc_id: x.group_id for x in ngram_join.duplicate_groups(d).collect()}
    assert len(set(got.values())) < 20 and all(got[a] == got[b] for a, b in want)


def test_variants_beyond_a_posting_are_families(spark, monkeypatch):
    """Variants of one text, more than the bound of rare tokens, meet in families, and the other candidates come in portions."""
    r = np.random.default_rng(7)
    texts = [" ".join(f"y{i}z{j}" for j in range(30)) for i in range(300)]
    for _ in range(300):
        w = [f"w{i}" for i in range(120)]
        for j in r.integers(0, 120, int(r.integers(0, 9))):
            w[j] = f"x{r.integers(0, 10**6)}"
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    job = _setjoin.Join(partial(ngram_join.grams, n=2), 0.65, posting=200)
    table, n = _setjoin.token_counts(_setjoin.profile(d, job))
    blobs = [x.packed for x in _setjoin._emit(d, job, table, n, 1).collect()]

    def tallied(expand):
        monkeypatch.setattr(_setjoin, "EXPAND", expand)
        each = [x for x in _setjoin.met(list(blobs), 0.65) if (x["c"] > 0).any()]
        total = Counter()
        for x in each:
            for a, b, c in zip(x["a"].tolist(), x["b"].tolist(), x["c"].tolist()):
                total[a, b] += c
        return total, [len(x["a"]) for x in each]

    whole, _ = tallied(1 << 19)
    parts, sizes = tallied(200)
    assert parts == whole and len(sizes) > 3 and max(sizes) < 1500
    want = brute_pairs(list(enumerate(texts)), lambda x: gram_set(x, 2), 0.65)
    assert len(whole) < 0.25 * 300 * 299 / 2 < len(want)
    assert collected(_setjoin.pairs(d, job)) == want


def test_blocks_of_a_family_meet_once(monkeypatch):
    """Each two sets of fitting lengths share exactly one key, with sides that compare them."""
    monkeypatch.setattr(_setjoin, "BLOCK", 7)
    r = np.random.default_rng(5)
    n = np.sort(r.integers(20, 200, 90))
    sig = np.repeat(np.array([5, 9], np.uint64), [50, 40])
    who = np.concatenate([np.arange(50), np.sort(r.choice(90, 40, replace=False))])
    run = np.where(sig == 9, 1, 0) << 32
    upto = np.searchsorted(run | n[who], run | np.floor(n[who] / 0.5).astype(np.int64), side="right")
    key, sets, side = _setjoin._members(sig, np.arange(90), who, upto, n, 0.5)
    for lo, hi in ((0, 50), (50, 90)):
        for i in range(lo, hi):
            for j in range(i + 1, min(upto[i], hi)):
                shared = [k for k in set(key[sets == who[i]]) & set(key[sets == who[j]]) for a in side[(key == k) & (sets == who[i])] for b in side[(key == k) & (sets == who[j])] if a == b == _setjoin.ONLY or {a, b} == {0, 1}]
                assert len(shared) >= 1 and len(set(shared)) == len(shared)


def rows_of(pairs, ids):
    """{doc_id: (class_id, links)} from {(a, b): jaccard} of documents with one text each."""
    low, links = {i: i for i in ids}, Counter(i for p in pairs for i in p)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (low[i], links[i]) for i in ids}


def classed(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.class_id, r.links) for r in rows}


def in_sql(sql, data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet/*.parquet'")
    return {i: (k, n) for i, k, n in c.execute(sql).fetchall()}


def test_ngram_classes(spark, tmp_path):
    """One row per document however many copies it has; its links are those of all pairs."""
    r = np.random.default_rng(11)
    texts = []
    for k in range(200):
        w = [f"w{i}" for i in range(60)]
        for j in r.integers(0, 60, int(r.integers(0, 9))):
            w[j] = f"x{r.integers(0, 10**6)}"
        texts += [" ".join(w)] * (30 if k == 0 else 1)
    d = spark.createDataFrame([*local(docs(spark)), *enumerate(texts, 100)], "doc_id long, text string")
    rows = local(d)
    want = rows_of(brute_pairs(rows, lambda x: gram_set(x, ngram_join.N), ngram_join.THRESHOLD), {i for i, _ in rows if i is not None})
    got = classed(ngram_join.similar_classes(d))
    assert got == want and want[4] == (4, 0) and want[100][1] > 29
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert in_sql(ngram_join.ORACLE, tmp_path) == want
    assert classed(ngram_join.similar_classes(empty(spark))) == {}
    assert queries()["op2_ngram_join"](spark, str(tmp_path)).columns == ["doc_id", "class_id", "links"]


def test_duplicate_groups(spark):
    d = docs(spark)
    pairs = brute_pairs(local(d), lambda x: gram_set(x, ngram_join.N), ngram_join.THRESHOLD)
    low = {i: i for i, x in local(d) if i is not None and x and gram_set(x, 2)}
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    got = ngram_join.duplicate_groups(d).collect()
    assert Counter((r.doc_id, r.group_id) for r in got) == Counter(low.items())


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 102), (102, 100)]
    got = {r.doc_id: r.group_id for r in _setjoin.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in (100, 101, 102, 103)}


def test_fingerprints(spark):
    d = docs(spark)
    want = brute_pairs(local(d), spot_set, spotsigs.THRESHOLD)
    assert collected(spotsigs.fingerprint_pairs(d)) == want and (10, 11) in want and (6, 13) in want
    assert collected(spotsigs.fingerprint_pairs(empty(spark))) == {}


def test_fingerprint_classes(spark, tmp_path):
    """One row per document however many copies it has; its links are those of all pairs."""
    rows = local(docs(spark)) + [(100 + i, FRENCH if i % 3 else BASE) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = rows_of(brute_pairs(rows, spot_set, spotsigs.THRESHOLD), {i for i, _ in rows if i is not None})
    got = classed(spotsigs.fingerprint_classes(d))
    assert got == want and want[4] == (4, 0) and want[101] == (6, 21)
    d.distinct().write.parquet(f"{tmp_path}/documents.parquet")  # the SQL reads repeated rows as one text
    assert in_sql(spotsigs.ORACLE, tmp_path) == want
    assert queries()["op3_fingerprints"](spark, str(tmp_path)).columns == ["doc_id", "class_id", "links"]
