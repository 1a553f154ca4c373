"""Operators 7, 8 and 9, and the pipeline."""

import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quillspark.llm import _store, knn_join, language_id, mixing, ngram_join, packing, pii, token_counts

from .util import BASE, FRENCH, LONG, brute_pairs, docs, empty, gram_set, local


def decreasing(lengths, capacity):
    bins = []
    for w in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + w <= capacity]
        if fits:
            max(fits, key=sum).append(w)
        else:
            bins.append([w])
    return bins


def fewest(lengths, capacity):
    """Exact number of bins, by subsets."""
    best = [(0, capacity)] + [(99, 0)] * ((1 << len(lengths)) - 1)
    for m in range(1, len(best)):
        for i, w in enumerate(lengths):
            if m >> i & 1:
                k, full = best[m ^ (1 << i)]
                best[m] = min(best[m], (k, full + w) if full + w <= capacity else (k + 1, w))
    return best[-1][0]


def test_best_fit_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(500):
        c = r.choice([10, 20, 37, 100])
        w = [r.randint(1, c) for _ in range(r.randint(1, 40))]
        got = packing.best_fit(Counter(w), c)
        assert Counter(x for b, n in got for x in b * n) == Counter(w)
        assert Counter(k for b, n in got for k in [sum(b)] * n) == Counter(map(sum, decreasing(w, c)))


def test_reduction_loses_no_bin():
    r = random.Random(2)
    fixed_some = 0
    for _ in range(300):
        c = r.choice([10, 20, 30, 50])
        w = [r.randint(max(1, c // r.choice([2, 3, 5, 9])), c) for _ in range(r.randint(1, 9))]
        fixed, rest = packing.reduce(Counter(w), c)
        n = sum(k for _, k in fixed)
        assert all(sum(b) <= c for b, _ in fixed) and Counter(x for b, k in fixed for x in b * k) + Counter(rest) == Counter(w)
        assert n + (fewest(list(Counter(rest).elements()), c) if rest else 0) == fewest(w, c)
        fixed_some += bool(n)
    assert fixed_some > 200


def check_packing(rows, got, capacity):
    """Every document is cut in full pieces and a rest, each in one bin, and no bin is overfull; as many bins as the solution has."""
    want = Counter()
    for i, t in rows:
        n = 0 if t is None else token_counts.counted(pa.array([t])).to_pylist()[0]
        for p in range(-(-n // capacity)):
            want[i, p, min(capacity, n - p * capacity)] += 1
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in got) == want
    load = Counter()
    for r in got:
        load[r.bin_id] += r.n_tokens
    assert max(load.values(), default=0) <= capacity
    rests = Counter(n for _, _, n in want.elements() if n < capacity)
    assert len(load) == sum(n == capacity for _, _, n in want.elements()) + sum(k for _, k in packing.solve(rests, capacity))


def test_pack(spark):
    d = docs(spark)
    check_packing(local(d), packing.pack(d, 64).collect(), 64)
    assert packing.pack(empty(spark)).count() == 0
    plain = spark.createDataFrame([(i, "ab " * (i % 50)) for i in range(400)], "doc_id long, text string")
    check_packing(local(plain), packing.pack(plain, 97).collect(), 97)


def test_ranks_span_hash_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 40)
    plain = spark.createDataFrame([(i, "ab " * (i % 90)) for i in range(300)], "doc_id long, text string")
    check_packing(local(plain), packing.pack(plain, 61).collect(), 61)


def brute_knn(rows, k):
    out = set()
    for i, v in rows.items():
        near = sorted((round(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), 6), j) for j, w in rows.items() if j != i)
        out |= {(i, r + 1, j, d) for r, (d, j) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("group_rows,chunk_rows", [(8192, 32768), (20, 25)])
def test_knn_join(spark, group_rows, chunk_rows):
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 5)) * 5
    rows = {i: (centres[i % 6] + r.normal(size=5)).astype(np.float32).tolist() for i in range(150)}
    rows |= {200: rows[3], 201: rows[3], 202: rows[3]}
    bad = [(300, None), (301, [1.0, 2.0]), (302, [float("nan")] * 5), (None, rows[3]), (303, [None] * 5), (3, rows[3])]
    d = spark.createDataFrame([(i, v, 1) for i, v in [*rows.items(), *bad]], "vec_id long, embedding array<float>, rank int")
    got = [(x.vec_id, x.rank, x.neighbor_id, x.distance) for x in knn_join.knn_join(d, 4, group_rows=group_rows, chunk_rows=chunk_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_knn(rows, 4)


def test_knn_join_prunes(spark):
    """Of well parted clusters, a vector goes to its own group and hardly any other; results are exact."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 8)) * 50
    rows = {i: (centres[i % 12] + r.normal(size=8)).astype(np.float32).tolist() for i in range(1200)}
    d = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    sent = knn_join.replicas(d, 5, "vec_id", "embedding", 150, 10**6)[0].filter("side = 1").groupBy("g").count().collect()
    assert len(sent) >= 8 and sum(x["count"] for x in sent) < 0.25 * len(sent) * len(rows)
    got = {(x.vec_id, x.rank, x.neighbor_id, x.distance) for x in knn_join.knn_join(d, 5, group_rows=150).collect()}
    assert got == brute_knn(rows, 5)


@pytest.mark.parametrize("scale", [1e-20, 1e-3, 1e16, 1e80])
def test_knn_join_at_any_scale(spark, scale):
    r = np.random.default_rng(5)
    rows = {i: (r.integers(-9, 9, 4) * scale).tolist() for i in range(60)}
    bad = [(100, [float("inf"), 0.0, 0.0, 0.0]), (101, [float("-inf")] * 4), (102, [1e200] * 4)]
    d = spark.createDataFrame([*rows.items(), *bad], "vec_id int, embedding array<double>")
    got = {(x.vec_id, x.rank, x.neighbor_id, x.distance) for x in knn_join.knn_join(d, 3, group_rows=20).collect()}
    assert len(got) == 180 and (got == brute_knn(rows, 3) or scale > 1)
    want = {(i, k): x for i, k, _, x in brute_knn(rows, 3)}
    assert all(abs(want[i, k] - x) <= 1e-12 * (scale + x) + 1e-6 for i, k, _, x in got)


def test_knn_join_wants_integers(spark):
    with pytest.raises(TypeError):
        knn_join.knn_join(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_knn_join_of_few(spark):
    d = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert {(x.vec_id, x.neighbor_id) for x in knn_join.knn_join(d, 5).collect()} == {(1, 2), (2, 1)}
    assert knn_join.knn_join(d.limit(0), 5).count() == 0 and knn_join.knn_join(d.limit(1), 5).count() == 0


def test_apportionment():
    r = random.Random(3)
    for _ in range(300):
        classes = [(float(r.randint(0, 12)), r.randint(0, 6), r.randint(1, 4)) for _ in range(r.randint(1, 6))]
        classes.sort(key=lambda c: -c[0])
        seats = r.randint(0, 40)
        line = [(-w / (2 * i + 1), -w, k, m) for k, (w, cap, members) in enumerate(classes) if w for m, i in product(range(members), range(cap))]
        want = Counter((k, m) for _, _, k, m in sorted(line)[:seats])
        base, more = mixing.apportion(classes, seats)
        got = Counter({(k, m): base[k] + (m < more[k]) for k, (_, _, members) in enumerate(classes) for m in range(members)})
        # Within one class and quotient, members are served in order; classes of equal weight stand in the order given.
        assert sum(got.values()) == sum(want.values()) == min(seats, len(line))
        distinct = len({w for w, _, _ in classes}) == len(classes)
        assert not distinct or +got == want


def brute_mix(rows, budget=mixing.BUDGET):
    """[(doc_id, source, shard, block)] of (doc_id, text, source)."""
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    size = lambda t: -(-len(t or "") // 4)
    shards = 1 + sum(size(t) for _, t, _ in rows) // mixing.SHARD_TOKENS
    groups = defaultdict(list)
    for i, t, s in rows:
        key = md5(t or "") if i is None else str(i)
        groups[s or "", int(md5("shard:" + key)[:8], 16) % shards].append((md5(f"{mixing.SEED}:{key}"), key, size(t), i))
    blocks = defaultdict(list)
    for g, members in groups.items():
        at = 0
        for _, _, n, i in sorted(members, key=lambda m: m[:3]):
            blocks[(*g, at // mixing.BLOCK_TOKENS)].append(i)
            at += n
    tokens, supply = Counter(), Counter()
    for (s, _), members in groups.items():
        tokens[s] += sum(m[2] for m in members)
    for s, _, _ in blocks:
        supply[s] += 1
    w = {s: float(n) ** mixing.TEMPERATURE for s, n in tokens.items()}
    line = sorted((-w[s] / (2 * i + 1), -w[s], s) for s in supply for i in range(supply[s]) if w[s])[: max(1, int(budget * len(blocks)))]
    out = []
    for s, seats in Counter(s for _, _, s in line).items():
        per = Counter(h for a, h, _ in blocks if a == s)
        quota = Counter(h for _, _, h in sorted((-n / (2 * i + 1), -n, h) for h, n in per.items() for i in range(n))[:seats])
        for h, k in quota.items():
            for b in sorted((b for a, x, b in blocks if (a, x) == (s, h)), key=lambda b: (md5(f"{mixing.SEED}:{s}:{h}:{b}"), b))[:k]:
                out += [(i, s, h, b) for i in blocks[s, h, b]]
    return Counter(out)


def test_mix(spark, monkeypatch):
    d = docs(spark)
    rows = [(r[0], r[1], r[3]) for r in d.collect()]
    assert Counter((r.doc_id, r.source, r.shard, r.block) for r in mixing.mix(d).collect()) == brute_mix(rows)
    assert mixing.mix(empty(spark)).count() == 0
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 900)
    r = random.Random(4)
    rows = [(i, "x" * r.randint(0, 200), r.choice(["hot", "hot", "hot", "b", "c", None])) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((x.doc_id, x.source, x.shard, x.block) for x in mixing.mix(d, budget=0.6).collect())
    assert got == brute_mix(rows, 0.6) and len({k[2] for k in got}) > 3
    only = mixing.mix(d, {"b": 1.0}, 0.1).collect()
    assert only and {x.source for x in only} == {"b"}


def test_pipeline(spark):
    """Each stage against brute force on what the stage before kept."""
    r = random.Random(5)
    french, english = FRENCH.split(), BASE.split()
    rows = []
    for i in range(60):
        w = [r.choice(french if i % 3 == 0 else english) for _ in range(40)]
        rows.append((i, " ".join(w) + (f" mail jo.{10 + i}@mail5.example.com" if i % 7 == 0 else ""), "fr" if i % 3 == 0 else "en", f"s{i % 4}"))
    rows += [(100 + i, rows[i][1], rows[i][2], "s0") for i in range(10)] + [(200 + i, rows[i][1].replace(" ", "  ", 3) + " end", rows[i][2], "s1") for i in range(5)]
    rows += [(300, "12 34 !!", "en", "s0"), (301, None, "en", "s0"), (302, "", "en", None), (303, LONG, "en", "s2")]
    d = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "mixture", "packing"] and corpus_pipeline.ORACLE_SQL is None
    now, kept = d, None
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x.asDict() for x in now.collect()}
        now = _store.materialise(stage(spark, now, "unused"), name)
        if name != "packing":
            assert now.columns == d.columns
            kept = {x.doc_id: x.asDict() for x in now.collect()}
        if name == "language_id":
            decided = {x.doc_id for x in language_id.identify(d).collect() if x.keep}
            assert set(kept) == decided and not decided & {300, 301, 302} and all(kept[i] == before[i] for i in kept)
        elif name == "near_duplicates":
            pairs = brute_pairs([(i, x["text"]) for i, x in before.items()], lambda t: gram_set(t, ngram_join.N), ngram_join.THRESHOLD)
            low = {i: i for i in before}
            for _ in low:
                for a, b in pairs:
                    low[a] = low[b] = min(low[a], low[b])
            assert set(kept) == {i for i in before if low[i] == i} and all(kept[i] == before[i] for i in kept) and len(kept) <= len(before) - 15
        elif name == "personal_data":
            found = dict(zip(before, pii.entities(pii.trained(), [x["text"] for x in before.values()])))
            assert {i: x["text"] for i, x in kept.items()} == {i: pii.redact(x["text"], found[i]) for i, x in before.items()}
            assert not any("@mail5" in x["text"] for x in kept.values()) and any("[EMAIL]" in x["text"] for x in kept.values()) and all(x["n_chars"] == len(x["text"]) for x in kept.values())
        elif name == "mixture":
            assert set(kept) == {k[0] for k in brute_mix([(i, x["text"], x["source"]) for i, x in before.items()])}
        else:
            check_packing([(i, x["text"]) for i, x in kept.items()], now.collect(), packing.CAPACITY)


def test_pipeline_stages_take_awkward_rows(spark):
    """Nulls, repeated rows, columns that clash in other letters and no rows go through every stage."""
    first = docs(spark)
    first = first.toDF(*first.columns[:-1], "DOC_ID").crossJoin(spark.createDataFrame([("other",)], "TEXT string"))
    assert [c.lower() for c in first.columns].count("doc_id") == [c.lower() for c in first.columns].count("text") == 2
    kept = corpus_pipeline.near_duplicates(spark, first, "").collect()
    assert Counter(x[0] for x in kept) == Counter([None, 1, 4, 5, 6, 7, 9, 10, 12, 14, 15])
    for start in (first, first.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
            if name != "packing":
                rows = now.collect()
                assert now.columns == first.columns and all(x[-1] == "other" for x in rows)
                now = spark.createDataFrame([tuple(x) for x in rows], now.schema)
        assert now.columns == ["doc_id", "piece", "n_tokens", "bin_id"] and (now.count() > 0) == (start is first)


def test_of_rows_with_one_id_the_smallest_stays(spark):
    rows = [(1, "b b b b", "en", "x"), (1, "a a a", "en", "y"), (1, None, "en", "z"), (2, None, "en", "x"), (2, "c d e", "en", "x"), (None, "q", "en", "x"), (None, "q", "en", "x"), (3, "u v w", "en", "b"), (3, "u v w", "en", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for parts in (1, 3):
        got = [tuple(x) for x in corpus_pipeline.near_duplicates(spark, d.repartition(parts, "source"), "").collect()]
        assert Counter(got) == Counter([(1, "a a a", "en", "y"), (2, "c d e", "en", "x"), (None, "q", "en", "x"), (None, "q", "en", "x"), (3, "u v w", "en", "a")])


def test_rows_without_id_are_taken_by_their_text(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 40)
    r = random.Random(8)
    rows = [(None if i % 2 else i, "x" * r.randint(20, 200) + str(i), r.choice("ab")) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter((x.doc_id, x.source, x.n_tokens) for x in mixing.mix(d, budget=0.5).collect())
    got = [tuple(x) for x in mixing.take(d, budget=0.5).collect()]
    assert Counter((i, s, -(-len(t) // 4)) for i, t, s in got) == taken and 60 < len(got) < 140 and set(got) < set(rows)


def test_a_corpus_of_one_block_is_taken(spark):
    d = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    assert mixing.mix(d).count() == mixing.take(d).count() == 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: {}})()
        conf = type("D", (), {"get": lambda self, k, d: d})()

    with pytest.raises(ValueError):
        _store.shared_dir(Cluster())
