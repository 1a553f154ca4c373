"""Operators on small rows: merging, rules, statistics, trends, comparison, batching, clusters, stores."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import batching, clustering, compare, issues, prompts, stats
from quillspark.sources import store

PATTERN = "pos int, id string, name string, frequency double, severity string, examples array<string>, suggestion string"


def test_merge_takes_mean_and_gravest(spark):
    rows = [(1, "a", "A", 2.0, "low", ["x", "y"], "s"), (2, "a", "A2", 5.0, "high", ["z", "w"], "t"), (2, "b", "B", 7.5, "medium", ["q"], "u")]
    got = issues.merge_patterns(spark.createDataFrame(rows, PATTERN)).orderBy("rank").collect()
    assert [(r.id, r.frequency, r.severity, r.examples) for r in got] == [("a", 4.0, "high", ["x", "y", "z"]), ("b", 7.5, "medium", ["q"])]
    assert got[0]["name"] == "A" and got[0]["suggestion"] == "s"


def test_cached_come_first_and_a_single_batch_is_left_alone(spark):
    new = spark.createDataFrame([(1, f"i{k}", "N", float(k), "low", ["e"], "s") for k in range(7)], PATTERN)
    none = spark.createDataFrame([], PATTERN)
    assert issues.merge_with_cached(none, new).count() == 7
    old = spark.createDataFrame([(9, "i0", "Old", 4.0, "low", ["o"], "s")], PATTERN)
    got = {r.id: r for r in issues.merge_with_cached(old, new).collect()}
    assert len(got) == 5 and max(r.frequency for r in got.values()) == 6


def test_rules(spark):
    p = spark.createDataFrame([("vague", "high"), ("too-broad", "medium"), ("own-thing", "low")], "id string, severity string")
    none = spark.createDataFrame([], "id string, enabled boolean, severity string")
    assert issues.apply_rules(p, none).count() == 3
    r = spark.createDataFrame([("vague", None, "low"), ("too-broad", False, None), ("zzz", True, None)], "id string, enabled boolean, severity string")
    assert [(x.id, x.severity) for x in issues.apply_rules(p, r).collect()] == [("vague", "low")]
    assert [x.id for x in issues.unknown_rules(r).collect()] == ["zzz"]
    assert {x.id for x in issues.rules_list(r).filter("overridden").collect()} == {"vague"}


def test_individual_results(spark):
    rows = [(1, "problems", ["other", "vague-request"], "e1", "s1"), (2, "ok", [], "", ""), (3, "problems", ["vague-request", "zz"], "e2", "s2"), (4, "problems", ["zz"], "e3", "s3")]
    top, totals = issues.aggregate_individual(spark.createDataFrame(rows, "pos int, status string, categories array<string>, example string, suggestion string"))
    got = top.collect()
    assert [r.id for r in got] == ["vague-request", "zz", "other"] and got[0].examples == ["e1", "e2"] and got[0].suggestion == "s1" and got[1]["name"] == "zz"
    t = totals.first()
    assert (t.total_prompts, t.prompts_with_issues, t.overall_score) == (4, 3, 2.5)


def test_examples_stop_before_they_are_deduplicated(spark):
    df = spark.createDataFrame([(1, "fix  it"), (2, "fix it"), (3, "fix it"), (4, "fix that")], "pos int, t string")
    assert {r.id: r.examples for r in issues.real_examples(df, "t", ["pos"]).collect()}["vague"] == ["fix it"]


def quantile(x, p):
    x, at = sorted(x), len(x) * p
    if p in (0, 1):
        return x[0] if p == 0 else x[-1]
    if at != int(at):
        return x[math.ceil(at) - 1]
    return (x[int(at) - 1] + x[int(at)]) / 2 if len(x) % 2 == 0 else x[int(at)]


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [5.0, 5.0, 5.0, 5.0], [float(i % 7) for i in range(50)], [float(i) for i in range(1, 11)], [float(i * i) for i in range(101)]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ps = {f"p{int(p * 100)}": p for p in (0, 0.25, 0.5, 0.75, 0.9, 1)}
    got = stats.quantiles(df, "v", ps).first()
    assert {k: got[k] for k in ps} == {k: quantile(values, p) for k, p in ps.items()}


def test_describe_edges(spark):
    e = stats.describe(spark.createDataFrame([], "v double"), "v").first()
    assert e.n == 0 and e["mean"] == e.median == e.sd == e.skew == 0
    c = stats.describe(spark.createDataFrame([(2.0,)] * 5, "v double"), "v").first()
    assert (c["mean"], c.sd, c.skew, c.kurt, c.p90) == (2, 0, 0, 0, 2)


def test_outliers_and_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 3, 3, 4, 100]], "v double")
    assert [r.v for r in stats.outliers(df, "v").filter("is_outlier").collect()] == [100]
    assert not stats.outliers(df.limit(3), "v").filter("is_outlier").count() and not stats.outliers(df, "v", "zscore").filter("is_outlier").count()
    assert [r.n for r in stats.histogram(df, "v", 3).orderBy("bin").collect()] == [7, 0, 1]
    assert [r.n for r in stats.histogram(spark.createDataFrame([(5.0,)] * 4, "v double"), "v", 2).orderBy("bin").collect()] == [4, 0]


def test_trend_forecast_improvement(spark):
    s = spark.createDataFrame([(f"2025-01-0{i + 1}", 5 + i / 2) for i in range(5)], "d string, y double").withColumn("d", F.col("d").cast("date"))
    t = stats.trend(s, "d", "y")
    r = t.first()
    assert (round(r.slope, 6), round(r.r2, 6), r.direction, r.confidence) == (0.5, 1.0, "improving", "high")
    assert [round(x.projected, 6) for x in stats.projection(t, [1]).collect()] == [7.5]
    f = stats.forecast(t, 2, "2025-01-05").orderBy("day").collect()
    assert [(str(x.day), x.predicted, x.lower, x.upper) for x in f] == [("2025-01-06", 7.5, 7.5, 7.5), ("2025-01-07", 8.0, 8.0, 8.0)]
    assert stats.trend(s.limit(1), "d", "y").first().direction == "stable"
    i = stats.improvement(s, "d", "y").first()
    assert (i.status, i.recent, i.earlier, i.delta) == ("improving", 6.5, 5.25, 1.25)
    assert stats.improvement(s.limit(2), "d", "y").first().status == "insufficient_data"
    assert [x.moving_average for x in stats.moving_average(s, "y", "d", 2).orderBy("d").collect()] == [5.0, 5.25, 5.75, 6.25, 6.75] and stats.moving_average(s, "y", "d", 0).count() == 0


def test_compare(spark):
    b = spark.createDataFrame([("a", "A", 1, "low"), ("b", "B", 2, "low"), ("c", "C", 3, "low")], "id string, name string, frequency int, severity string")
    a = spark.createDataFrame([("b", "B9", 2, "high"), ("c", "C", 3, "low"), ("d", "D", 1, "low")], "id string, name string, frequency int, severity string")
    got = {r.id: (r.status, r["name"]) for r in compare.compare_patterns(b, a).collect()}
    assert got == {"a": ("resolved", "A"), "b": ("changed", "B"), "d": ("new", "D")}


def greedy(tokens, limit, most):
    out, batch, total, n, full = [], -1, 0, 0, True
    for t in tokens:
        if t > limit or full or total + t > limit or n >= most:
            batch, total, n = batch + 1, 0, 0
        total, n, full = total + t, n + 1, t > limit
        out.append(batch)
    return out


def test_greedy_batches(spark):
    sizes = [40, 400, 1200, 4100, 4, 8, 3990, 12, 12, 12, 2000, 2000, 1]
    df = spark.createDataFrame([("g", i, "x" * n) for i, n in enumerate(sizes)] + [("h", 0, "y")], "g string, i int, t string")
    got = batching.greedy_batches(df, "t", "g", ["i"], 3000, 3).filter("g = 'g'").orderBy("i").collect()
    assert [r.batch for r in got] == greedy([math.ceil(n / 4) for n in sizes], 1000, 3)
    assert [r.batch for r in batching.greedy_batches(df, "t", "g", ["i"], 500, 3).filter("g = 'g'").orderBy("i").collect()] == list(range(len(sizes)))
    assert batching.strategy_of("unknown")[0] == "micro" and batching.strategy_of("mixtral:latest")[0] == "standard"


def brute_silhouette(v, c):
    unit = [[x / math.hypot(*a) for x in a] for a in v]
    dist = lambda p, q: 1 - sum(x * y for x, y in zip(p, q))
    out = []
    for i, u in enumerate(unit):
        mean = lambda k: sum(dist(u, w) for j, w in enumerate(unit) if c[j] == k and j != i) / max(1, sum(1 for j in range(len(v)) if c[j] == k and j != i))  # noqa: E731, B023
        a, b = mean(c[i]), min(mean(k) for k in set(c) if k != c[i])
        out.append((b - a) / max(a, b))
    return out


def test_silhouette_and_labels(spark):
    v = [[1.0, 0.1], [0.9, 0.2], [0.1, 1.0], [0.2, 0.8], [-1.0, 0.3]]
    c = [0, 0, 1, 1, 2]
    df = spark.createDataFrame([(i, x, k) for i, (x, k) in enumerate(zip(v, c))], "i int, v array<double>, c int")
    got = [r.silhouette for r in clustering.silhouette(df, "i", "v", "c").orderBy("id").collect()]
    assert got == pytest.approx(brute_silhouette(v, c)) and got[4] == 1
    t = spark.createDataFrame([(0, 0, "fix the bug now"), (1, 0, "fix"), (2, 1, "zebra zebra lion"), (3, 2, "a b")], "i int, c int, t string")
    assert {r.c: (r.label, r.representative) for r in clustering.labelled(t, "t", "c", ["i"]).collect()} == {0: ("Debug & Fix Issues", "fix"), 1: ("Zebra Tasks", "zebra zebra lion"), 2: ("Mixed Prompts", "a b")}
    k, costs = clustering.elbow(df, "v")
    assert k == 2 or k >= 2 and len(costs) >= 1


def test_days_and_duplicates(spark):
    p = spark.createDataFrame([("b", "2025-01-01T10:00:00Z", "s", "x", "2025-01-01"), ("a", "2025-01-01T09:00:00Z", "s", "y", "2025-01-01"), ("a", "2025-01-01T09:00:00Z", "s", "y", "2025-01-01")], "content string, timestamp string, sessionId string, project string, date string")
    d = prompts.by_day(p).first()
    assert d.n == 3 and [x.content for x in d.prompts] == ["a", "a", "b"] and d.projects == ["x", "y"]
    assert prompts.drop_repeated(p).count() == 2 and prompts.on_date(p, "timestamp", "2025-01-01").count() == 3 and prompts.in_range(p, "timestamp", "2025-01-02", "2025-01-01").count() == 0
    assert prompts.dry_run(p).first().n == 3


def test_stores(spark, tmp_path):
    path = str(tmp_path / "history")
    schema = "date date, provider string, prompts int, projects array<string>, score double, patterns array<struct<id:string,examples:array<string>>>, top_suggestion string"
    e = spark.createDataFrame([(None, "offline", 3, ["Alpha"], 7.0, [("vague", ["mail a@b.com"])], "t")], schema)
    for day, score in (("2025-01-01", 5.0), ("2025-01-02", 7.0), ("2025-01-02", 8.0)):
        store.save_history(e.withColumn("date", F.lit(day).cast("date")).withColumn("score", F.lit(score)), path)
    h = spark.read.parquet(path)
    assert h.count() == 2 and store.load_history(spark, path, "2025-01-02").first().score == 8
    assert h.first().patterns[0].examples == ["mail [REDACTED_EMAIL]"]
    assert [str(r.date) for r in store.list_history(h, "offline", "ALPH", 5, 9).collect()] == ["2025-01-02", "2025-01-01"] and not store.list_history(h, project="zz").count()
    results = str(tmp_path / "results")
    store.save_results(spark.createDataFrame([("h1", "2025-01-01"), ("h2", "2025-02-01")], "hash string, date string"), results)
    asked = spark.createDataFrame([("h1", "p"), ("h1", "p"), ("h3", "q"), ("h3", "q")], "hash string, content string")
    known = spark.read.parquet(results)
    assert store.hits(asked, known, text="content").count() == 1 and store.misses(asked, known).count() == 2 and store.hit_rate(asked, known).first().rate == 50
    assert store.cleanup_results(spark, results, "2025-02-01") == 1 and store.cleanup_results(spark, results + "x", "2025-02-01") == 0
    c = spark.createDataFrame([("k", "m", 2, 1000, "old"), ("k", "m", 2, 5000, "new"), ("z", "m", 2, 1000, "r")], "key string, model string, prompt_count int, cached_at long, result string")
    ask = spark.createDataFrame([("k", "m", 2), ("z", "other", 2)], "key string, model string, prompt_count int")
    assert [r.result for r in store.fresh_batches(ask, store.newest(c), 6000, 2000).collect()] == ["new"] and store.unexpired(c, 6000, 2000).count() == 1
