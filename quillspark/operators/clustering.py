"""Clusters of embeddings: k-means, elbow, silhouette, inertia, keywords and labels."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round, jvm

STOP_WORDS = sorted("are and for from has have that the this was with".split())


def _unit(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: F.try_divide(x, n))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sums(df: DataFrame, vec: str, cluster: str, normalise: bool) -> DataFrame:
    """(cluster, n, total): the vector sum of each cluster, by element, so that partial sums are combined before the shuffle."""
    v = _unit(F.col(vec)) if normalise else F.transform(F.col(vec), lambda x: x.cast("double"))
    e = df.select(F.col(cluster).alias("cluster"), F.posexplode(v).alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return e.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))


def inertia(df: DataFrame, vec: str, cluster: str, cosine: bool = False) -> DataFrame:
    """(cluster, n, inertia): sum of squared distances to the cluster's mean."""
    c = sums(df, vec, cluster, normalise=False).select("cluster", "n", F.transform("total", lambda x: x / F.col("n")).alias("centre"))
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    if cosine:
        d = F.lit(1.0) - _dot(_unit(v), _unit(F.col("centre")))
        sq = d * d
    else:
        sq = F.aggregate(F.zip_with(v, "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return df.withColumnRenamed(cluster, "cluster").join(F.broadcast(c), "cluster").groupBy("cluster", "n").agg(F.sum(sq).alias("inertia"))


def silhouette(df: DataFrame, ident: str, vec: str, cluster: str) -> DataFrame:
    """(id, cluster, a, b, silhouette) by cosine distance, in time linear in the rows.

    The mean distance of a unit vector u to a cluster is 1 - u.S/n, S being the sum of its unit vectors; within its own
    cluster, itself apart, (n - u.S)/(n - 1), and 0 for a single one. With one cluster, all are 0.
    """
    s = sums(df, vec, cluster, normalise=True)
    table = s.agg(F.collect_list(F.struct("cluster", "n", "total")).alias("all"))
    rows = df.select(F.col(ident).alias("id"), F.col(cluster).alias("cluster"), _unit(F.col(vec)).alias("u")).crossJoin(F.broadcast(table))
    own = F.filter("all", lambda c: c["cluster"] == F.col("cluster"))[0]
    a = F.when(own["n"] > 1, (own["n"] - _dot(F.col("u"), own["total"])) / (own["n"] - 1)).otherwise(0.0)
    others = F.transform(F.filter("all", lambda c: c["cluster"] != F.col("cluster")), lambda c: F.lit(1.0) - _dot(F.col("u"), c["total"]) / c["n"])
    out = rows.select("id", "cluster", a.alias("a"), F.array_min(others).alias("b"))
    return out.withColumn("silhouette", F.when(F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))))


def kmeans(df: DataFrame, vec: str, k: int, iterations: int = 100, cosine: bool = True, seed: int = 42) -> tuple[KMeansModel, DataFrame]:
    """(model, df with cluster)."""
    rows = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="_v", predictionCol="cluster", distanceMeasure="cosine" if cosine else "euclidean").fit(rows)
    return model, model.transform(rows).drop("_v")


def elbow(df: DataFrame, vec: str, max_k: int = 8) -> tuple[int, list[float]]:
    """(k, inertias for k = 2..): where the second difference of inertia is greatest; 2 with fewer than three values."""
    n = df.limit(2 * max_k + 1).count()
    top = min(max_k, n // 2)
    if top < 2:
        return min(2, n), []
    rows = df.select(vec).persist()  # read once, for all numbers of clusters
    try:
        costs = [kmeans(rows, vec, k, 50)[0].summary.trainingCost for k in range(2, top + 1)]
    finally:
        rows.unpersist()
    drops = [a - b for a, b in zip(costs, costs[1:])]
    bends = [a - b for a, b in zip(drops, drops[1:])]
    return (bends.index(max(bends)) + 3 if bends else 2), costs


def clusters(df: DataFrame, cluster: str, ident: str) -> DataFrame:
    """(cluster, n, first_seen, members in order) of assigned rows; first_seen orders clusters by their first row."""
    return df.groupBy(cluster).agg(F.count("*").alias("n"), F.min(ident).alias("first_seen"), F.sort_array(F.collect_list(ident)).alias("members"))


def centres(model: KMeansModel) -> list[list[float]]:
    """Cluster centres."""
    return [list(map(float, c)) for c in model.clusterCenters()]


def keywords(df: DataFrame, text: str, keys: list[str], order: list[str], k: int = 5) -> DataFrame:
    """(keys, keyword, n, rank): the most frequent words of three letters or more per group; earlier words first among equals."""
    words = F.regexp_extract_all(F.lower(text), F.lit(jvm(r"\b[a-z]{3,}\b")), 0)
    w = df.select(*keys, *order, F.posexplode(words).alias("_i", "keyword")).filter(~F.col("keyword").isin(STOP_WORDS))
    n = w.groupBy(*keys, "keyword").agg(F.count("*").alias("n"), F.min(F.struct(*order, "_i")).alias("seen"))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "seen"))
    return n.withColumn("rank", r).filter(F.col("rank") <= k).drop("seen")


def label_of(words: Column) -> Column:
    """Label of a cluster by its keywords."""
    any_of = lambda s: F.arrays_overlap(words, F.array(*map(F.lit, s.split())))
    first = words[0]
    own = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1 << 30), F.lit(" Tasks"))
    out = F.when(F.size(words) == 0, "Mixed Prompts").when(any_of("bug debug error fix"), "Debug & Fix Issues").when(any_of("add build create implement"), "Feature Implementation")
    out = out.when(any_of("clean improve optimize refactor"), "Refactoring").when(any_of("spec test testing"), "Testing").when(any_of("change modify update"), "Updates & Modifications")
    return out.otherwise(own)


def labelled(df: DataFrame, text: str, cluster: str, order: list[str]) -> DataFrame:
    """(cluster, n, label, keywords, representative): the representative is the shortest text, the first among equals."""
    kw = keywords(df, text, [cluster], order).groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    rep = df.groupBy(cluster).agg(F.count("*").alias("n"), F.min_by(text, F.struct(F.length(text), *order)).alias("representative"))
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    return rep.join(kw, cluster, "left").select(cluster, "n", label_of(words).alias("label"), words.alias("keywords"), "representative")


def cluster_summary(df: DataFrame, cluster: str) -> DataFrame:
    """One row: clusters, mean size to one place, largest and smallest size."""
    return df.groupBy(cluster).count().agg(F.count("*").alias("clusters"), js_round(F.avg("count"), 1).alias("avg_size"), F.max("count").alias("largest"), F.min("count").alias("smallest"))


def cluster_analysis(df: DataFrame, ident: str, vec: str, text: str | None = None, max_k: int = 8) -> DataFrame | None:
    """df with cluster and silhouette; None below three rows."""
    n = df.count()
    if n < 3:
        return None
    k, _ = elbow(df, vec, min(max_k, max(n // 3, 1)))
    _, rows = kmeans(df, vec, max(2, k))
    s = silhouette(rows, ident, vec, "cluster").select(F.col("id").alias(ident), "silhouette")
    return rows.join(s, ident)


