"""Descriptive statistics, quantiles, outliers, histograms, trends and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round

PERCENTILES = (25, 50, 75, 90, 95)


def _ranks(n: Column, p: float) -> tuple[Column, Column]:
    """Ranks (from 1) whose values' mean is quantile p of n values.

    The rule: at n*p, the next rank if that isn't whole; else the mean of that rank and the next, for an even n, or the next, for an odd one.
    """
    at = n * F.lit(p)
    if p <= 0:
        return F.lit(1).cast("long"), F.lit(1).cast("long")
    if p >= 1:
        return n, n
    up, whole = F.ceil(at), at.cast("long").cast("double") == at
    low = F.when(~whole, up).when(n % 2 == 0, at.cast("long")).otherwise(at.cast("long") + 1)
    high = F.when(~whole, up).otherwise(at.cast("long") + 1)
    return low, high


def quantiles(df: DataFrame, column: str, ps: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """One row (per key) of quantiles.

    Values are counted first, so what is ranked is one row per different value; ranks come from sums per value range,
    so no task holds all values.
    """
    keys = keys or []
    v = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("v")).count()
    spread = _spread(v, keys)
    w = Window.partitionBy(*keys, "part").orderBy("v")
    before = spread.groupBy(*keys, "part").agg(F.sum("count").alias("m"))
    pw = Window.partitionBy(*keys).orderBy("part")
    before = before.withColumn("start", F.sum("m").over(pw) - F.col("m")).withColumn("n", F.sum("m").over(Window.partitionBy(*keys)))
    on = keys + ["part"]
    ranked = spread.join(F.broadcast(before), on).withColumn("last", F.col("start") + F.sum("count").over(w)).withColumn("first", F.col("last") - F.col("count") + 1)
    out = []
    for name, p in ps.items():
        lo, hi = _ranks(F.col("n"), p)
        at = lambda r: F.max(F.when((r >= F.col("first")) & (r <= F.col("last")), F.col("v")))
        out.append(((at(lo) + at(hi)) / 2).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def _spread(v: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the number of the range, by approximate percentiles, that they lie in."""
    cuts = v.agg(F.expr("approx_percentile(v, array(" + ", ".join(str(i / 32) for i in range(1, 32)) + "), 1000)").alias("c")).first()
    edges = sorted(set(cuts.c or [])) if cuts else []
    part = F.lit(0)
    for e in edges:
        part = part + (F.col("v") > F.lit(float(e))).cast("int")
    return v.withColumn("part", part)


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, median, sd, variance, min, max, range, percentiles, sample skewness and excess kurtosis.

    sd and variance are 0 below 2 values, skewness below 3, kurtosis below 4 and where all values are equal; an empty column is all zeros.
    """
    x = F.col(column).cast("double")
    n = F.count(x).cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    skew = F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    base = df.agg(
        F.count(x).alias("n"), zero(F.avg(x)).alias("mean"), zero(F.stddev_samp(x)).alias("sd"), zero(F.var_samp(x)).alias("variance"), zero(F.min(x)).alias("lowest"), zero(F.max(x)).alias("highest"),
        zero(F.max(x) - F.min(x)).alias("value_range"), zero(F.when(F.var_pop(x) > 0, skew)).alias("skew"), zero(F.when(F.var_pop(x) > 0, kurt)).alias("kurt"),
    )
    q = quantiles(df, column, {f"p{p}": p / 100 for p in PERCENTILES})
    out = base.crossJoin(q.agg(*(zero(F.max(f"p{p}")).alias(f"p{p}") for p in PERCENTILES)))
    return out.withColumn("median", F.col("p50"))


def outliers(df: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    """Rows of df with lower, upper and is_outlier. Below 4 values nothing is one and the bounds are min and max."""
    x = F.col(column).cast("double")
    if method == "zscore":
        b = df.agg(F.count(x).alias("_n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        few = F.col("_n") < 4
        b = b.select(F.when(few, F.col("_lo")).otherwise(F.col("_m") - 3 * F.col("_s")).alias("lower"), F.when(few, F.col("_hi")).otherwise(F.col("_m") + 3 * F.col("_s")).alias("upper"), few.alias("_few"), "_m", "_s")
        out = df.crossJoin(F.broadcast(b))
        hit = ~F.col("_few") & (F.abs(F.try_divide(x - F.col("_m"), F.col("_s"))) > 3)
        return out.withColumn("is_outlier", F.coalesce(hit, F.lit(False))).drop("_few", "_m", "_s")
    q = quantiles(df, column, {"_q1": 0.25, "_q3": 0.75})
    b = df.agg(F.count(x).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi")).crossJoin(q)
    few, iqr = F.col("_n") < 4, F.col("_q3") - F.col("_q1")
    b = b.select(F.when(few, F.col("_lo")).otherwise(F.col("_q1") - iqr * 1.5).alias("lower"), F.when(few, F.col("_hi")).otherwise(F.col("_q3") + iqr * 1.5).alias("upper"), few.alias("_few"))
    out = df.crossJoin(F.broadcast(b))
    return out.withColumn("is_outlier", F.coalesce(~F.col("_few") & ((x < F.col("lower")) | (x > F.col("upper"))), F.lit(False))).drop("_few")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, lower, n) of equal widths; all values in bin 0 if they are equal; empty bins are kept."""
    x = F.col(column).cast("double")
    b = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = df.filter(x.isNotNull()).crossJoin(F.broadcast(b)).groupBy(at.cast("int").alias("bin")).count()
    frame = b.filter("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("lower"), F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def moving_average(series: DataFrame, value: str, order: str, window: int) -> DataFrame:
    """series with moving_average over the row and window - 1 before it, to 2 places; no rows for a window below 1. The series has one row per day."""
    if window < 1:
        return series.withColumn("moving_average", F.lit(None).cast("double")).limit(0)
    w = Window.orderBy(order).rowsBetween(-(window - 1), 0)
    return series.withColumn("moving_average", js_round(F.avg(value).over(w), 2))


def trend(series: DataFrame, day: str, score: str) -> DataFrame:
    """One row: slope, intercept, r2, last_x, last_day, direction and confidence of a line over days since the first.

    With fewer than two points all are 0, stable and low. Points are taken in order of day.
    """
    first = series.agg(F.min(day).alias("_first"))
    xy = series.crossJoin(F.broadcast(first)).select(F.datediff(day, "_first").cast("double").alias("x"), F.col(score).cast("double").alias("y"), F.col(day).alias("d"))
    n = F.count("*")
    fit = xy.agg(n.alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.max("x").alias("last_x"), F.max("d").alias("last_day"))
    use = lambda c: F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0))).alias(c)
    out = fit.select("n", use("slope"), use("intercept"), use("r2"), use("last_x"), "last_day")
    return out.withColumns({"direction": F.when(F.col("slope") > 0.1, "improving").when(F.col("slope") < -0.1, "declining").otherwise("stable"), "confidence": F.when(F.col("r2") > 0.7, "high").when(F.col("r2") > 0.4, "medium").otherwise("low")})


def projection(fit: DataFrame, days: list[int]) -> DataFrame:
    """(days, projected) on the line of trend(), so many days after the last point."""
    return fit.select(F.explode(F.array(*map(F.lit, days))).alias("days"), "slope", "intercept", "last_x").select("days", (F.col("intercept") + F.col("slope") * (F.col("last_x") + F.col("days"))).alias("projected"))


def forecast(fit: DataFrame, periods: int, as_of: str) -> DataFrame:
    """(day, predicted, lower, upper) for each of the days after as_of; the band is as wide as the fit is poor and within 0..10."""
    rows = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(max(periods, 1)))).alias("k")).filter(F.col("k") <= periods)
    p = F.col("intercept") + F.col("slope") * (F.col("last_x") + F.col("k"))
    width = (F.lit(1.0) - F.col("r2")) * 2
    return rows.select(F.date_add(F.lit(as_of).cast("date"), F.col("k")).alias("day"), js_round(p, 2).alias("predicted"), js_round(F.greatest(F.lit(0.0), p - width), 2).alias("lower"), js_round(F.least(F.lit(10.0), p + width), 2).alias("upper"))


def improvement(series: DataFrame, day: str, score: str) -> DataFrame:
    """One row: mean of the last three points, of those before, their difference and its status."""
    r = F.row_number().over(Window.orderBy(F.desc(day)))
    ranked = series.select(r.alias("r"), F.col(score).cast("double").alias("y"))
    out = ranked.agg(F.count("*").alias("n"), F.avg(F.when(F.col("r") <= 3, F.col("y"))).alias("recent"), F.avg(F.when(F.col("r") > 3, F.col("y"))).alias("earlier"))
    earlier = F.coalesce("earlier", "recent")
    delta = F.col("recent") - earlier
    few = F.col("n") < 3
    status = F.when(few, "insufficient_data").when(delta > 0.5, "improving").when(delta < -0.5, "declining").otherwise("stable")
    zero = lambda c: F.when(few, F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))
    return out.select(status.alias("status"), zero(js_round(F.col("recent"), 2)).alias("recent"), zero(js_round(earlier, 2)).alias("earlier"), zero(js_round(delta, 2)).alias("delta"), zero(js_round(F.try_divide(delta, earlier) * 100, 1)).alias("percent"))
