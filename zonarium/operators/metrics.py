"""Request metrics: rates by window, error ratios, histograms and their quantiles, latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rates(events: DataFrame, at: str, every: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Rows in each time window and group."""
    window = F.window(at, every, slide) if slide else F.window(at, every)
    return events.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def ratio(events: DataFrame, at: str, every: str, slide: str, bad: Column) -> DataFrame:
    """Share of bad rows in sliding windows."""
    g = events.groupBy(F.window(at, every, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    return g.select(F.col("w.start").alias("start"), "n", "bad", F.round(F.col("bad") / F.col("n"), 4).alias("ratio"))


def bounds_from_text(text: Column) -> Column:
    """Bucket bounds from a comma list: numbers only, positive, distinct, ascending."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("bigint")), lambda x: x > 0)))


def histogram(events: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts (``le``) for each bound and group: one pass, all bounds counted at once."""
    counted = events.groupBy(*by).agg(*(F.count_if(F.col(value) <= b).alias(f"_b{k}") for k, b in enumerate(bounds)), F.count(value).alias("total"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{k}").alias("n")) for k, b in enumerate(bounds)))
    return counted.select(*by, "total", F.explode(rows).alias("_r")).select(*by, "_r.le", "_r.n", "total")


def histogram_quantile(histogram_: DataFrame, by: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets by interpolation inside the bucket that reaches the rank."""
    w = W.partitionBy(*by).orderBy("le")
    h = histogram_.withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("from", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("rank", F.col("total") * q)
    hit = h.where((F.col("n") >= F.col("rank")) & (F.col("below") < F.col("rank")))
    return hit.select(*by, F.round(F.col("from") + (F.col("le") - F.col("from")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below")), 4).alias("quantile"))


def latency(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p90 (interpolated) and mean for each group."""
    v = F.col(value)
    return events.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.percentile(v, 0.5), 4).alias("p50"), F.round(F.percentile(v, 0.9), 4).alias("p90"), F.round(F.avg(v), 4).alias("mean"))
