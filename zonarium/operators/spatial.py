"""Spatial joins by grid cells: containment, smallest polygon, neighbours within a radius, zonal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonarium.functions import geometry as g
from zonarium.operators.lookups import small, top_k
from zonarium.sources.scratch import materialised


#: A zone is filed under the cells of a level where it is at most so many cells wide and high.
CELLS = 4


def cell_join(points: DataFrame, zones: DataFrame, size: float, x: str = "x", y: str = "y", ring: str | None = None) -> DataFrame:
    """Points with the zones that contain them (boundary by half-open boxes, or by the ring if there is one).

    A zone is filed under the cells its box touches, on the finest of some levels (each of twice the cells' size) where they
    are at most ``CELLS`` and one a side, and a point under its one cell of every level in use, so candidates meet by
    equality and no zone is many rows; the exact test follows.  For crowded points or many corners see ``spatial_index``.
    """
    wide = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) / (size * CELLS)
    filed = zones.withColumn("_l", F.ceil(F.log2(F.greatest(wide, F.lit(1.0)))).cast("int")).where("_l is not null")
    levels = sorted(r["_l"] for r in filed.select("_l").distinct().collect())
    at = lambda v: F.floor(v / (F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_l"))))
    p = points.withColumn("_l", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_cx", at(F.col(x))).withColumn("_cy", at(F.col(y)))
    z = filed.withColumn("_cx", F.explode(F.sequence(at(F.col("xmin")), at(F.col("xmax"))))).withColumn("_cy", F.explode(F.sequence(at(F.col("ymin")), at(F.col("ymax")))))
    inside = g.contains(F.col(ring), F.col(x), F.col(y)) if ring else (F.col(x) >= F.col("xmin")) & (F.col(x) < F.col("xmax")) & (F.col(y) >= F.col("ymin")) & (F.col(y) < F.col("ymax"))
    return p.join(small(z), ["_l", "_cx", "_cy"]).where(inside).drop("_l", "_cx", "_cy")


def within_radius(points: DataFrame, others: DataFrame, radius: float, x: str = "x", y: str = "y", ox: str = "ox", oy: str = "oy") -> DataFrame:
    """Pairs of points and others at most ``radius`` apart, with ``distance``: others are filed under nine cells."""
    p = points.withColumn("_cx", F.floor(F.col(x) / radius)).withColumn("_cy", F.floor(F.col(y) / radius))
    around = F.array(*(F.lit(k).cast("long") for k in (-1, 0, 1)))
    o = others.withColumn("_cx", F.explode(F.transform(around, lambda k: k + F.floor(F.col(ox) / radius)))).withColumn("_cy", F.explode(F.transform(around, lambda k: k + F.floor(F.col(oy) / radius))))
    apart = F.sqrt(F.pow(F.col(x) - F.col(ox), 2) + F.pow(F.col(y) - F.col(oy), 2))
    return p.join(small(o), ["_cx", "_cy"]).withColumn("distance", apart).where(F.col("distance") <= radius).drop("_cx", "_cy")


def nearest_within(points: DataFrame, others: DataFrame, key: str, radius: float, most: int, digits: int = 9, x: str = "x", y: str = "y", ox: str = "ox", oy: str = "oy") -> DataFrame:
    """Points with the ``most`` nearest others at most ``radius`` apart, with ``distance``; ties of the rounded distance go to the smaller key.

    Equal points ask once, and of others in one place only the ``most`` smallest keys can be among the nearest, so the
    pairs that are compared depend on the places, not on how many rows stand in each.
    """
    first = top_k(others, [ox, oy], most, F.col(key)).drop("rank")
    near = within_radius(points.select(x, y).distinct(), first, radius, x, y, ox, oy)
    near = top_k(near, [x, y], most, F.round("distance", digits), F.col(key)).drop("rank")
    return points.join(small(materialised(near, "nearest")), [x, y])


def percentile(value: str | Column, q: float, accuracy: int | None = None) -> Column:
    """Exact percentile, which holds a group's distinct values in one task; with ``accuracy`` a sketch of fixed size, off by at most 1/accuracy of the ranks."""
    return F.percentile(value, q) if accuracy is None else F.percentile_approx(value, q, accuracy)


def zonal_percentile(pixels: DataFrame, zone: str, value: str, q: float, least: int, accuracy: int | None = None) -> DataFrame:
    """Percentile of the values in each zone, null with fewer than ``least`` of them: one aggregation for all zones."""
    n = F.count(value)
    return pixels.groupBy(zone).agg(n.alias("n"), F.when(n >= least, percentile(value, q, accuracy)).alias("p"))


def cloud_height(points: DataFrame, key: str, z: str, ground: str, least: int = 10, least_ground: int = 5, highest: float = 60.0, accuracy: int | None = None) -> DataFrame:
    """Height over ground of each body from its points; null without enough points or if it is not plausible."""
    on_ground = F.when(F.col(ground), F.col(z))
    a = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), percentile(z, 0.9, accuracy).alias("_t"), F.count(on_ground).alias("_g"), percentile(on_ground, 0.5, accuracy).alias("_b"))
    h = F.col("_t") - F.col("_b")
    return a.select(key, "n", F.when((F.col("n") >= least) & (F.col("_g") >= least_ground) & h.between(0, highest), F.round(h, 4)).alias("altura"))
