"""Queries over places: what may be built on parcels, zones with holes at points, shapes read from GML, bodies written and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonarium.functions import geometry as g
from zonarium.functions import gml
from zonarium.operators.envelope import building_envelopes as envelopes
from zonarium.operators.lookups import small
from zonarium.operators.spatial_index import spatial_join
from zonarium.plans.registry import Registry, table
from zonarium.sources import volumes
from zonarium.sources.scratch import materialised

R = Registry()
C = F.col


def _ring(*corners: tuple[object, object]) -> Column:
    at = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.array(*(F.struct(at(x).cast("double").alias("x"), at(y).cast("double").alias("y")) for x, y in corners))


def _turned(ring: Column) -> Column:
    """By the angle of the triangle 3-4-5."""
    return F.transform(ring, lambda p: F.struct((0.8 * p["x"] - 0.6 * p["y"]).alias("x"), (0.6 * p["x"] + 0.8 * p["y"]).alias("y")))


@R.add(
    # a corner that points inwards leaves its square less a quarter of a polygon of 64 sides
    """WITH p AS (SELECT c_custkey AS k, c_custkey % 5 AS kind, 12.0::DOUBLE + c_custkey % 9 AS w, 12.0::DOUBLE + c_custkey % 7 AS h, 0.5 + (c_custkey % 4) * 0.5::DOUBLE AS d, 1.0::DOUBLE + c_custkey % 3 AS front,
        (c_custkey % 4) * 0.5::DOUBLE AS side, 6.0::DOUBLE + c_custkey % 3 AS big, ['north', 'south', 'east', 'west'][(c_custkey // 5 % 4)::INT + 1] AS dir, 1 - 8 * sin(pi() / 32) AS corner FROM customer),
    a AS (SELECT *, CASE WHEN kind < 2 THEN CASE WHEN dir IN ('north', 'south') THEN (w - 2 * side) * (h - front - 2) ELSE (w - front - 2) * (h - 2 * side) END
        WHEN kind = 2 THEN (w - 2 * d) * (h - 2 * d) - w * h / 9 + d * d * corner WHEN kind = 3 THEN (w - 2 * d) * (h - 2 * d) - (w / 4 + 2 * d) * (h / 4 + 2 * d) + 4 * d * d * corner
        WHEN w > 2 * big AND h > 2 * big THEN (w - 2 * big) * (h - 2 * big) END AS area FROM p)
    SELECT k AS c_custkey, CASE kind WHEN 0 THEN 'rect_directional' WHEN 1 THEN 'rotated_rect_directional' ELSE 'conservative_max_uniform' END AS mode,
        CASE kind WHEN 0 THEN 'rectangle_axis_aligned' WHEN 1 THEN 'rectangle_rotated' ELSE 'general' END AS shape, CASE WHEN kind < 2 THEN 'applied' WHEN kind = 2 THEN 'not_applicable' ELSE 'not_requested' END AS directional,
        CASE WHEN kind < 2 THEN CASE dir WHEN 'north' THEN 'top' WHEN 'south' THEN 'bottom' WHEN 'east' THEN 'right' ELSE 'left' END END AS front_side,
        CASE WHEN area IS NULL THEN 'exhausted' WHEN kind = 2 THEN 'non_rectangular_parcel' END AS reason, round(area, 4) AS area, CASE WHEN area IS NULL THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END AS rings FROM a"""
)
def building_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as parcels: straight and turned rectangles with a front, outlines with a corner out, courtyards, and setbacks that may leave nothing."""
    k = C("c_custkey")
    kind, w, h, d = k % 5, 12.0 + k % 9, 12.0 + k % 7, 0.5 + (k % 4) * 0.5
    box = _ring((0, 0), (w, 0), (w, h), (0, h))
    ell = _ring((0, 0), (w, 0), (w, h * 2 / 3), (w * 2 / 3, h * 2 / 3), (w * 2 / 3, h), (0, h))
    hole = _ring((w * 3 / 8, h * 3 / 8), (w * 5 / 8, h * 3 / 8), (w * 5 / 8, h * 5 / 8), (w * 3 / 8, h * 5 / 8))
    rings = F.when(kind == 1, F.array(_turned(box))).when(kind == 2, F.array(ell)).when(kind == 3, F.array(box, hole)).otherwise(F.array(box))
    direction = F.element_at(F.array(*map(F.lit, ("north", "south", "east", "west"))), (F.floor(k / 5) % 4 + 1).cast("int"))
    parcels = table(spark, sf_dir, "customer").select(
        "c_custkey",
        rings.alias("rings"),
        F.when(kind == 4, 6.0 + k % 3).when(kind >= 2, d).otherwise(0.0).alias("retranqueo_min_m"),
        F.when(kind < 2, 1.0 + k % 3).alias("setback_front_m"),
        F.when(kind < 2, (k % 4) * 0.5).alias("setback_side_m"),
        F.when(kind < 2, 2.0).alias("setback_back_m"),
        F.when(kind < 2, direction).when(kind == 2, "north").alias("front_direction"),
    )
    e = envelopes(parcels.repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey"), "c_custkey")  # drawing costs more than dealing, and few bytes would be few tasks
    n = F.aggregate("parts", F.lit(0), lambda s, p: s + F.size(p))
    return e.select("c_custkey", C("setback_mode").alias("mode"), C("polygon_type").alias("shape"), "directional", "front_side", "reason", F.round("area_m2", 4).alias("area"), n.alias("rings"))


@R.add(
    """WITH z AS (SELECT s_suppkey AS z, (s_suppkey * 53 % 1000)::DOUBLE / 10 + 0.05 AS cx, (s_suppkey * 29 % 1000)::DOUBLE / 10 + 0.05 AS cy, 0.1371717 * pow(10, s_suppkey % 6 - 1)::DOUBLE AS r FROM supplier),
    p AS (SELECT c_custkey, (c_custkey * 37 % 1000)::DOUBLE / 10 AS x, (c_custkey * 91 % 1000)::DOUBLE / 10 AS y FROM customer),
    j AS (SELECT c_custkey, z, r FROM p JOIN z ON abs(x - cx) + abs(y - cy) < r AND abs(x - cx) + abs(y - cy) >= r / 3)
    SELECT c_custkey, count(*) AS n, first(z ORDER BY r, z) AS smallest, sum(z)::BIGINT AS total FROM j GROUP BY c_custkey"""
)
def zones_with_holes_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points, suppliers as square rings on their corners, from a fiftieth of the points' plane to a hundred times it."""
    s, k = C("s_suppkey"), C("c_custkey")
    r = F.lit(0.1371717) * F.pow(F.lit(10.0), s % 6 - 1)
    around = lambda x, y, r: _ring((x + r, y), (x, y + r), (x - r, y), (x, y - r))
    z = table(spark, sf_dir, "supplier").select(s.alias("z"), ((s * 53 % 1000).cast("double") / 10 + 0.05).alias("cx"), ((s * 29 % 1000).cast("double") / 10 + 0.05).alias("cy"), r.alias("r"))
    # equal zones and equal points meet once, with what their copies add up to
    z = z.groupBy("cx", "cy", "r").agg(F.count(F.lit(1)).alias("zones"), F.min("z").alias("z"), F.sum("z").alias("keys"))
    z = z.select("z", "r", "zones", "keys", (C("cx") - C("r")).alias("xmin"), (C("cx") + C("r")).alias("xmax"), (C("cy") - C("r")).alias("ymin"), (C("cy") + C("r")).alias("ymax"), F.array(around(C("cx"), C("cy"), C("r")), around(C("cx"), C("cy"), C("r") / 3)).alias("rings"))
    p = table(spark, sf_dir, "customer").select("c_custkey", ((k * 37 % 1000).cast("double") / 10).alias("x"), ((k * 91 % 1000).cast("double") / 10).alias("y"))
    hits = spatial_join(p.select("x", "y").distinct(), materialised(z, "zones"), "rings")
    found = hits.groupBy("x", "y").agg(F.sum("zones").alias("n"), F.min_by("z", F.struct("r", "z")).alias("smallest"), F.sum("keys").alias("total"))
    found = p.join(small(materialised(found, "places")), ["x", "y"])
    return found.groupBy("c_custkey").agg(F.sum("n").alias("n"), F.min("smallest").alias("smallest"), F.sum("total").alias("total"))


def _gml(lon: Column, lat: Column, n: Column) -> Column:
    """Two squares, the first with a hole, in the spellings of two versions; latitude first if degrees."""
    degrees = n % 3 != 1
    at = lambda dx, dy: (F.round(lon + dx, 6).cast("string"), F.round(lat + dy, 6).cast("string"))

    def boundary(corners: list[tuple[float, float]]) -> tuple[Column, Column]:
        pairs = [at(*c) for c in [*corners, corners[0]]]
        both = [F.when(degrees, F.concat(y, F.lit(" "), x)).otherwise(F.concat(x, F.lit(" "), y)) for x, y in pairs]
        listed = F.concat_ws(" ", *both)
        return F.concat(F.lit("<gml:LinearRing><gml:posList srsDimension='2'>"), listed, F.lit("</gml:posList></gml:LinearRing>")), F.concat(
            F.lit("<gml:LinearRing><gml:coordinates>"), F.concat_ws(" ", *(F.replace(b, F.lit(" "), F.lit(",")) for b in both)), F.lit("</gml:coordinates></gml:LinearRing>")
        )

    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    (o3, o2), (i3, i2), (b3, b2) = (boundary(square(*q)) for q in ((0.0, 0.0, 0.04), (0.01, 0.01, 0.02), (0.1, 0.0, 0.01)))
    name = F.when(n % 3 == 0, " srsName='urn:ogc:def:crs:EPSG::4326'").when(n % 3 == 1, " srsName='EPSG:25829'").otherwise("")
    three = F.concat(
        F.lit("<f xmlns:gml='http://www.opengis.net/gml'><code>z</code><msGeometry><gml:MultiSurface"), name, F.lit("><gml:surfaceMember><gml:Polygon><gml:exterior>"), o3, F.lit("</gml:exterior><gml:interior>"), i3,
        F.lit("</gml:interior></gml:Polygon></gml:surfaceMember><gml:surfaceMember><gml:Polygon><gml:exterior>"), b3, F.lit("</gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></msGeometry></f>"),
    )
    two = F.concat(
        F.lit("<f xmlns:gml='http://www.opengis.net/gml'><msGeometry><gml:MultiPolygon"), name, F.lit("><gml:polygonMember><gml:Polygon><gml:outerBoundaryIs>"), o2, F.lit("</gml:outerBoundaryIs><gml:innerBoundaryIs>"), i2,
        F.lit("</gml:innerBoundaryIs></gml:Polygon></gml:polygonMember><gml:polygonMember><gml:Polygon><gml:outerBoundaryIs>"), b2, F.lit("</gml:outerBoundaryIs></gml:Polygon></gml:polygonMember></gml:MultiPolygon></msGeometry></f>"),
    )
    return F.when(n % 2 == 0, three).otherwise(two)


@R.add(
    """WITH s AS (SELECT s_suppkey AS k, round(CASE WHEN s_suppkey % 3 = 1 THEN 520000 + s_suppkey % 900 ELSE -8.9 + (s_suppkey % 900)::DOUBLE / 1000 END, 6) AS x, round(CASE WHEN s_suppkey % 3 = 1 THEN 4670000 + s_suppkey % 700 ELSE 42.1 + (s_suppkey % 700)::DOUBLE / 1000 END, 6) AS y FROM supplier)
    SELECT k AS s_suppkey, 2 AS parts, 3 AS rings, round(0.04 * 0.04 - 0.02 * 0.02 + 0.01 * 0.01, 6) AS area, round(x, 4) AS xmin, round(y + 0.04, 4) AS ymax, true AS inside, false AS in_hole, true AS in_second FROM s"""
)
def gml_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as GML features in degrees and metres: axes put right, holes kept, area and containment."""
    k = C("s_suppkey")
    x = F.round(F.when(k % 3 == 1, 520000 + (k % 900).cast("double")).otherwise(-8.9 + (k % 900).cast("double") / 1000), 6)
    y = F.round(F.when(k % 3 == 1, 4670000 + (k % 700).cast("double")).otherwise(42.1 + (k % 700).cast("double") / 1000), 6)
    docs = table(spark, sf_dir, "supplier").repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey").select("s_suppkey", x.alias("x"), y.alias("y")).select("s_suppkey", "x", "y", _gml(C("x"), C("y"), k).alias("doc"))
    read = docs.select("s_suppkey", "x", "y", F.from_xml("doc", f"code string, msGeometry {gml.GEOMETRY}", gml.OPTIONS)["msGeometry"].alias("m"))
    s = read.select("s_suppkey", "x", "y", gml.shape(C("m")).alias("s"))
    local = F.transform("s", lambda polygon: F.transform(polygon, lambda r: F.transform(r, lambda p: F.struct((p["x"] - C("x")).alias("x"), (p["y"] - C("y")).alias("y")))))
    local = s.select("s_suppkey", "x", "y", local.alias("s"))
    b = g.shape_bounds(C("s"))
    inside = lambda dx, dy: g.shape_contains(C("s"), F.lit(dx), F.lit(dy))
    return local.select(
        "s_suppkey", F.size("s").alias("parts"), F.size(g.rings_of(C("s"))).alias("rings"), F.round(g.shape_area(C("s")), 6).alias("area"), F.round(C("x") + b["xmin"], 4).alias("xmin"), F.round(C("y") + b["ymax"], 4).alias("ymax"),
        inside(0.005, 0.02).alias("inside"), inside(0.02, 0.02).alias("in_hole"), inside(0.105, 0.005).alias("in_second"),
    )


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as bodies: boxes, those of even keys with a courtyard."""
    k = C("s_suppkey")
    w, h = 8.0 + k % 9, 6.0 + k % 5
    outer, hole = _ring((0, 0), (w, 0), (w, h), (0, h)), _ring((2, 2), (4, 2), (4, 4.5), (2, 4.5))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"), (3.0 + (k % 7) * 0.5).alias("height"))


@R.add(
    """WITH b AS (SELECT s_suppkey, (8.0::DOUBLE + s_suppkey % 9) * (6.0::DOUBLE + s_suppkey % 5) - CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 0 END AS area, 3.0::DOUBLE + (s_suppkey % 7) * 0.5::DOUBLE AS height, CASE WHEN s_suppkey % 2 = 0 THEN 8 ELSE 4 END AS corners FROM supplier)
    SELECT s_suppkey, round(area * height, 4) AS volume, 2 * corners AS vertices, 2 * corners + 2 * (CASE WHEN corners = 8 THEN 8 ELSE 2 END) AS triangles, corners = 8 AS voids FROM b"""
)
def volumes_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies written as GLB and read back: what the triangles enclose, and whether the STEP text has voids."""
    made = volumes.gltf_and_ifc(_bodies(spark, sf_dir), "s_suppkey", "rings", "height")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            meshes = [volumes.glb_mesh(bytes(x)) for x in pdf["glb"]]
            yield pd.DataFrame({"s_suppkey": pdf["s_suppkey"], "volume": [round(volumes.volume(*m), 4) for m in meshes], "vertices": [len(v) for v, _ in meshes], "triangles": [len(f) // 3 for _, f in meshes], "voids": pdf["ifc"].str.contains("WITHVOIDS")})

    return made.select("s_suppkey", "glb", "ifc").mapInPandas(read, "s_suppkey bigint, volume double, vertices int, triangles int, voids boolean")


@R.add()
def volume_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bodies as glTF, GLB and IFC."""
    return volumes.gltf_and_ifc(_bodies(spark, sf_dir), "s_suppkey", "rings", "height")
