"""The spatial index: its tree and tiles against plain loops, skewed points, wide zones, and no rows that grow with a zone."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonarium.functions import gml
from zonarium.functions import geometry as g
from zonarium.operators import spatial_index as si


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 700), st.integers(0, 300), st.integers(0, 10_000))
def test_tree_equals_every_pair(n, m, seed):
    rng = np.random.default_rng(seed)
    low = rng.integers(0, 50, (n, 2)).astype(float)
    size = rng.integers(0, 12, (n, 2)).astype(float) * rng.choice([1, 10], (n, 1))
    boxes = np.stack([low[:, 0], low[:, 0] + size[:, 0], low[:, 1], low[:, 1] + size[:, 1]], axis=1)
    x, y = rng.integers(0, 60, (2, m)).astype(float)
    got = sorted((int(p), int(z)) for ps, zs in si.PackedTree(boxes).candidates(x, y) for p, z in zip(ps, zs, strict=True))
    want = [(p, z) for p in range(m) for z in range(n) if boxes[z, 0] <= x[p] <= boxes[z, 1] and boxes[z, 2] <= y[p] <= boxes[z, 3]]
    assert got == want


def test_tree_splits_points_when_pairs_are_many(monkeypatch):
    monkeypatch.setattr(si, "HELD", 64)
    boxes = np.tile([[0.0, 10.0, 0.0, 10.0]], (40, 1))
    got = list(si.PackedTree(boxes).candidates(np.full(30, 5.0), np.full(30, 5.0)))
    assert sum(len(p) for p, _ in got) == 1200 and len(got) > 5


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(1, 60), st.integers(0, 1000), st.booleans())
def test_a_zone_touches_the_tiles_of_its_points(n, tiles, seed, crowded):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 30, (2, n)).astype(float)
    if crowded:
        x[: n // 2], y[: n // 2] = 7.0, 7.0
    plane = si.fitted_plane(x, y, tiles)
    tile = plane.tile(x, y)
    assert tile.max() < plane.first[-1] == len(plane.salts) and plane.salts.sum() <= 2 * plane.first[-1] + tiles + 1
    for a, b, c, d in rng.integers(0, 31, (8, 4)):
        box = np.array([min(a, b), max(a, b), min(c, d), max(c, d)], float)
        held = set(tile[(x >= box[0]) & (x <= box[1]) & (y >= box[2]) & (y <= box[3])])
        found = plane.touched(box, 10**6)
        assert held <= set(found)
        assert plane.touched(box, len(found)) is not None and plane.touched(box, len(found) - 1) is None


def square(x, y, r):
    return [[(x + r, y), (x, y + r), (x - r, y), (x, y - r)], [(x + r / 3, y), (x, y + r / 3), (x - r / 3, y), (x, y - r / 3)]]


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(4)
    points = [(k, float(x), float(y), "p") for k, (x, y) in enumerate(rng.integers(0, 1000, (3000, 2)) / 10)]
    points += [(3000 + k, 50.0, 50.0, "p") for k in range(1500)] + [(9000, None, 1.0, "p"), (9001, float("nan"), 1.0, None)]
    zones = [(k, float(x) + 0.05, float(y) + 0.05, 0.1371717 * 10.0 ** (k % 6 - 1)) for k, (x, y) in enumerate(rng.integers(0, 1000, (400, 2)) / 10)]
    p = spark.createDataFrame(points, "id int, x double, y double, tag string").repartition(5)
    z = spark.createDataFrame(
        [(k, x - r, x + r, y - r, y + r, [[{"x": a, "y": b} for a, b in ring] for ring in square(x, y, r)]) for k, x, y, r in zones] + [(900, None, 1.0, 0.0, 1.0, None), (901, 0.0, 1.0, 0.0, 1.0, None)],
        "z int, xmin double, xmax double, ymin double, ymax double, rings array<array<struct<x:double,y:double>>>",
    )
    known = [(i, x, y) for i, x, y, _ in points if x is not None and x == x]
    want = sorted((i, k) for i, x, y in known for k, cx, cy, r in zones if r / 3 <= abs(x - cx) + abs(y - cy) < r)
    boxed = sorted((i, k) for i, x, y in known for k, cx, cy, r in [*zones, (901, 0.5, 0.5, 0.5)] if cx - r <= x < cx + r and cy - r <= y < cy + r)
    return p, z, want, boxed


TIGHT = si.Limits(zones=20, corners=200, rows_per_tile=150, sample=2000, most_tiles=64, tiles_of_zone=6)


@pytest.mark.parametrize("limits", [None, TIGHT, si.Limits(zones=100, corners=900, rows_per_tile=400, sample=500, tiles_of_zone=2)])
def test_join_with_rings(places, limits):
    p, z, want, _ = places
    got = si.spatial_join(p, z, "rings", limits=limits)
    assert got.columns == ["id", "x", "y", "tag", "z", "xmin", "xmax", "ymin", "ymax"]
    assert sorted((r.id, r.z) for r in got.collect()) == want


@pytest.mark.parametrize("limits", [None, TIGHT])
def test_join_with_envelopes_is_half_open(places, limits):
    p, z, _, boxed = places
    assert sorted((r.id, r.z) for r in si.spatial_join(p, z.drop("rings"), limits=limits).collect()) == boxed


def test_no_row_grows_with_a_zone(places):
    p, z, *_ = places
    some = p.select("x", "y").where("x is not null and not isnan(x)").toPandas()
    plane = si.fitted_plane(some.x.to_numpy(), some.y.to_numpy(), 64)
    hot = plane.tile(np.array([50.0]), np.array([50.0]))[0]
    assert plane.salts[hot] > 5  # a third of the points is in one place
    for half in (0.1, 1.0, 1e3, 1e6):
        found = plane.touched(np.array([50 - half, 50 + half, 50 - half, 50 + half]), 6)
        assert found is None or len(found) <= 6


def test_empty_sides_and_clashes(places):
    p, z, *_ = places
    for limits in (None, TIGHT):
        assert si.spatial_join(p.limit(0), z, "rings", limits=limits).count() == 0
        assert si.spatial_join(p, z.limit(0), "rings", limits=limits).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        si.spatial_join(p.withColumn("z", F.lit(1)), z, "rings")


def read_shape(spark, body, bounded=""):
    doc = f"<f xmlns:gml='http://www.opengis.net/gml'>{bounded}<msGeometry>{body}</msGeometry></f>"
    df = spark.createDataFrame([(doc,)], "doc string").select(F.from_xml("doc", f"boundedBy {gml.BOUNDED_BY}, msGeometry {gml.GEOMETRY}", gml.OPTIONS).alias("f"))
    df = df.select(gml.shape(F.col("f.msGeometry"), F.col("f.boundedBy")).alias("s"))
    return df.select("s", g.shape_area(F.col("s")).alias("area"), g.shape_contains(F.col("s"), F.lit(5.0), F.lit(5.0)).alias("centre"), g.shape_contains(F.col("s"), F.lit(1.0), F.lit(5.0)).alias("edge")).first()


OUTER, HOLE = "0 0 10 0 10 10 0 10 0 0", "4 4 6 4 6 6 4 6 4 4"


def test_gml_hole_is_outside(spark):
    got = read_shape(spark, f"<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{OUTER}</gml:posList></gml:LinearRing></gml:exterior><gml:interior><gml:LinearRing><gml:posList>{HOLE}</gml:posList></gml:LinearRing></gml:interior></gml:Polygon>")
    assert got.area == 96 and not got.centre and got.edge and len(got.s) == 1 and len(got.s[0]) == 2


def test_gml_axes_by_name_then_by_place(spark):
    ring = lambda t: f"<gml:Polygon{{}}><gml:exterior><gml:LinearRing><gml:posList>{t}</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"
    lat_lon = "42.1 -8.5 42.2 -8.5 42.2 -8.4 42.1 -8.5"
    first = lambda got: (got.s[0][0][0].x, got.s[0][0][0].y)
    assert first(read_shape(spark, ring(lat_lon).format(""))) == (-8.5, 42.1)
    assert first(read_shape(spark, ring(lat_lon).format(" srsName='EPSG:25829'"))) == (42.1, -8.5)
    assert first(read_shape(spark, ring("1 2 3 4 5 7 1 2").format(" srsName='urn:x:4258'"))) == (2.0, 1.0)
    assert first(read_shape(spark, ring("1 2 3 4 5 7 1 2").format(""), "<boundedBy><gml:Envelope srsName='EPSG:4326'/></boundedBy>")) == (2.0, 1.0)
    assert first(read_shape(spark, ring("1 2 3 4 5 7 1 2").format(""))) == (1.0, 2.0)


def test_gml_of_no_use(spark):
    assert read_shape(spark, "").s is None
    assert read_shape(spark, "<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>1 2 x y</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>").s is None
    two = "<gml:MultiPolygon><gml:polygonMember><gml:Polygon><gml:outerBoundaryIs><gml:LinearRing><gml:coordinates>0,0 9,0 9,9</gml:coordinates></gml:LinearRing></gml:outerBoundaryIs></gml:Polygon></gml:polygonMember></gml:MultiPolygon>"
    assert read_shape(spark, two).area == 40.5
