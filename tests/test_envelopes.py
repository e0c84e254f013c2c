"""Outlines drawn in: against a count of pixels, known areas and the rules for fronts and streets."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zonarium.functions import outlines as o
from zonarium.operators.envelope import building_envelopes, envelope
from zonarium.sources.volumes import ears

#: What the corner square of side 1 keeps beside a quarter circle of chords.
CORNER = 1 - 8 * math.sin(math.pi / 32)


def ring(*points):
    return np.array(points, float)


ELL = [ring((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10))]
YOU = [ring((0, 0), (12, 0), (12, 10), (8, 10), (8, 4), (4, 4), (4, 10), (0, 10))]
COURT = [ring((0, 0), (20, 0), (20, 20), (0, 20)), ring((8, 8), (12, 8), (12, 12), (8, 12))]


def pixels(rings, by, n=400):
    """Area of the points that are inside and ``by`` from every edge, by counting."""
    rings = o.oriented(rings)
    low, high = rings[0].min(axis=0), rings[0].max(axis=0)
    step = (high - low) / n
    xs, ys = (low[k] + step[k] * (np.arange(n) + 0.5) for k in (0, 1))
    grid = np.stack(np.meshgrid(xs, ys), axis=-1).reshape(-1, 2)
    return sum(int((o.inside(g, rings) & (o.distance(g, rings) >= by)).sum()) for g in np.array_split(grid, 40)) * step[0] * step[1]


@pytest.mark.parametrize(
    ("rings", "by", "area"),
    [
        (ELL, 1, 64 - 36 + CORNER),
        (YOU, 1, 80 - 36 + 2 * CORNER),
        (COURT, 2, 256 - 64 + 16 * CORNER),
        ([ring((0, 0), (4, 0), (4, 3), (0, 3))], 1, 2.0),
        ([ring((0, 0), (4, 0), (4, 3), (0, 3))], 1.5, 0.0),
        ([ring((0, 0), (4, 0), (4, 3), (0, 3))], 0, 12.0),
    ],
)
def test_known_areas(rings, by, area):
    assert o.inset(rings, by)[0] == pytest.approx(area, abs=1e-9)


def test_an_outline_may_fall_apart():
    area, parts = o.inset(YOU, 2.1)
    assert len(parts) == 2 and area == pytest.approx(pixels(YOU, 2.1, 2000), abs=0.01)
    assert o.inset(YOU, 3) == (0.0, [])


def test_a_hole_stays_a_hole():
    area, parts = o.inset(COURT, 1)
    assert len(parts) == 1 and len(parts[0]) == 2 and sum(o.signed_area(r) for r in parts[0]) == pytest.approx(area)


@settings(max_examples=40, deadline=None)
@given(st.integers(4, 24), st.floats(0.1, 1.5), st.integers(0, 10_000), st.floats(0, 6.3))
def test_stars_equal_a_count_of_pixels(n, by, seed, turn):
    rng = np.random.default_rng(seed)
    at = (np.arange(n) + rng.uniform(0.1, 0.9, n)) * 2 * math.pi / n + turn
    r = rng.uniform(3, 10, n)
    star = [np.stack([r * np.cos(at), r * np.sin(at)], axis=1)]
    area, parts = o.inset(star, by)
    whole = abs(o.signed_area(star[0]))
    assert area == pytest.approx(pixels(star, by), abs=0.004 * whole + 0.02)
    assert sum(o.signed_area(r) for p in parts for r in p) == pytest.approx(area, rel=1e-3, abs=0.02)
    assert all((o.distance(r, star) >= by - 0.01 * by).all() for p in parts for r in p)


def test_direction_of_rings_does_not_matter():
    turned = [r[::-1] for r in COURT]
    assert o.inset(turned, 1)[0] == pytest.approx(o.inset(COURT, 1)[0])
    assert o.inset([np.concatenate([r, r[:1]]) for r in COURT], 1)[0] == pytest.approx(o.inset(COURT, 1)[0])


@pytest.mark.parametrize("rings", [COURT, [*COURT, ring((2, 2), (4, 2), (3, 5))], [ELL[0], ring((1, 1), (3, 1), (3, 3), (1, 3)), ring((5, 1), (9, 1), (7, 3))]])
def test_triangles_cover_an_outline_without_its_holes(rings):
    whole = o.bridged(rings)
    area = sum(map(o.signed_area, o.oriented(rings)))
    corners = [tuple(p) for p in whole]
    cut = ears(corners)
    sizes = [abs((corners[b][0] - corners[a][0]) * (corners[c][1] - corners[a][1]) - (corners[b][1] - corners[a][1]) * (corners[c][0] - corners[a][0])) / 2 for a, b, c in cut]
    assert o.signed_area(whole) == pytest.approx(area) and sum(sizes) == pytest.approx(area)
    middles = np.array([np.mean([corners[i] for i in t], axis=0) for t, s in zip(cut, sizes, strict=True) if s > 1e-9])
    assert o.inside(middles, o.oriented(rings)).all()


def box(w, h, angle=0.0):
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return [np.array([(x * c - y * s, x * s + y * c) for x, y in ((0, 0), (w, 0), (w, h), (0, h))])]


@pytest.mark.parametrize(
    ("angle", "direction", "area", "side"),
    [(0, "south", (20 - 4) * (10 - 3 - 1), "bottom"), (0, "east", (20 - 4) * (10 - 4), "right"), (30, "east", (20 - 4) * (10 - 4), "right"), (-30, "north", (20 - 4) * (10 - 4), "top"), (120, "north", (20 - 4) * (10 - 4), None)],
)
def test_rectangles_by_direction(angle, direction, area, side):
    got = envelope(box(20, 10, angle), (0.0, 3.0, 2.0, 1.0), direction, None, None)
    assert got["area_m2"] == pytest.approx(area) and got["directional"] == "applied" and got["front_source"] == "request"
    assert got["setback_mode"] == ("rect_directional" if angle == 0 else "rotated_rect_directional") and side in (None, got["front_side"])
    assert o.signed_area(o.oriented(got["parts"][0])[0]) == pytest.approx(area)


def test_front_is_the_side_nearest_to_the_street():
    street = ring((-5, -3), (30, -3))
    got = envelope(box(20, 10), (0.0, 3.0, 2.0, 1.0), None, None, street)
    assert (got["front_side"], got["front_source"], got["axis_distance_m"]) == ("bottom", "street_axis", 3.0) and got["area_m2"] == 16 * 6
    far = envelope(box(20, 10), (1.0, 3.0, None, None), None, None, ring((0, 100), (1, 100)))
    assert far["axis_ignored"] == "too_far" and far["setback_mode"] == "conservative_max_uniform" and far["area_m2"] == pytest.approx(14 * 4)
    turned = envelope(box(20, 10, 30), (0.0, 3.0, 2.0, 1.0), None, None, ring((-2, -4), (18, 7)))
    assert turned["front_source"] == "street_axis" and turned["front_side"] == "bottom"


def test_modes_and_reasons():
    assert envelope(box(3, 20), (0.0, 3.0, 2.0, 5.0), "south", None, None)["reason"] == "exhausted"
    ell = envelope(ELL, (0.5, 1.0, None, None), "north", None, None)
    assert (ell["reason"], ell["directional"], ell["setback_applied_m"]) == ("non_rectangular_parcel", "not_applicable", 1.0)
    assert envelope(box(20, 10), (1.0, None, None, None), None, None, None)["directional"] == "not_requested"
    assert envelope(box(20, 10), (0.0, 1.0, 1.0, 1.0), None, "south", None)["front_source"] == "plan_default"
    assert envelope([ring((0, 0), (1, 1), (2, 2))], (0.0, None, None, None), None, None, None)["reason"] == "empty"
    nearly = [ring((0, 0), (20, 0.02), (20, 10), (0, 10.01))]
    assert envelope(nearly, (0.0, 3.0, 2.0, 1.0), "south", None, None)["directional"] == "applied"


def test_rows_of_parcels(spark):
    point = lambda p: {"x": float(p[0]), "y": float(p[1])}
    degrees = [[point((-8.7 + x / (111320 * math.cos(math.radians(42.2 + 5 / 110574))), 42.2 + y / 110574)) for x, y in box(20, 10)[0]]]
    rows = [(1, [[point(p) for p in r] for r in COURT], 2.0, None, False), (2, [[point(p) for p in box(20, 10)[0]]], 0.0, "east", False), (3, None, 1.0, None, None), (4, degrees, 2.0, None, True), (5, [], 1.0, "north", False)]
    df = spark.createDataFrame(rows, "id int, rings array<array<struct<x:double,y:double>>>, retranqueo_min_m double, front_direction string, lonlat boolean")
    got = {r.id: r for r in building_envelopes(df, "id").collect()}
    assert got[1].area_m2 == pytest.approx(256 - 64 + 16 * CORNER) and len(got[1].parts[0]) == 2
    assert got[2].area_m2 == 200 and got[2].front_side == "right" and got[3].reason == got[5].reason == "empty" and got[3].area_m2 is None
    assert got[4].area_m2 == pytest.approx(16 * 6, rel=1e-3) and all(abs(p.x + 8.7) < 0.01 and abs(p.y - 42.2) < 0.01 for p in got[4].parts[0][0])


def test_equal_parcels_are_drawn_once(monkeypatch):
    from types import SimpleNamespace

    from zonarium.operators import envelope as module

    calls = []
    monkeypatch.setattr(module, "envelope", lambda *a: calls.append(a) or envelope(*a))
    monkeypatch.setattr(module, "DRAWN", 2)
    row = lambda w, front=float("nan"): SimpleNamespace(rings=[[{"x": x, "y": y} for x, y in ((0.0, 0.0), (w, 0.0), (w, 9.0), (0.0, 9.0))]], street=None, lonlat=None, retranqueo_min_m=1.0, setback_front_m=front, setback_side_m=None, setback_back_m=None, front_direction=None, front_default=None)
    drawn = {}
    got = [module._drawn(row(w), ["area_m2"], drawn)[0] for w in (9.0, 9.0, 8.0, 9.0, 8.0, 7.0, 9.0)]
    assert got == [49.0, 49.0, 42.0, 49.0, 42.0, 35.0, 49.0] and len(calls) == 4 and len(drawn) <= 2
    assert module._drawn(row(9.0, 2.0), ["area_m2"], drawn)[0] == 25.0


def test_parcels_of_one_small_file_go_to_every_core(spark, tmp_path):
    from zonarium.plans import catalogue

    spark.range(0, 300, 1, 1).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    df = catalogue.QUERIES["building_envelopes"](spark, str(tmp_path))
    assert df.count() == 300 and df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
