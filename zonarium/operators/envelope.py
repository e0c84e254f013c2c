"""What may be built on a parcel once its setbacks are kept: rectangles side by side, any other outline all round.

A parcel is a row with its rings; rows are independent, so the work is a map over Arrow batches, spread like its input.
A parcel that is a rectangle, turned or not, and has a front (asked for, or the side nearest to the street) is drawn in
by its front, back and side setbacks.  Every other one is drawn in by the largest setback, with round corners where the
outline turns inwards; it may have holes and may fall into several outlines.  Lengths are metres; ``lonlat`` outlines are scaled about their centre.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonarium.functions import outlines as o

#: A street further away than this many times the parcel's longer side is not its street.
STREET_REACH = 1.5
#: So many different parcels are remembered in a task.
DRAWN = 4096
#: How much larger than the parcel its smallest enclosing rectangle may be for it to count as a rectangle.
RECTANGLE_TOLERANCE = 0.005
# Metres a degree of longitude (at the equator) and of latitude, and the least metres a degree of longitude.
DEGREE_X, DEGREE_Y, LEAST_DEGREE_X = 111320.0, 110574.0, 50000.0

SIDES = {"top": (0.0, 1.0), "bottom": (0.0, -1.0), "left": (-1.0, 0.0), "right": (1.0, 0.0)}
CARDINAL = {"north": (0.0, 1.0), "south": (0.0, -1.0), "east": (1.0, 0.0), "west": (-1.0, 0.0)}
OPPOSITE = {"top": "bottom", "bottom": "top", "left": "right", "right": "left"}

POINTS = "array<array<array<struct<x:double,y:double>>>>"
FIELDS = (
    "setback_mode string, polygon_type string, directional string, reason string, front_side string, front_source string, "
    f"axis_ignored string, axis_distance_m double, setback_applied_m double, area_m2 double, parts {POINTS}"
)
INPUTS = ("rings", "retranqueo_min_m", "setback_front_m", "setback_side_m", "setback_back_m", "front_direction", "front_default", "street", "lonlat")


class Frame(NamedTuple):
    """A rectangle's box after turning by ``-angle`` about the origin."""

    angle: float
    box: tuple[float, float, float, float]


def _turned(points: np.ndarray, angle: float) -> np.ndarray:
    c, s = math.cos(angle), math.sin(angle)
    return points @ np.array([[c, s], [-s, c]])


def as_rectangle(ring: np.ndarray) -> Frame | None:
    """The frame of a ring of four corners that is a rectangle, or nearly; straight ones keep angle 0."""
    if len(ring) != 4:
        return None
    area, best = abs(o.signed_area(ring)), None
    for k in range(4):
        dx, dy = ring[(k + 1) % 4] - ring[k]
        angle = math.atan2(dy, dx)
        angle -= round(angle / (math.pi / 2)) * (math.pi / 2)  # the least turn that makes it straight
        p = _turned(ring, -angle)
        (x0, y0), (x1, y1) = p.min(axis=0), p.max(axis=0)
        box = (x1 - x0) * (y1 - y0)
        if best is None or box < best[0] - 1e-12 * box:
            best = (box, Frame(angle if abs(angle) > 1e-12 else 0.0, (x0, x1, y0, y1)))
    return best[1] if best[0] <= area * (1 + RECTANGLE_TOLERANCE) else None


def _apart(street: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Least distance between a line of points and the segment a-b."""
    edge = [np.stack([a, b])]
    if len(street) == 1:
        return float(o.distance(street, edge)[0])
    ends = min(float(o.distance(street, edge).min()), min(_to_line(street, p) for p in (a, b)))
    p, q = street[:-1], street[1:]
    side = lambda u, v, w: (v[..., 0] - u[..., 0]) * (w[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (w[..., 0] - u[..., 0])
    crossed = (side(p, q, a) * side(p, q, b) < 0) & (side(a, b, p) * side(a, b, q) < 0)
    return 0.0 if crossed.any() else ends


def _to_line(street: np.ndarray, p: np.ndarray) -> float:
    a, d = street[:-1], np.diff(street, axis=0)
    n = (d * d).sum(axis=1)
    t = np.clip(np.divide(((p - a) * d).sum(axis=1), n, out=np.zeros(len(a)), where=n > 0), 0, 1)
    off = p - a - t[:, None] * d
    return float(np.sqrt((off * off).sum(axis=1)).min())


def _sides(box: tuple[float, float, float, float]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    x0, x1, y0, y1 = box
    at = lambda *v: np.array(v)
    return {"top": (at(x0, y1), at(x1, y1)), "bottom": (at(x0, y0), at(x1, y0)), "left": (at(x0, y0), at(x0, y1)), "right": (at(x1, y0), at(x1, y1))}


def envelope(rings: list[np.ndarray], setbacks: tuple[float | None, ...], direction: str | None, default: str | None, street: np.ndarray | None) -> dict:
    """The envelope of one outline in metres; ``setbacks`` are (all round, front, side, back)."""
    least, front, side, back = (float(v) if v is not None and not math.isnan(v) else None for v in setbacks)
    rings = o.oriented(rings)
    out = {"setback_mode": None, "polygon_type": "general", "directional": "not_requested", "reason": None, "front_side": None, "front_source": "none", "axis_ignored": None, "axis_distance_m": None, "setback_applied_m": 0.0, "area_m2": None, "parts": []}
    if not rings:
        return out | {"reason": "empty"}
    if street is not None and len(street):
        outer = rings[0]
        nearest = min(_apart(street, a, b) for a, b in zip(outer, np.roll(outer, -1, axis=0), strict=True))
        if o.inside(street[:1], rings)[0]:
            nearest = 0.0
        if nearest > STREET_REACH * float(np.ptp(outer, axis=0).max()):
            out["axis_ignored"], street = "too_far", None
    else:
        street = None
    source = "request" if direction else "plan_default" if default else "none"
    direction = direction or default
    asked = direction is not None or street is not None
    frame = as_rectangle(rings[0]) if asked and len(rings) == 1 else None
    if frame is not None:
        if direction is None:
            lines = _sides(frame.box)
            line = _turned(street, -frame.angle)
            far = {name: _apart(line, *ends) for name, ends in lines.items()}
            looks = min(far, key=far.get)
            source, out["axis_distance_m"] = "street_axis", far[looks]
        else:
            c = _turned(np.array([CARDINAL.get(direction.lower(), CARDINAL["north"])]), -frame.angle)[0]
            looks = max(SIDES, key=lambda s: round(c[0] * SIDES[s][0] + c[1] * SIDES[s][1], 9))
        by = dict.fromkeys(SIDES, side or 0.0) | {looks: front or 0.0, OPPOSITE[looks]: back or 0.0}
        x0, x1, y0, y1 = frame.box
        x0, x1, y0, y1 = x0 + by["left"], x1 - by["right"], y0 + by["bottom"], y1 - by["top"]
        straight = frame.angle == 0.0
        out |= {"front_side": looks, "front_source": source}
        if x0 >= x1 or y0 >= y1:
            return out | {"reason": "exhausted", "directional": "not_applicable"}
        ring = _turned(np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]), frame.angle)
        kind = "rectangle_axis_aligned" if straight else "rectangle_rotated"
        mode = "rect_directional" if straight else "rotated_rect_directional"
        return out | {"setback_mode": mode, "polygon_type": kind, "directional": "applied", "area_m2": (x1 - x0) * (y1 - y0), "parts": [[ring]]}
    by = max(v for v in (least or 0.0, front or 0.0, side or 0.0, back or 0.0))
    area, parts = o.inset(rings, by)
    out |= {"setback_mode": "conservative_max_uniform", "setback_applied_m": by, "front_source": source}
    if any((front or 0.0, side or 0.0, back or 0.0)) or asked:
        out |= {"directional": "not_applicable", "reason": "non_rectangular_parcel" if asked else "no_front"}
    return out | ({"area_m2": area, "parts": parts} if parts else {"reason": "exhausted"})


def _points(ring: tuple[tuple[float, float], ...]) -> np.ndarray:
    return np.array(ring, float).reshape(-1, 2)


def _drawn(row, names: list[str], drawn: dict[tuple, tuple]) -> tuple:
    """The fields of one parcel; equal parcels are drawn once as long as ``drawn`` holds them."""
    line = lambda ps: tuple((p["x"], p["y"]) for p in ps)
    outline = tuple(map(line, row.rings)) if row.rings is not None else ()
    axis = line(row.street) if row.street is not None else None
    setbacks = tuple(None if v is None or math.isnan(v) else v for v in (row.retranqueo_min_m, row.setback_front_m, row.setback_side_m, row.setback_back_m))
    case = (outline, axis, setbacks, row.front_direction, row.front_default, bool(row.lonlat))
    if case not in drawn:
        rings, street = [_points(r) for r in outline], _points(axis) if axis is not None else None
        centre, scale = np.zeros(2), np.ones(2)
        if row.lonlat and rings and len(rings[0]):
            centre = (rings[0].min(axis=0) + rings[0].max(axis=0)) / 2
            scale = np.array([max(LEAST_DEGREE_X, DEGREE_X * math.cos(math.radians(centre[1]))), DEGREE_Y])
        rings = [(r - centre) * scale for r in rings]
        street = (street - centre) * scale if street is not None else None
        got = envelope(rings, setbacks, row.front_direction, row.front_default, street)
        got["parts"] = [[[{"x": float(x), "y": float(y)} for x, y in ring / scale + centre] for ring in part] for part in got["parts"]]
        if len(drawn) >= DRAWN:
            drawn.clear()
        drawn[case] = tuple(got[n] for n in names)
    return drawn[case]


def building_envelopes(parcels: DataFrame, key: str) -> DataFrame:
    """One row per parcel with its envelope (``FIELDS``); ``parts`` are outlines, each an outer ring and its holes.

    Besides ``key`` and ``rings``, any of the columns of ``INPUTS`` may be there; one that is not is null.  A parcel
    without a ring of positive area has the reason ``empty``, one whose setbacks leave nothing ``exhausted``; both have no area.
    """
    held = [F.col(c) if c in parcels.columns else F.lit(None).alias(c) for c in INPUTS]
    kind = dict(parcels.dtypes)[key]
    names = [f.strip().split(" ")[0] for f in FIELDS.split(", ")]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[tuple, tuple] = {}
        for pdf in batches:
            yield pd.DataFrame([(row.key_, *_drawn(row, names, drawn)) for row in pdf.itertuples(index=False)], columns=[key, *names])

    typed = {"rings": "array<array<struct<x:double,y:double>>>", "street": "array<struct<x:double,y:double>>", "front_direction": "string", "front_default": "string", "lonlat": "boolean"}
    held = [c.cast(typed.get(n, "double")).alias(n) for n, c in zip(INPUTS, held, strict=True)]
    return parcels.select(F.col(key).alias("key_"), *held).mapInPandas(draw, f"{key} {kind}, {FIELDS}")
