"""Planar geometry over rings (arrays of (x, y) structs) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def closed(ring: Column) -> Column:
    """The ring with its first point repeated at the end."""
    return F.when((F.size(ring) > 0) & (F.element_at(ring, 1) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def _edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting on a closed ring."""
    crossed = F.filter(
        _edges(ring),
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < e["a"]["x"] + F.try_divide((y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]), e["b"]["y"] - e["a"]["y"])),
    )
    return F.size(crossed) % 2 == 1


def rings_of(parts: Column) -> Column:
    """All rings of a shape: an array of polygons, each an outer ring and its holes."""
    return F.flatten(parts)


def shape_contains(parts: Column, x: Column, y: Column) -> Column:
    """Even-odd over all rings of a shape: inside a part and not in one of its holes."""
    return F.size(F.filter(rings_of(parts), lambda r: contains(closed(r), x, y))) % 2 == 1


def shape_area(parts: Column) -> Column:
    """Area of the outer rings less that of the holes."""
    total = lambda rings: F.aggregate(rings, F.lit(0.0), lambda s, r: s + area(closed(r)))
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + 2 * area(closed(p[0])) - total(p))


def shape_bounds(parts: Column) -> Column:
    return bounds(F.flatten(rings_of(parts)))


def area(ring: Column) -> Column:
    """Area of a closed ring (shoelace)."""
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def length(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2)))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"), F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax"))


def rectangle(xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """A closed ring around a box."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(at(xmin, ymin), at(xmax, ymin), at(xmax, ymax), at(xmin, ymax), at(xmin, ymin))


def rounded(ring: Column, digits: int = 6) -> Column:
    return F.transform(ring, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))


def shadow_ring(ring: Column, dx: Column, dy: Column) -> Column:
    """The base ring followed by the shifted ring and closed."""
    moved = F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))
    return F.concat(ring, moved, F.slice(ring, 1, 1))


def inset_rectangle(xmin: Column, xmax: Column, ymin: Column, ymax: Column, front: Column, side: Column, back: Column, direction: Column) -> Column:
    """Envelope box of a parcel box whose front looks to ``direction``; null if setbacks use it up."""
    d = F.lower(direction)
    south = F.when(d == "south", front).when(d == "north", back).otherwise(side)
    north = F.when(d == "north", front).when(d == "south", back).otherwise(side)
    west = F.when(d == "west", front).when(d == "east", back).otherwise(side)
    east = F.when(d == "east", front).when(d == "west", back).otherwise(side)
    box = F.struct((xmin + west).alias("xmin"), (xmax - east).alias("xmax"), (ymin + south).alias("ymin"), (ymax - north).alias("ymax"))
    return F.when((box["xmin"] < box["xmax"]) & (box["ymin"] < box["ymax"]), box)


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))


def projected(ring: Column) -> Column:
    """A lon/lat ring in metres of zone 29 north."""
    from zonarium.functions.sun import utm29

    def one(p: Column) -> Column:
        east, north = utm29(p["x"], p["y"])
        return F.struct(east.alias("x"), north.alias("y"))

    return F.transform(ring, one)


def centre(ring: Column) -> Column:
    """Centre of the ring's bounds."""
    b = bounds(ring)
    return F.struct(((b["xmin"] + b["xmax"]) / 2).alias("x"), ((b["ymin"] + b["ymax"]) / 2).alias("y"))


def padded(lon: Column, lat: Column, metres: float = 30.0) -> Column:
    """A lon/lat box of ``metres`` around a point."""
    dy = F.lit(metres / 111320.0)
    dx = metres / (111320.0 * F.cos(F.radians(lat)))
    return F.struct((lon - dx).alias("xmin"), (lon + dx).alias("xmax"), (lat - dy).alias("ymin"), (lat + dy).alias("ymax"))


def footprint_m2(ring: Column) -> Column:
    """Square metres of a small lon/lat ring by the local scale."""
    return area(ring) * 111320.0 * 111320.0 * F.cos(F.radians(centre(ring)["y"]))


def crossing(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Where segments a-b and c-d cross; null if they do not."""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    s = F.try_divide((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), den)
    u = F.try_divide((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), den)
    return F.when(s.between(0, 1) & u.between(0, 1), F.struct((ax + s * (bx - ax)).alias("x"), (ay + s * (by - ay)).alias("y")))


def minimap(ring: Column, box: Column, width: float, height: float) -> Column:
    """The ring fitted into a canvas of the given size (y down)."""
    scale = F.least(F.try_divide(F.lit(width), box["xmax"] - box["xmin"]), F.try_divide(F.lit(height), box["ymax"] - box["ymin"]))
    return F.transform(ring, lambda p: F.struct(((p["x"] - box["xmin"]) * scale).alias("x"), (height - (p["y"] - box["ymin"]) * scale).alias("y")))


def least_gap(inner: Column, outer: Column) -> Column:
    """Least distance between the lines of two closed rings, by the corners of each and the edges of the other; for rings that do not cross."""
    from zonarium.functions.outlines import gaps

    return F.arrow_udf(gaps, "double")(inner, outer)  # loops of built-in functions over all pairs would be interpreted
