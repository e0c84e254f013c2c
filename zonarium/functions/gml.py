"""Polygons with holes and parts from GML, in the spellings of versions 2 and 3, as expressions over parsed XML.

A shape is an array of polygons, a polygon an array of rings (outer first), a ring an array of points (x, y).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RING = "struct<LinearRing: struct<posList: string, coordinates: string>>"
_POLYGON = f"struct<_srsName: string, exterior: {_RING}, interior: array<{_RING}>, outerBoundaryIs: {_RING}, innerBoundaryIs: array<{_RING}>>"
_MANY = "struct<_srsName: string, {member}: array<struct<Polygon: {polygon}>>>"
#: Schema of a geometry element: one polygon, or several as members.
GEOMETRY = (
    f"struct<Polygon: {_POLYGON}, MultiPolygon: {_MANY.format(member='polygonMember', polygon=_POLYGON)}, "
    f"MultiSurface: {_MANY.format(member='surfaceMember', polygon=_POLYGON)}>"
)
BOUNDED_BY = "struct<Envelope: struct<_srsName: string>>"
#: Options of the XML reader and of ``from_xml`` that these schemas need.
OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_"}

# Codes of coordinate systems with latitude first and with east first, and the box in which a first pair counts as latitude, longitude.
LATITUDE_FIRST, EAST_FIRST = "(4326|4258)$", "25829|25830|32629"
LATITUDES, LONGITUDES = (35.0, 45.0), (-11.0, -5.0)


def ring(text: Column) -> Column:
    """Points of a ``posList`` (numbers) or ``coordinates`` (pairs with commas); pairs that are no numbers are left out."""
    pairs = F.filter(F.split(F.trim(text), r"\s+"), lambda v: v != "")
    flat = F.when(text.contains(","), F.flatten(F.transform(pairs, lambda v: F.slice(F.split(v, ","), 1, 2)))).otherwise(pairs)
    n = F.transform(flat, lambda v: v.try_cast("double"))
    steps = F.when(F.size(n) >= 2, F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    points = F.transform(steps, lambda i: F.struct(F.get(n, 2 * i).alias("x"), F.get(n, 2 * i + 1).alias("y")))
    return F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def _text(boundary: Column) -> Column:
    r = boundary["LinearRing"]
    return F.coalesce(r["posList"], r["coordinates"])


def _polygon(p: Column) -> Column:
    outer = F.array(ring(_text(F.coalesce(p["exterior"], p["outerBoundaryIs"]))))
    holes = F.concat(*(F.coalesce(F.transform(p[k], lambda b: ring(_text(b))), F.array().cast("array<array<struct<x:double,y:double>>>")) for k in ("interior", "innerBoundaryIs")))
    return F.concat(outer, F.filter(holes, lambda r: F.size(r) >= 3))


def polygons(geometry: Column) -> Column:
    """The polygons of a geometry element of schema ``GEOMETRY``, those whose outer ring has fewer than three points left out; null without any."""
    members = F.concat(
        F.filter(F.array(geometry["Polygon"]), lambda p: p.isNotNull()),
        F.coalesce(geometry["MultiPolygon"]["polygonMember"]["Polygon"], F.array().cast(f"array<{_POLYGON}>")),
        F.coalesce(geometry["MultiSurface"]["surfaceMember"]["Polygon"], F.array().cast(f"array<{_POLYGON}>")),
    )
    shapes = F.filter(F.transform(members, _polygon), lambda p: F.size(p[0]) >= 3)
    return F.when(F.size(shapes) > 0, shapes)


def latitude_first(geometry: Column, bounded_by: Column | None, shapes: Column) -> Column:
    """Whether pairs are (latitude, longitude): by the first system named, else by where the first pair would lie."""
    named = [geometry["MultiPolygon"]["_srsName"], geometry["MultiSurface"]["_srsName"], geometry["Polygon"]["_srsName"]]
    if bounded_by is not None:
        named.insert(0, bounded_by["Envelope"]["_srsName"])
    for members in (geometry["MultiPolygon"]["polygonMember"], geometry["MultiSurface"]["surfaceMember"]):
        named.append(F.get(F.filter(members["Polygon"]["_srsName"], lambda s: s.isNotNull()), F.lit(0)))
    known = [F.when(s.rlike(LATITUDE_FIRST), True).when(s.rlike(EAST_FIRST), False) for s in named]
    p = F.get(F.get(F.get(shapes, F.lit(0)), F.lit(0)), F.lit(0))
    return F.coalesce(*known, p["x"].between(*LATITUDES) & p["y"].between(*LONGITUDES), F.lit(False))


def swapped(shapes: Column) -> Column:
    point = lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y"))
    return F.transform(shapes, lambda polygon: F.transform(polygon, lambda r: F.transform(r, point)))


def shape(geometry: Column, bounded_by: Column | None = None) -> Column:
    """The shape of a geometry element, longitude or east first."""
    found = polygons(geometry)
    return F.when(latitude_first(geometry, bounded_by, found), swapped(found)).otherwise(found)
