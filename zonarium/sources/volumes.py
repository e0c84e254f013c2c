"""Extruded bodies as glTF, GLB and IFC text (Arrow-batched Python: byte layouts are not expressions)."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from zonarium.functions import outlines


def _ring(points) -> list[tuple[float, float]]:
    base = [(float(p["x"]), float(p["y"])) for p in points]
    return list(dict.fromkeys(base[:-1] if base and base[0] == base[-1] else base))


def _turn(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float]) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def ears(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles of a ring, concave or not, counter-clockwise: corners that hold no other point are cut off one by one.

    The ring may pass a corner twice, as one that is bridged to its holes does; a point in the place of a corner does not count as held.
    """
    left = list(range(len(ring)))
    if sum(_turn((0.0, 0.0), ring[k - 1], ring[k]) for k in left) < 0:
        left.reverse()
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            a, b, c = ring[i], ring[j], ring[m]
            if _turn(a, b, c) > 0 and not any(min(_turn(a, b, ring[x]), _turn(b, c, ring[x]), _turn(c, a, ring[x])) >= 0 for x in left if ring[x] not in (a, b, c)):
                break
        else:
            k = next((k for k in range(len(left)) if _turn(ring[left[k - 1]], ring[left[k]], ring[left[(k + 1) % len(left)]]) == 0), 0)  # a straight corner
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
        out.append((i, j, m))
        del left[k]
    return [*out, tuple(left)] if len(left) == 3 else out


def _rings(points) -> list[list[tuple[float, float]]]:
    """The rings of an outline (one ring, or an outer one and holes), each turned the right way and without repeats."""
    some = list(points)
    nested = bool(some) and not isinstance(some[0], dict) and not hasattr(some[0], "asDict")
    rings = [np.array(_ring(r), float).reshape(-1, 2) for r in (some if nested else [some])]
    return [[tuple(map(float, p)) for p in r] for r in outlines.oriented(rings)]


def mesh(points, height: float) -> tuple[list[tuple[float, float, float]], list[int]]:
    """Vertices (y up) and triangles: floor and roof cut into ears around the holes, two triangles a wall of every ring."""
    rings = _rings(points)
    base = [p for r in rings for p in r]
    n, number = len(base), {p: k for k, p in enumerate(base)}
    vertices = [(x, 0.0, -y) for x, y in base] + [(x, float(height), -y) for x, y in base]
    whole = [tuple(map(float, p)) for p in outlines.bridged([np.array(r) for r in rings])] if rings else []
    caps = [tuple(number[whole[i]] for i in t) for t in ears(whole)]
    faces = [i for a, b, c in caps for i in (a, c, b)] + [n + i for t in caps for i in t]
    first = 0
    for r in rings:
        for k in range(len(r)):
            i, j = first + k, first + (k + 1) % len(r)
            faces += [i, j, n + j, i, n + j, n + i]
        first += len(r)
    return vertices, faces


def volume(vertices, faces) -> float:
    """Volume inside a closed mesh, by the signed tetrahedra of its triangles."""
    v = np.asarray(vertices, float)
    a, b, c = (v[np.asarray(faces)[k::3]] for k in range(3))
    return float((a * np.cross(b, c)).sum() / 6)


def gltf(points, height: float) -> tuple[dict, bytes]:
    """The document and its buffer: positions, then 32-bit indices."""
    vertices, faces = mesh(points, height)
    positions = b"".join(struct.pack("<3f", *v) for v in vertices)
    indices = b"".join(struct.pack("<I", i) for i in faces)
    low, high = ([f(v[k] for v in vertices) for k in range(3)] for f in (min, max))
    document = {
        "asset": {"version": "2.0"},
        "scene": 0,
        "scenes": [{"nodes": [0]}],
        "nodes": [{"mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(vertices), "type": "VEC3", "min": low, "max": high}, {"bufferView": 1, "componentType": 5125, "count": len(faces), "type": "SCALAR"}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": len(positions), "target": 34962}, {"buffer": 0, "byteOffset": len(positions), "byteLength": len(indices), "target": 34963}],
        "buffers": [{"byteLength": len(positions) + len(indices)}],
    }
    return document, positions + indices


def glb(document: dict, buffer: bytes) -> bytes:
    """Header, JSON chunk padded with blanks, binary chunk padded with zeros."""
    text = json.dumps(document, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    buffer += b"\0" * (-len(buffer) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(buffer)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(buffer), b"BIN\0") + buffer


def glb_mesh(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a GLB file as ``glb`` writes it."""
    magic, version, size = struct.unpack_from("<4sII", data)
    if magic != b"glTF" or version != 2 or size != len(data):
        raise ValueError("not a whole GLB file")
    text, _ = struct.unpack_from("<I4s", data, 12)
    document, start = json.loads(data[20 : 20 + text]), 28 + text
    views = document["bufferViews"]
    at = lambda k, kind: np.frombuffer(data, kind, views[k]["byteLength"] // 4, start + views[k]["byteOffset"])
    return at(0, "<f4").reshape(-1, 3), at(1, "<u4")


def ifc(key: object, points, height: float) -> str:
    """A minimal STEP file: one building element, its outline extruded, holes as inner curves."""
    lines = ["ISO-10303-21;", "HEADER;", "FILE_DESCRIPTION((''),'2;1');", f"FILE_NAME('{key}','',(''),(''),'','','');", "FILE_SCHEMA(('IFC4'));", "ENDSEC;", "DATA;"]
    n, curves = 0, []
    for ring in _rings(points):
        for k, (x, y) in enumerate([*ring, ring[0]], n + 1):
            lines.append(f"#{k}=IFCCARTESIANPOINT(({x!r},{y!r}));")
        refs = ",".join(f"#{k}" for k in range(n + 1, n + len(ring) + 2))
        n += len(ring) + 2
        lines.append(f"#{n}=IFCPOLYLINE(({refs}));")
        curves.append(f"#{n}")
    holes = ",".join(curves[1:])
    profile = f"IFCARBITRARYPROFILEDEFWITHVOIDS(.AREA.,$,{curves[0]},({holes}))" if holes else f"IFCARBITRARYCLOSEDPROFILEDEF(.AREA.,$,{curves[0]})"
    lines += [
        f"#{n + 1}={profile};",
        f"#{n + 2}=IFCDIRECTION((0.,0.,1.));",
        f"#{n + 3}=IFCEXTRUDEDAREASOLID(#{n + 1},$,#{n + 2},{float(height)!r});",
        f"#{n + 4}=IFCSHAPEREPRESENTATION($,'Body','SweptSolid',(#{n + 3}));",
        f"#{n + 5}=IFCPRODUCTDEFINITIONSHAPE($,$,(#{n + 4}));",
        f"#{n + 6}=IFCBUILDINGELEMENTPROXY('{key}',$,'{key}',$,$,$,#{n + 5},$,$);",
        "ENDSEC;",
        "END-ISO-10303-21;",
    ]
    return "\n".join(lines)


def cityjson(key: object, points, height: float) -> dict:
    """A CityJSON document of one solid: floor and roof with their holes, walls of every ring, vertices shared by place."""
    rings = _rings(points)
    place: dict[tuple[float, float, float], int] = {}
    number = lambda x, y, z: place.setdefault((x, y, z), len(place))
    low = [[number(x, y, 0.0) for x, y in r] for r in rings]
    high = [[number(x, y, float(height)) for x, y in r] for r in rings]
    walls = [[[a[k], a[(k + 1) % len(a)], b[(k + 1) % len(a)], b[k]]] for a, b in zip(low, high, strict=True) for k in range(len(a))]
    shell = [[r[::-1] for r in low], high, *walls]
    kinds = [{"type": "GroundSurface"}, {"type": "RoofSurface"}, {"type": "WallSurface"}]
    solid = {"type": "Solid", "lod": "1", "boundaries": [shell], "semantics": {"surfaces": kinds, "values": [[0, 1] + [2] * len(walls)]}}
    return {"type": "CityJSON", "version": "1.1", "CityObjects": {str(key): {"type": "Building", "geometry": [solid]}}, "vertices": [list(p) for p in place]}


def gltf_and_ifc(bodies: DataFrame, key: str, ring: str, height: str) -> DataFrame:
    """All three forms of each body; ``ring`` is one ring, or an array of an outer ring and holes."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, points, h in zip(pdf[key], pdf[ring], pdf[height], strict=True):
                document, buffer = gltf(points, h)
                whole = document | {"buffers": [{"byteLength": len(buffer), "uri": "data:application/octet-stream;base64," + base64.b64encode(buffer).decode()}]}
                out.append((k, json.dumps(whole), glb(document, buffer), ifc(k, points, h)))
            yield pd.DataFrame(out, columns=[key, "gltf", "glb", "ifc"])

    return bodies.select(key, ring, height).mapInPandas(build, f"{key} {dict(bodies.dtypes)[key]}, gltf string, glb binary, ifc string")
