"""Containment joins whose cost does not grow with the size of a zone or the crowding of points.

Zones that fit a stated bound are packed into one tree of envelopes, broadcast, and asked by every Arrow batch of points.
Beyond it the plane is cut into tiles by a sample of the points (slabs of equal count, each cut again), so crowded places
get small tiles; a tile that still holds too large a share, as equal points do, is shared out over salts.  A zone is sent to
the few tiles it touches, and each tile packs its own tree.  A zone that touches more tiles than that is not sent
to them but joins a broadcast block, whose size is bounded; every block is one more map over the points.  Such a zone covers many tiles'
worth of points, so these maps are paid for by their results.

A zone is an envelope (half-open), or has rings: arrays of points that are tested even-odd together, so holes and parts
need no care.  Null or NaN coordinates match nothing; a zone without rings or with null bounds contains nothing; equal points and zones match each on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonarium.sources.scratch import materialised

FAN = 16
#: Pairs, or edges of pairs, that are held at once.
HELD = 1 << 20
BOUNDS = ("xmin", "xmax", "ymin", "ymax")


@dataclass(frozen=True)
class Limits:
    """Bounds of what is broadcast (zones, and corners of their rings), and of tiles and the sample that fits them."""

    zones: int = 50_000
    corners: int = 2_000_000
    rows_per_tile: int = 200_000
    sample: int = 20_000
    most_tiles: int = 2_048
    tiles_of_zone: int = 16


class PackedTree:
    """Envelopes in the order of a sort-tile-recursive packing, ``FAN`` a node, level upon level."""

    def __init__(self, boxes: np.ndarray) -> None:
        """``boxes`` has a row (xmin, xmax, ymin, ymax) for every entry."""
        n = len(boxes)
        x, y = boxes[:, 0] + boxes[:, 1], boxes[:, 2] + boxes[:, 3]
        slab = max(1, int(np.ceil(np.sqrt(n / FAN)))) * FAN
        by_x = np.argsort(x, kind="stable")
        rank = np.empty(n, np.int64)
        rank[by_x] = np.arange(n) // slab
        self.order = np.lexsort((y, rank))
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > FAN:
            low = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append(np.stack([np.minimum.reduceat(low[:, 0], at), np.maximum.reduceat(low[:, 1], at), np.minimum.reduceat(low[:, 2], at), np.maximum.reduceat(low[:, 3], at)], axis=1))

    def candidates(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(point, entry) whose closed envelope holds the point; points are halved until a level's pairs are few."""
        stack = [np.arange(len(x))]
        while stack:
            points = stack.pop()
            top = self.levels[-1]
            if len(points) * len(top) > HELD and len(points) > 1:
                stack += [points[: len(points) // 2], points[len(points) // 2 :]]
                continue
            p, node = np.repeat(points, len(top)), np.tile(np.arange(len(top)), len(points))
            for depth in range(len(self.levels) - 1, -1, -1):
                b = self.levels[depth][node]
                hit = (x[p] >= b[:, 0]) & (x[p] <= b[:, 1]) & (y[p] >= b[:, 2]) & (y[p] <= b[:, 3])
                p, node = p[hit], node[hit]
                if not depth or not len(p):
                    break
                if len(p) * FAN > HELD and len(points) > 1:
                    p = None
                    break
                below = len(self.levels[depth - 1])
                p, node = np.repeat(p, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                p, node = p[node < below], node[node < below]
            if p is None:
                stack += [points[: len(points) // 2], points[len(points) // 2 :]]
            elif len(p):
                yield p, self.order[node]


class ZoneIndex:
    """A packed tree over a table of zones, with the edges of their rings."""

    def __init__(self, zones: pa.Table, rings: str | None) -> None:
        boxes = np.stack([zones.column(b).to_numpy(zero_copy_only=False).astype(float) for b in BOUNDS], axis=1)
        good = ~np.isnan(boxes).any(axis=1)
        if rings:
            good &= zones.column(rings).is_valid().to_numpy(zero_copy_only=False)
        self.zones = zones.filter(pa.array(good)).combine_chunks()
        self.half_open = rings is None
        self.boxes = boxes[good]
        self.tree = PackedTree(self.boxes) if len(self.boxes) else None
        if rings:
            self._edges(self.zones.column(rings))
            self.zones = self.zones.drop_columns([rings])

    def _edges(self, column: pa.ChunkedArray) -> None:
        """Edges of all rings end to end; zone z has those from ``first[z]`` on."""
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        rings = lists.flatten()
        points = rings.flatten()
        x, y = (points.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y"))
        sizes = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        per_zone = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        last = np.zeros(len(x), dtype=bool)
        last[ends[sizes > 0] - 1] = True
        follow = np.arange(len(x)) + 1
        follow[last] = (ends - sizes)[sizes > 0]  # a ring that is not closed is closed here
        self.edges = np.stack([x, y, x[follow], y[follow]]) if len(x) else np.zeros((4, 0))
        upto = np.concatenate([[0], ends])
        self.first = upto[np.concatenate([[0], np.cumsum(per_zone)])]

    def matches(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(point, zone) of every containment."""
        if self.tree is None:
            return
        for p, z in self.tree.candidates(x, y):
            if self.half_open:
                ok = (x[p] < self.boxes[z, 1]) & (y[p] < self.boxes[z, 3])
                yield p[ok], z[ok]
                continue
            many = (self.first[1:] - self.first[:-1])[z]
            for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(np.cumsum(many) // HELD)) + 1):
                ok = self._inside(x[p[part]], y[p[part]], z[part], many[part])
                yield p[part][ok], z[part][ok]

    def _inside(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Even-odd: whether a ray to the right crosses an odd number of edges."""
        total = int(many.sum())
        if not total:
            return np.zeros(len(z), dtype=bool)
        ends = np.cumsum(many)
        which = np.repeat(np.arange(len(z)), many)
        at = np.arange(total) - np.repeat(ends - many, many) + self.first[z][which]
        x0, y0, x1, y1 = self.edges[:, at]
        px, py = x[which], y[which]
        spans = (y0 > py) != (y1 > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            crosses = spans & (px < x0 + (py - y0) * (x1 - x0) / (y1 - y0))
        return np.bincount(which[crosses], minlength=len(z)) % 2 == 1


@dataclass(frozen=True)
class Plane:
    """Tiles of a plane: inner bounds of the slabs, for each slab the inner bounds of its tiles, and salts by tile."""

    slabs: np.ndarray
    tiles: list[np.ndarray]
    salts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Number of the first tile of each slab."""
        return np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.tiles])])

    def tile(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        slab = np.searchsorted(self.slabs, x, side="right")
        out = np.zeros(len(x), np.int64)
        first = self.first
        for s in np.unique(slab):
            here = slab == s
            out[here] = first[s] + np.searchsorted(self.tiles[s], y[here], side="right")
        return out

    def touched(self, box: np.ndarray, most: int) -> np.ndarray | None:
        """Tiles that a closed box meets; none if they are more than ``most``."""
        first, found = self.first, []
        low, high = (int(np.searchsorted(self.slabs, v, side="right")) for v in box[:2])
        if high - low >= most:
            return None
        for s in range(low, high + 1):
            a, b = (int(np.searchsorted(self.tiles[s], v, side="right")) for v in box[2:])
            found.append(np.arange(first[s] + a, first[s] + b + 1))
            if sum(map(len, found)) > most:
                return None
        return np.concatenate(found)


def fitted_plane(x: np.ndarray, y: np.ndarray, tiles: int) -> Plane:
    """A plane of about ``tiles`` tiles with equal numbers of sample points."""
    side = max(1, int(np.ceil(np.sqrt(tiles))))
    cut = lambda v, n: np.unique(np.quantile(v, np.arange(1, n) / n, method="nearest")) if n > 1 and len(v) else np.zeros(0)
    slabs = cut(x, side)
    slab = np.searchsorted(slabs, x, side="right")
    plane = Plane(slabs, [cut(y[slab == s], side) for s in range(len(slabs) + 1)], np.zeros(0))
    count = np.bincount(plane.tile(x, y), minlength=plane.first[-1])
    fair = max(1.0, 2 * len(x) / max(1, tiles))
    return Plane(plane.slabs, plane.tiles, np.maximum(1, np.ceil(count / fair)).astype(np.int64))


def _joined(index: ZoneIndex, points: pa.Table, x: str, y: str) -> Iterator[pa.RecordBatch]:
    px, py = (points.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (x, y))
    for p, z in index.matches(px, py):
        left, right = points.take(pa.array(p)), index.zones.take(pa.array(z))
        yield from pa.Table.from_arrays([*left.columns, *right.columns], names=[*left.column_names, *right.column_names]).combine_chunks().to_batches(max_chunksize=1 << 16)


def _asked(points: DataFrame, zones: DataFrame, x: str, y: str, rings: str | None, schema: T.StructType) -> DataFrame:
    """Every batch of points asks one broadcast index of ``zones``, whose size the caller has bounded."""
    held = points.sparkSession.sparkContext.broadcast(ZoneIndex(zones.toArrow(), rings))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _joined(held.value, pa.Table.from_batches([batch]), x, y)

    return points.mapInArrow(ask, schema)


def _tiled(points: DataFrame, zones: DataFrame, plane: Plane, x: str, y: str, rings: str | None, schema: T.StructType, limits: Limits) -> DataFrame:
    """Zones that touch few tiles meet the points of those tiles."""
    extra = T.StructType([T.StructField("_tile", T.LongType()), T.StructField("_salt", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            px, py = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in (x, y))
            known = ~(np.isnan(px) | np.isnan(py))
            b = b.filter(pa.array(known))
            tile = plane.tile(px[known], py[known])
            salt = (np.arange(turn, turn + len(tile)) % plane.salts[tile]).astype(np.int64)  # in turn, whatever the rows hold
            turn += len(tile)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tile), pa.array(salt)], [*b.schema.names, "_tile", "_salt"])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            boxes = _boxes(b)
            row, tile, salt = [], [], []
            for k in np.flatnonzero(~np.isnan(boxes).any(axis=1)):
                found = plane.touched(boxes[k], limits.tiles_of_zone)
                if found is None:
                    continue
                salts = plane.salts[found]
                row.append(np.full(salts.sum(), k))
                tile.append(np.repeat(found, salts))
                salt.append(np.concatenate([np.arange(s) for s in salts]))
            if row:
                got = b.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(np.concatenate(tile).astype(np.int64)), pa.array(np.concatenate(salt).astype(np.int64))], [*b.schema.names, "_tile", "_salt"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        index = ZoneIndex(right.drop_columns(["_tile", "_salt"]), rings)
        found = list(_joined(index, left.drop_columns(["_tile", "_salt"]), x, y))
        names = [n for n in left.column_names if n not in ("_tile", "_salt")] + index.zones.column_names
        kinds = [left.schema.field(n).type for n in left.column_names if n not in ("_tile", "_salt")] + [f.type for f in index.zones.schema]
        return pa.Table.from_batches(found) if found else pa.table([pa.array([], k) for k in kinds], names)

    by = ["_tile", "_salt"]
    dealt = points.mapInArrow(deal, T.StructType([*points.schema.fields, *extra.fields])).groupBy(*by)
    return dealt.cogroup(zones.mapInArrow(file, T.StructType([*zones.schema.fields, *extra.fields])).groupBy(*by)).applyInArrow(meet, schema)


def _boxes(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in BOUNDS], axis=1)


def _wide(zones: DataFrame, plane: Plane, most: int) -> DataFrame:
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not np.isnan(box).any() and plane.touched(box, most) is None for box in _boxes(b)], pa.bool_()))

    return zones.mapInArrow(pick, zones.schema)


def spatial_join(points: DataFrame, zones: DataFrame, rings: str | None = None, x: str = "x", y: str = "y", limits: Limits | None = None) -> DataFrame:
    """Points with each zone that contains them: all columns of both but ``rings``.

    ``zones`` has the envelope as ``xmin``, ``xmax``, ``ymin``, ``ymax``; with ``rings``, an array of arrays of (x, y), the
    point must also be inside them.
    """
    limits = limits or Limits()
    kept = [f for f in zones.schema.fields if f.name != rings]
    clash = {f.name for f in kept} & set(points.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    schema = T.StructType([*points.schema.fields, *kept])
    corners = F.coalesce(F.sum(F.aggregate(rings, F.lit(0).cast("long"), lambda n, r: n + F.size(r))), F.lit(0)) if rings else F.lit(0)
    n_zones, n_corners = zones.agg(F.count(F.lit(1)), corners).first()
    if n_zones <= limits.zones and n_corners <= limits.corners:
        return _asked(points, zones, x, y, rings, schema)
    at = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x = x and y = y and not isnan(x) and not isnan(y)")
    some = at.orderBy(F.rand(7)).limit(limits.sample).toArrow()  # only how rows are dealt depends on the sample
    tiles = int(min(limits.most_tiles, max(1, -(-points.count() // limits.rows_per_tile), -(-n_zones // limits.zones))))
    plane = fitted_plane(some.column("x").to_numpy(), some.column("y").to_numpy(), tiles)
    out = _tiled(points, zones, plane, x, y, rings, schema, limits)
    wide = materialised(_wide(zones, plane, limits.tiles_of_zone).withColumn("_turn", F.monotonically_increasing_id()), "wide-zones")
    n_wide, n_corners = wide.agg(F.count(F.lit(1)), corners).first()
    blocks = max(-(-n_wide // limits.zones), -(-n_corners // limits.corners))
    for k in range(blocks):
        block = wide.where(F.col("_turn") % blocks == k).drop("_turn")
        out = out.unionByName(_asked(points, block, x, y, rings, schema))
    return out
