"""Outlines with holes, in numpy: turning them the right way, drawing them in, cutting them into triangles; and gaps between rings, a batch at a time.

An outline is a list of rings, the outer one first; a ring is an array of corners (x, y) that need not repeat the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chords for a quarter of a circle.
CHORDS = 16
#: So many pairs of a corner and an edge are measured at once, or all pairs of one corner if these are more.
PAIRS = 1 << 14


def signed_area(ring: np.ndarray) -> float:
    """Positive if counter-clockwise."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2


def tidy(ring: np.ndarray) -> np.ndarray:
    """The ring without repeated neighbours, the closing corner among them."""
    ring = np.asarray(ring, float).reshape(-1, 2)
    return ring[(ring != np.roll(ring, 1, axis=0)).any(axis=1)] if len(ring) > 1 else ring


def oriented(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Outer ring counter-clockwise, holes clockwise, rings without area left out; nothing without an outer ring."""
    out = []
    for k, ring in enumerate(rings):
        ring = tidy(ring)
        area = signed_area(ring) if len(ring) > 2 else 0.0
        if area == 0:
            if k == 0:
                return []
            continue
        out.append(ring if (area > 0) == (k == 0) else ring[::-1])
    return out


def _edges(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])


def inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd over all rings."""
    a, b = _edges(rings)
    x, y = points[:, :1], points[:, 1:]
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = x < a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return (spans & left).sum(axis=1) % 2 == 1


def distance(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """From each point to the nearest edge."""
    a, b = _edges(rings)
    d = b - a
    along = ((points[:, None, :] - a) * d).sum(axis=2) / (d * d).sum(axis=1)
    off = points[:, None, :] - a - np.clip(along, 0, 1)[..., None] * d
    return np.sqrt((off * off).sum(axis=2)).min(axis=1)


def _offset(rings: list[np.ndarray], by: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the edges moved to their left and of the chords around corners that turn right; and the corner each chord goes around (NaN for edges)."""
    start, end, around = [], [], []
    for ring in rings:
        u = np.roll(ring, -1, axis=0) - ring
        u /= np.hypot(u[:, 0], u[:, 1])[:, None]
        normal = np.stack([-u[:, 1], u[:, 0]], axis=1) * by
        start.append(ring + normal)
        end.append(np.roll(ring, -1, axis=0) + normal)
        around.append(np.full((len(ring), 2), np.nan))
        before = np.roll(u, 1, axis=0)
        turn = before[:, 0] * u[:, 1] - before[:, 1] * u[:, 0]
        for k in np.flatnonzero(turn < -1e-12):
            since = np.arctan2(normal[k - 1, 1], normal[k - 1, 0])
            sweep = np.arctan2(-turn[k], (before[k] * u[k]).sum())
            steps = max(1, int(np.ceil(sweep / (np.pi / 2 / CHORDS) - 1e-9)))
            angle = since - np.linspace(0, sweep, steps + 1)
            arc = ring[k] + by * np.stack([np.cos(angle), np.sin(angle)], axis=1)
            arc[0], arc[-1] = ring[k] + normal[k - 1], ring[k] + normal[k]
            start.append(arc[:-1])
            end.append(arc[1:])
            around.append(np.repeat(ring[k : k + 1], steps, axis=0))
    return np.concatenate(start), np.concatenate(end), np.concatenate(around)


def _split(start: np.ndarray, end: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces between all places where they cross or touch."""
    d = end - start
    cross = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    gap = start[None, :, :] - start[:, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * d[None, :, 1] - gap[..., 1] * d[None, :, 0]) / cross
        u = (gap[..., 0] * d[:, None, 1] - gap[..., 1] * d[:, None, 0]) / cross
    meet = (np.abs(cross) > 1e-14) & (t > 0) & (t < 1) & (u >= -1e-9) & (u <= 1 + 1e-9)
    at, _ = np.nonzero(meet)
    every = np.arange(len(start))
    k, t = np.concatenate([every, at, every]), np.concatenate([np.zeros(len(every)), t[meet], np.ones(len(every))])
    order = np.lexsort((t, k))
    k, t = k[order], t[order]
    apart = np.concatenate([[True], (np.diff(k) > 0) | (np.diff(t) > 1e-12)])
    k, t = k[apart], t[apart]
    same = k[1:] == k[:-1]
    k, low, high = k[:-1][same], t[:-1][same], t[1:][same]
    return start[k] + low[:, None] * d[k], start[k] + high[:, None] * d[k], around[k]


def _chained(start: np.ndarray, end: np.ndarray, gap: float) -> list[np.ndarray]:
    """Closed rings of pieces, each followed by the one that begins nearest to its end, at most ``gap`` away."""
    apart = np.hypot(end[:, None, 0] - start[None, :, 0], end[:, None, 1] - start[None, :, 1])
    apart[apart > gap] = np.inf
    free, rings = np.ones(len(start), dtype=bool), []
    for first in range(len(start)):
        if not free[first]:
            continue
        path, k = [first], first
        free[first] = False
        while True:
            j = int(np.where(free | (np.arange(len(start)) == first), apart[k], np.inf).argmin())
            if not np.isfinite(apart[k, j]) or j == first:
                break
            free[j] = False
            path.append(j)
            k = j
        if len(path) > 2 and apart[k, first] <= gap:
            rings.append(start[path])
    return rings


def inset(rings: list[np.ndarray], by: float) -> tuple[float, list[list[np.ndarray]]]:
    """What of the outline is ``by`` or more from its edges: the area, and the outlines it falls into.

    Every edge is moved inwards and every corner that points inwards becomes an arc; the pieces between their crossings
    that are inside and nowhere nearer than ``by`` to an edge bound the result, in the turning sense of the outline, so their
    cross products add up to its area.
    """
    rings = oriented(rings)
    if not rings:
        return 0.0, []
    origin = rings[0].mean(axis=0)
    rings = [r - origin for r in rings]
    if by <= 0:
        return sum(map(signed_area, rings)), [[r + origin for r in rings]]
    start, end, around = _split(*_offset(rings, by))
    middle = (start + end) / 2
    arc = ~np.isnan(around[:, 0])
    out = middle[arc] - around[arc]
    middle[arc] = around[arc] + out * (by / np.hypot(out[:, 0], out[:, 1]))[:, None]  # where the circle itself passes
    size = max(float(np.ptp(rings[0], axis=0).max()), by)
    keep = (distance(middle, rings) >= by - 1e-7 * size) & inside(middle, rings) & (np.hypot(*(end - start).T) > 1e-9 * size)
    start, end = start[keep], end[keep]
    area = float((start[:, 0] * end[:, 1] - start[:, 1] * end[:, 0]).sum()) / 2
    if area <= 1e-9 * size * size:
        return 0.0, []
    found = [(signed_area(r), r) for r in _chained(start, end, 0.02 * by + 1e-6 * size)]
    parts = [[r] for a, r in found if a > 1e-9 * size * size]
    for a, hole in found:
        if a < -1e-9 * size * size:
            for part in parts:
                if inside(hole[:1], part[:1])[0]:
                    part.append(hole)
                    break
    return area, [[r + origin for r in part] for part in parts]


def _between(ring: np.ndarray, k: int, q: np.ndarray) -> bool:
    """Whether the direction from corner ``k`` to ``q`` points into the ring (counter-clockwise)."""
    a, p, b = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
    turn = lambda u, v, w: (v[0] - u[0]) * (w[1] - u[1]) - (v[1] - u[1]) * (w[0] - u[0])
    if turn(a, p, b) >= 0:
        return turn(p, q, a) > 0 and turn(p, b, q) > 0
    return not (turn(p, q, b) >= 0 and turn(p, a, q) >= 0)


def bridged(rings: list[np.ndarray]) -> np.ndarray:
    """One ring that runs round the outer one and, over a bridge there and back, round every hole; for cutting into triangles.

    Holes are joined from the right-most on, each by the shortest line from its right-most corner to a corner of
    the ring so far that crosses nothing.
    """
    rings = oriented(rings)
    if not rings:
        return np.zeros((0, 2))
    ring, holes = rings[0], sorted(rings[1:], key=lambda h: -h[:, 0].max())
    for n, hole in enumerate(holes):
        k = int(hole[:, 0].argmax())
        p = hole[k]
        a, b = _edges([ring, *holes[n:]])
        for j in np.argsort(((ring - p) ** 2).sum(axis=1), kind="stable"):
            q = ring[j]
            if not _between(ring, int(j), p):
                continue
            side = lambda u, v, w: (v[..., 0] - u[..., 0]) * (w[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (w[..., 0] - u[..., 0])
            crosses = (side(p, q, a) * side(p, q, b) < 0) & (side(a, b, p) * side(a, b, q) < 0)
            on_way = (np.abs(side(p, q, a)) < 1e-12) & (((a - p) * (a - q)).sum(axis=1) < 0)
            if not crosses.any() and not on_way.any():
                break
        else:
            continue  # a hole outside the ring
        ring = np.concatenate([ring[: j + 1], np.roll(hole, -k, axis=0), hole[k : k + 1], ring[j:]])
    return ring


def _corners(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All corners of a batch of rings: x, y, the row of each, and whether both coordinates are known."""
    points = rings.flatten()
    x, y = (pc.cast(pc.struct_field(points, name), pa.float64()) for name in "xy")
    sizes = pc.fill_null(rings.value_lengths(), 0).to_numpy(zero_copy_only=False)
    known = pc.and_(x.is_valid(), y.is_valid()).to_numpy(zero_copy_only=False)
    return x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(rings)), sizes), known


def _to_edges(corners: tuple, ring: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` rows the least distance of its corners from the edges of its ring, and whether there is any; NaN only if nothing else."""
    x, y, row, known = ring
    k = np.flatnonzero((row[1:] == row[:-1]) & known[1:] & known[:-1])
    ax, ay, dx, dy = x[k], y[k], x[k + 1] - x[k], y[k + 1] - y[k]
    size = dx * dx + dy * dy
    edges = np.bincount(row[k], minlength=n)
    first = np.cumsum(edges) - edges
    px, py, row, known = corners
    k = np.flatnonzero(known & (edges[row] > 0))
    px, py, row = px[k], py[k], row[k]
    first, edges = first[row], edges[row]
    least, some = np.full(n, np.nan), np.zeros(n, dtype=bool)
    some[row] = True
    ends = (np.cumsum(edges) - 1) // PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(row)] if len(row) else []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        count = edges[low:high]
        start = np.cumsum(count) - count
        p = np.repeat(np.arange(low, high), count)
        e = np.arange(len(p)) + np.repeat(first[low:high] - start, count)
        ox, oy, ex, ey, whole = px[p] - ax[e], py[p] - ay[e], dx[e], dy[e], size[e]
        t = ox * ex + oy * ey
        t = np.divide(t, whole, out=np.zeros_like(t), where=whole != 0)
        t = np.fmax(0.0, np.fmin(1.0, t))
        np.fmin.at(least, row[low:high], np.fmin.reduceat((ox - t * ex) ** 2 + (oy - t * ey) ** 2, start))
    return np.sqrt(least), some


def gaps(inner: pa.Array, outer: pa.Array) -> pa.Array:
    """Row by row the least distance between the lines of two closed rings (lists of points x, y) that do not cross; null if no corner meets an edge of the other."""
    n, a, b = len(inner), _corners(inner), _corners(outer)
    with np.errstate(all="ignore"):
        (there, one), (back, other) = _to_edges(a, b, n), _to_edges(b, a, n)
        return pa.array(np.fmin(there, back), mask=~(one | other))
