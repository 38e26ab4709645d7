"""Polygons with holes, in parts or crossing themselves: what they share, their union, difference, border and distance.

A shape is a list of rings; a point is inside if it lies in an odd number of them. Shapes
are cut into slabs between all x of corners and crossings; in a slab edges do not cross,
so what is inside is a stack of trapezoids. Small helpers for Arrow batches of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import on_workers

RINGS = "array<array<struct<x:double,y:double>>>"
#: Corners of a circle that stands for a rounded corner.
CIRCLE = 64
_CLOSE = 1e-7
#: Slabs times edges at once.
_BLOCK = 1 << 20

Shape = list[np.ndarray]


def shape(rings) -> Shape:
    """Rings as arrays of corners, without the repeated last one."""
    out = []
    for ring in [] if rings is None else rings:
        p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
        out.append(p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p)
    return [p for p in out if len(p) >= 3]


def _edges(shapes: list[Shape]) -> np.ndarray:
    """(x0, y0, x1, y1, owner) of every edge that is not upright, from left to right."""
    rows = [np.column_stack([p, np.roll(p, -1, 0), np.full(len(p), i)]) for i, s in enumerate(shapes) for p in s]
    e = np.concatenate(rows) if rows else np.zeros((0, 5))
    e = e[e[:, 0] != e[:, 2]]
    back = e[:, 0] > e[:, 2]
    e[back] = e[back][:, [2, 3, 0, 1, 4]]
    return e


def trapezoids(shapes: list[Shape], wanted: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """(x0, x1, y0 at x0, y0 at x1, y1 at x0, y1 at x1) of where ``wanted`` (of which shapes hold each place, a row a shape) is true."""
    return cut(_edges(shapes), len(shapes), wanted)


def cut(e: np.ndarray, n: int, wanted: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Trapezoids of edges (x0, y0, x1, y1, owner) of ``n`` shapes."""
    if not len(e):
        return np.zeros((0, 6))
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    at0 = e[:, 1] - slope * e[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (at0[None, :] - at0[:, None]) / (slope[:, None] - slope[None, :])
    both = np.isfinite(cross) & (cross > np.maximum(e[:, None, 0], e[None, :, 0])) & (cross < np.minimum(e[:, None, 2], e[None, :, 2]))
    xs = np.unique(np.concatenate([e[:, 0], e[:, 2], cross[both]]))
    xs = xs[np.append(True, np.diff(xs) > _CLOSE / 100)]
    y = lambda i, x: e[i, 1] + (x - e[i, 0]) * slope[i]
    # slabs by blocks, so that slabs times edges stays small
    step = max(1, _BLOCK // len(e))
    out = [_stacks(e, y, xs[k : k + step + 1], n, wanted) for k in range(0, len(xs) - 1, step)]
    return np.concatenate(out) if out else np.zeros((0, 6))


def _stacks(e: np.ndarray, y: Callable, xs: np.ndarray, n: int, wanted: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The trapezoids between neighbouring ``xs``, all slabs at once: edges by slab and height, insides by parity."""
    a, b = xs[:-1], xs[1:]
    m = (a + b) / 2
    slab, i = np.nonzero((e[None, :, 0] <= m[:, None]) & (e[None, :, 2] >= m[:, None]))
    if not len(i):
        return np.zeros((0, 6))
    order = np.lexsort((y(i, m[slab]), slab))
    slab, i = slab[order], i[order]
    first = np.append(True, slab[1:] != slab[:-1])
    passed = np.zeros((len(i) + 1, n), np.int32)
    passed[np.arange(len(i)) + 1, e[i, 4].astype(int)] = 1
    passed = np.cumsum(passed, 0, dtype=np.int32)
    before = passed[np.flatnonzero(first)][np.cumsum(first) - 1]
    now = wanted(((passed[1:] - before) % 2 == 1).T)
    was = np.append(False, now[:-1]) & ~first
    # what begins in a slab and does not end there is none
    last = np.append(first[1:], True)
    begin, end = np.flatnonzero(now & ~was & ~(last & now)), np.flatnonzero(was & ~now)
    if len(begin) != len(end):
        open_ = np.flatnonzero(last & now & was)
        begin = np.delete(begin, np.searchsorted(begin, open_, "right") - 1)
    k = slab[begin]
    t = np.column_stack([a[k], b[k], y(i[begin], a[k]), y(i[begin], b[k]), y(i[end], a[k]), y(i[end], b[k])])
    thick = t[:, 4] - t[:, 2] + t[:, 5] - t[:, 3] > 1e-12
    t, k = t[thick], k[thick]
    # an interval that begins where the one before ends goes on
    on = (k[1:] == k[:-1]) & (np.abs(t[:-1, 4] - t[1:, 2]) + np.abs(t[:-1, 5] - t[1:, 3]) < _CLOSE / 100)
    head, tail = np.append(True, ~on)[: len(t)], np.append(~on, True)[: len(t)]
    return np.column_stack([t[head, :4], t[tail, 4:]])


def area(t: np.ndarray) -> float:
    return float(((t[:, 1] - t[:, 0]) * (t[:, 4] - t[:, 2] + t[:, 5] - t[:, 3])).sum() / 2)


def both(a: Shape, b: Shape) -> np.ndarray:
    return trapezoids([a, b], lambda s: s[0] & s[1])


def less(a: Shape, b: Shape) -> np.ndarray:
    return trapezoids([a, b], lambda s: s[0] & ~s[1])


def joined(shapes: list[Shape]) -> np.ndarray:
    return trapezoids(shapes, lambda s: s.any(0))


def _sides(t: np.ndarray) -> list[tuple]:
    """The directed border of trapezoids: inside is on the left; sides that two share are gone."""
    t = np.round(t / _CLOSE).astype(np.int64)
    out = [((x0, a), (x1, b)) for x0, x1, a, b, _, _ in t.tolist()] + [((x1, d), (x0, c)) for x0, x1, _, _, c, d in t.tolist()]
    upright: dict[int, list[tuple[int, int]]] = {}
    for x0, x1, a, b, c, d in t.tolist():
        upright.setdefault(x1, []).extend([(b, 1), (d, -1)])
        upright.setdefault(x0, []).extend([(a, -1), (c, 1)])
    for x, marks in upright.items():
        level, was = 0, None
        for y, step in sorted(marks):
            if level and was is not None and y != was:
                out.append(((x, was), (x, y)) if level > 0 else ((x, y), (x, was)))
            level, was = level + step, y
    return [s for s in out if s[0] != s[1]]


def rings(t: np.ndarray) -> Shape:
    """The border of trapezoids as rings: outer ones run against the clock, holes with it."""
    after: dict[tuple, list[tuple]] = {}
    for a, b in _sides(t):
        after.setdefault(a, []).append(b)
    out = []
    while after:
        start = min(after)
        ring, at, came = [], start, None
        while True:
            ways = after[at]
            if came is not None and len(ways) > 1:  # where rings touch, turn left most
                angle = lambda q: np.arctan2(came[0] * (q[1] - at[1]) - came[1] * (q[0] - at[0]), came[0] * (q[0] - at[0]) + came[1] * (q[1] - at[1]))  # noqa: B023, E731
                ways.sort(key=angle)
            to = ways.pop()
            if not ways:
                del after[at]
            ring.append(at)
            came, at = (to[0] - at[0], to[1] - at[1]), to
            if at == start:
                break
        p = np.array(ring, float) * _CLOSE
        out.append(without_straight(p))
    return [p for p in out if len(p) >= 3]


def without_straight(p: np.ndarray, slack: float = 1e-6) -> np.ndarray:
    """A ring without the corners that lie between their neighbours."""
    while len(p) > 3:
        v = _next(p) - p
        u = np.concatenate([v[-1:], v[:-1]])
        bend = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) > slack * (1 + np.hypot(*u.T) + np.hypot(*v.T))
        if bend.all() or bend.sum() < 3:
            break
        # of straight corners side by side only every other goes at once
        drop = ~bend
        drop[1:] &= bend[:-1]
        p = p[~drop]
    return p


def _next(p: np.ndarray) -> np.ndarray:
    """Each corner's next one; quicker than ``np.roll``."""
    return np.concatenate([p[1:], p[:1]])


def ring_area(p: np.ndarray) -> float:
    q = _next(p)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def holds(s: Shape, x: float, y: float) -> bool:
    inside = False
    for p in s:
        q = np.roll(p, -1, 0)
        over = (p[:, 1] > y) != (q[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= bool((over & (x < (q[:, 0] - p[:, 0]) * (y - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0])).sum() % 2)
    return inside


def parts(s: Shape) -> list[Shape]:
    """An outer ring with its holes for each separate part, the largest first."""
    outer = sorted((p for p in s if ring_area(p) > 0), key=ring_area, reverse=True)
    out = [[p] for p in outer]
    for h in (p for p in s if ring_area(p) < 0):
        # a hole belongs to the smallest outer ring around it
        for own in reversed(out):
            if holds(own[:1], *h[0]) or holds(own[:1], *h.mean(0)):
                own.append(h)
                break
    return sorted(out, key=lambda o: sum(map(ring_area, o)), reverse=True)


def clean(s: Shape) -> Shape:
    """The largest part of what lies in an odd number of rings, its outer ring against the clock; nothing below a millionth."""
    found = parts(rings(joined([s])))
    return found[0] if found and sum(map(ring_area, found[0])) > 1e-6 else []


def crosses_itself(s: Shape) -> bool:
    """Whether edges of rings meet elsewhere than in neighbours' corners."""
    for p in s:
        q = np.roll(p, -1, 0)
        n = len(p)
        side = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
        a, b, c, d = p[:, None], q[:, None], p[None], q[None]
        meet = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
        i, j = np.nonzero(meet)
        if ((np.abs(i - j) > 1) & (np.abs(i - j) < n - 1)).any():
            return True
    return False


def _bends_out(s: Shape) -> list[np.ndarray]:
    """For each ring, which corners the shape's inside bends outwards at."""
    out = []
    for k, p in enumerate(s):
        u, v = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
        left = (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) * np.sign(ring_area(p)) > 0
        out.append(~left if holds(s[:k] + s[k + 1 :], *p[0]) else left)
    return out


def border(s: Shape, d: float, outwards: bool) -> list[Shape]:
    """Boxes along edges, and circles around the corners that they leave open on one side: all within ``d`` of the border on that side."""
    turn = np.arange(CIRCLE) * 2 * np.pi / CIRCLE
    out = []
    for p, bends in zip(s, _bends_out(s), strict=True):
        q = np.roll(p, -1, 0)
        for a, b, open_ in zip(p, q, bends == outwards, strict=True):
            if open_:
                out.append([a + d * np.column_stack([np.cos(turn), np.sin(turn)])])
            n = np.hypot(*(b - a))
            if n > 0:
                off = np.array([-(b - a)[1], (b - a)[0]]) / n * d
                out.append([np.array([a + off, a - off, b - off, b + off])])
    return out


def _round_about(p: np.ndarray, d: float) -> np.ndarray:
    """A convex ring grown by ``d``: its edges moved out, with arcs between them."""
    p = p if ring_area(p) > 0 else p[::-1]
    v = np.roll(p, -1, 0) - p
    out_ = np.arctan2(v[:, 1], v[:, 0]) - np.pi / 2
    step, ring = 2 * np.pi / CIRCLE, []
    for corner, a, b in zip(p, np.roll(out_, 1), out_, strict=True):
        b = a + (b - a) % (2 * np.pi)
        between = np.arange(np.floor(a / step + 1e-9) + 1, np.ceil(b / step - 1e-9)) * step
        t = np.array([a, *between, b])
        ring.append(corner + d * np.column_stack([np.cos(t), np.sin(t)]))
    return np.concatenate(ring)


def buffered(s: Shape, d: float) -> Shape:
    """Grown by ``d`` with round corners, or shrunk if it is negative."""
    if not d or not s:
        return s
    if d < 0:
        return rings(trapezoids([s, *border(s, -d, False)], lambda x: x[0] & ~x[1:].any(0)))
    if len(s) == 1 and _bends_out(s)[0].all():
        return [_round_about(s[0], d)]
    return rings(joined([s, *border(s, d, True)]))


def beyond(a: Shape, b: Shape, grow: float) -> float:
    """Area of ``a`` beyond ``b`` grown: only what sticks out meets the pieces of the border that are near it."""
    out = rings(less(a, b))
    if not out or not grow:
        return sum(map(ring_area, out))
    lo, hi = np.concatenate(out).min(0), np.concatenate(out).max(0)
    near = [p for p in border(b, grow, True) if (p[0].max(0) >= lo).all() and (p[0].min(0) <= hi).all()]
    return area(trapezoids([out, *near], lambda x: x[0] & ~x[1:].any(0)))


def _to_segments(points: np.ndarray, p: np.ndarray, q: np.ndarray) -> float:
    v = q - p
    n = np.maximum((v**2).sum(1), 1e-300)
    f = np.clip(((points[:, None] - p[None]) * v[None]).sum(2) / n, 0, 1)
    return float(np.sqrt((((p[None] + f[..., None] * v[None]) - points[:, None]) ** 2).sum(2)).min())


def distance(a: Shape, b: Shape) -> float:
    """Shortest distance in plan; 0 if the shapes share an area or touch."""
    if not a or not b:
        return float("inf")
    if area(both(a, b)) > 0:
        return 0.0
    ends = lambda s: (np.concatenate(s), np.concatenate([np.roll(p, -1, 0) for p in s]))
    (p, q), (r, t) = ends(a), ends(b)
    return min(_to_segments(p, r, t), _to_segments(r, p, q))


def simplified(p: np.ndarray, slack: float) -> np.ndarray:
    """A ring with fewer corners, none of those left out farther than ``slack`` from it (from the farthest two corners on)."""

    def line(i: int, j: int) -> list[int]:
        if j - i < 2:
            return []
        a, b = r[i], r[j]
        n = np.hypot(*(b - a)) or 1.0
        off = np.abs((b - a)[0] * (r[i + 1 : j, 1] - a[1]) - (b - a)[1] * (r[i + 1 : j, 0] - a[0])) / n
        k = int(off.argmax()) + i + 1
        return [*line(i, k), k, *line(k, j)] if off.max() > slack else []

    if len(p) <= 4:
        return p
    far = int(np.hypot(*(p - p[0]).T).argmax())
    r = np.concatenate([p, p[:1]])
    keep = [0, *line(0, far), far, *line(far, len(p))]
    return r[keep] if len(keep) >= 3 else p


def regular(p: np.ndarray, angle: float, slack: float = 0.35, snap: float = 22.5, most: float = 0.25) -> np.ndarray:
    """A footprint's ring with edges near the main directions laid along them; unchanged if its area would change too much."""
    c, s = np.cos(-angle), np.sin(-angle)
    q = simplified(p @ np.array([[c, s], [-s, c]]), slack)
    n = len(q)
    v = np.roll(q, -1, 0) - q
    turn = np.degrees(np.arctan2(v[:, 1], v[:, 0])) % 180
    flat, up = np.minimum(turn, 180 - turn) <= snap, np.abs(turn - 90) <= snap
    mid = q + v / 2
    out = []
    for i in range(n):  # the corner between edge i - 1 and edge i
        h = i - 1
        if flat[h] and up[i]:
            out.append((mid[i, 0], mid[h, 1]))
        elif up[h] and flat[i]:
            out.append((mid[h, 0], mid[i, 1]))
        else:
            out.append(tuple(q[i]))
    r = np.array(out) @ np.array([[c, -s], [s, c]])
    was = abs(ring_area(p))
    return p if crosses_itself([r]) or abs(abs(ring_area(r)) - was) > most * was else r


# ---- columns


def _column(kernel: Callable, kind: str, *columns: Column) -> Column:
    """``kernel`` of each Arrow batch's columns of rings and its number of rows: arrays in, an array out."""
    from . import overlays

    on_workers(SparkSession.active())

    if len(columns) == 1:

        @F.arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in batches:
                yield kernel(overlays.read(a), len(a))

    else:

        @F.arrow_udf(kind)
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for a, b in batches:
                yield kernel(overlays.read(a), overlays.read(b), len(a))

    return run(*columns)


def _overlaid(a: Column, b: Column, which: str) -> Column:
    from . import overlays

    def kernel(x, y, n: int) -> pa.Array:
        return overlays.arrow(overlays.outlines(*overlays.pairwise(x, y, n, getattr(overlays, which)), n), n)

    return _column(kernel, RINGS, a, b)


def _each(f: Callable[[Shape], Shape], a: Column) -> Column:
    from . import overlays

    return _column(lambda x, n: overlays.write([f(s) for s in overlays.shapes(x, n)]), RINGS, a)


def shared(a: Column, b: Column) -> Column:
    """Area of what two shapes share. Put box tests before it."""
    from . import overlays

    return _column(lambda x, y, n: pa.array(overlays.shared(x, y, n)), "double", a, b)


def outside(a: Column, b: Column, grow: float = 0.0) -> Column:
    """Area of ``a`` beyond ``b`` grown."""
    from . import overlays

    return _column(lambda x, y, n: pa.array(overlays.beyond(x, y, n, grow)), "double", a, b)


def apart(a: Column, b: Column) -> Column:
    from . import overlays

    return _column(lambda x, y, n: pa.array(overlays.apart(x, y, n)), "double", a, b)


def intersection(a: Column, b: Column) -> Column:
    return _overlaid(a, b, "BOTH")


def difference(a: Column, b: Column) -> Column:
    return _overlaid(a, b, "LESS")


def union(a: Column, b: Column) -> Column:
    return _overlaid(a, b, "JOINED")


def largest(a: Column) -> Column:
    """The largest part of a shape, cleaned."""
    from . import overlays

    return _column(lambda x, n: overlays.write(overlays.cleaned(x, n)), RINGS, a)


def grown(a: Column, by: float) -> Column:
    from . import overlays

    return _column(lambda x, n: overlays.arrow(overlays.buffered(x, n, by), n), RINGS, a)


def self_crossing(a: Column) -> Column:
    from . import overlays

    return _column(lambda x, n: pa.array(overlays.crossing(x, n)), "boolean", a)


def regularised(a: Column) -> Column:
    """The outer ring laid along its main directions."""
    from . import overlays

    return _column(lambda x, n: overlays.write(overlays.regularised(x, n)), RINGS, a)


def union_by(df: DataFrame, by: list[str], rings_: str, grow: float = 0.0, simplify: float = 0.0) -> DataFrame:
    """``(by, rings, area, n_parts)``: the union of each group's shapes, grown first, then simplified.

    Groups are the units of a storey or the parts of an object, few shapes each.
    """
    from . import overlays

    on_workers(df.sparkSession)

    @F.arrow_udf(f"struct<rings:{RINGS},area:double,n_parts:int>")
    def united(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for groups in batches:
            start, n = overlays._lists(groups)
            which = np.repeat(np.arange(len(groups)), n)
            r = overlays.read(groups.values.take(pa.array(overlays._runs(start, n))))
            number = np.arange(len(which)) - (np.cumsum(n) - n)[which]
            if grow:
                r = overlays.buffered(r, len(which), grow)
            side = (overlays.Rings(r.p, r.size, which[r.row]), number[r.row])
            found = overlays.outlines(*overlays.trapezoids([side], len(groups), overlays.JOINED), len(groups))
            if simplify:
                found = overlays.simplified(found, simplify)
            outer = np.bincount(found.row, overlays.ring_areas(found) > 0, len(groups)).astype(np.int32)  # a part has one outer ring
            columns = [overlays.arrow(found, len(groups)), pa.array(overlays.areas(found, len(groups))), pa.array(outer)]
            yield pa.StructArray.from_arrays(columns, ["rings", "area", "n_parts"])

    # batches of groups, as a call of Python for each of many small groups costs more than its shapes
    of = df.groupBy(*by).agg(F.collect_list(rings_).alias("_shapes"))
    return of.select(*by, united("_shapes").alias("_u")).select(*by, "_u.*")
