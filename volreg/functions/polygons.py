"""Rings of points as column expressions, and the area two polygons share in Arrow batches.

A ring is an array of (x, y) structs; it may repeat its first point at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import on_workers


def edges(ring: Column) -> Column:
    """Array of (x0, y0, x1, y1), the last edge back to the first point."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def _total(ring: Column, term) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + term(e))


def signed_area(ring: Column) -> Column:
    return _total(ring, lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]) / 2


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def perimeter(ring: Column) -> Column:
    return _total(ring, lambda e: F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]))


def centroid(ring: Column) -> tuple[Column, Column]:
    cross = lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]
    six = F.nullif(6 * signed_area(ring), F.lit(0.0))
    return _total(ring, lambda e: (e["x0"] + e["x1"]) * cross(e)) / six, _total(ring, lambda e: (e["y0"] + e["y1"]) * cross(e)) / six


def on_edge(e: Column, x: Column, y: Column, slack: float = 1e-9) -> Column:
    along = F.abs((e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"])) <= slack
    return along & x.between(F.least(e["x0"], e["x1"]) - slack, F.greatest(e["x0"], e["x1"]) + slack) & y.between(F.least(e["y0"], e["y1"]) - slack, F.greatest(e["y0"], e["y1"]) + slack)


def contains(ring: Column, x: Column, y: Column, slack: float = 1e-9) -> Column:
    """Inside by counting crossings, or on the border."""
    crossing = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0)) + e["x0"])
    odd = F.size(F.filter(edges(ring), lambda e: F.coalesce(crossing(e), F.lit(False)))) % 2 == 1
    return odd | F.exists(edges(ring), lambda e: on_edge(e, x, y, slack))


def orientation(ring: Column, shortest: float = 0.3) -> Column:
    """Main direction modulo a right angle: mean of four times the edges' angles, by length."""
    long = F.filter(edges(ring), lambda e: F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]) > shortest)
    add = lambda f: F.aggregate(long, F.lit(0.0), lambda s, e: s + F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]) * f(4 * F.atan2(e["y1"] - e["y0"], e["x1"] - e["x0"])))
    return F.atan2(add(F.sin), add(F.cos)) / 4


def sweep(points: DataFrame, by: str) -> DataFrame:
    """Rows (by, part_no, x, y, invert, width, height) of an alignment's points to one rectangle for each span.

    The ring stands half a width to both sides, with flat ends; heights run from the
    lower invert to the higher one plus the height. Parts overlap at bends, and their
    volumes add up.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("part_no")
    ahead = {c: F.lead(c).over(w) for c in ("x", "y", "invert")}
    s = points.withColumns({f"n{c}": v for c, v in ahead.items()}).where("nx is not null")
    length = F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    ox, oy = -(F.col("ny") - F.col("y")) / length * F.col("width") / 2, (F.col("nx") - F.col("x")) / length * F.col("width") / 2
    corner = lambda x, y, k: F.struct((F.col(x) + k * ox).alias("x"), (F.col(y) + k * oy).alias("y"))
    ring = F.array(corner("x", "y", 1), corner("x", "y", -1), corner("nx", "ny", -1), corner("nx", "ny", 1))
    return s.where(length > 0).select(by, "part_no", ring.alias("ring"), length.alias("length"), F.least("invert", "ninvert").alias("z_min"), (F.greatest("invert", "ninvert") + F.col("height")).alias("z_max"))


def _clip(subject: list, a: tuple, b: tuple) -> list:
    """The part of a polygon on the left of the line from a to b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    side = [dx * (y - a[1]) - dy * (x - a[0]) for x, y in subject]
    out = []
    for i, (x, y) in enumerate(subject):
        j = i + 1 if i + 1 < len(subject) else 0
        s, t = side[i], side[j]
        if s >= 0:
            out.append((x, y))
        if s * t < 0:
            f = s / (s - t)
            out.append((x + (subject[j][0] - x) * f, y + (subject[j][1] - y) * f))
    return out


def _area(p) -> float:
    return 0.5 * sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], *p[:1]], strict=True)) if len(p) > 2 else 0.0


def _pieces(ring: list) -> list[tuple[list, int]]:
    """Convex pieces with signs that add up to a simple polygon: itself, or triangles from its first point."""
    n = len(ring)
    turns = [(ring[(i + 1) % n][0] - ring[i][0]) * (ring[(i + 2) % n][1] - ring[(i + 1) % n][1]) - (ring[(i + 1) % n][1] - ring[i][1]) * (ring[(i + 2) % n][0] - ring[(i + 1) % n][0]) for i in range(n)]
    if all(t >= 0 for t in turns):
        return [(ring, 1)]
    if all(t <= 0 for t in turns):
        return [(ring[::-1], 1)]
    out = []
    for a, b in zip(ring[1:-1], ring[2:], strict=True):
        t = [ring[0], a, b]
        if abs(s := _area(t)) > 1e-12:
            out.append((t, 1) if s > 0 else (t[::-1], -1))
    return out


def shared_area(a, b) -> float:
    """Area of the intersection of two simple polygons, convex or not, given as points."""
    open_ring = lambda r: r[:-1] if len(r) > 1 and r[0] == r[-1] else r
    a, b = (open_ring([(float(x), float(y)) for x, y in r]) for r in (a, b))
    if len(a) < 3 or len(b) < 3:
        return 0.0
    total = 0.0
    for s, i in _pieces(a):
        for t, j in _pieces(b):
            p = s
            for u, v in zip(t, [*t[1:], t[0]], strict=True):
                p = _clip(p, u, v)
                if not p:
                    break
            total += i * j * _area(p)
    return abs(total)  # triangles of a ring that runs clockwise turn the sign


def with_shared_area(pairs: DataFrame, a: str, b: str, name: str = "shared_m2") -> DataFrame:
    """``pairs`` with the area that the rings in columns ``a`` and ``b`` share. Put box tests before it."""
    on_workers(pairs.sparkSession)
    points = lambda ring: [(p["x"], p["y"]) for p in ring]

    @F.pandas_udf("double")
    def area(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([shared_area(points(p), points(q)) for p, q in zip(x, y, strict=True)], dtype=float)

    return pairs.withColumn(name, area(a, b))
