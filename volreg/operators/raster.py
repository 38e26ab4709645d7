"""Rasters in long form: one row for each cell with a value, ``(row, col, value)``.

Holes are absent rows. What looks at a cell's surroundings works on tiles (``tiles.py``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import large, stored
from . import tiles
from .tiles import Box

#: Cells around a tile that holes are filled from; what is farther takes joins.
REACH = 64


def index(x: Column, origin: float, cell: float) -> Column:
    """Number of the cell whose middle is nearest, halves to even."""
    return F.rint((x - origin) / cell).cast("int")


def binned(points: DataFrame, x0: float, y0: float, cell: float, stat: str = "min", value: str = "z") -> DataFrame:
    agg = {"min": F.min, "max": F.max, "mean": F.avg, "count": F.count}[stat]
    return points.groupBy(index(F.col("y"), y0, cell).alias("row"), index(F.col("x"), x0, cell).alias("col")).agg(agg(value).alias("value"))


def opened(raster: DataFrame, radius: int) -> DataFrame:
    """Grey opening with a square of side 2 r + 1: least, then greatest, each along rows and columns by itself."""
    return tiles.to_cells(tiles.cut(raster, 2 * radius), 2 * radius, lambda a, row, col: tiles.inner(tiles.opened(a[0], radius), 2 * radius)[None])


def radii(largest: int) -> list[int]:
    """Growing radii: each at least one more and about 1.6 times the one before, the largest last."""
    out, r = [], 1
    while r < largest:
        out.append(r)
        r = max(r + 1, -(-16 * r // 10))
    return [*out, max(1, largest)]


def slope(raster: DataFrame, cell: float) -> DataFrame:
    """Steepness from differences of neighbours, central where both are there, else one-sided, else 0."""
    return tiles.to_cells(tiles.cut(raster, 1), 1, lambda a, row, col: tiles.slope(a[0], cell)[None])


def difference(a: DataFrame, b: DataFrame, floor: float | None = None) -> DataFrame:
    d = F.col("a.value") - F.col("b.value")
    return a.alias("a").join(b.alias("b"), ["row", "col"]).select("row", "col", (d if floor is None else F.greatest(d, F.lit(floor))).alias("value"))


def sample(raster: DataFrame, points: DataFrame, x0: float, y0: float, cell: float, how: str = "bilinear") -> DataFrame:
    """``points`` (pid, x, y) with ``value``; null beside holes and beyond the border."""
    r, c = (F.col("y") - y0) / cell, (F.col("x") - x0) / cell
    if how == "nearest":
        return points.withColumns({"row": F.rint(r).cast("int"), "col": F.rint(c).cast("int")}).join(large(raster), ["row", "col"], "left").drop("row", "col")
    near = large(tiles.corners(raster, cell).withColumnsRenamed({"row": "r0", "col": "c0"}))
    at = points.withColumns({"r0": F.floor(r).cast("int"), "c0": F.floor(c).cast("int"), "fr": r - F.floor(r), "fc": c - F.floor(c)})
    return at.join(near, ["r0", "c0"], "left").select(*points.columns, _bilinear("t").alias("value"))


def _bilinear(layer: str) -> Column:
    """The value between four corners; null beside holes."""
    share = lambda k, f: F.col(f) if k else 1 - F.col(f)
    terms = [F.col(f"{layer}{i}{j}") * (share(i, "fr") * share(j, "fc")) for i in (0, 1) for j in (0, 1)]
    return terms[0] + terms[1] + terms[2] + terms[3]


def filled(raster: DataFrame, holes: DataFrame, reach: int) -> DataFrame:
    """Values for ``holes`` (row, col) from the nearest cell within ``reach``; of equals the least (row, col)."""
    b = reach
    block = lambda c: F.floor(F.col(c) / b)
    near = holes.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(8)))).select("row", "col", (block("row") + F.col("d").cast("int") % 3 - 1).alias("br"), (block("col") + F.floor(F.col("d") / 3) - 1).alias("bc"))
    valid = raster.select(F.col("row").alias("r"), F.col("col").alias("c"), "value", F.floor(F.col("row") / b).alias("br"), F.floor(F.col("col") / b).alias("bc"))
    d2 = F.pow(F.col("row") - F.col("r"), 2) + F.pow(F.col("col") - F.col("c"), 2)
    return near.join(large(valid), ["br", "bc"]).where(d2 <= reach * reach).groupBy("row", "col").agg(F.min_by("value", F.struct(d2, "r", "c")).alias("value"))


def filled_from_nearest(raster: DataFrame, holes: DataFrame, reach: int) -> DataFrame:
    """Values for all ``holes`` from the nearest cell at any distance: the reach doubles until none is left."""
    left, out = stored(holes.select("row", "col"), "holes"), None
    empty = raster.isEmpty()
    while True:
        found = stored(filled(raster, left, reach), "filled")
        out = found if out is None else out.union(found)
        left = stored(left.join(found, ["row", "col"], "left_anti"), "holes")
        if empty or left.isEmpty():
            return out
        reach *= 2


def lattice(raster: DataFrame) -> DataFrame:
    """Every (row, col) of the raster's box."""
    box = raster.agg(*(f(c).alias(f"{c}_{n}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max)))).where("row_lo is not null")
    rows = box.withColumn("row", F.explode(F.sequence("row_lo", "row_hi"))).repartition("row")
    return rows.select("row", F.explode(F.sequence("col_lo", "col_hi")).alias("col"))


def holes(raster: DataFrame) -> DataFrame:
    """The cells of the raster's box that have no value."""
    return lattice(raster).join(raster, ["row", "col"], "left_anti")


def complete(raster: DataFrame, reach: int = REACH) -> DataFrame:
    """The raster with every hole of its box filled from the nearest cell."""
    box = Box.of(raster)
    if box is None:
        return raster.select("row", "col", "value")
    done = tiles.filled(tiles.cut(raster, reach, box), reach, reach, box, _first, 0, "complete")
    return tiles.to_cells(done, 0)


def _first(a: np.ndarray, row: int, col: int) -> tuple[np.ndarray, np.ndarray]:
    return a[0], np.empty((0, tiles.TILE, tiles.TILE))


def blurred(raster: DataFrame, weights: list[float]) -> DataFrame:
    """A full raster's weighted means along rows, then columns; beyond the border it is mirrored, the border cell itself too.

    ``weights`` are those of the middle and of each distance.
    """
    box, k = Box.of(raster), len(weights) - 1
    if box is None:
        return raster.select("row", "col", "value")
    return tiles.to_cells(tiles.cut(raster, k), k, lambda a, row, col: tiles.blurred(a[0], weights, row, col, box)[None])


def gaussian(sigma: float = 1.0, reach: float = 4.0) -> list[float]:
    import math

    return [math.exp(-0.5 * (d / sigma) ** 2) for d in range(int(reach * sigma + 0.5) + 1)]


def ground(points: DataFrame, x0: float, y0: float, cell: float, largest: int, steepness: float = 0.2, smooth: bool = True) -> DataFrame:
    """Progressive morphological filter: the terrain raster over the points' whole box.

    Voids are filled, then every opening works on the one before; a cell that drops by
    more than the slope allows for the window belongs to an object. Objects and voids are
    filled from the nearest terrain, and the terrain is smoothed a little. Openings whose
    halos add up to less than a tile share one exchange of borders.
    """
    seen = stored(binned(points, x0, y0, cell, "min"), "seen")
    box = Box.of(seen)
    if box is None:
        return seen
    groups = [[]]
    for r in radii(largest):
        if groups[-1] and 2 * (sum(groups[-1]) + r) > tiles.TILE - REACH:
            groups.append([])
        groups[-1].append(r)
    halos = [2 * sum(g) + (REACH if g is groups[-1] else 0) for g in groups]

    def observed(a: np.ndarray, row: int, col: int) -> tuple[np.ndarray, np.ndarray]:
        mid = tiles.inner(a[0], REACH)
        return a[0], np.stack([np.isnan(mid).astype(float)])  # 1: a void, never taken for terrain

    def sifted(a: np.ndarray, radii_: list[int]) -> np.ndarray:
        """Layers surface, gone, opened so far: after further openings, within what they leave of the halo."""
        surface, gone, now = a
        for r in radii_:
            was, now = now, tiles.opened(now, r)
            gone = np.where(was - now > steepness * r * cell, 1.0, gone)
        return tiles.inner(np.stack([surface, gone, now]), 2 * sum(radii_))

    def started(a: np.ndarray) -> np.ndarray:
        return a if len(a) == 3 else np.stack([a[0], a[1], a[0]])

    def terrain(a: np.ndarray, row: int, col: int) -> tuple[np.ndarray, np.ndarray]:
        surface, gone, _ = sifted(started(a), groups[-1])
        return np.where(gone == 0, surface, np.nan), np.empty((0, tiles.TILE, tiles.TILE))

    pieces = tiles.filled(tiles.cut(seen, REACH, box), REACH, REACH, box, observed, halos[0], "surface")
    for g, halo, onward in zip(groups[:-1], halos[:-1], halos[1:], strict=True):
        pieces = tiles.step(pieces, halo, lambda a, row, col, g=g: sifted(started(a), g), onward)
    weights = gaussian() if smooth else [1.0]
    k = len(weights) - 1
    bare = tiles.filled(pieces, halos[-1], REACH, box, terrain, k, "terrain")
    return tiles.to_cells(bare, k, lambda a, row, col: tiles.blurred(a[0], weights, row, col, box)[None])


def classified(points: DataFrame, terrain: DataFrame, x0: float, y0: float, cell: float, height: float = 0.3, widen: float = 1.25) -> DataFrame:
    """``points`` with their height above the terrain and whether they are ground: the tolerance widens with the local slope."""
    r, c = (F.col("y") - y0) / cell, (F.col("x") - x0) / cell
    # tiles are few rows and small files: what a join takes their cells for would fit the driver
    near = large(tiles.corners(terrain, cell).withColumnsRenamed({"row": "r0", "col": "c0"}))
    at = points.withColumns({"r0": F.floor(r).cast("int"), "c0": F.floor(c).cast("int"), "fr": r - F.floor(r), "fc": c - F.floor(c)}).join(near, ["r0", "c0"], "left")
    # beyond the border's cells' middles, up to half a cell, and beside holes: the nearest cell's
    place = (F.rint(F.col("r0") + F.col("fr")).cast("int") - F.col("r0")) * 2 + F.rint(F.col("c0") + F.col("fc")).cast("int") - F.col("c0")
    closest = lambda layer: F.get(F.array(*(F.col(f"{layer}{i}{j}") for i in (0, 1) for j in (0, 1))), place)
    at = at.select(*points.columns, *(F.coalesce(_bilinear(x), closest(x)).alias(n) for x, n in (("t", "terrain"), ("s", "steep"))))
    tolerance = height + widen * F.coalesce("steep", F.lit(0.0)) * cell
    return at.withColumn("above", F.col("z") - F.col("terrain")).withColumn("is_ground", F.round(F.abs("above") - tolerance, 9) <= 0)


def ground_summary(classified_: DataFrame) -> DataFrame:
    """One row: points, the share that is ground, and mean and greatest height above it."""
    return classified_.agg(F.count("*").alias("points"), F.bround(F.avg(F.col("is_ground").cast("int")), 6).alias("ground_share"), F.bround(F.avg("above"), 6).alias("mean_above"), F.bround(F.max("above"), 6).alias("max_above"))


def decimated(raster: DataFrame, most: int) -> DataFrame:
    """Every n-th row and column so that about ``most`` cells stay; values to two places."""
    size = raster.agg(((F.max("row") - F.min("row") + 1) * (F.max("col") - F.min("col") + 1)).alias("cells"))
    step = F.greatest(F.ceil(F.sqrt(F.col("cells") / most)), F.lit(1))
    return raster.crossJoin(F.broadcast(size)).where((F.col("row") % step == 0) & (F.col("col") % step == 0)).select("row", "col", F.bround("value", 2).alias("value"))  # one row by construction
