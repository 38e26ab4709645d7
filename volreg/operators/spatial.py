"""Joins of boxes: by column, by point, by overlap and by distance.

Spark has no range join, so boxes are put into the cells of grids and joined on the cell.
There is a grid for each level of sizes, with cells four times as wide as the level below;
a box lies in the grid of its size, where it meets four cells at most, however large it is.
Two boxes meet in the grid of the larger one: the smaller is put into that grid too, but
only if the other side has boxes of that level. A pair is kept only in the cell of its
larger lower corner, so none comes twice and no distinct is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EPS
from ..shared import stored

#: Metres of the finest cell's side, somewhat larger than most boxes, and the factor from level to level.
CELL, FACTOR = 32.0, 4.0
#: Levels: the coarsest cells are wider than the Earth is round.
LEVELS = 11
_KEY = ["_turn", "_level", "_cx", "_cy"]


def cell(x: Column, level: Column) -> Column:
    return F.floor(x / (CELL * F.pow(F.lit(FACTOR), level)))


def level(x0: str = "x0", x1: str = "x1", y0: str = "y0", y1: str = "y1", grow: float = 0.0) -> Column:
    """The level whose cells are as wide as the box, or the coarsest."""
    size = F.greatest(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)) + 2 * grow
    found = F.ceil(F.log(F.greatest(size, F.lit(CELL)) / CELL) / math.log(FACTOR) - 1e-9)
    return F.least(found, F.lit(LEVELS - 1)).cast("int")


def _with_levels(df: DataFrame, other: DataFrame, grow: float) -> DataFrame:
    """The rows with the array ``_levels`` of levels that the other side's boxes have: one row, of a few numbers, is sent."""
    found = other.select(level(grow=grow).alias("_l")).agg(F.collect_set("_l").alias("_levels"))
    return df.crossJoin(F.broadcast(found))


def _in_cells(boxes: DataFrame, grow: float) -> DataFrame:
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a) - grow, F.col("_level")), cell(F.col(b) + grow, F.col("_level"))))
    return boxes.withColumn("_cx", span("x0", "x1")).withColumn("_cy", span("y0", "y1"))


def _renamed(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{tag}_{c}") if not c.startswith("_") else F.col(c) for c in df.columns))


def box_pairs(a: DataFrame, b: DataFrame, grow: float = 0.0) -> DataFrame:
    """Pairs of boxes that touch in plan once ``a`` is grown; columns get the prefixes ``a_`` and ``b_``.

    Turn 0 joins boxes of ``a`` in their own grids with those of ``b`` of no higher level,
    turn 1 boxes of ``b`` in theirs with smaller ones of ``a``. Both sides are stored, as
    each is read for its boxes and for its levels.
    """
    a, b = (stored(a, "boxes"),) * 2 if a is b else (stored(a, "boxes"), stored(b, "boxes"))
    at = lambda turn, levels: F.transform(levels, lambda x: F.struct(F.lit(turn).alias("turn"), x.alias("level")))
    own = lambda *turns: F.array(*(F.struct(F.lit(t).alias("turn"), F.col("_l").alias("level")) for t in turns))
    higher = F.filter("_levels", lambda x: x > F.col("_l"))

    def side(df: DataFrame, other: DataFrame, tag: str, mine: Column, up: int, grow_: float, others_: float) -> DataFrame:
        df = _with_levels(df.withColumn("_l", level(grow=grow_)), other, others_).withColumn("_at", F.explode(F.concat(mine, at(up, higher))))
        df = _in_cells(df.withColumns({"_turn": F.col("_at.turn"), "_level": F.col("_at.level")}).drop("_at", "_levels", "_l"), grow_)
        return _renamed(df, tag)

    pairs = side(a, b, "a", own(0), 1, grow, 0.0).join(side(b, a, "b", own(0, 1), 0, 0.0, grow), _KEY)
    c = F.col
    touch = (c("a_x0") - grow <= c("b_x1")) & (c("b_x0") <= c("a_x1") + grow) & (c("a_y0") - grow <= c("b_y1")) & (c("b_y0") <= c("a_y1") + grow)
    corner = lambda axis: F.greatest(cell(c(f"a_{axis}0") - grow, c("_level")), cell(c(f"b_{axis}0"), c("_level")))
    return pairs.where(touch & (c("_cx") == corner("x")) & (c("_cy") == corner("y"))).drop(*_KEY)


def in_boxes(points: DataFrame, boxes: DataFrame, grow: float = 0.0) -> DataFrame:
    """Rows of ``points`` (x, y) with those of ``boxes``, grown on all sides, that they lie in, borders included; names of both must differ."""
    boxes = stored(boxes, "boxes")
    at = _with_levels(points, boxes, grow).withColumn("_level", F.explode("_levels")).drop("_levels")
    at = at.withColumns({"_cx": cell(F.col("x"), F.col("_level")), "_cy": cell(F.col("y"), F.col("_level"))})
    met = at.join(_in_cells(boxes.withColumn("_level", level(grow=grow)), grow), _KEY[1:])
    return met.where(F.col("x").between(F.col("x0") - grow, F.col("x1") + grow) & F.col("y").between(F.col("y0") - grow, F.col("y1") + grow)).drop(*_KEY)


def overlap(axis: str = "x") -> Column:
    lo, hi = {"x": ("x0", "x1"), "y": ("y0", "y1"), "z": ("z_min", "z_max")}[axis]
    return F.least(F.col(f"a_{hi}"), F.col(f"b_{hi}")) - F.greatest(F.col(f"a_{lo}"), F.col(f"b_{lo}"))


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def shared_area() -> Column:
    return positive(overlap("x")) * positive(overlap("y"))


def shared_volume() -> Column:
    return shared_area() * positive(overlap("z"))


def plan_distance() -> Column:
    return F.hypot(positive(-overlap("x")), positive(-overlap("y")))


def clearance() -> Column:
    """Shortest distance of two boxes; 0 where they meet."""
    return F.hypot(plan_distance(), positive(-overlap("z")))


def column_at(objects: DataFrame, x: float, y: float) -> DataFrame:
    """Everything above and below a place, its border included, from the top down."""
    hit = objects.where((F.col("x0") <= x) & (F.col("x1") >= x) & (F.col("y0") <= y) & (F.col("y1") >= y))
    return hit.orderBy(F.desc("z_min"), "seq")


def at_point(objects: DataFrame, x: float, y: float, z: float, kinds: list[str] | None = None) -> DataFrame:
    hit = column_at(objects, x, y).where((F.col("z_min") - EPS <= z) & (F.col("z_max") + EPS >= z))
    return hit.where(F.col("kind").isin(kinds)) if kinds else hit


def probe(objects: DataFrame, probes: DataFrame, with_z: bool = True) -> DataFrame:
    """``(probe_id, object_id)`` for many probes ``(probe_id, x, y, z)`` at once."""
    met = in_boxes(probes, objects)
    if with_z:
        met = met.where((F.col("z") >= F.col("z_min") - EPS) & (F.col("z") <= F.col("z_max") + EPS))
    return met.select("probe_id", "object_id", "kind", "seq", "z_min")


def best_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each box of ``a`` the one of ``b`` with the largest shared area, the first entered of equals; null without any."""
    pairs = box_pairs(a, b).withColumn("shared", shared_area()).where("shared > 0")
    best = pairs.groupBy(F.col("a_object_id").alias("object_id")).agg(F.max_by(F.struct("b_object_id", "shared"), F.struct("shared", -F.col("b_seq"))).alias("m"))
    return a.select("object_id").join(best, "object_id", "left").select("object_id", F.col("m.b_object_id").alias("best_id"), F.col("m.shared").alias("shared_m2"))


def iou() -> Column:
    both = shared_area()
    area = lambda t: (F.col(f"{t}_x1") - F.col(f"{t}_x0")) * (F.col(f"{t}_y1") - F.col(f"{t}_y0"))
    return both / (area("a") + area("b") - both)


def ray_pick(objects: DataFrame, rays: DataFrame) -> DataFrame:
    """The object that each ray ``(ray_id, ox, oy, oz, dx, dy, dz)`` meets first, by kind, then by distance (slab test, t in 0..1)."""
    from ..schema import lookup

    kinds = {"unit": 0, "storey": 1, "building": 2, "infrastructure": 3, "parcel": 4, "air_rights": 5}
    # the cells under pieces of a ray, each about a cell long, bound the pairs; the slab test of the whole ray is exact
    pieces = F.greatest(F.lit(1), F.ceil(F.hypot("dx", "dy") / CELL).cast("int"))
    cut = rays.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    at = lambda a, k: F.col(f"o{a}") + F.col(f"d{a}") * ((F.col("piece") + k) / F.col("pieces"))
    # a little wider than the piece, for rounding
    low = lambda a: F.least(at(a, 0), at(a, 1)) - EPS
    high = lambda a: F.greatest(at(a, 0), at(a, 1)) + EPS
    boxes = cut.select(*rays.columns, low("x").alias("x0"), high("x").alias("x1"), low("y").alias("y0"), high("y").alias("y1"), low("z").alias("z_min"), high("z").alias("z_max"))
    pairs = box_pairs(boxes, objects)
    enter, leave = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for a, lo, hi in (("x", "x0", "x1"), ("y", "y0", "y1"), ("z", "z_min", "z_max")):
        o, d = F.col(f"a_o{a}"), F.col(f"a_d{a}")
        t0, t1 = (F.col(f"b_{lo}") - o) / F.nullif(d, F.lit(0.0)), (F.col(f"b_{hi}") - o) / F.nullif(d, F.lit(0.0))
        outside = outside | ((d == 0) & ((o < F.col(f"b_{lo}")) | (o > F.col(f"b_{hi}"))))
        enter = F.greatest(enter, F.coalesce(F.least(t0, t1), F.lit(0.0)))
        leave = F.least(leave, F.coalesce(F.greatest(t0, t1), F.lit(1.0)))
    met = pairs.withColumns({"t": enter, "leave": leave, "out": outside}).where("not out and t <= leave").withColumn("rank", lookup(F.col("b_kind"), kinds, 9))
    return met.groupBy(F.col("a_ray_id").alias("ray_id")).agg(F.min_by(F.struct("b_object_id", "t"), F.struct("rank", "t", "b_seq")).alias("m")).select("ray_id", F.col("m.b_object_id").alias("object_id"), F.col("m.t").alias("t"))
