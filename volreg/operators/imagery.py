"""Pixels and evidence: what looks built, masks and their regions, and whether two extractions agree.

Images are rows (row, col, r, g, b), full rectangles; masks are (row, col, value) with 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .cloud import connected, numbered
from .raster import blurred


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def built_probability(pixels: DataFrame, reach: int = 3) -> DataFrame:
    """``(row, col, value)``: how likely a pixel is a smooth, lit surface without plants: three doubts, multiplied."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    total = F.greatest(r + g + b, F.lit(1e-6))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    plants = clip(((2 * g - r - b) / total - 0.015) / 0.14)
    shadow = clip((78.0 - total / 3.0) / 55.0) * clip(1.0 - (high - low) / F.greatest(high, F.lit(1e-6)) * 2.0)
    p = stored(pixels.select("row", "col", plants.alias("plants"), shadow.alias("shadow"), (total / 3.0).alias("light")), "pixels")
    even = [1.0] * (reach + 1)
    mean = blurred(p.select("row", "col", F.col("light").alias("value")), even).withColumnRenamed("value", "mean")
    square = blurred(p.select("row", "col", (F.col("light") * F.col("light")).alias("value")), even).withColumnRenamed("value", "square")
    rough = clip(F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))) / 30.0)
    out = p.join(mean, ["row", "col"]).join(square, ["row", "col"])
    return out.select("row", "col", clip((1 - F.col("plants")) * (1 - F.col("shadow")) * (1 - 0.6 * rough)).alias("value"))


def raised(probability: DataFrame, heights: DataFrame, least: float = 2.5) -> DataFrame:
    """The probability times a soft gate on ``heights`` (row, col, value) above the ground; no height counts as 0."""
    h = heights.select("row", "col", F.col("value").alias("h"))
    gate = 1 / (1 + F.exp(-(F.coalesce("h", F.lit(0.0)) - least) / 0.5))
    return probability.join(h, ["row", "col"], "left").select("row", "col", (F.col("value") * gate).alias("value"))


def _window(mask: DataFrame, radius: int, grow: bool) -> DataFrame:
    for along, across in (("col", "row"), ("row", "col")):
        w = Window.partitionBy(across).orderBy(along).rangeBetween(-radius, radius)
        inside = F.max("value").over(w) if grow else F.when(F.count("*").over(w) == 2 * radius + 1, F.min("value").over(w)).otherwise(0)
        mask = mask.withColumn("value", inside)
    return mask


def opened(mask: DataFrame, radius: int) -> DataFrame:
    """Erosion, then dilation by a square; what lies beyond the border counts as 0."""
    return _window(_window(mask, radius, False), radius, True)


def closed(mask: DataFrame, radius: int) -> DataFrame:
    return _window(_window(mask, radius, True), radius, False)


def regions(cells: DataFrame) -> DataFrame:
    """``cells`` (row, col) with ``label``: the same for cells that sides connect, the smallest number of a cell."""
    cells = stored(cells.select("row", "col", (F.col("row").cast("long") * (1 << 31) + F.col("col")).alias("pid")), "cells")
    beside = cells.select("pid", F.explode(F.array(*(F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in ((0, 1), (1, 0))))).alias("n")).select("pid", "n.row", "n.col")
    links = beside.join(cells.select("row", "col", F.col("pid").alias("other")), ["row", "col"]).select("pid", "other")
    return cells.join(connected(cells.select("pid"), links), "pid").select("row", "col", "label")


def without_holes(mask: DataFrame) -> DataFrame:
    """The mask with every region of 0 that does not reach the border set to 1."""
    mask = stored(mask.select("row", "col", "value"), "mask")
    box = mask.agg(*(f(c).alias(f"{c}_{n}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))))
    empty = stored(regions(mask.where("value = 0")), "empty")
    at_border = empty.crossJoin(F.broadcast(box)).where("row = row_lo or row = row_hi or col = col_lo or col = col_hi").select("label").distinct()  # one row
    inner = empty.join(at_border, "label", "left_anti").select("row", "col", F.lit(1).alias("in"))
    return mask.join(inner, ["row", "col"], "left").select("row", "col", F.greatest("value", F.coalesce("in", F.lit(0))).alias("value"))


def footprints(probability: DataFrame, resolution: float, x0: float, y0: float, threshold: float = 0.5, open_px: int = 2, close_px: int = 4, least_m2: float = 30.0) -> DataFrame:
    """Regions of a cleaned mask, the largest first: ``(place, label, pixels, area_m2, x0, y0, x1, y1, mean)``."""
    p = stored(probability, "probability")
    mask = p.select("row", "col", (F.col("value") > threshold).cast("int").alias("value"))
    mask = opened(mask, open_px) if open_px else mask
    mask = without_holes(closed(mask, close_px) if close_px else mask)
    found = regions(mask.where("value = 1")).join(p, ["row", "col"])
    least = max(8, int(least_m2 / resolution**2))
    by = found.groupBy("label").agg(F.count("*").alias("pixels"), *(f(c).alias(f"{c}_{n}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))), F.avg("value").alias("mean")).where(F.col("pixels") >= least)
    x, y = lambda c, d: x0 + (F.col(c) + d) * resolution, lambda c, d: y0 + (F.col(c) + d) * resolution
    by = stored(by, "regions")
    by = by.join(numbered(by.select("label", F.col("pixels").alias("n"))).select("label", "cluster"), "label")
    return by.select((F.col("cluster") + 1).alias("place"), "label", "pixels", (F.col("pixels") * resolution**2).alias("area_m2"), x("col_lo", 0).alias("x0"), y("row_lo", 0).alias("y0"), x("col_hi", 1).alias("x1"), y("row_hi", 1).alias("y1"), "mean")


def to_world(pixels: DataFrame, resolution: float, x0: float, y0: float) -> DataFrame:
    """``pixels`` with x and y of their middles."""
    return pixels.withColumns({"x": x0 + (F.col("col") + 0.5) * resolution, "y": y0 + (F.col("row") + 0.5) * resolution})


def agreement(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(a, b, iou)``: in order of ``a`` each takes the best ``b`` that none before it took (the smaller of equals), if the iou reaches the threshold.

    ``pairs`` have (a, b, iou). In a round every ``a`` that is the first of all that still
    want its best ``b`` takes it, which is what taking them one by one gives.
    """
    left, out = stored(pairs.where(F.col("iou") > 0).select("a", "b", "iou"), "pairs"), None
    while True:
        best = left.groupBy("a").agg(F.max_by(F.struct("b", "iou"), F.struct("iou", -F.col("b"))).alias("m")).select("a", "m.*")
        # one whose best is too little wants nothing any more
        best = best.where(F.col("iou") >= threshold)
        wants = left.join(best.select("a"), "a", "left_semi")
        first = wants.groupBy("b").agg(F.min("a").alias("first"))
        now = stored(best.join(first, "b").where("a = first").select("a", "b", "iou"), "taken")
        if now.isEmpty():
            return pairs.select("a", "b", "iou").limit(0) if out is None else out
        out = now if out is None else out.union(now)
        left = stored(wants.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti"), "pairs")


def surface_heights(parcels: DataFrame, points: DataFrame) -> DataFrame:
    """``(id, z_min, z_max)``: parcels from 6 m below the median of terrain heights at their corners, the first counted twice, to just above it.

    ``points`` have (id, value) of each corner of a closed ring; corners without a value do not count.
    """
    z = points.where("value is not null").groupBy("id").agg(F.percentile("value", F.lit(0.5)).alias("z"))
    return parcels.join(z, "id").select("id", (F.col("z") - 6.0).alias("z_min"), (F.col("z") + 0.001).alias("z_max"))


def spread_labels(points: DataFrame, representatives: DataFrame, reach: float) -> DataFrame:
    """``(pid, label)``: of the nearest representative (pid, x, y, z, label) at any distance, the smallest pid of equals.

    ``reach`` is where the search begins; null only where there is no representative at all.
    """
    from .cloud import nearest_of

    label = representatives.select(F.col("pid").alias("other"), "label")
    return points.select("pid").join(nearest_of(points, representatives, reach).join(label, "other").select("pid", "label"), "pid", "left")


def roof_levels(points: DataFrame, by: str = "b") -> DataFrame:
    """``(by, roof_z, parapet_z, parapet)``: the highest bin of 20 cm with many points among the upper two fifths, and the top above it."""
    p = stored(points.select(by, "z"), "roofs")
    top = p.groupBy(by).agg(F.percentile("z", F.lit(0.995)).alias("parapet_z"), F.percentile("z", F.lit(0.6)).alias("cut"))
    band = stored(p.join(top, by).where("z > cut").select(by, "z"), "band")
    span = band.groupBy(by).agg(F.count("*").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.percentile("z", F.lit(0.5)).alias("mid"))
    span = span.withColumn("bins", F.greatest(F.lit(4), F.floor(F.round((F.col("hi") - F.col("lo")) / 0.2, 9)).cast("int"))).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    wide = span.where("n >= 30 and hi - lo >= 0.3")
    bin_ = F.least(F.floor((F.col("z") - F.col("lo")) / F.col("width")), F.col("bins") - 1).cast("int")
    n = band.join(wide, by).groupBy(by, bin_.alias("bin")).agg(F.count("*").alias("k"))
    strong = n.join(n.groupBy(by).agg(F.max("k").alias("most")), by).where("k >= 0.35 * most").groupBy(by).agg(F.max("bin").alias("bin"))
    out = top.join(span, by, "left").join(strong, by, "left")
    roof = F.when(F.coalesce("n", F.lit(0)) < 30, F.col("parapet_z")).when(F.col("hi") - F.col("lo") < 0.3, F.col("mid")).otherwise(F.col("lo") + (F.col("bin") + 0.5) * F.col("width"))
    out = out.withColumn("roof", roof).withColumn("over", F.col("parapet_z") - F.col("roof"))
    judged = (F.coalesce("n", F.lit(0)) >= 30) & (F.col("hi") - F.col("lo") >= 0.3)
    real = judged & (F.col("over") > 0.25) & (F.col("over") < 2.5)
    return out.select(by, F.when(judged & ~real, F.col("parapet_z")).otherwise(F.col("roof")).alias("roof_z"), "parapet_z", real.alias("parapet"))


def extraction_report(matched: DataFrame, truth: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of accuracy beyond counts: of matches that reach the threshold the area's error in percent, the height's bias and root mean square, and the share of right floor counts.

    ``truth`` and ``predicted`` have (id, area, height, floors); ``matched`` has (truth, predicted, iou).
    """
    t = truth.select(F.col("id").alias("truth"), *(F.col(c).alias(f"t_{c}") for c in ("area", "height", "floors")))
    p = predicted.select(F.col("id").alias("predicted"), *(F.col(c).alias(f"p_{c}") for c in ("area", "height", "floors")))
    m = matched.where(F.col("iou") >= threshold).join(t, "truth").join(p, "predicted")
    e, a = F.col("p_height") - F.col("t_height"), F.abs(F.col("p_area") - F.col("t_area")) / F.greatest(F.col("t_area"), F.lit(1e-9))
    return m.agg(F.bround(F.avg(a) * 100, 2).alias("area_error_pct"), F.bround(F.avg(e), 3).alias("height_bias_m"), F.bround(F.sqrt(F.avg(e * e)), 3).alias("height_rmse_m"), F.bround(F.avg(F.when(F.col("p_floors").isNotNull(), (F.col("p_floors") == F.col("t_floors")).cast("int"))), 4).alias("floor_accuracy"))


def missed(matched: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``id`` of what no prediction matches well enough, each once."""
    weak = matched.where(F.col("iou") < threshold).select(F.col("truth").alias("id"))
    none = truth.select("id").join(matched.select(F.col("truth").alias("id")), "id", "left_anti")
    return weak.union(none).distinct()


def roof_form(nz: Column) -> Column:
    """By the tilt of a plane's normal: flat below 8 degrees, pitched below 45, else steep."""
    tilt = F.degrees(F.acos(F.least(F.abs(nz), F.lit(1.0))))
    return F.when(tilt < 8, "flat").when(tilt < 45, "pitched").otherwise("steep")
