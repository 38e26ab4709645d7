"""Work on tiles against the same on whole arrays: rasters over several tiles, at negative places, with holes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volreg.operators import raster, tiles
from volreg.operators.tiles import TILE, Box

ROW, COL = -300, -20
HEIGHT, WIDTH = 310, 190


@pytest.fixture(scope="module")
def grid():
    r = np.random.default_rng(3)
    a = r.integers(0, 400, (HEIGHT, WIDTH)) / 8
    a[r.random(a.shape) < 0.02] = np.nan
    a[100:240, 20:160] = np.nan  # nothing within REACH of its middle
    return a


@pytest.fixture(scope="module")
def cells(spark, grid):
    row, col = np.nonzero(~np.isnan(grid))
    return spark.createDataFrame(__import__("pandas").DataFrame({"row": (row + ROW).astype("int32"), "col": (col + COL).astype("int32"), "value": grid[row, col]})).repartition(5)


def array(df):
    out = np.full((HEIGHT, WIDTH), np.nan)
    p = df.toPandas()
    assert not p.duplicated(["row", "col"]).any()
    out[p["row"] - ROW, p["col"] - COL] = p["value"]
    return out


def slow_moving(a, radius, f):
    for axis in (1, 0):
        out = np.full(a.shape, np.nan)
        for d in range(-radius, radius + 1):
            out = f(out, shifted(a, d, axis))
        a = np.where(np.isnan(a), np.nan, out)
    return a


def shifted(a, d, axis):
    out, n = np.full(a.shape, np.nan), a.shape[axis]
    to, source = slice(max(0, -d), min(n, n - d)), slice(max(0, d), min(n, n + d))
    if axis:
        out[:, to] = a[:, source]
    else:
        out[to] = a[source]
    return out


def slow_fill(a):
    row, col = np.nonzero(~np.isnan(a))
    out = a.copy()
    for r, c in zip(*np.nonzero(np.isnan(a)), strict=True):
        d = (row - r) ** 2 + (col - c) ** 2
        out[r, c] = a[row, col][np.flatnonzero(d == d.min())[0]]  # cells are in order of row, then column
    return out


@pytest.mark.parametrize("radius", [1, 5, 70])
def test_opening_crosses_tiles(cells, grid, radius):
    want = slow_moving(slow_moving(grid, radius, np.fmin), radius, np.fmax)
    np.testing.assert_array_equal(array(raster.opened(cells, radius)), want)


def test_fill_and_blur_and_slope(cells, grid):
    full = slow_fill(grid)
    got = raster.complete(cells)
    np.testing.assert_array_equal(array(got), full)
    weights = raster.gaussian()
    wide = np.pad(full, 4, "symmetric")
    w = np.array([*weights[:0:-1], *weights]) / (weights[0] + 2 * sum(weights[1:]))
    rows = sum(w[d] * wide[:, d : d + WIDTH] for d in range(9))
    np.testing.assert_allclose(array(raster.blurred(got, weights)), sum(w[d] * rows[d : d + HEIGHT] for d in range(9)), atol=1e-9)
    gy, gx = np.gradient(full, 0.5)
    np.testing.assert_allclose(array(raster.slope(got, 0.5)), np.hypot(gx, gy), atol=1e-9)


def test_ground_over_tiles_as_on_one_array(spark, cells, grid):
    """All rounds on whole arrays; 60 needs several exchanges of borders."""
    largest = 60
    points = cells.select((F.col("col") * 2.0).alias("x"), (F.col("row") * 2.0).alias("y"), F.col("value").alias("z"))
    surface = slow_fill(grid)
    now, gone = surface, np.isnan(grid)
    for r in raster.radii(largest):
        was, now = now, tiles.opened(now, r)
        gone = gone | (was - now > 0.2 * r * 2.0)
    want = slow_fill(np.where(gone, np.nan, surface))
    got = raster.ground(points, 0.0, 0.0, 2.0, largest, smooth=False)
    np.testing.assert_array_equal(array(got), want)


def test_small_and_empty_rasters(spark):
    one = spark.createDataFrame([(5, -7, 2.0)], "row int, col int, value double")
    for f in (lambda r: raster.opened(r, 3), raster.complete, lambda r: raster.blurred(r, raster.gaussian())):
        assert [(x.row, x.col, round(x.value, 9)) for x in f(one).collect()] == [(5, -7, 2.0)]
        assert f(one.where("false")).collect() == []
    assert raster.ground(spark.createDataFrame([], "x double, y double, z double"), 0.0, 0.0, 1.0, 6).collect() == []
    assert Box.of(one.where("false")) is None


def test_one_shuffle_for_each_exchange(cells):
    plan = raster.opened(cells, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(tr") <= 2 and "Window" not in plan
    assert TILE == 256


def test_samples_at_borders(spark):
    flat = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3) if (r, c) != (1, 1)], "row int, col int, value double")
    spots = [("in", 0.5, 0.0), ("hole", 0.5, 0.5), ("edge", 2.0, 2.0), ("low", -0.4, 0.2), ("high", 2.4, 1.9), ("far", 9.0, 9.0)]
    p = spark.createDataFrame(spots, "pid string, x double, y double").withColumn("z", F.lit(1.0))
    got = {r.pid: r.terrain for r in raster.classified(p, flat, 0.0, 0.0, 1.0).collect()}
    assert got == {"in": 0.0, "hole": 0.0, "edge": 22.0, "low": 0.0, "high": 22.0, "far": None}
    exact = {r.pid: r.value for r in raster.sample(flat, p.select("pid", "x", "y"), 0.0, 0.0, 1.0).collect()}
    assert exact == dict.fromkeys(exact)  # each lacks a corner
