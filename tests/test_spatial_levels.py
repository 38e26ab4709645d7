"""Boxes of very different sizes: pairs against plain loops, and rows by number of cells."""

import random

from pyspark.sql import functions as F

from volreg.operators import spatial


def boxes(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        side = 10 ** r.uniform(0, 4)
        x, y = r.uniform(-6000, 6000), r.uniform(-6000, 6000)
        out.append((f"{seed}-{i}", float(round(x)), float(round(y)), float(round(x + side)), float(round(y + side * r.choice([0.1, 1])))))
    return [*out, (f"{seed}-line", -30000.0, 5.0, 30000.0, 5.0), (f"{seed}-point", 64.0, 64.0, 64.0, 64.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "object_id string, x0 double, y0 double, x1 double, y1 double")


def test_pairs_as_loops(spark):
    a, b = boxes(1, 150), boxes(2, 150)
    for grow in (0.0, 40.0):
        want = sorted((p[0], q[0]) for p in a for q in b if p[1] - grow <= q[3] and q[1] <= p[3] + grow and p[2] - grow <= q[4] and q[2] <= p[4] + grow)
        got = sorted((r.a_object_id, r.b_object_id) for r in spatial.box_pairs(frame(spark, a), frame(spark, b), grow).select("a_object_id", "b_object_id").collect())
        assert got == want


def test_points_as_loops(spark):
    b, r = boxes(3, 200), random.Random(4)
    p = [(i, float(r.randrange(-6000, 6000)), float(r.randrange(-6000, 6000))) for i in range(300)] + [(300, 64.0, 64.0), (301, 0.0, 5.0)]
    points = spark.createDataFrame(p, "pid int, x double, y double")
    for grow in (0.0, 3.0):
        want = sorted((i, q[0]) for i, x, y in p for q in b if q[1] - grow <= x <= q[3] + grow and q[2] - grow <= y <= q[4] + grow)
        got = sorted((r.pid, r.object_id) for r in spatial.in_boxes(points, frame(spark, b), grow).select("pid", "object_id").collect())
        assert got == want


def test_a_long_corridor_costs_a_few_rows(spark):
    """A corridor of 30 km meets four cells of its level; small boxes are put into one grid more, each in one to four of its cells."""
    corridor = frame(spark, [("c", 0.0, 0.0, 30000.0, 8.0)])
    homes = spark.range(2000).select(F.concat(F.lit("h"), "id").alias("object_id"), (F.col("id") * 15.0).alias("x0"), F.lit(6.0).alias("y0"), (F.col("id") * 15.0 + 10).alias("x1"), F.lit(16.0).alias("y1"))
    in_cells = spatial._in_cells(corridor.withColumn("_level", spatial.level()), 0.0)
    assert in_cells.count() <= 4
    pairs = spatial.box_pairs(corridor, homes)
    assert pairs.count() == 2000
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    up = spatial._with_levels(homes.withColumn("_l", spatial.level()), corridor, 0.0).select(F.explode(F.filter("_levels", lambda x: x > F.col("_l"))).alias("_level"), "x0", "x1", "y0", "y1")
    assert spatial._in_cells(up, 0.0).count() <= 2000 * 2
