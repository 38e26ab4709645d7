"""Queries on surveys: the whole ground filter, storeys from facade points, smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import REGISTER_SQL, _lots
from .more_queries import _POINTS, points, surface
from .operators import facade, raster
from .operators.cloud import stored
from .queries import query

# ---- ground


def _filled_sql(name: str, known: str, missing: str) -> str:
    """The rows of ``known`` and those of ``missing`` with the nearest known value; of equals the least row, then column."""
    return f"""{name} AS MATERIALIZED (SELECT row, col, v FROM {known} UNION ALL SELECT h.row, h.col, arg_min(k.v, ((h.row - k.row) ** 2 + (h.col - k.col) ** 2, k.row, k.col)) FROM {missing} h, {known} k GROUP BY 1, 2)"""


def _blur_sql(name: str, source: str) -> str:
    w = raster.gaussian()
    total = w[0] + 2 * sum(w[1:])
    values = ", ".join(f"({d}, {w[abs(d)] / total!r}::DOUBLE)" for d in range(-4, 5))
    step = lambda name, source, along, across: f"""{name} AS MATERIALIZED (SELECT a.{across}, a.{along}, sum(k.w * b.v) AS v FROM {source} a CROSS JOIN (VALUES {values}) k(d, w) CROSS JOIN box JOIN {source} b ON b.{across} = a.{across}
 AND b.{along} = CASE WHEN a.{along} + d < {along}_0 THEN 2 * {along}_0 - 1 - a.{along} - d WHEN a.{along} + d > {along}_n THEN 2 * {along}_n + 1 - a.{along} - d ELSE a.{along} + d END GROUP BY 1, 2)"""  # noqa: E731
    return step(f"{name}_1", source, "col", "row") + ",\n" + step(name, f"{name}_1", "row", "col")


_LATTICE = """, box AS MATERIALIZED (SELECT min(row) AS row_0, max(row) AS row_n, min(col) AS col_0, max(col) AS col_n FROM cells), lat AS MATERIALIZED (SELECT r::INT AS row, c::INT AS col FROM box, LATERAL (SELECT unnest(range(row_0, row_n + 1)) AS r), LATERAL (SELECT unnest(range(col_0, col_n + 1)) AS c)),
seen AS MATERIALIZED (SELECT row, col, lo AS v FROM cells), void AS MATERIALIZED (SELECT * FROM lat ANTI JOIN seen USING (row, col)),
"""
LARGEST = 18


def _ground_sql() -> str:
    out = _POINTS.rstrip() + _LATTICE + _filled_sql("full_", "seen", "void") + ",\no0 AS (SELECT row, col, v, false AS gone FROM full_)"
    for n, r in enumerate(raster.radii(LARGEST)):
        frame = lambda f, across, along, r=r: f"{f}(v) OVER (PARTITION BY {across} ORDER BY {along} RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
        out += f""",
w{n}a AS (SELECT row, col, v AS was, gone, {frame("min", "row", "col")} AS v FROM o{n}), w{n}b AS (SELECT row, col, was, gone, {frame("min", "col", "row")} AS v FROM w{n}a), w{n}c AS (SELECT row, col, was, gone, {frame("max", "row", "col")} AS v FROM w{n}b),
w{n}d AS (SELECT row, col, was, gone, {frame("max", "col", "row")} AS v FROM w{n}c), o{n + 1} AS MATERIALIZED (SELECT row, col, v, gone OR was - v > 0.2::DOUBLE * {r} * 1.0::DOUBLE AS gone FROM w{n}d)"""
    last = f"o{len(raster.radii(LARGEST))}"
    out += f""",
gone_ AS MATERIALIZED (SELECT f.row, f.col, f.v, o.gone OR s.v IS NULL AS gone FROM full_ f JOIN {last} o USING (row, col) LEFT JOIN seen s USING (row, col)), kept AS MATERIALIZED (SELECT row, col, v FROM gone_ WHERE NOT gone), lost AS MATERIALIZED (SELECT row, col FROM gone_ WHERE gone),
"""
    return out + _filled_sql("bare", "kept", "lost") + ",\n" + _blur_sql("dtm", "bare")


def _at_sql(source: str) -> str:
    """Bilinear values of ``source`` at the places, of the nearest cell where a corner is missing."""
    return f"""(SELECT p.x, p.y, CASE WHEN count(g.v) = 4 THEN sum(g.v * (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END)) ELSE any_value(e.v) END AS v
 FROM places p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j) LEFT JOIN {source} g ON g.row = floor(y)::INT + i AND g.col = floor(x)::INT + j LEFT JOIN {source} e ON e.row = round_even(y, 0)::INT AND e.col = round_even(x, 0)::INT GROUP BY 1, 2)"""


_CLASSIFIED = f""", places AS MATERIALIZED (SELECT DISTINCT x, y FROM pts),
steep AS MATERIALIZED (SELECT c.row, c.col, sqrt(gx * gx + gy * gy) AS v FROM dtm c LEFT JOIN dtm l ON l.row = c.row AND l.col = c.col - 1 LEFT JOIN dtm r ON r.row = c.row AND r.col = c.col + 1 LEFT JOIN dtm d ON d.col = c.col AND d.row = c.row - 1 LEFT JOIN dtm u ON u.col = c.col AND u.row = c.row + 1,
 LATERAL (SELECT coalesce((r.v - l.v) / 2, r.v - c.v, c.v - l.v, 0) AS gx, coalesce((u.v - d.v) / 2, u.v - c.v, c.v - d.v, 0) AS gy)),
th AS MATERIALIZED (SELECT p.flag, p.z - t.v AS above, round(abs(p.z - t.v) - (0.3::DOUBLE + 1.25::DOUBLE * coalesce(s.v, 0) * 1.0::DOUBLE), 9) <= 0 AS is_ground FROM pts p JOIN {_at_sql("dtm")} t USING (x, y) JOIN {_at_sql("steep")} s USING (x, y))"""


def classified(spark, sf):
    s = points(spark, sf)
    terrain = raster.ground(s, 0.0, 0.0, 1.0, LARGEST)
    return raster.classified(s, terrain, 0.0, 0.0, 1.0)


@query(_ground_sql() + " SELECT row, col, round_even(v, 6) AS value FROM dtm", False)
def terrain_model(spark, sf):
    return raster.ground(points(spark, sf), 0.0, 0.0, 1.0, LARGEST).withColumn("value", F.bround("value", 6))


@query(_ground_sql() + _CLASSIFIED + " SELECT flag, is_ground, count(*) AS n, round_even(avg(above), 6) AS above FROM th GROUP BY 1, 2", False)
def ground_filter(spark, sf):
    return classified(spark, sf).groupBy("flag", "is_ground").agg(F.count("*").alias("n"), F.bround(F.avg("above"), 6).alias("above"))


@query(_ground_sql() + _CLASSIFIED + " SELECT count(*) AS points, round_even(avg(is_ground::INT), 6) AS ground_share, round_even(avg(above), 6) AS mean_above, round_even(max(above), 6) AS max_above FROM th", False)
def ground_summary(spark, sf):
    return raster.ground_summary(classified(spark, sf))


@query(_POINTS.rstrip() + _LATTICE + _filled_sql("full_", "seen", "void") + ",\n" + _blur_sql("soft", "full_") + " SELECT row, col, round_even(v, 6) AS value FROM soft", False)
def gaussian_smooth(spark, sf):
    return raster.blurred(stored(raster.complete(surface(spark, sf)), "full"), raster.gaussian()).withColumn("value", F.bround("value", 6))


# ---- storeys from facade points: slabs have many points, walls between them few, rooms inside count for none

_FACADE = (
    REGISTER_SQL
    + """, fb AS MATERIALIZED (SELECT p_partkey AS b, 0.0::DOUBLE AS ground, nf * h AS eave, nb, nf, h FROM lots),
pt AS (SELECT b, i * h + ((b * 7 + j * 13) % 10)::DOUBLE / 50 AS z FROM fb, LATERAL (SELECT unnest(range(0, nf + 1)) AS i), range(0, 20) u(j) UNION ALL SELECT b, (i + 0.5::DOUBLE) * h + ((b + j) % 10)::DOUBLE / 10 FROM fb, LATERAL (SELECT unnest(range(0, nf)) AS i), range(0, 4) u(j)),
own AS MATERIALIZED (SELECT *, (hi - lo) / bins AS width FROM (SELECT *, greatest(8, floor(round((hi - lo) / 0.1::DOUBLE, 9)))::INT AS bins FROM (SELECT b, ground + 0.4::DOUBLE AS lo, eave - 0.2::DOUBLE AS hi FROM fb) WHERE hi > lo)),
hn AS MATERIALIZED (SELECT b, least(floor((z - lo) / width), bins - 1)::INT AS bin, count(*) AS n FROM pt JOIN own USING (b) WHERE z BETWEEN lo AND hi GROUP BY 1, 2), en AS (SELECT b FROM hn GROUP BY 1 HAVING sum(n) >= 40),
bn AS (SELECT o.*, coalesce(n, 0) AS n, lo + (o.bin + 0.5::DOUBLE) * width AS centre FROM (SELECT own.*, unnest(range(0, bins))::INT AS bin FROM own JOIN en USING (b)) o LEFT JOIN hn ON hn.b = o.b AND hn.bin = o.bin),
sm AS MATERIALIZED (SELECT *, (coalesce(lag(n) OVER w, n) + n + coalesce(lead(n) OVER w, n)) / 3 AS s FROM bn WINDOW w AS (PARTITION BY b ORDER BY bin)),
dt AS MATERIALIZED (SELECT b, bin, bins, s - CASE WHEN bins <= 104 THEN avg(s) OVER (PARTITION BY b) ELSE sum(s) OVER (PARTITION BY b ORDER BY bin ROWS BETWEEN 52 PRECEDING AND 51 FOLLOWING) / 104 END AS d FROM sm WHERE bins >= 24),
sg AS MATERIALIZED (SELECT b, bin, bins, d - avg(d) OVER (PARTITION BY b) AS v FROM dt), eg AS MATERIALIZED (SELECT b, bins, sum(v * v) AS e FROM sg GROUP BY 1, 2 HAVING sum(v * v) > 1e-9),
ac AS MATERIALIZED (SELECT x.b, y.bin - x.bin AS lag, eg.bins, round(sum(x.v * y.v) / any_value(e), 9) AS a FROM sg x JOIN sg y ON y.b = x.b AND y.bin - x.bin BETWEEN 23 AND 53 JOIN eg ON eg.b = x.b GROUP BY 1, 2, 3),
bt AS (SELECT b, arg_max(lag, (a, -lag)) AS lag, max(a) AS a FROM ac WHERE lag BETWEEN 24 AND least(52, bins - 1) AND least(52, bins - 1) > 24 GROUP BY 1),
pch AS MATERIALIZED (SELECT b, (lag + CASE WHEN abs(bend) > 1e-12 THEN greatest(-1, least(1, 0.5::DOUBLE * (before - after) / bend)) ELSE 0 END) * 0.1::DOUBLE AS pitch, greatest(0, least(1, a)) AS strength
 FROM (SELECT bt.*, p.a AS before, q.a AS after, p.a - 2 * bt.a + q.a AS bend FROM bt LEFT JOIN ac p ON p.b = bt.b AND p.lag = bt.lag - 1 LEFT JOIN ac q ON q.b = bt.b AND q.lag = bt.lag + 1)),
ft AS MATERIALIZED (SELECT *, CASE WHEN h / n BETWEEN 2.4::DOUBLE * 0.8::DOUBLE AND 5.2::DOUBLE * 1.2::DOUBLE THEN h / n ELSE p END AS storey FROM (SELECT *, greatest(1, round_even(h / p, 0)) AS n FROM (SELECT *, CASE WHEN weak THEN 3.0::DOUBLE ELSE pitch END AS p, CASE WHEN weak THEN 0 ELSE strength0 END AS strength
 FROM (SELECT b, ground, eave, nb, eave - ground AS h, pitch, strength AS strength0, coalesce(pitch IS NULL OR pitch <= 0 OR strength < 0.12::DOUBLE OR eave - ground < 2.4::DOUBLE, true) AS weak FROM fb LEFT JOIN pch USING (b))))),
"""
    + """pv AS MATERIALIZED (SELECT b, bin, s - avg(s) OVER (PARTITION BY b) AS v FROM sm),
po AS (SELECT o.*, k FROM (SELECT DISTINCT b, bins, lo, hi, storey FROM sm JOIN ft USING (b) WHERE NOT weak) o, LATERAL (SELECT unnest(range(0, greatest(4, round_even(storey / 0.1::DOUBLE, 0)::INT))) AS k)),
pj AS (SELECT b, k, least(floor(round((k * 0.1::DOUBLE + j * storey) / 0.1::DOUBLE, 9)), bins - 1)::INT AS bin FROM po, LATERAL (SELECT unnest(range(0, ceil(round((hi - lo - k * 0.1::DOUBLE) / storey, 9))::INT)) AS j)),
ph AS MATERIALIZED (SELECT b, arg_max(k, (score, -k)) * 0.1::DOUBLE AS phase FROM (SELECT pj.b, k, round(avg(v), 9) AS score FROM pj JOIN pv USING (b, bin) GROUP BY 1, 2) GROUP BY 1),
lv AS MATERIALIZED (SELECT f.b, i::INT AS i, ground + i * storey AS z, coalesce(phase, 0) AS phase, f.weak, f.storey, f.eave, f.n, f.strength, f.ground FROM ft f LEFT JOIN ph USING (b), LATERAL (SELECT unnest(range(0, n::INT + 1)) AS i)),
pk AS (SELECT lv.b, lv.i, arg_max(centre, (s, -bin)) AS peak FROM lv JOIN sm ON sm.b = lv.b AND NOT weak AND i > 0 AND i < lv.n AND bins > 8 AND abs(round(centre - z - phase, 9)) <= 0.45::DOUBLE GROUP BY 1, 2),
zs AS MATERIALIZED (SELECT lv.*, CASE WHEN i = n AND NOT weak THEN eave ELSE coalesce(peak, z) END AS raw FROM lv LEFT JOIN pk USING (b, i)),
up(b, i, z) AS (SELECT b, 0, raw FROM zs WHERE i = 0 UNION ALL SELECT zs.b, zs.i, CASE WHEN NOT weak AND raw <= up.z + 0.5::DOUBLE THEN up.z + storey ELSE raw END FROM up JOIN zs ON zs.b = up.b AND zs.i = up.i + 1),
ups AS MATERIALIZED (SELECT * FROM up)
"""
)


def towers(spark, sf):
    """Buildings (b, ground, eave, basements, box) and the points around and inside them."""
    lots = _lots(spark, sf)
    k, h, nf = F.col("p_partkey"), F.col("h"), F.col("nf")
    b = lots.select(k.alias("b"), F.lit(0.0).alias("ground"), (nf * h).alias("eave"), F.col("nb").cast("int").alias("basements"), F.col("bx").alias("x0"), F.col("by").alias("y0"), (F.col("bx") + 8).alias("x1"), (F.col("by") + 10).alias("y1"))
    at = lambda df, z, dx: df.select((F.col("bx") + dx).alias("x"), (F.col("by") + 5).alias("y"), z.alias("z"))
    j = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    slabs = lots.withColumn("i", F.explode(F.sequence(F.lit(0), nf.cast("int")))).withColumn("j", j(20))
    walls = lots.withColumn("i", F.explode(F.sequence(F.lit(0), nf.cast("int") - 1))).withColumn("j", j(4))
    i = F.col("i")
    slab, wall = i * h + (k * 7 + F.col("j") * 13) % 10 / 50, (i + 0.5) * h + (k + F.col("j")) % 10 / 10
    return b, at(slabs, slab, 0.0).unionByName(at(walls, wall, 8.0)).unionByName(at(walls, wall, 4.0))


@query(_FACADE + """ SELECT u.b, u.i AS level, round_even(u.z, 6) AS z_min, round_even(v.z, 6) AS z_max, 'estimated' AS source, round_even(least(1, f.strength * 1.4::DOUBLE), 6) AS confidence, CASE WHEN f.weak THEN 'uniform_division' ELSE 'autocorrelation' END AS method, round_even(f.storey, 6) AS pitch_m
 FROM ups u JOIN ups v ON v.b = u.b AND v.i = u.i + 1 JOIN ft f ON f.b = u.b
UNION ALL SELECT b, -1, -3.0, 0.0, 'assumed', 0.3, CASE WHEN weak THEN 'uniform_division' ELSE 'autocorrelation' END, round_even(storey, 6) FROM ft WHERE nb = 1""", False)
def storey_segmentation(spark, sf):
    b, p = towers(spark, sf)
    r = lambda c: F.bround(c, 6).alias(c)
    return facade.segmented(facade.around(b, p), b).select("b", "level", r("z_min"), r("z_max"), "source", r("confidence"), "method", r("pitch_m"))


@query(_FACADE + " SELECT b, round_even(pitch, 6) AS pitch_m, round_even(strength, 6) AS strength FROM pch", False)
def facade_pitch(spark, sf):
    b, p = towers(spark, sf)
    df = facade.signals(facade.around(b, p), b)
    return facade.pitches(df).select("b", F.bround("pitch_m", 6).alias("pitch_m"), F.bround("strength", 6).alias("strength"))


@query(_FACADE + " SELECT b, bin, n, round_even(s, 9) AS s, round_even(v, 6) AS v FROM sm JOIN sg USING (b, bin)", False)
def facade_signal(spark, sf):
    b, p = towers(spark, sf)
    return facade.detrended(facade.signals(facade.around(b, p), b), 104).select("b", "bin", F.col("n").cast("long").alias("n"), F.bround("s", 9).alias("s"), F.bround("v", 6).alias("v"))


@query(_FACADE + " SELECT b, round_even(phase, 6) AS phase_m FROM ph", False)
def comb_phase(spark, sf):
    b, p = towers(spark, sf)
    df = stored(facade.signals(facade.around(b, p), b), "signals")
    fit = facade.fitted(b, facade.pitches(df))
    return facade.phases(df, fit).select("b", F.bround("phase_m", 6).alias("phase_m"))


@query(_FACADE + " SELECT b, count(*) AS n FROM pt JOIN fb USING (b) WHERE z BETWEEN ground + 0.4::DOUBLE AND eave - 0.2::DOUBLE GROUP BY 1", False)
def facade_points(spark, sf):
    b, p = towers(spark, sf)
    return facade.around(b, p).groupBy("b").agg(F.count("*").alias("n"))


@query(REGISTER_SQL + " SELECT p_partkey AS b, l AS level, 2.5::DOUBLE + l * h AS z_min, 2.5::DOUBLE + (l + 1) * h AS z_max, 'floor_plan' AS source, 1.0::DOUBLE AS confidence FROM (SELECT *, unnest(range(-nb, nf))::INT AS l FROM lots)", False)
def storeys_from_plan(spark, sf):
    lots = _lots(spark, sf)
    floors = lots.select(F.col("p_partkey").alias("b"), F.explode(F.sequence((-F.col("nb")).cast("int"), F.col("nf").cast("int") - 1)).alias("level"), "h").select("b", "level", (F.col("level") * F.col("h")).alias("z_bottom"), ((F.col("level") + 1) * F.col("h")).alias("z_top"))
    return facade.from_plan(floors, lots.select(F.col("p_partkey").alias("b"), F.lit(2.5).alias("ground")))
