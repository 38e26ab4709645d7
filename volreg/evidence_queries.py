"""Queries on pixels, regions and evidence, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .fixtures import REGISTER_SQL, _lots, register, table
from .more_queries import _CLOUD, footprint_pairs, points, small_cloud, surface
from .operators import cloud, imagery, raster, scoring
from .operators import register as reg
from .operators.cloud import stored
from .queries import _SCANS, query, scans
from .shared import shared_folder
from .sources import pointfiles
from .survey_queries import _LATTICE, _filled_sql

# ---- an image of 20 columns from parts: stripes of plants, shadow and roofs

_PIXELS = "WITH RECURSIVE px AS MATERIALIZED (SELECT (p_partkey // 20)::INT AS row, (p_partkey % 20)::INT AS col, (40 + p_partkey * 37 % 180)::INT AS r, (60 + p_partkey * 11 % 150)::INT AS g, (50 + p_partkey * 23 % 170)::INT AS b FROM part)"


def pixels(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(F.expr("cast(p_partkey div 20 as int)").alias("row"), (k % 20).cast("int").alias("col"), (40 + k * 37 % 180).cast("int").alias("r"), (60 + k * 11 % 150).cast("int").alias("g"), (50 + k * 23 % 170).cast("int").alias("b"))


def _mean_sql(name: str, source: str, value: str) -> str:
    step = lambda name, source, along, across, v: f"""{name} AS MATERIALIZED (SELECT a.row, a.col, avg(b.{v}) AS v FROM {source} a CROSS JOIN range(-3, 4) k(d) CROSS JOIN ext JOIN {source} b ON b.{across} = a.{across}
 AND b.{along} = CASE WHEN a.{along} + d < {along}_0 THEN 2 * {along}_0 - 1 - a.{along} - d WHEN a.{along} + d > {along}_n THEN 2 * {along}_n + 1 - a.{along} - d ELSE a.{along} + d END GROUP BY 1, 2)"""  # noqa: E731
    return step(f"{name}_1", source, "col", "row", value) + ", " + step(name, f"{name}_1", "row", "col", "v")


_BUILT = (
    _PIXELS
    + """, ext AS (SELECT min(row) AS row_0, max(row) AS row_n, min(col) AS col_0, max(col) AS col_n FROM px),
lt AS MATERIALIZED (SELECT row, col, greatest(0, least(1, ((2 * g - r - b) / greatest(r + g + b, 1e-6) - 0.015::DOUBLE) / 0.14::DOUBLE)) AS plants, greatest(0, least(1, (78 - (r + g + b) / 3::DOUBLE) / 55)) * greatest(0, least(1, 1 - (greatest(r, g, b) - least(r, g, b)) / greatest(greatest(r, g, b), 1e-6) * 2)) AS shadow, (r + g + b) / 3::DOUBLE AS light, ((r + g + b) / 3::DOUBLE) ** 2 AS sq FROM px), """
    + _mean_sql("mn", "lt", "light") + ", " + _mean_sql("ms", "lt", "sq")
    + """, pr AS MATERIALIZED (SELECT row, col, greatest(0, least(1, (1 - plants) * (1 - shadow) * (1 - 0.6::DOUBLE * greatest(0, least(1, sqrt(greatest(ms.v - mn.v * mn.v, 0)) / 30))))) AS value FROM lt JOIN mn USING (row, col) JOIN ms USING (row, col))"""
)


@query(_BUILT + " SELECT row, col, round_even(value, 6) AS value FROM pr", False)
def built_probability(spark, sf):
    return imagery.built_probability(pixels(spark, sf)).withColumn("value", F.bround("value", 6))


@query(_BUILT + " SELECT row, col, round_even(value * (1 / (1 + exp(-(CASE WHEN (row + col) % 3 = 0 THEN 0 ELSE col / 4::DOUBLE END - 2.5::DOUBLE) / 0.5::DOUBLE))), 6) AS value FROM pr", False)
def fused_probability(spark, sf):
    p = pixels(spark, sf)
    heights = p.where("(row + col) % 3 <> 0").select("row", "col", (F.col("col") / 4).alias("value"))
    return imagery.raised(imagery.built_probability(p), heights).withColumn("value", F.bround("value", 6))


# ---- masks: rooms of 7 by 7 cells with walls, holes and specks

_MASK = "WITH RECURSIVE mk AS MATERIALIZED (SELECT (p_partkey // 20)::INT AS row, (p_partkey % 20)::INT AS col, CASE WHEN (p_partkey // 20) % 7 < 5 AND p_partkey % 20 % 7 < 5 AND NOT ((p_partkey // 20) % 7 = 2 AND p_partkey % 20 % 7 = 2) OR p_partkey % 53 = 0 THEN 1 ELSE 0 END AS value FROM part)"


def mask(spark, sf):
    k, r, c = F.col("p_partkey"), F.expr("(p_partkey div 20) % 7"), F.col("p_partkey") % 20 % 7
    inside = (r < 5) & (c < 5) & ~((r == 2) & (c == 2)) | (k % 53 == 0)
    return table(spark, sf, "part").select(F.expr("cast(p_partkey div 20 as int)").alias("row"), (k % 20).cast("int").alias("col"), F.when(inside, 1).otherwise(0).alias("value"))


def _morph_sql(name: str, source: str, radius: int, grow: bool) -> str:
    def one(name, source, along, across):
        frame = f"OVER (PARTITION BY {across} ORDER BY {along} RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
        value = f"max(value) {frame}" if grow else f"CASE WHEN count(*) {frame} = {2 * radius + 1} THEN min(value) {frame} ELSE 0 END"
        return f"{name} AS MATERIALIZED (SELECT row, col, ({value})::INT AS value FROM {source})"

    return one(f"{name}_1", source, "col", "row") + ", " + one(name, f"{name}_1", "row", "col")


@query(_MASK + ", " + _morph_sql("er", "mk", 1, False) + ", " + _morph_sql("op", "er", 1, True) + ", " + _morph_sql("di", "op", 2, True) + ", " + _morph_sql("cl", "di", 2, False) + " SELECT row, col, op.value AS opened, cl.value AS closed FROM op JOIN cl USING (row, col)", False)
def mask_morphology(spark, sf):
    o = stored(imagery.opened(mask(spark, sf), 1), "opened")
    return o.withColumnRenamed("value", "opened").join(imagery.closed(o, 2).withColumnRenamed("value", "closed"), ["row", "col"])


def _regions_sql(name: str, cells: str) -> str:
    return f"""{name}_r(row, col, r2, c2) AS (SELECT row, col, row, col FROM {cells} UNION SELECT a.row, a.col, b.row, b.col FROM {name}_r a JOIN {cells} b ON (b.row = a.r2 AND abs(b.col - a.c2) = 1) OR (b.col = a.c2 AND abs(b.row - a.r2) = 1)),
{name} AS MATERIALIZED (SELECT row, col, min(r2::BIGINT * 2147483648 + c2) AS label FROM {name}_r GROUP BY 1, 2)"""


@query(_MASK + ", on_ AS MATERIALIZED (SELECT row, col FROM mk WHERE value = 1), " + _regions_sql("rg", "on_") + " SELECT label, count(*) AS n FROM rg GROUP BY 1", False)
def region_labels(spark, sf):
    return imagery.regions(mask(spark, sf).where("value = 1")).groupBy("label").agg(F.count("*").alias("n"))


_UNHOLED = ", off_ AS MATERIALIZED (SELECT row, col FROM mk WHERE value = 0), " + _regions_sql("bg", "off_") + """, ex AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM mk), edge AS (SELECT DISTINCT label FROM bg, ex WHERE row IN (r0, r1) OR col IN (c0, c1)),
inner_ AS (SELECT row, col FROM bg ANTI JOIN edge USING (label)), full_ AS MATERIALIZED (SELECT row, col, CASE WHEN i.row IS NOT NULL THEN 1 ELSE value END AS value FROM mk LEFT JOIN inner_ i USING (row, col))"""


@query(_MASK + _UNHOLED + " SELECT row, col, value::INT AS value FROM full_", False)
def filled_holes(spark, sf):
    return imagery.without_holes(mask(spark, sf))


@query(_MASK + _UNHOLED + ", on_ AS MATERIALIZED (SELECT row, col FROM full_ WHERE value = 1), " + _regions_sql("rg", "on_") + """, st AS (SELECT label, count(*) AS pixels, min(row) AS a, max(row) AS b, min(col) AS c, max(col) AS d FROM rg GROUP BY 1 HAVING count(*) >= 8)
SELECT row_number() OVER (ORDER BY pixels DESC, label)::INT AS place, label, pixels, pixels * 0.25::DOUBLE AS area_m2, 100 + c * 0.5::DOUBLE AS x0, 50 + a * 0.5::DOUBLE AS y0, 100 + (d + 1) * 0.5::DOUBLE AS x1, 50 + (b + 1) * 0.5::DOUBLE AS y1 FROM st""", False)
def image_footprints(spark, sf):
    p = mask(spark, sf).withColumn("value", F.col("value").cast("double"))
    return imagery.footprints(p, 0.5, 100.0, 50.0, open_px=0, close_px=0, least_m2=2.0).drop("mean")


# ---- agreement and accuracy

_AGREE = REGISTER_SQL + _SCANS + """, pr AS MATERIALIZED (SELECT k AS a, replace(object_id, 'B-', '')::BIGINT AS b, iou FROM ious), ord AS MATERIALIZED (SELECT a, row_number() OVER (ORDER BY a) AS i FROM (SELECT DISTINCT a FROM pr)),
rec(i, a, b, iou, used) AS (SELECT 0, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, []::BIGINT[] UNION ALL SELECT o.i, o.a, CASE WHEN m.iou >= 0.3 THEN m.b END, m.iou, CASE WHEN m.iou >= 0.3 THEN list_append(rec.used, m.b) ELSE rec.used END FROM rec JOIN ord o ON o.i = rec.i + 1 LEFT JOIN LATERAL (SELECT arg_max(b, (iou, -b)) AS b, max(iou) AS iou FROM pr WHERE pr.a = o.a AND NOT list_contains(rec.used, pr.b)) m ON true)
SELECT a, b, iou FROM rec WHERE b IS NOT NULL"""


@query(_AGREE, False)
def extraction_agreement(spark, sf):
    p = footprint_pairs(spark, sf).select(F.replace("predicted", F.lit("scan-"), F.lit("")).cast("long").alias("a"), F.replace("truth", F.lit("B-"), F.lit("")).cast("long").alias("b"), "iou")
    return imagery.agreement(p, 0.3)


_MATCHED = REGISTER_SQL + _SCANS + """, prs AS MATERIALIZED (SELECT object_id AS truth, 'scan-' || k AS predicted, iou FROM ious),
rec(round, truth, predicted, iou, taken) AS (SELECT 0, truth, predicted, iou, row_number() OVER (PARTITION BY truth ORDER BY iou DESC, predicted DESC) = 1 AND row_number() OVER (PARTITION BY predicted ORDER BY iou DESC, truth DESC) = 1 FROM prs
 UNION ALL SELECT round + 1, truth, predicted, iou, row_number() OVER (PARTITION BY truth ORDER BY iou DESC, predicted DESC) = 1 AND row_number() OVER (PARTITION BY predicted ORDER BY iou DESC, truth DESC) = 1
 FROM (SELECT *, max(taken::INT) OVER (PARTITION BY truth) AS t, max(taken::INT) OVER (PARTITION BY predicted) AS p FROM rec) WHERE t = 0 AND p = 0), mt AS MATERIALIZED (SELECT truth, predicted, iou FROM rec WHERE taken)"""


def _truth(spark, sf):
    b = reg.of_kind(register(spark, sf), "building")
    return b.select(F.col("object_id").alias("id"), reg.area().alias("area"), F.col("z_max").alias("height"), F.col("storeys_above_ground").alias("floors"))


@query(_MATCHED + """, e AS (SELECT (k % 7) / 8::DOUBLE AS d, CASE WHEN k % 5 = 0 THEN NULL ELSE (k % 4 > 0)::INT END AS f, 80::DOUBLE AS pa, 80::DOUBLE AS ta FROM (SELECT replace(predicted, 'scan-', '')::BIGINT AS k FROM mt WHERE iou >= 0.5))
SELECT round_even(avg(abs(pa - ta) / ta) * 100, 2) AS area_error_pct, round_even(avg(d), 3) AS height_bias_m, round_even(sqrt(avg(d * d)), 3) AS height_rmse_m, round_even(avg(f), 4) AS floor_accuracy FROM e
 WHERE true""", False)
def accuracy_report(spark, sf):
    m = stored(scoring.greedy_match(footprint_pairs(spark, sf)), "matched")
    truth = stored(_truth(spark, sf), "truth")
    # what a scan says of the building that it matches: somewhat higher, floors wrong or untold
    k = F.replace("predicted", F.lit("scan-"), F.lit("")).cast("long")
    said = m.join(truth, m["truth"] == truth["id"]).select(F.col("predicted").alias("id"), "area", (F.col("height") + k % 7 / 8).alias("height"), F.when(k % 5 == 0, None).when(k % 4 > 0, F.col("floors")).otherwise(F.col("floors") + 1).alias("floors"))
    return imagery.extraction_report(m, truth, said)


@query(_MATCHED + " SELECT object_id AS id FROM objects WHERE kind = 'building' AND object_id NOT IN (SELECT truth FROM mt WHERE iou >= 0.5)", False)
def missed_buildings(spark, sf):
    m = stored(scoring.greedy_match(footprint_pairs(spark, sf)), "matched")
    return imagery.missed(m, _truth(spark, sf))


# ---- heights of parcels, spread labels, scores, roofs, classes

_CORNERS = ", cor AS (SELECT s_suppkey AS id, i, (s_suppkey % 40 + CASE WHEN i IN (1, 2) THEN 5 ELSE 0 END)::DOUBLE AS x, (s_suppkey % 23 + CASE WHEN i IN (2, 3) THEN 4 ELSE 0 END)::DOUBLE AS y FROM supplier, range(0, 5) t(i))"


@query(_CLOUD.replace("WITH RECURSIVE p AS", "WITH RECURSIVE pts AS (SELECT (l_partkey % 97)::DOUBLE / 2 AS x, (l_orderkey % 61)::DOUBLE / 2 AS y, l_quantity / 4 + CASE WHEN l_returnflag = 'R' THEN 8 ELSE 0 END AS z FROM lineitem), cells AS (SELECT round_even(y, 0)::INT AS row, round_even(x, 0)::INT AS col, min(z) AS lo FROM pts GROUP BY 1, 2), p AS") + _LATTICE + _filled_sql("full_", "seen", "void") + _CORNERS + """, z AS (SELECT id, quantile_cont(v, 0.5) AS z FROM cor LEFT JOIN full_ ON row = round_even(y, 0)::INT AND col = round_even(x, 0)::INT GROUP BY 1)
SELECT id, z - 6 AS z_min, z + 0.001::DOUBLE AS z_max FROM z""", False)
def surface_parcels(spark, sf):
    k = F.col("s_suppkey")
    i = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")
    c = table(spark, sf, "supplier").select(k.alias("id"), i).withColumns({"x": (F.col("id") % 40 + F.when(F.col("i").isin(1, 2), 5).otherwise(0)).cast("double"), "y": (F.col("id") % 23 + F.when(F.col("i").isin(2, 3), 4).otherwise(0)).cast("double")})
    at = c.select(F.concat_ws("-", "id", "i").alias("pid"), "id", "x", "y")
    z = raster.sample(raster.complete(surface(spark, sf)), at, 0.0, 0.0, 1.0, "nearest")
    return imagery.surface_heights(table(spark, sf, "supplier").select(k.alias("id")), z.select("id", "value"))


@query(_CLOUD + """, rp AS MATERIALIZED (SELECT pid, x, y, z, pid % 5 AS label FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 1.5), floor(y / 1.5), floor(z / 1.5) ORDER BY pid) AS r FROM p) WHERE r = 1)
SELECT p.pid, (SELECT arg_min(label, ((p.x-r.x)**2 + (p.y-r.y)**2 + (p.z-r.z)**2, r.pid)) FROM rp r WHERE r.x < 12 AND r.y < 5) AS label FROM p""", False)
def spread_labels(spark, sf):
    p = small_cloud(spark, sf)
    return imagery.spread_labels(p, cloud.voxels(p, 1.5).where("x < 12 and y < 5").withColumn("label", F.col("pid") % 5), 2.6)


@query(_CLOUD + " SELECT pid, round_even(1 / (1 + exp(-(z * 8 - 2.5::DOUBLE) / 0.4::DOUBLE)) * greatest(0, least(1, (pid % 9) / 8::DOUBLE - 1.4::DOUBLE * (pid % 4) / 10::DOUBLE)) * CASE WHEN pid % 3 > 0 THEN 0.25 ELSE 1 END, 9) AS score FROM p", False)
def building_score(spark, sf):
    k = F.col("pid")
    return small_cloud(spark, sf).select("pid", F.bround(cloud.building_score(F.col("z") * 8, k % 9 / 8, k % 4 / 10, k % 3 + 1), 9).alias("score"))


_ROOFS = REGISTER_SQL + """, pt AS MATERIALIZED (SELECT p_partkey AS b, nf * h - CASE WHEN j < 60 THEN (j % 4) / 16::DOUBLE WHEN j < 70 AND p_partkey % 3 > 0 THEN -0.75::DOUBLE - (j % 2) / 4::DOUBLE ELSE j / 32::DOUBLE END AS z FROM lots, range(0, 100) t(j)),
tp AS (SELECT b, quantile_cont(z, 0.995) AS pz, quantile_cont(z, 0.6) AS cut FROM pt GROUP BY 1), bd AS MATERIALIZED (SELECT b, z FROM pt JOIN tp USING (b) WHERE z > cut),
sp AS (SELECT *, greatest(4, floor(round((hi - lo) / 0.2::DOUBLE, 9)))::INT AS bins FROM (SELECT b, count(*) AS n, min(z) AS lo, max(z) AS hi, quantile_cont(z, 0.5) AS mid FROM bd GROUP BY 1)), wd AS (SELECT *, (hi - lo) / bins AS width FROM sp),
hn AS (SELECT b, least(floor((z - lo) / width), bins - 1)::INT AS bin, count(*) AS k FROM bd JOIN wd USING (b) WHERE n >= 30 AND hi - lo >= 0.3 GROUP BY 1, 2), sg AS (SELECT b, max(bin) AS bin FROM (SELECT *, max(k) OVER (PARTITION BY b) AS most FROM hn) WHERE k >= 0.35 * most GROUP BY 1),
rf AS (SELECT b, pz, coalesce(n >= 30 AND hi - lo >= 0.3, false) AS judged, CASE WHEN coalesce(n, 0) < 30 THEN pz WHEN hi - lo < 0.3 THEN mid ELSE lo + (bin + 0.5::DOUBLE) * width END AS roof FROM tp LEFT JOIN wd USING (b) LEFT JOIN sg USING (b))
SELECT b, round_even(CASE WHEN judged AND NOT (pz - roof > 0.25 AND pz - roof < 2.5) THEN pz ELSE roof END, 6) AS roof_z, round_even(pz, 6) AS parapet_z, judged AND pz - roof > 0.25 AND pz - roof < 2.5 AS parapet FROM rf"""


@query(_ROOFS, False)
def roof_levels(spark, sf):
    k, j = F.col("p_partkey"), F.col("j")
    down = F.when(j < 60, j % 4 / 16).when((j < 70) & (k % 3 > 0), -0.75 - j % 2 / 4).otherwise(j / 32)
    p = _lots(spark, sf).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(99)))).select(k.alias("b"), (F.col("nf") * F.col("h") - down).alias("z"))
    out = imagery.roof_levels(p)
    return out.withColumns({"roof_z": F.bround("roof_z", 6), "parapet_z": F.bround("parapet_z", 6)})


@query("SELECT p_partkey AS k, CASE WHEN degrees(acos(least(abs((p_partkey % 21 - 10) / 10::DOUBLE), 1))) < 8 THEN 'flat' WHEN degrees(acos(least(abs((p_partkey % 21 - 10) / 10::DOUBLE), 1))) < 45 THEN 'pitched' ELSE 'steep' END AS form FROM part", False)
def roof_form(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), imagery.roof_form((F.col("p_partkey") % 21 - 10) / 10).alias("form"))


@query(_PIXELS + " SELECT row, col, 100 + (col + 0.5::DOUBLE) * 0.5::DOUBLE AS x, 50 + (row + 0.5::DOUBLE) * 0.5::DOUBLE AS y FROM px", False)
def pixel_to_world(spark, sf):
    return imagery.to_world(pixels(spark, sf).select("row", "col"), 0.5, 100.0, 50.0)


@query("SELECT l_linenumber::SMALLINT AS classification, count(*) AS n, sum(round_even(l_quantity / 4, 3)) AS z FROM lineitem GROUP BY 1", False)
def las_round_trip(spark, sf):
    k = F.col("l_orderkey")
    p = table(spark, sf, "lineitem").select((k % 97 / 2).alias("x"), (F.col("l_partkey") % 61 / 2).alias("y"), (F.col("l_quantity") / 4).alias("z"), F.col("l_linenumber").cast("smallint").alias("classification"), F.lit(7).alias("intensity"), F.lit(1).cast("smallint").alias("return_number"))
    at = f"{shared_folder(spark)}/las-{uuid.uuid4().hex}"
    pointfiles.write(p.repartition(4), at)
    back = pointfiles.read(spark, at, schema="z double, classification smallint")
    return back.groupBy("classification").agg(F.count("*").alias("n"), F.bround(F.sum("z"), 6).alias("z"))
