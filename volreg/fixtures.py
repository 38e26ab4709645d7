"""A register made from a star schema by closed formulas, so that SQL can make the same one.

Suppliers give parcels on a lattice, parts give buildings with storeys and air rights,
line items give units, nations give corridors. Lengths are multiples of 1/8 metre, so
areas and volumes are exact. Some storeys, units and areas are shifted on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import OBJECT_COLUMNS
from .shared import spread

CORRIDOR_KINDS = ["metro", "water", "storm", "power", "unknown"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _objects(df: DataFrame, **columns) -> DataFrame:
    """Rows of a register from ``df``; what is not given is null."""
    kinds = dict.fromkeys(OBJECT_COLUMNS, "string") | dict.fromkeys(["confidence", "x0", "y0", "x1", "y1", "z_min", "z_max", "recorded_area_m2", "floor_height_m", "facade_periodicity"], "double") | dict.fromkeys(["level", "storeys_above_ground", "storey_estimate_from_scan"], "int") | {"seq": "bigint"}
    given = {"owner": F.lit(""), "name": F.lit(""), "use": F.lit(""), "level": F.lit(0), "confidence": F.lit(1.0), **columns}
    return df.select(*(given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in OBJECT_COLUMNS))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k % 10) * 60.0, F.expr("s_suppkey div 10") * 60.0
    return _objects(
        table(spark, sf_dir, "supplier"), seq=k, object_id=F.concat(F.lit("P-"), k), kind=F.lit("parcel"), owner=F.col("s_name"), name=F.concat(F.lit("Parcel "), k), stratum=F.lit("G"), provenance=F.lit("existing_record"),
        x0=x, y0=y, x1=x + 50, y1=y + 50, z_min=F.lit(-6.0), z_max=F.lit(0.0))


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their place, floors and storey height, over all tasks: a part becomes some ten objects and hundreds of points. The parcel count is one number."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("ns"))
    lots = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", fine=False).crossJoin(F.broadcast(n))  # one row by construction
    k = F.expr("p_partkey % ns")
    return lots.select(
        "p_partkey", "p_name", "p_size", k.alias("parcel"), F.expr("p_partkey div ns").alias("slot"), (1 + F.col("p_size") % 10).alias("nf"), (F.col("p_size") % 2).alias("nb"), (2.75 + 0.25 * (F.col("p_size") % 4)).alias("h"),
        ((k % 10) * 60.0 + 1).alias("px"), (F.expr("(p_partkey % ns) div 10") * 60.0 + 1).alias("py"),
    ).withColumns({"bx": F.col("px") + (F.col("slot") % 5) * 10.0, "by": F.col("py") + F.expr("slot div 5") * 12.25})


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _objects(
        _lots(spark, sf_dir), seq=F.lit(10**12) + k, object_id=F.concat(F.lit("B-"), k), kind=F.lit("building"), parent_id=F.concat(F.lit("P-"), F.col("parcel")), name=F.col("p_name"), stratum=F.lit("G"),
        provenance=F.when(k % 3 == 0, "extracted").otherwise("approved_plan"), confidence=F.when(k % 3 == 0, (k % 11) / 10).otherwise(1.0),
        x0=F.col("bx"), y0=F.col("by"), x1=F.col("bx") + 8, y1=F.col("by") + 10, z_min=-F.col("nb") * F.col("h"), z_max=F.col("nf") * F.col("h"),
        recorded_area_m2=F.when(k % 13 == 0, 90.0).otherwise(80.0), storeys_above_ground=F.col("nf"), storey_estimate_from_scan=F.col("nf") + (k % 17 == 0).cast("int"), floor_height_m=F.col("h"), facade_periodicity=F.when(k % 2 == 0, 0.5).otherwise(0.1))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _lots(spark, sf_dir).withColumn("level", F.explode(F.sequence(-F.col("nb"), F.col("nf") - 1)))
    up = F.col("level") >= 1
    shift = F.when(up & (F.col("p_partkey") % 23 == 0), 0.5).when(up & (F.col("p_partkey") % 29 == 0), -0.25).otherwise(0.0)
    return levels.withColumns({"z0": F.col("level") * F.col("h") + shift, "z1": (F.col("level") + 1) * F.col("h") + shift})


def storeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, l = F.col("p_partkey"), F.col("level")
    return _objects(
        _levels(spark, sf_dir), seq=F.lit(2 * 10**12) + k * 100 + l, object_id=F.concat(F.lit("B-"), k, F.lit("/S"), l), kind=F.lit("storey"), parent_id=F.concat(F.lit("B-"), k), level=l, stratum=F.when(l < 0, "U").otherwise("B"), provenance=F.lit("derived"),
        confidence=F.lit(0.9), x0=F.col("bx"), y0=F.col("by"), x1=F.col("bx") + 8, y1=F.col("by") + 10, z_min=F.col("z0"), z_max=F.col("z1"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey", (F.col("l_linenumber") - 1).alias("level"), (F.col("l_suppkey") % 4).alias("q")).agg(F.min("l_quantity").alias("least"))
    shift = F.greatest(F.col("least").cast("int") % 8 - 4, F.lit(0)) / 4
    on = items.withColumnRenamed("l_partkey", "p_partkey").join(_levels(spark, sf_dir), ["p_partkey", "level"])
    k, l, q = F.col("p_partkey"), F.col("level"), F.col("q")
    x, y = F.col("bx") + (q % 2) * 4 + 0.25 + shift, F.col("by") + F.expr("q div 2") * 5 + 0.25
    return _objects(
        on, seq=F.lit(3 * 10**12) + (k * 100 + l) * 4 + q, object_id=F.concat(F.lit("B-"), k, F.lit("/S"), l, F.lit("/U"), q), kind=F.lit("unit"), parent_id=F.concat(F.lit("B-"), k, F.lit("/S"), l), level=l, stratum=F.when(l < 0, "U").otherwise("B"), provenance=F.lit("approved_plan"),
        owner=F.concat(F.lit("Owner "), k % 7), use=F.when(q == 0, "office").otherwise("dwelling"), x0=x, y0=y, x1=x + 3.5, y1=y + 4.5, z_min=F.col("z0"), z_max=F.col("z1"))


def air_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, top = F.col("p_partkey"), F.col("nf") * F.col("h")
    return _objects(
        _lots(spark, sf_dir), seq=F.lit(5 * 10**12) + k, object_id=F.concat(F.lit("B-"), k, F.lit("/AIR")), kind=F.lit("air_rights"), parent_id=F.concat(F.lit("P-"), F.col("parcel")), stratum=F.lit("A"), provenance=F.lit("assumed"), confidence=F.lit(0.5),
        x0=F.col("bx"), y0=F.col("by"), x1=F.col("bx") + 8, y1=F.col("by") + 10, z_min=top, z_max=top + 30)


def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, y, z = F.col("n_nationkey"), F.col("n_nationkey") * 24.0, -1.0 - F.col("n_nationkey") % 5
    kind: Column = F.element_at(F.array(*map(F.lit, CORRIDOR_KINDS)), F.col("n_regionkey") + 1)
    return _objects(
        table(spark, sf_dir, "nation"), seq=F.lit(6 * 10**12) + n, object_id=F.concat(F.lit("C-"), n), kind=F.lit("infrastructure"), name=F.col("n_name"), owner=F.lit("city"), stratum=F.lit("I"), provenance=F.lit("surveyed"), corridor_kind=kind,
        x0=F.lit(-10.0), y0=y - 1, x1=F.lit(610.0), y1=y + 1, z_min=z - 2, z_max=z)


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f(spark, sf_dir) for f in (parcels, buildings, storeys, units, air_rights, corridors)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: The same register in SQL: a WITH clause that ends in ``objects``.
REGISTER_SQL = """
WITH RECURSIVE ns AS (SELECT count(*) AS ns FROM supplier),
lots AS (SELECT p_partkey, p_name, p_size, p_partkey % ns AS parcel, p_partkey // ns AS slot, 1 + p_size % 10 AS nf, p_size % 2 AS nb,
  2.75::DOUBLE + 0.25::DOUBLE * (p_size % 4) AS h, ((p_partkey % ns) % 10) * 60.0::DOUBLE + 1 + ((p_partkey // ns) % 5) * 10.0::DOUBLE AS bx,
  ((p_partkey % ns) // 10) * 60.0::DOUBLE + 1 + ((p_partkey // ns) // 5) * 12.25::DOUBLE AS "by" FROM part, ns),
lev AS (SELECT *, l * h + s AS z0, (l + 1) * h + s AS z1 FROM (SELECT *, CASE WHEN l >= 1 AND p_partkey % 23 = 0 THEN 0.5::DOUBLE WHEN l >= 1 AND p_partkey % 29 = 0 THEN -0.25::DOUBLE ELSE 0.0::DOUBLE END AS s
  FROM (SELECT *, unnest(range(-nb, nf))::INT AS l FROM lots))),
items AS (SELECT l_partkey AS p_partkey, l_linenumber - 1 AS l, l_suppkey % 4 AS q, greatest(min(l_quantity)::INT % 8 - 4, 0)::DOUBLE / 4 AS sh FROM lineitem GROUP BY 1, 2, 3),
objects AS (
SELECT s_suppkey::BIGINT AS seq, 'P-' || s_suppkey AS object_id, 'parcel' AS kind, NULL::VARCHAR AS parent_id, 'Parcel ' || s_suppkey AS name, s_name AS owner, '' AS use, 0 AS level, 'G' AS stratum, 'existing_record' AS provenance, 1.0::DOUBLE AS confidence,
  (s_suppkey % 10) * 60.0::DOUBLE AS x0, (s_suppkey // 10) * 60.0::DOUBLE AS y0, (s_suppkey % 10) * 60.0::DOUBLE + 50 AS x1, (s_suppkey // 10) * 60.0::DOUBLE + 50 AS y1, -6.0::DOUBLE AS z_min, 0.0::DOUBLE AS z_max,
  NULL::VARCHAR AS corridor_kind, NULL::DOUBLE AS recorded_area_m2, NULL::INT AS storeys_above_ground, NULL::INT AS storey_estimate_from_scan, NULL::DOUBLE AS floor_height_m, NULL::DOUBLE AS facade_periodicity FROM supplier
UNION ALL SELECT 1000000000000 + p_partkey, 'B-' || p_partkey, 'building', 'P-' || parcel, p_name, '', '', 0, 'G', CASE WHEN p_partkey % 3 = 0 THEN 'extracted' ELSE 'approved_plan' END, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 11)::DOUBLE / 10 ELSE 1.0 END,
  bx, "by", bx + 8, "by" + 10, -nb * h, nf * h, NULL, CASE WHEN p_partkey % 13 = 0 THEN 90.0 ELSE 80.0 END, nf, nf + (p_partkey % 17 = 0)::INT, h, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0.1 END FROM lots
UNION ALL SELECT 2000000000000 + p_partkey * 100 + l, 'B-' || p_partkey || '/S' || l, 'storey', 'B-' || p_partkey, '', '', '', l, CASE WHEN l < 0 THEN 'U' ELSE 'B' END, 'derived', 0.9, bx, "by", bx + 8, "by" + 10, z0, z1, NULL, NULL, NULL, NULL, NULL, NULL FROM lev
UNION ALL SELECT 3000000000000 + (p_partkey * 100 + l) * 4 + q, 'B-' || p_partkey || '/S' || l || '/U' || q, 'unit', 'B-' || p_partkey || '/S' || l, '', 'Owner ' || p_partkey % 7, CASE WHEN q = 0 THEN 'office' ELSE 'dwelling' END, l, CASE WHEN l < 0 THEN 'U' ELSE 'B' END, 'approved_plan', 1.0,
  bx + (q % 2) * 4 + 0.25 + sh, "by" + (q // 2) * 5 + 0.25, bx + (q % 2) * 4 + 0.25 + sh + 3.5, "by" + (q // 2) * 5 + 0.25 + 4.5, z0, z1, NULL, NULL, NULL, NULL, NULL, NULL FROM items JOIN lev USING (p_partkey, l)
UNION ALL SELECT 5000000000000 + p_partkey, 'B-' || p_partkey || '/AIR', 'air_rights', 'P-' || parcel, '', '', '', 0, 'A', 'assumed', 0.5, bx, "by", bx + 8, "by" + 10, nf * h, nf * h + 30, NULL, NULL, NULL, NULL, NULL, NULL FROM lots
UNION ALL SELECT 6000000000000 + n_nationkey, 'C-' || n_nationkey, 'infrastructure', NULL, n_name, 'city', '', 0, 'I', 'surveyed', 1.0, -10.0, n_nationkey * 24.0 - 1, 610.0, n_nationkey * 24.0 + 1, -3.0 - n_nationkey % 5, -1.0 - n_nationkey % 5,
  ['metro', 'water', 'storm', 'power', 'unknown'][n_regionkey + 1], NULL, NULL, NULL, NULL, NULL FROM nation)
"""
