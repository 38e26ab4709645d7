"""Reading points, plans and registers; writing registers as documents. All through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geodesy import Local, let
from ..operators.register import area

POINTS = "x double, y double, z double, classification smallint, intensity int, return_number smallint"


def read_points(spark: SparkSession, path: str, separator: str = ",", header: bool = True) -> DataFrame:
    """Points from delimited text with a fixed schema; columns that a file lacks are null."""
    return with_pid(spark.read.csv(path, schema=POINTS, sep=separator, header=header, enforceSchema=True))


def with_pid(points: DataFrame) -> DataFrame:
    """``points`` with ``pid``, which depends on a point's values alone and not on how files are split; equal points are counted."""
    values = F.xxhash64(*points.columns)
    copy = F.row_number().over(Window.partitionBy("_h").orderBy(*points.columns))
    return points.withColumn("_h", values).withColumn("_copy", copy).withColumn("pid", F.when(F.col("_copy") == 1, F.col("_h")).otherwise(F.xxhash64("_h", "_copy"))).drop("_h", "_copy")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Points from text with blanks between numbers: x y z and maybe a class."""
    parts = F.split(F.trim("value"), "\\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    p = spark.read.text(path).select(number(0).alias("x"), number(1).alias("y"), number(2).alias("z"), number(3).cast("smallint").alias("classification"), F.lit(None).cast("int").alias("intensity"), F.lit(None).cast("smallint").alias("return_number"))
    return with_pid(p.where("x is not null and y is not null and z is not null"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of GeoJSON files: (id, owner, land_use, ring) with the outer ring's positions."""
    schema = "type string, features array<struct<properties:struct<parcel_id:string,owner:string,land_use:string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    f = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("features").alias("f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.where("f.geometry.type = 'Polygon'").select(F.col("f.properties.parcel_id").alias("id"), "f.properties.owner", "f.properties.land_use", ring.alias("ring"))


def save(objects: DataFrame, path: str) -> None:
    objects.write.mode("errorifexists").partitionBy("kind").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_document(objects: DataFrame, path: str, name: str, jurisdiction: dict[str, str], origin: dict[str, float]) -> None:
    """A register as a folder: ``objects`` in parts by kind, and ``register``, one JSON line with its name, jurisdiction, origin and statistics.

    The statistics are aggregates of what was written; the line comes last, so a folder
    without it is no register.
    """
    spark = objects.sparkSession
    objects.write.mode("errorifexists").partitionBy("kind").parquet(f"{path}/objects")
    by_kind = spark.read.parquet(f"{path}/objects").groupBy("kind").agg(F.count("*").alias("n"), *(f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("z_min", F.min), ("x1", F.max), ("y1", F.max), ("z_max", F.max))))
    # a row for each kind
    total = by_kind.agg(F.sum("n").alias("objects"), F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("by_kind"), F.struct(*(f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("z_min", F.min), ("x1", F.max), ("y1", F.max), ("z_max", F.max)))).alias("extent"))
    known = lambda d: F.struct(*(F.lit(v).alias(k) for k, v in d.items()))
    head = total.select(F.lit(name).alias("name"), known(jurisdiction).alias("jurisdiction"), known(origin).alias("origin"), F.struct("objects", "by_kind", "extent").alias("stats"))
    head.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("errorifexists").text(f"{path}/register")


def load_document(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The objects of a saved register and its head. Doubled ids or codes, and a number of objects that is not the head's, are errors before anything is returned.

    Ids and codes are counted by one aggregation, whose few offenders alone reach the driver.
    """
    import json

    head = json.loads(spark.read.text(f"{path}/register").first()[0])
    objects = spark.read.parquet(f"{path}/objects")
    named = [F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in ("object_id", "code") if c in objects.columns]
    counts = objects.select(F.explode(F.array(*named)).alias("v")).where("v.value is not null").groupBy("v").count()
    doubled = [f"{r.v.what} {r.v.value}" for r in counts.where("count > 1").orderBy("v").limit(5).collect()]
    if doubled:
        raise ValueError(f"in the register more than once: {', '.join(doubled)}")
    if (n := objects.count()) != head["stats"]["objects"]:
        raise ValueError(f"the register has {n} objects, its head says {head['stats']['objects']}")
    return objects, head


def box_ring(origin: Local | None = None) -> Column:
    """The closed ring of a box, in degrees at the ground if an origin is given."""
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    if origin is None:
        return F.array(*(F.array(F.col(x), F.col(y)) for x, y in corners))
    place = lambda x, y: origin.inverse(F.col(x), F.col(y), F.lit(0.0))
    return F.array(*(F.array(F.round(p[1], 8), F.round(p[0], 8)) for p in (place(x, y) for x, y in corners)))


def geojson(objects: DataFrame, origin: Local) -> DataFrame:
    """``(object_id, feature)``: a GeoJSON feature for each object."""
    properties = F.struct("object_id", "kind", "name", "owner", "level", "stratum", "z_min", "z_max", area().alias("area_m2"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(box_ring(origin)).alias("coordinates"))
    return objects.select("object_id", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))


# Element names by kind.
CITY_TAGS = {"parcel": "LandUse", "building": "Building", "storey": "BuildingPart", "unit": "Room", "infrastructure": "Tunnel", "air_rights": "GenericCityObject"}


def citygml(objects: DataFrame, origin: Local) -> DataFrame:
    """``(object_id, element)``: a city model element with its footprint at z_min and its height."""
    from ..schema import lookup

    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    tag = lookup(F.col("kind"), CITY_TAGS)
    positions = F.array_join(F.transform(box_ring(origin), lambda p: F.format_string("%.8f %.8f %.3f", p[0], p[1], F.col("z_min"))), " ")
    text = F.concat(F.lit("<"), tag, F.lit(' id="'), escape(F.col("object_id")), F.lit('"><name>'), escape(F.col("name")), F.lit("</name><posList>"), positions, F.lit("</posList><height>"), F.format_string("%.3f", F.col("z_max") - F.col("z_min")), F.lit("</height></"), tag, F.lit(">"))
    return objects.select("object_id", text.alias("element"))


def _plans(parts: DataFrame, origin: Local) -> DataFrame:
    """``(object_id, polygons, z_min, z_max)``: each part's rings, closed, as positions of longitude and latitude to eight places; parts in order."""

    def position(p: Column) -> Column:
        return origin.ground(p["x"], p["y"], lambda lat, lon: F.array(F.round(lon, 8), F.round(lat, 8)))

    # a ring's first position is copied, not computed again
    closed = lambda ring: let(F.transform(ring, position), lambda r: F.concat(r, F.slice(r, 1, 1)))
    each = parts.select("object_id", F.struct("part_no", F.transform("rings", closed).alias("rings")).alias("p"), "z_min", "z_max")
    # the few parts of an object
    return each.groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["rings"]).alias("polygons"), F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"))


def plan_geojson(parts: DataFrame, objects: DataFrame, origin: Local) -> DataFrame:
    """``(object_id, feature)``: a GeoJSON feature of each object's real plan, with holes, and a MultiPolygon for several parts.

    ``objects`` has object_id, kind and whatever else is to be a property.
    """
    properties = [c for c in objects.columns if c not in ("object_id", "rings", "z_min", "z_max")]
    df = _plans(parts, origin).join(objects.select("object_id", *properties), "object_id")
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get("polygons", F.lit(0)).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygons").alias("coordinates")))
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("object_id", *properties, "z_min", "z_max")), F.lit(',"geometry":'), F.when(F.size("polygons") == 1, one).otherwise(many), F.lit("}"))
    return df.select("object_id", text.alias("feature"))


def plan_citygml(parts: DataFrame, objects: DataFrame, origin: Local) -> DataFrame:
    """``(object_id, element)``: a city model element with a polygon for each part, its outer ring and its holes at the object's z_min, and the height."""
    from ..schema import lookup

    df = _plans(parts, origin).join(objects.select("object_id", "kind"), "object_id")
    tag = lookup(F.col("kind"), CITY_TAGS)
    escaped = F.replace(F.replace(F.replace("object_id", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    positions = lambda ring: F.array_join(F.transform(ring, lambda p: F.format_string("%.8f %.8f %.3f", p[0], p[1], F.col("z_min"))), " ")
    named = lambda ring, i: F.concat(F.when(i == 0, "<exterior>").otherwise("<interior>"), positions(ring), F.when(i == 0, "</exterior>").otherwise("</interior>"))
    polygon = lambda rings: F.concat(F.lit("<polygon>"), F.array_join(F.transform(rings, named), ""), F.lit("</polygon>"))
    text = F.concat(F.lit("<"), tag, F.lit(' id="'), escaped, F.lit('">'), F.array_join(F.transform("polygons", polygon), ""), F.lit("<height>"), F.format_string("%.3f", F.col("z_max") - F.col("z_min")), F.lit("</height></"), tag, F.lit(">"))
    return df.select("object_id", text.alias("element"))
