"""Queries written in SQL alone, through the registered functions, and the register as nested documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .fixtures import register, table
from .functions import idcode
from .functions.sql import register_functions
from .operators import hierarchy
from .queries import _ANCESTORS, _GEOHASH, positions, query
from .shared import shared_folder
from .sources import files
from .streaming import mint


@query(_GEOHASH + "SELECT k, code AS geohash, array_to_string(ds[3:6], '') AS unit36, right(compact, 1) AS mark FROM ids", False)
def sql_codes(spark, sf):
    register_functions(spark)
    stratum = F.element_at(F.split(F.lit("G,B,U,A,I"), ","), (F.col("k") % 5 + 1).cast("int"))
    places = positions(spark, sf).withColumn("stratum", stratum)
    return spark.sql(
        """SELECT k, geohash, unit36, volreg_check(concat('27025004', upper(geohash), stratum, volreg_base36(level, 2), unit36)) AS mark
        FROM (SELECT *, volreg_geohash(lat, lon, 10) AS geohash, volreg_base36(unit, 4) AS unit36 FROM {places})""",
        places=places,
    )


@query("""SELECT 'C' || n_nationkey AS corridor, (n_nationkey + 1)::DOUBLE * 2 AS area, 2 * (n_nationkey + 1 + 2)::DOUBLE AS around, j AS part_no, -3.0::DOUBLE - j AS z_min, -2.0::DOUBLE - j + 2 AS z_max FROM (SELECT n_nationkey, unnest(range(0, 3))::INT AS j FROM nation)""", False)
def sql_corridors(spark, sf):
    register_functions(spark)
    n = F.col("n_nationkey")
    # an alignment of three spans with a bend after each
    turns = table(spark, sf, "nation").select(F.concat(F.lit("C"), n).alias("corridor"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"), (n + 1).cast("double").alias("span"))
    turns = turns.select("corridor", "i", (F.ceil(F.col("i") / 2) * F.col("span")).alias("x"), (F.floor(F.col("i") / 2) * F.col("span")).alias("y"), (-2.0 - F.col("i")).alias("invert"), F.lit(2.0).alias("width"), F.lit(2.0).alias("height"))
    return spark.sql(
        """SELECT corridor, round(abs(volreg_ring_area(ring)), 9) AS area, round(volreg_ring_length(ring), 9) AS around, part_no, z_min, z_max
        FROM volreg_corridor_parts(TABLE(SELECT corridor, x, y, invert, width, height, i FROM {turns}) PARTITION BY corridor ORDER BY i)""",
        turns=turns,
    )


def _fold_sql() -> str:
    head = """'{"object_id":"' || x.object_id || '","kind":"' || x.kind || '","level":' || x.level || ',"children":['"""
    out = _ANCESTORS + ", n AS MATERIALIZED (SELECT o.object_id, o.parent_id, o.kind, o.level, coalesce(d, 0) AS depth FROM objects o LEFT JOIN (SELECT object_id, max(distance) AS d FROM up GROUP BY 1) USING (object_id))"
    out += f", f4 AS (SELECT x.object_id, x.parent_id, x.kind, x.level, 1 AS n_objects, {head} || ']}}' AS document FROM n x WHERE depth = 4)"
    for d in range(3, -1, -1):
        out += f", f{d} AS MATERIALIZED (SELECT x.object_id, x.parent_id, x.kind, x.level, (1 + coalesce(sum(c.n_objects), 0))::BIGINT AS n_objects, {head} || coalesce(string_agg(c.document, ',' ORDER BY c.kind, -c.level, c.object_id), '') || ']}}' AS document FROM n x LEFT JOIN f{d + 1} c ON c.parent_id = x.object_id WHERE x.depth = {d} GROUP BY x.object_id, x.parent_id, x.kind, x.level)"
    return out + " SELECT object_id, n_objects, document FROM f0"


@query(_fold_sql())
def register_tree(spark, sf):
    return hierarchy.nested(register(spark, sf))


@query("SELECT kind, count(*) AS n, count(*) AS n_in_head, round_even(sum((x1 - x0) * (y1 - y0) * (z_max - z_min)), 3) AS volume, 'Block 7' AS name, '27/025/004' AS jurisdiction, 18.5::DOUBLE AS lat, (SELECT count(*) FROM objects) AS objects, (SELECT max(z_max) FROM objects) AS top FROM objects GROUP BY 1")
def register_document(spark, sf):
    path = f"{shared_folder(spark)}/register-{uuid.uuid4().hex}"
    files.save_document(register(spark, sf), path, "Block 7", {"state": "27", "district": "025", "tehsil": "004"}, {"lat": 18.5, "lon": 73.75, "height": 560.0})
    objects, head = files.load_document(spark, path)
    volume = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("z_max") - F.col("z_min"))
    by_kind = objects.groupBy("kind").agg(F.count("*").alias("n"), F.bround(F.sum(volume), 3).alias("volume"))
    stats, place = head["stats"], head["jurisdiction"]
    counted = spark.createDataFrame(list(stats["by_kind"].items()), "kind string, n_in_head long")
    return by_kind.join(counted, "kind", "left").select("kind", "n", "n_in_head", "volume", F.lit(head["name"]).alias("name"), F.lit("/".join(place.values())).alias("jurisdiction"), F.lit(head["origin"]["lat"]).alias("lat"), F.lit(stats["objects"]).cast("long").alias("objects"), F.lit(stats["extent"]["z_max"]).alias("top"))


# every fourth position was numbered before the stream began; of the others some bring a code that is refused. Which numbers a cell gives does not depend on the order of arrival
_ARRIVED = """, shared AS MATERIALIZED (SELECT o.k, h.code, o.unit FROM (SELECT *, min(k) OVER (PARTITION BY k // 256) AS first FROM p) o JOIN h ON h.k = o.first),
v AS MATERIALIZED (SELECT k, code, k % 5 AS s, unit % 3 AS p, CASE WHEN k % 4 = 0 THEN 'old' WHEN k % 7 = 1 THEN 'invalid' WHEN k % 7 = 2 THEN 'foreign' ELSE 'minted' END AS verdict FROM shared),
r AS MATERIALIZED (SELECT code, s, verdict, CASE WHEN verdict = 'old' THEN row_number() OVER (PARTITION BY code, s, verdict ORDER BY k) - 1 ELSE p END::INT AS p, row_number() OVER (PARTITION BY code, s ORDER BY verdict = 'minted', k) AS i FROM v WHERE verdict IN ('old', 'minted')),
m(code, s, verdict, i, taken, u) AS (SELECT code, s, verdict, i, [p], p FROM r WHERE i = 1 UNION ALL
 SELECT code, s, verdict, i, list_append(taken, n), n FROM (SELECT r.*, m.taken, list_min(list_filter(range(r.p, r.p + len(m.taken) + 1), lambda x: NOT list_contains(m.taken, x)))::INT AS n FROM m JOIN r ON r.code = m.code AND r.s = m.s AND r.i = m.i + 1))
SELECT code AS geohash, ['G', 'B', 'U', 'A', 'I'][s + 1] AS stratum, verdict, count(*) AS n, string_agg(u::VARCHAR, ',' ORDER BY u) AS units FROM m WHERE verdict = 'minted' GROUP BY 1, 2, 3
UNION ALL SELECT '', ['G', 'B', 'U', 'A', 'I'][s + 1], verdict, count(*), '' FROM v WHERE verdict IN ('invalid', 'foreign') GROUP BY 1, 2, 3"""


def _shared_positions(spark, sf):
    """Orders of one range of 256 keys stand where the first of them does."""
    first = F.min("k").over(Window.partitionBy(F.expr("k div 256")))
    return positions(spark, sf).withColumn("first", first).withColumns({"lat": 18.5 + (F.col("first") % 997) / 65536, "lon": 73.75 + (F.col("first") % 1009) / 32768}).drop("first")


@query(_GEOHASH + _ARRIVED, False)
def minted_stream(spark, sf):
    lit, k = F.lit, F.col("k")
    code = lambda district, unit: idcode.compact(lit("27"), lit(district), lit("4"), F.col("geohash"), F.col("stratum"), lit(1), unit)
    placed = lambda df: df.withColumns({"geohash": idcode.geohash_encode(F.col("lat"), F.col("lon")), "stratum": F.element_at(F.split(lit("G,B,U,A,I"), ","), (k % 5 + 1).cast("int")), "object_id": k.cast("string")})
    old = idcode.mint_units(placed(_shared_positions(spark, sf)).where("k % 4 = 0").drop("unit"), ["geohash", "stratum"], ["k"])
    register = old.select("object_id", code("25", F.col("unit")).alias("code"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _shared_positions(spark, sf).where("k % 4 <> 0").write.parquet(f"{folder}/in")
    arriving = placed(spark.readStream.schema(_shared_positions(spark, sf).schema).parquet(f"{folder}/in"))
    spoilt = F.concat(F.substring(code("25", lit(0)), 1, 25), lit("-"))
    arriving = arriving.select("object_id", "lat", "lon", "stratum", lit(1).alias("level"), (F.col("unit") % 3).alias("preferred"), F.when(k % 7 == 1, spoilt).when(k % 7 == 2, code("99", lit(0))).alias("code"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, mint.STORE)
    try:
        out = mint.mint_stream(arriving, "27", "25", "4", register)
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    got = spark.read.schema(out.schema).parquet(f"{folder}/out")
    minted = F.col("verdict") == "minted"
    units = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(minted, F.col("unit")))), lambda u: u.cast("string")), ",")
    return got.groupBy(F.when(minted, F.col("geohash")).otherwise("").alias("geohash"), "stratum", "verdict").agg(F.count("*").alias("n"), units.alias("units"))
