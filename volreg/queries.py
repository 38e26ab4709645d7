"""Queries over the register fixture, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import REGISTER_SQL, register, table
from .functions import idcode
from .operators import hierarchy, rules, spatial
from .operators import register as reg
from .operators.cloud import stored
from .schema import AUTHORITATIVE

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, on_register: bool = True):
    """Register a query under its function's name; ``sql`` follows the register's WITH clause if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (REGISTER_SQL + sql) if on_register else sql
        return f

    return add


# ---- filters, lookups, totals


@query("""SELECT CASE grouping(kind, provenance) WHEN 1 THEN 'kind' WHEN 2 THEN 'provenance' ELSE 'all' END AS dimension, coalesce(kind, provenance, 'all') AS value, count(*) AS n,
  round_even(sum((x1-x0)*(y1-y0)) FILTER (WHERE kind='unit'), 2) AS unit_area_m2, round_even(sum((x1-x0)*(y1-y0)*(z_max-z_min)) FILTER (WHERE kind='unit'), 2) AS unit_volume_m3,
  least(min(z_min), min(z_max)) AS z_low, greatest(max(z_min), max(z_max)) AS z_high FROM objects GROUP BY GROUPING SETS ((kind), (provenance), ())""")
def register_stats(spark, sf):
    return reg.stats(register(spark, sf))


@query("SELECT object_id, owner, x0, y0, z_min, z_max FROM objects WHERE kind IN ('parcel', 'infrastructure')")
def kind_filter(spark, sf):
    return reg.of_kind(register(spark, sf), "parcel", "infrastructure").select("object_id", "owner", "x0", "y0", "z_min", "z_max")


@query("SELECT seq, object_id, kind, level, parent_id FROM objects WHERE kind IN ('storey', 'unit') AND level = 1 ORDER BY seq LIMIT 5000")
def list_objects_page(spark, sf):
    return reg.list_objects(register(spark, sf), ["storey", "unit"], level=1).select("seq", "object_id", "kind", "level", "parent_id")


@query("""SELECT object_id, kind, stratum, CASE kind WHEN 'parcel' THEN 'G' WHEN 'building' THEN 'G' WHEN 'storey' THEN 'B' WHEN 'unit' THEN 'B' WHEN 'infrastructure' THEN 'I' ELSE 'A' END AS default_stratum,
  provenance IN ('surveyed', 'approved_plan', 'existing_record') AS authoritative, round_even(confidence, 3) AS confidence, round_even((x1-x0)*(y1-y0), 3) AS area_m2, round_even((x1-x0)*(y1-y0)*(z_max-z_min), 3) AS volume_m3,
  round_even(z_max-z_min, 3) AS height_m, round_even((x0+x1)/2, 3) AS cx, round_even((y0+y1)/2, 3) AS cy, round_even((z_min+z_max)/2, 3) AS cz FROM objects""")
def prism_measures(spark, sf):
    return reg.payload(register(spark, sf))


@query("SELECT min(x0) AS x0, min(y0) AS y0, min(z_min) AS z_min, max(x1) AS x1, max(y1) AS y1, max(z_max) AS z_max, count(*) AS n FROM objects")
def extent_bbox(spark, sf):
    return reg.extent(register(spark, sf))


@query("""SELECT object_id, kind, name, owner, rank, n_found FROM (SELECT *, count(*) OVER () AS n_found FROM (SELECT object_id, kind, name, owner, CASE WHEN lower(object_id) = 'b-1' THEN 0 WHEN starts_with(lower(object_id), 'b-1') THEN 1 WHEN contains(lower(name), 'b-1') THEN 2 ELSE 3 END AS rank
  FROM objects WHERE contains(lower(object_id) || ' ' || lower(name) || ' ' || lower(owner) || ' ' || lower(use) || ' ' || lower(kind), 'b-1'))) ORDER BY rank, object_id LIMIT 40""")
def search_ranked(spark, sf):
    return reg.search(register(spark, sf), " B-1 ")


@query("SELECT kind, owner, count(*) AS n, min(object_id) AS first_id FROM objects WHERE owner <> '' GROUP BY ALL")
def owner_holdings(spark, sf):
    return register(spark, sf).where("owner <> ''").groupBy("kind", "owner").agg(F.count("*").alias("n"), F.min("object_id").alias("first_id"))


# ---- hierarchy


@query("SELECT parent_id AS object_id, count(*) AS n_children, arg_min(object_id, seq) AS first_child, arg_max(object_id, seq) AS last_child FROM objects WHERE parent_id IS NOT NULL GROUP BY 1")
def children(spark, sf):
    return hierarchy.children(register(spark, sf))


_ANCESTORS = """, up(object_id, distance, ancestor_id) AS (SELECT o.object_id, 1, p.object_id FROM objects o JOIN objects p ON p.object_id = o.parent_id
  UNION ALL SELECT up.object_id, distance + 1, p.object_id FROM up JOIN objects a ON a.object_id = up.ancestor_id JOIN objects p ON p.object_id = a.parent_id)"""


@query(_ANCESTORS + " SELECT object_id, distance, ancestor_id FROM up")
def ancestors(spark, sf):
    return hierarchy.ancestors(register(spark, sf))


@query(_ANCESTORS + " SELECT ancestor_id AS object_id, count(*) AS n_descendants, count(*) FILTER (WHERE kind = 'unit') AS n_units FROM up JOIN objects USING (object_id) GROUP BY 1")
def descendants(spark, sf):
    return hierarchy.descendants(register(spark, sf))


@query("SELECT object_id, parent_id, kind, level, row_number() OVER (PARTITION BY parent_id, CASE WHEN parent_id IS NULL THEN kind END ORDER BY kind, level * (parent_id IS NOT NULL)::INT DESC, object_id)::INT AS place FROM objects")
def tree_edges(spark, sf):
    return hierarchy.tree(register(spark, sf))


@query(", kept AS MATERIALIZED (SELECT object_id, parent_id FROM objects WHERE object_id NOT LIKE 'P-%7' AND coalesce(parent_id, '') <> 'B-3') SELECT o.object_id, o.parent_id FROM kept o ANTI JOIN kept p ON p.object_id = o.parent_id WHERE o.parent_id IS NOT NULL")
def orphans_anti(spark, sf):
    # parcels that end in 7 are taken out, and building 3's children with them, so that there are orphans
    kept = register(spark, sf).where("object_id not like 'P-%7' and coalesce(parent_id, '') <> 'B-3'")
    return hierarchy.orphans(kept)


@query("SELECT level, max(z_max) + 0.05::DOUBLE AS plane_z, count(*) AS n_storeys FROM objects WHERE kind = 'storey' GROUP BY 1")
def section_planes(spark, sf):
    return hierarchy.section_height(register(spark, sf))


# ---- spatial lookups and joins


@query("SELECT seq, object_id, kind, z_min, z_max FROM objects WHERE x0 <= 4 AND x1 >= 4 AND y0 <= 3 AND y1 >= 3 ORDER BY z_min DESC, seq")
def column_lookup(spark, sf):
    return spatial.column_at(register(spark, sf), 4.0, 3.0).select("seq", "object_id", "kind", "z_min", "z_max")


_PROBES = ", probes AS (SELECT c_custkey AS probe_id, (c_custkey % 600) + 0.5::DOUBLE AS x, (c_custkey % 37) * 3.25::DOUBLE AS y, (c_custkey % 23) - 4.0::DOUBLE AS z FROM customer)"


def probes(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("probe_id"), (k % 600 + 0.5).alias("x"), ((k % 37) * 3.25).alias("y"), (k % 23 - 4.0).alias("z"))


@query(_PROBES + " SELECT probe_id, object_id, kind, seq, o.z_min FROM probes, objects o WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z >= o.z_min - 0.001::DOUBLE AND z <= z_max + 0.001::DOUBLE")
def point_in_volume(spark, sf):
    return spatial.probe(register(spark, sf), probes(spark, sf))


@query(_PROBES + " SELECT probe_id, count(*) AS n, arg_max(object_id, (z_min, -seq)) AS top FROM probes, objects WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1")
def column_probes(spark, sf):
    hit = spatial.probe(register(spark, sf), probes(spark, sf), with_z=False)
    return hit.groupBy("probe_id").agg(F.count("*").alias("n"), F.max_by("object_id", F.struct("z_min", -F.col("seq"))).alias("top"))


@query("""SELECT a.object_id AS a_id, b.object_id AS b_id, least(a.z_max, b.z_max) - greatest(a.z_min, b.z_min) AS z_overlap FROM objects a JOIN objects b ON a.kind = 'storey' AND b.kind = 'infrastructure'
  AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND least(a.z_max, b.z_max) > greatest(a.z_min, b.z_min)""")
def z_overlap_pairs(spark, sf):
    o = register(spark, sf)
    pairs = spatial.box_pairs(reg.of_kind(o, "storey"), reg.of_kind(o, "infrastructure")).withColumn("z_overlap", spatial.overlap("z")).where("z_overlap > 0")
    return pairs.select(F.col("a_object_id").alias("a_id"), F.col("b_object_id").alias("b_id"), "z_overlap")


@query("""SELECT object_id, best_id, shared_m2 FROM (SELECT a.object_id, b.object_id AS best_id, s AS shared_m2, row_number() OVER (PARTITION BY a.object_id ORDER BY s DESC NULLS LAST, b.seq) AS r
  FROM (SELECT * FROM objects WHERE kind = 'infrastructure') a LEFT JOIN (SELECT * FROM objects WHERE kind = 'parcel') b ON least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0),
  LATERAL (SELECT CASE WHEN b.seq IS NOT NULL THEN (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) END AS s)) WHERE r = 1""")
def best_parcel_overlap(spark, sf):
    o = register(spark, sf)
    return spatial.best_overlap(reg.of_kind(o, "infrastructure"), reg.of_kind(o, "parcel"))


_SCANS = """, scans AS (SELECT p_partkey AS k, bx + (p_partkey % 41)::DOUBLE / 8 AS x0, "by" AS y0, bx + (p_partkey % 41)::DOUBLE / 8 + 8 AS x1, "by" + 10 AS y1 FROM lots WHERE p_partkey % 19 <> 0),
ious AS (SELECT s.k, b.object_id, b.seq, i / (160 - i) AS iou FROM scans s JOIN objects b ON b.kind = 'building' AND least(s.x1, b.x1) > greatest(s.x0, b.x0) AND least(s.y1, b.y1) > greatest(s.y0, b.y0),
  LATERAL (SELECT (least(s.x1, b.x1) - greatest(s.x0, b.x0)) * (least(s.y1, b.y1) - greatest(s.y0, b.y0)) AS i))"""


def scans(spark, sf):
    """Footprints as a scan would give them: shifted by up to five metres, some missing."""
    b = reg.of_kind(register(spark, sf), "building").withColumn("k", F.substring("object_id", 3, 20).cast("long")).where("k % 19 <> 0")
    shift = (F.col("k") % 41) / 8
    return b.select(F.concat(F.lit("scan-"), "k").alias("object_id"), F.col("k").alias("seq"), (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1", "z_min", "z_max")


@query(_SCANS + " SELECT 'scan-' || k AS scan_id, best_id, iou FROM (SELECT k, arg_max(object_id, (iou, -seq)) AS best_id, max(iou) AS iou FROM ious GROUP BY k) WHERE iou > 0.35")
def best_plan_iou(spark, sf):
    pairs = spatial.box_pairs(scans(spark, sf), reg.of_kind(register(spark, sf), "building")).withColumn("iou", spatial.iou()).where("iou > 0")
    best = pairs.groupBy(F.col("a_object_id").alias("scan_id")).agg(F.max_by("b_object_id", F.struct("iou", -F.col("b_seq"))).alias("best_id"), F.max("iou").alias("iou"))
    return best.where("iou > 0.35")


@query(""", rays AS (SELECT c_custkey AS ray_id, (c_custkey % 600)::DOUBLE AS ox, -5.0::DOUBLE AS oy, 40.0::DOUBLE AS oz, (c_custkey % 5) - 2.0::DOUBLE AS dx, 70.0::DOUBLE AS dy, -50.0::DOUBLE AS dz FROM customer),
met AS (SELECT ray_id, o.*, CASE kind WHEN 'unit' THEN 0 WHEN 'storey' THEN 1 WHEN 'building' THEN 2 WHEN 'infrastructure' THEN 3 WHEN 'parcel' THEN 4 ELSE 5 END AS rank,
  greatest(0, coalesce(least((x0-ox)/nullif(dx,0), (x1-ox)/nullif(dx,0)), 0), least((y0-oy)/dy, (y1-oy)/dy), least((z_min-oz)/dz, (z_max-oz)/dz)) AS t,
  least(1, coalesce(greatest((x0-ox)/nullif(dx,0), (x1-ox)/nullif(dx,0)), 1), greatest((y0-oy)/dy, (y1-oy)/dy), greatest((z_min-oz)/dz, (z_max-oz)/dz)) AS leave
  FROM rays JOIN objects o ON y0 <= 65 AND NOT (dx = 0 AND (ox < x0 OR ox > x1)))
SELECT ray_id, object_id, t FROM (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY rank, t, seq) AS r FROM met WHERE t <= leave) WHERE r = 1""")
def ray_aabb_pick(spark, sf):
    k = F.col("c_custkey")
    rays = table(spark, sf, "customer").select(k.alias("ray_id"), (k % 600).cast("double").alias("ox"), F.lit(-5.0).alias("oy"), F.lit(40.0).alias("oz"), (k % 5 - 2.0).alias("dx"), F.lit(70.0).alias("dy"), F.lit(-50.0).alias("dz"))
    return spatial.ray_pick(register(spark, sf), rays)


# ---- rules; each finding is (rule, severity, object_a, object_b, measure, context)

_OVERLAP = """SELECT 'VERT_OVERLAP' AS rule, 'error' AS severity, a.object_id AS object_a, b.object_id AS object_b, (dx * dy * dz)::DOUBLE AS measure, dz::DOUBLE AS context
 FROM (SELECT * FROM objects WHERE kind IN ('unit', 'infrastructure')) a JOIN (SELECT * FROM objects WHERE kind IN ('unit', 'infrastructure')) b ON (a.x0 < b.x0 OR (a.x0 = b.x0 AND a.seq < b.seq)) AND a.x1 > b.x0 AND a.y1 > b.y0 AND b.y1 > a.y0 AND a.z_max > b.z_min AND b.z_max > a.z_min,
 LATERAL (SELECT least(a.x1, b.x1) - greatest(a.x0, b.x0) AS dx, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS dy, least(a.z_max, b.z_max) - greatest(a.z_min, b.z_min) AS dz)
 WHERE dx * dy * dz > 0.05 AND coalesce(a.parent_id <> b.object_id, true) AND coalesce(b.parent_id <> a.object_id, true)"""
_PLAN = """SELECT 'PLAN_CONTAINMENT' AS rule, 'error' AS severity, o.object_id AS object_a, p.object_id AS object_b, outside AS measure, a AS context FROM objects o JOIN objects p ON p.object_id = o.parent_id AND o.kind <> 'air_rights',
 LATERAL (SELECT (o.x1-o.x0)*(o.y1-o.y0) AS a, greatest(0, least(o.x1, p.x1 + 0.05::DOUBLE) - greatest(o.x0, p.x0 - 0.05::DOUBLE)) * greatest(0, least(o.y1, p.y1 + 0.05::DOUBLE) - greatest(o.y0, p.y0 - 0.05::DOUBLE)) AS i), LATERAL (SELECT a - i AS outside) WHERE outside > 0.25"""
_VERTICAL = """SELECT 'VERT_CONTAINMENT' AS rule, 'error' AS severity, o.object_id AS object_a, p.object_id AS object_b, greatest(p.z_min - o.z_min, o.z_max - p.z_max) AS measure, least(p.z_min - o.z_min, o.z_max - p.z_max) AS context FROM objects o JOIN objects p ON p.object_id = o.parent_id
 WHERE o.kind <> 'air_rights' AND p.kind <> 'parcel' AND (o.z_min < p.z_min - 0.05::DOUBLE OR o.z_max > p.z_max + 0.05::DOUBLE)"""
_CONTINUITY = """SELECT CASE WHEN gap > 0 THEN 'STOREY_GAP' ELSE 'STOREY_OVERLAP' END AS rule, CASE WHEN gap > 0 THEN 'warning' ELSE 'error' END AS severity, object_id AS object_a, upper AS object_b, abs(gap) AS measure, NULL::DOUBLE AS context
 FROM (SELECT object_id, lead(object_id) OVER w AS upper, lead(z_min) OVER w - z_max AS gap FROM objects WHERE kind = 'storey' WINDOW w AS (PARTITION BY parent_id ORDER BY level, seq)) WHERE abs(gap) > 0.15"""
# a union's area by inclusion and exclusion over the at most four units of a storey
_UNASSIGNED = """SELECT 'UNASSIGNED_AREA' AS rule, CASE WHEN residue / 80 > 0.42 THEN 'warning' ELSE 'info' END AS severity, object_id AS object_a, NULL::VARCHAR AS object_b, residue AS measure, residue / 80 AS context FROM (
 SELECT parent_id AS object_id, 80 - (sum(w) FILTER (WHERE n = 1) - coalesce(sum(w) FILTER (WHERE n = 2), 0) + coalesce(sum(w) FILTER (WHERE n = 3), 0) - coalesce(sum(w) FILTER (WHERE n = 4), 0)) AS residue FROM sets GROUP BY 1) WHERE residue >= 1"""
_SETS = """, u AS (SELECT c.parent_id, c.seq, greatest(c.x0, s.x0) AS x0, greatest(c.y0, s.y0) AS y0, least(c.x1, s.x1) AS x1, least(c.y1, s.y1) AS y1 FROM objects c JOIN objects s ON s.object_id = c.parent_id WHERE c.kind = 'unit'),
chain(parent_id, seq, x0, y0, x1, y1, n) AS (SELECT *, 1 FROM u UNION ALL SELECT c.parent_id, u.seq, greatest(c.x0, u.x0), greatest(c.y0, u.y0), least(c.x1, u.x1), least(c.y1, u.y1), n + 1 FROM chain c JOIN u ON u.parent_id = c.parent_id AND u.seq > c.seq),
sets AS (SELECT parent_id, n, greatest(0, x1 - x0) * greatest(0, y1 - y0) AS w FROM chain) """
_CLEARANCE = """SELECT 'INFRA_CLEARANCE' AS rule, CASE WHEN d <= 0.001 THEN 'error' ELSE 'warning' END AS severity, s.object_id AS object_a, c.object_id AS object_b, d AS measure, need AS context FROM (SELECT *, CASE corridor_kind WHEN 'metro' THEN 3.0 WHEN 'water' THEN 1.0 WHEN 'storm' THEN 1.0 WHEN 'power' THEN 1.5 ELSE 1.0 END::DOUBLE AS need FROM objects WHERE kind = 'infrastructure') c JOIN (SELECT * FROM objects WHERE kind IN ('building', 'unit')) s
 ON s.y0 <= c.y1 + 3 AND s.y1 >= c.y0 - 3, LATERAL (SELECT greatest(0, s.x0 - c.x1, c.x0 - s.x1) AS dx, greatest(0, s.y0 - c.y1, c.y0 - s.y1) AS dy, greatest(0, s.z_min - c.z_max, c.z_min - s.z_max) AS dz), LATERAL (SELECT sqrt(dx * dx + dy * dy) AS p, sqrt(dx * dx + dy * dy + dz * dz) AS d) WHERE p <= need AND d < need"""
_AREA = """SELECT 'AREA_MISMATCH' AS rule, 'warning' AS severity, object_id AS object_a, NULL::VARCHAR AS object_b, round_even(pct, 2) AS measure, recorded_area_m2 AS context FROM (SELECT *, 100 * abs((x1-x0)*(y1-y0) - recorded_area_m2) / recorded_area_m2 AS pct FROM objects WHERE recorded_area_m2 <> 0) WHERE pct > 5"""
_STOREYS = """SELECT 'UNAUTHORISED_STOREY' AS rule, CASE WHEN facade_periodicity >= 0.25 THEN 'error' ELSE 'warning' END AS severity, object_id AS object_a, NULL::VARCHAR AS object_b, (storey_estimate_from_scan - storeys_above_ground)::DOUBLE AS measure, (storey_estimate_from_scan - storeys_above_ground) * floor_height_m * (x1-x0)*(y1-y0) AS context FROM objects WHERE kind = 'building' AND storey_estimate_from_scan > storeys_above_ground"""
_PROVENANCE = f"""SELECT 'PROVENANCE_REVIEW' AS rule, 'info' AS severity, arg_min(object_id, seq) AS object_a, NULL::VARCHAR AS object_b, count(*)::DOUBLE AS measure, (count(*) FILTER (WHERE confidence < 0.6))::DOUBLE AS context FROM objects WHERE provenance NOT IN {tuple(AUTHORITATIVE)} HAVING count(*) > 0"""


def _rule(name, f, sql):
    run = lambda spark, sf: f(register(spark, sf))
    run.__name__ = name
    query(sql)(run)


_rule("volumetric_overlap", rules.volumetric_overlap, _OVERLAP)
_rule("plan_containment", rules.plan_containment, _PLAN)
_rule("vertical_containment", rules.vertical_containment, _VERTICAL)
_rule("storey_continuity", rules.storey_continuity, _CONTINUITY)
_rule("unassigned_area", rules.unassigned_area, _SETS + _UNASSIGNED)
_rule("clearance_band", rules.corridor_clearance, _CLEARANCE)
_rule("area_mismatch", rules.area_mismatch, _AREA)
_rule("unauthorised_storeys", rules.unauthorised_storeys, _STOREYS)
_rule("provenance_summary", rules.provenance_review, _PROVENANCE)

def stored_register(spark, sf):
    """The register as a table: eleven rules then read their own columns of it, and none makes it again."""
    return stored(register(spark, sf), "register")


_FINDINGS = _SETS + ", findings AS (" + " UNION ALL ".join([_OVERLAP, _PLAN, _VERTICAL, _CONTINUITY, _UNASSIGNED, _CLEARANCE, _AREA, _STOREYS, _PROVENANCE]) + ") "


@query(_FINDINGS + "SELECT *, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS rank FROM findings")
def validation_report(spark, sf):
    return rules.validate(stored_register(spark, sf))


@query(_FINDINGS + "SELECT s.severity, count(f.rule) AS n FROM (VALUES ('error'), ('warning'), ('info')) s(severity) LEFT JOIN findings f USING (severity) GROUP BY 1")
def severity_counts(spark, sf):
    return rules.severity_counts(rules.validate(stored_register(spark, sf)))


@query(_FINDINGS + "SELECT DISTINCT o.object_id, rule, object_a, object_b FROM findings f JOIN objects o ON f.object_a IN (o.object_id, o.parent_id) OR f.object_b IN (o.object_id, o.parent_id)")
def findings_for_object(spark, sf):
    o = stored_register(spark, sf)
    return rules.findings_for(rules.validate(o), o)


@query("""SELECT CASE WHEN x1 <= x0 OR y1 <= y0 THEN 'GEOM_EMPTY' ELSE 'GEOM_FLAT' END AS rule, 'error' AS severity, object_id AS object_a, NULL::VARCHAR AS object_b, (x1-x0)*(y1-y0)*(z_max-z_min) AS measure, NULL::DOUBLE AS context FROM
 (SELECT object_id, x0, CASE WHEN seq % 31 = 0 THEN x0 ELSE x1 END AS x1, y0, y1, z_min, CASE WHEN seq % 37 = 0 THEN z_min ELSE z_max END AS z_max FROM objects) WHERE x1 <= x0 OR z_max - z_min <= 0.001""")
def geometry_validity(spark, sf):
    # every 31st object is made empty and every 37th flat, so that the rule finds some
    o = register(spark, sf)
    return rules.geometry_validity(o.withColumns({"x1": F.expr("if(seq % 31 = 0, x0, x1)"), "z_max": F.expr("if(seq % 37 = 0, z_min, z_max)")}))


# ---- identifiers

_POSITIONS = "SELECT o_orderkey AS k, 18.5::DOUBLE + (o_orderkey % 997)::DOUBLE / 65536 AS lat, 73.75::DOUBLE + (o_orderkey % 1009)::DOUBLE / 32768 AS lon, (o_orderkey % 40)::INT AS level, (o_orderkey % 5000)::INT AS unit FROM orders"
_GEOHASH = f"""WITH RECURSIVE p AS ({_POSITIONS}),
g(k, lat, lon, level, unit, i, a, b, c, d, v, code) AS (SELECT *, 0, -90.0::DOUBLE, 90.0::DOUBLE, -180.0::DOUBLE, 180.0::DOUBLE, 0, '' FROM p UNION ALL
 SELECT k, lat, lon, level, unit, i + 1, CASE WHEN NOT e AND up THEN m ELSE a END, CASE WHEN NOT e AND NOT up THEN m ELSE b END, CASE WHEN e AND up THEN m ELSE c END, CASE WHEN e AND NOT up THEN m ELSE d END,
  CASE WHEN i % 5 = 4 THEN 0 ELSE v * 2 + up::INT END, CASE WHEN i % 5 = 4 THEN code || substr('0123456789bcdefghjkmnpqrstuvwxyz', v * 2 + up::INT + 1, 1) ELSE code END
 FROM (SELECT *, i % 2 = 0 AS e, CASE WHEN i % 2 = 0 THEN (c + d) / 2 ELSE (a + b) / 2 END AS m, CASE WHEN i % 2 = 0 THEN lon > (c + d) / 2 ELSE lat > (a + b) / 2 END AS up FROM g WHERE i < 50)),
h AS (SELECT * FROM g WHERE i = 50),
b36 AS (SELECT *, list_transform([level // 36, level % 36, unit // 46656, unit // 1296 % 36, unit // 36 % 36, unit % 36], lambda x: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x + 1, 1)) AS ds FROM h),
pay AS (SELECT *, '27025004' || upper(code) || ['G', 'B', 'U', 'A', 'I'][k % 5 + 1] || array_to_string(ds, '') AS payload FROM b36),
chk(k, payload, i, p) AS (SELECT k, payload, 0, 36 FROM pay UNION ALL SELECT k, payload, i + 1, 2 * (CASE WHEN s = 0 THEN 36 ELSE s END) % 37 FROM (SELECT *, (p + strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(payload, i + 1, 1)) - 1) % 36 AS s FROM chk WHERE i < 25)),
ids AS (SELECT pay.*, payload || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (37 - chk.p) % 36 + 1, 1) AS compact FROM pay JOIN chk USING (k, payload) WHERE chk.i = 25)
"""


def positions(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("k"), (18.5 + (k % 997) / 65536).alias("lat"), (73.75 + (k % 1009) / 32768).alias("lon"), (k % 40).cast("int").alias("level"), (k % 5000).cast("int").alias("unit"))


def identified(spark, sf):
    """Positions with their codes, jurisdiction 27/025/004."""
    stratum = F.element_at(F.split(F.lit("G,B,U,A,I"), ","), (F.col("k") % 5 + 1).cast("int"))
    p = positions(spark, sf).withColumns({"geohash": idcode.geohash_encode(F.col("lat"), F.col("lon")), "stratum": stratum})
    return p.withColumn("compact", idcode.compact(F.lit("27"), F.lit("25"), F.lit("4"), F.col("geohash"), F.col("stratum"), F.col("level"), F.col("unit")))


@query(_GEOHASH + "SELECT k, code AS geohash FROM h", False)
def geohash_encode(spark, sf):
    return positions(spark, sf).select("k", idcode.geohash_encode(F.col("lat"), F.col("lon")).alias("geohash"))


@query(_GEOHASH + "SELECT k, a AS lat_lo, b AS lat_hi, c AS lon_lo, d AS lon_hi FROM h", False)
def geohash_decode(spark, sf):
    return identified(spark, sf).select("k", idcode.geohash_bounds(F.col("geohash")).alias("b")).select("k", "b.*")


@query(_GEOHASH + "SELECT substr(code, 1, n) AS cell, n, count(*) AS objects FROM h, range(1, 11) t(n) GROUP BY ALL", False)
def geohash_ladder(spark, sf):
    n = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(10).cast("bigint"))).alias("n")
    return identified(spark, sf).select("geohash", n).groupBy(F.expr("substring(geohash, 1, n)").alias("cell"), "n").agg(F.count("*").alias("objects"))


@query(_GEOHASH + "SELECT k, level, array_to_string(ds[1:2], '') AS level36, unit, array_to_string(ds[3:6], '') AS unit36 FROM b36", False)
def base36(spark, sf):
    p = positions(spark, sf)
    return p.select("k", "level", idcode.base36(F.col("level"), 2).alias("level36"), "unit", idcode.base36(F.col("unit"), 4).alias("unit36"))


@query(_GEOHASH + "SELECT k, substr(compact, 26, 1) AS check_char FROM ids", False)
def check_char(spark, sf):
    return identified(spark, sf).select("k", idcode.check_character(F.substring("compact", 1, 25)).alias("check_char"))


_SPELLED = """, spelled AS (SELECT *, CASE WHEN k % 13 = 0 THEN compact[1:24] || CASE compact[25] WHEN '0' THEN '1' ELSE '0' END || compact[26] WHEN k % 29 = 0 THEN compact[1:20] WHEN k % 31 = 0 THEN compact[1:18] || 'X' || compact[20:26]
 ELSE lower(compact[1:2] || '-' || compact[3:5] || ' ' || compact[6:26]) END AS code_text FROM ids)"""


def spelled(spark, sf):
    """Codes in mixed spellings: every 13th has a wrong character, some are short or have no such layer."""
    k = F.col("k")

    def text(c):
        part = lambda a, n: c.substr(a, n)
        wrong = F.concat(part(1, 24), F.when(part(25, 1) == "0", "1").otherwise("0"), part(26, 1))
        return F.when(k % 13 == 0, wrong).when(k % 29 == 0, part(1, 20)).when(k % 31 == 0, F.concat(part(1, 18), F.lit("X"), part(20, 7))).otherwise(F.lower(F.concat(part(1, 2), F.lit("-"), part(3, 3), F.lit(" "), part(6, 21))))

    return identified(spark, sf).withColumn("code_text", idcode.let(F.col("compact"), text))


@query(_GEOHASH + _SPELLED + """SELECT k, CASE WHEN k % 13 = 0 THEN 'check' WHEN k % 29 = 0 THEN 'length' WHEN k % 31 = 0 THEN 'malformed' END AS problem,
 CASE WHEN k % 13 <> 0 AND k % 29 <> 0 AND k % 31 <> 0 THEN code END AS geohash, CASE WHEN k % 13 <> 0 AND k % 29 <> 0 AND k % 31 <> 0 THEN level END AS level, CASE WHEN k % 13 <> 0 AND k % 29 <> 0 AND k % 31 <> 0 THEN unit END AS unit FROM spelled""", False)
def id_parse_validate(spark, sf):
    e = spelled(spark, sf).select("k", F.explode(F.array(idcode.examined(F.col("code_text")))).alias("e"))
    return e.select("k", "e.problem", "e.fields.geohash", "e.fields.level", "e.fields.unit")


@query(_GEOHASH + """SELECT k, CASE WHEN k % 5 IN (2, 4) THEN -level ELSE level END AS signed_level, ['Surface parcel', 'Above-ground unit', 'Sub-surface unit', 'Air rights', 'Infrastructure corridor'][k % 5 + 1] || ', ' ||
 CASE WHEN level = 0 THEN 'ground level' ELSE 'level ' || level || CASE WHEN k % 5 IN (2, 4) THEN ' below' ELSE ' above' END || ' ground' END || ', unit #' || unit AS description,
 compact[1:2] || '-' || compact[3:5] || '-' || compact[6:8] || '-' || code || '-' || compact[19:21] || '-' || compact[22:25] || '-' || compact[26] AS display FROM ids""", False)
def id_describe(spark, sf):
    s, l, u = F.col("p.stratum"), F.col("p.level"), F.col("p.unit")
    p = identified(spark, sf).withColumn("p", idcode.parsed(F.col("compact")))
    return p.select("k", idcode.signed_level(s, l).alias("signed_level"), idcode.described(s, l, u).alias("description"), idcode.punctuated(F.col("compact")).alias("display"))


@query(_GEOHASH + "SELECT k, code AS geohash, (row_number() OVER (PARTITION BY code, k % 5, level ORDER BY k) - 1)::INT AS unit FROM h", False)
def mint_units_rank(spark, sf):
    return idcode.mint_units(identified(spark, sf).drop("unit"), ["geohash", "stratum", "level"], ["k"]).select("k", "geohash", "unit")


@query(_GEOHASH + """, r AS MATERIALIZED (SELECT k, code, k % 5 AS s, unit % 3 AS p, row_number() OVER (PARTITION BY code, k % 5 ORDER BY k) AS i FROM h),
m(k, code, s, p, i, taken, u) AS (SELECT k, code, s, p, i, [p], p FROM r WHERE i = 1 UNION ALL
 SELECT k, code, s, p, i, list_append(taken, n), n FROM (SELECT r.*, m.taken, list_min(list_filter(range(r.p, r.p + len(m.taken) + 1), lambda x: NOT list_contains(m.taken, x)))::INT AS n FROM m JOIN r ON r.code = m.code AND r.s = m.s AND r.i = m.i + 1))
SELECT k AS seq, code AS geohash, ['G', 'B', 'U', 'A', 'I'][s + 1] AS stratum, p AS preferred, u AS unit FROM m""", False)
def mint_units_preferred(spark, sf):
    rows = identified(spark, sf).select(F.col("k").alias("seq"), "geohash", "stratum", (F.col("unit") % 3).alias("preferred"))
    return idcode.mint_preferred(rows, ["geohash", "stratum"], "seq long, geohash string, stratum string, preferred int, unit int")


@query(_GEOHASH + "SELECT 'CODE_DUPLICATE' AS rule, 'O-' || k AS object_a, 'O-' || prev AS object_b FROM (SELECT k, lag(k) OVER (PARTITION BY compact[1:21] ORDER BY k) AS prev FROM ids WHERE k % 7 <> 0) WHERE prev IS NOT NULL UNION ALL SELECT 'CODE_MISSING', 'O-' || k, NULL FROM ids WHERE k % 7 = 0", False)
def id_duplicates(spark, sf):
    # codes without unit and check repeat; every 7th is taken away
    rows = identified(spark, sf).select(F.col("k").alias("seq"), F.concat(F.lit("O-"), "k").alias("object_id"), F.when(F.col("k") % 7 != 0, F.substring("compact", 1, 21)).alias("code"))
    return rules.identifier_integrity(rows).select("rule", "object_a", "object_b")


@query(_GEOHASH + """SELECT k, moved >= a AND moved <= b AND lon >= c AND lon <= d AS stable, round_even(sqrt(((moved - (a + b) / 2) * 111132) ** 2 + ((lon - (c + d) / 2) * 111320 * cos(radians((a + b) / 2))) ** 2), 4) AS drift_m FROM (SELECT *, lat + (k % 3)::DOUBLE / 262144 AS moved FROM h)""", False)
def id_stability(spark, sf):
    moved = F.col("lat") + (F.col("k") % 3) / 262144
    b = identified(spark, sf).withColumn("b", idcode.geohash_bounds(F.col("geohash")))
    return b.select("k", idcode.inside(F.col("b"), moved, F.col("lon")).alias("stable"), F.bround(idcode.drift(F.col("b"), moved, F.col("lon")), 4).alias("drift_m"))
