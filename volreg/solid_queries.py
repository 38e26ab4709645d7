"""Queries on volumes of any plan. Each part gives a site of closed forms: a parcel with a hole, an L-shaped
building and storey, units (a box, a turned square, a triangle that sticks out) and a bent corridor."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import table
from .functions import overlay, polygons
from .more_queries import ORIGIN, _e6, enu_inverse_sql
from .operators import solids
from .queries import query
from .shared import spread, stored
from .sources import files

# s: a site's scale; ox, oy: its place
_SITES = "WITH t AS (SELECT p_partkey AS k, (1 + p_size % 8)::DOUBLE AS s, (p_partkey % 50) * 300.0::DOUBLE AS ox, (p_partkey // 50) * 300.0::DOUBLE AS oy FROM part)"


def sites(spark, sf):
    k = F.col("p_partkey")
    return spread(table(spark, sf, "part"), "p_partkey").select(k.alias("k"), (1 + F.col("p_size") % 8).cast("double").alias("s"), (k % 50 * 300.0).alias("ox"), (F.expr("p_partkey div 50") * 300.0).alias("oy"))


def _ring(*corners):
    """Corners (a, b, c, d): a * s + c and b * s + d from the site's place."""
    return F.array(*(F.struct((F.col("ox") + a * F.col("s") + c).alias("x"), (F.col("oy") + b * F.col("s") + d).alias("y")) for a, b, c, d in ((*p, 0, 0)[:4] for p in corners)))


SHAPES = {
    "P": ("parcel", None, [[((0, 0), (10, 0), (10, 10), (0, 10)), ((8, 8), (8, 9), (9, 9), (9, 8))]], -6.0, 0.0),
    "B": ("building", "P", [[((0, 0), (6, 0), (6, 3), (3, 3), (3, 6), (0, 6))]], 0.0, 6.0),
    "S": ("storey", "B", [[((0, 0), (6, 0), (6, 3), (3, 3), (3, 6), (0, 6))]], 0.0, 3.0),
    "U1": ("unit", "S", [[((0, 0), (3, 0), (3, 6), (0, 6))]], 0.0, 3.0),
    "U2": ("unit", "S", [[((2.5, 1.5), (4, 0), (5.5, 1.5), (4, 3))]], 0.0, 3.0),
    "U3": ("unit", "B", [[((3, 0), (7, 0), (3, 2))]], 3.0, 6.0),
    "C": ("infrastructure", None, [[((0, 0, -2, -3), (6, 0, 3, -3), (6, 0, 3, -2), (0, 0, -2, -2))], [((6, 0, 2.5, -2.5), (6, 0, 3.5, -2.5), (6, 8, 3.5, 0), (6, 8, 2.5, 0))]], -2.0, 1.0),
}


def parts(spark, sf):
    """The sites' parts (object_id, part_no, rings, z_min, z_max) with kind, parent_id and corridor_kind."""
    site = sites(spark, sf)
    name = lambda n: F.concat(F.lit("K"), "k", F.lit(f"/{n}")) if n else F.lit(None).cast("string")
    each = [
        F.struct(name(n).alias("object_id"), F.lit(i).alias("part_no"), F.array(*(_ring(*r) for r in rings)).alias("rings"), F.lit(lo).alias("z_min"), F.lit(hi).alias("z_max"), F.lit(kind).alias("kind"), name(up).alias("parent_id"), F.lit("metro" if kind == "infrastructure" else None).cast("string").alias("corridor_kind"))
        for n, (kind, up, all_, lo, hi) in SHAPES.items() for i, rings in enumerate(all_)
    ]
    return stored(site.select(F.explode(F.array(*each)).alias("o")).select("o.*"), "parts")


def split(spark, sf):
    p = parts(spark, sf)
    return p.select("object_id", "part_no", "rings", "z_min", "z_max"), p.select("object_id", "kind", "parent_id", "corridor_kind").distinct()


_MEASURES = """ SELECT 'K' || k || '/' || n AS object_id, np AS n_parts, round_even(a, 6) AS area, round_even(v, 6) AS volume, round_even(l, 6) AS lateral_area, x0, y1, z_min::DOUBLE AS z_min, z_max::DOUBLE AS z_max, round_even(cx, 6) AS cx FROM t,
LATERAL (VALUES ('P', 1, 99*s*s, 594*s*s, 44*s*6, ox, oy+10*s, -6.0, 0.0, ox+5*s), ('B', 1, 27*s*s, 162*s*s, 24*s*6, ox, oy+6*s, 0.0, 6.0, ox + 2.5*s), ('S', 1, 27*s*s, 81*s*s, 72*s, ox, oy+6*s, 0.0, 3.0, ox + 2.5*s), ('U1', 1, 18*s*s, 54*s*s, 54*s, ox, oy+6*s, 0.0, 3.0, ox+1.5*s),
 ('U2', 1, 4.5*s*s, 13.5*s*s, 18*sqrt(2)*s, ox+2.5*s, oy+3*s, 0.0, 3.0, ox+4*s), ('U3', 1, 4*s*s, 12*s*s, 3*(6+2*sqrt(5))*s, ox+3*s, oy+2*s, 3.0, 6.0, ox+13*s/3),
 ('C', 2, 6*s+5 + 8*s+2.5 - 0.25, 3*(6*s+5 + 8*s+2.5), 3*(2*(6*s+6) + 2*(8*s+3.5)), ox-2, oy+8*s, -2.0, 1.0, ox + ((6*s+5)*(3*s+0.5) + (8*s+2.5)*(6*s+3)) / (14*s+7.5))) x(n, np, a, v, l, x0, y1, z_min, z_max, cx)"""


@query(_SITES + _MEASURES, False)
def solid_measures(spark, sf):
    p, _ = split(spark, sf)
    r = lambda c: F.bround(c, 6).alias(c)
    return solids.solid_measures(p).select("object_id", F.col("n_parts").cast("int").alias("n_parts"), r("area"), r("volume"), r("lateral_area"), "x0", "y1", "z_min", "z_max", r("cx"))


_F = "SELECT '{rule}' AS rule, '{severity}' AS severity, 'K' || k || '/{a}' AS object_a, {b} AS object_b, round_even({m}, 6) AS measure, {c}::DOUBLE AS context FROM t"


def _shown(findings):
    return findings.withColumns({c: F.bround(c, 6) for c in ("measure", "context")})


# the corridor meets the triangle only where that reaches over it, but lies lower
@query(_SITES + " " + _F.format(rule="VERT_OVERLAP", severity="error", a="U1", b="'K' || k || '/U2'", m="0.75 * s * s", c="3"), False)
def solid_overlaps(spark, sf):
    return _shown(solids.volumetric_overlap(*split(spark, sf)))


@query(_SITES + " " + _F.format(rule="PLAN_CONTAINMENT", severity="error", a="U3", b="'K' || k || '/B'", m="(s - 0.05) ** 2 / 4", c="NULL") + " WHERE (s - 0.05) ** 2 / 4 > 0.25", False)
def solid_containment(spark, sf):
    return _shown(solids.plan_containment(*split(spark, sf)))


@query(_SITES + " " + _F.format(rule="UNASSIGNED_AREA", severity="info", a="S", b="NULL", m="4.75 * s * s", c="round_even(4.75 / 27, 6)"), False)
def solid_unassigned(spark, sf):
    return _shown(solids.unassigned_area(*split(spark, sf)))


_NEAR = """, d AS (SELECT k, n, d FROM t, LATERAL (VALUES ('B', 2.0::DOUBLE), ('U1', 2.0::DOUBLE), ('U2', sqrt(0::DOUBLE + 2 * 2)), ('U3', sqrt(greatest(0, least(2, 2.5 - s)) ** 2 + 4))) x(n, d))
SELECT 'INFRA_CLEARANCE' AS rule, 'warning' AS severity, 'K' || k || '/' || n AS object_a, 'K' || k || '/C' AS object_b, round_even(d, 6) AS measure, 3.0::DOUBLE AS context FROM d WHERE d < 3"""


@query(_SITES + _NEAR, False)
def solid_clearance(spark, sf):
    return _shown(solids.corridor_clearance(*split(spark, sf)))


@query(_SITES + """ SELECT 'K' || k || '/B' AS object_id, 'K' || k || '/P' AS best_id, 27 * s * s AS shared_m2, round_even(27 / 99::DOUBLE, 9) AS iou FROM t
UNION ALL SELECT 'K' || k || '/C', 'K' || k || '/P', round_even(least(10 * s, 8 * s) * greatest(0, least(1, 10 * s - 6 * s - 2.5)), 9), round_even(least(10 * s, 8 * s) * greatest(0, least(1, 10 * s - 6 * s - 2.5)) / (14 * s + 7.25 + 99 * s * s - least(10 * s, 8 * s) * greatest(0, least(1, 10 * s - 6 * s - 2.5))), 9) FROM t""", False)
def solid_parcels(spark, sf):
    p, o = split(spark, sf)
    of = lambda *kinds: p.join(o.where(F.col("kind").isin(*kinds)).select("object_id"), "object_id", "left_semi")
    return solids.best_shared(of("building", "infrastructure"), of("parcel")).select("object_id", "best_id", F.bround("shared_m2", 9).alias("shared_m2"), F.bround("iou", 9).alias("iou"))


_POINTS_AT = [("hole", 8.5, 8.5, -1.0), ("notch", 4.0, 4.0, 1.0), ("wall", 3.0, 4.0, 1.0), ("tip", 2.75, 1.5, 1.0), ("low", 1.0, 1.0, -3.0), ("rim", 8.0, 8.5, -1.0)]
_HITS = {"notch": "''", "hole": "''", "wall": "'B,S,U1'", "tip": "'B,S,U1,U2'", "low": "'P'", "rim": "'P'"}


@query(_SITES + f" SELECT 'K' || k || '/' || n AS probe_id, hits FROM t, (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {h})' for n, h in _HITS.items() if h != chr(39) * 2)}) x(n, hits)", False)
def solid_probes(spark, sf):
    p, _ = split(spark, sf)
    at = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(z).alias("z")) for n, a, b, z in _POINTS_AT))).alias("q")
    probes = sites(spark, sf).select("k", "s", "ox", "oy", at).select(F.concat(F.lit("K"), "k", F.lit("/"), "q.n").alias("probe_id"), (F.col("ox") + F.col("q.a") * F.col("s")).alias("x"), (F.col("oy") + F.col("q.b") * F.col("s")).alias("y"), F.col("q.z").alias("z"))
    # the few objects at a point
    return solids.probe(p, probes).groupBy("probe_id").agg(F.array_join(F.array_sort(F.collect_list(F.substring_index("object_id", "/", -1))), ",").alias("hits"))


@query(_SITES + " SELECT 'K' || k || '/U1' AS a_id, 'K' || k || '/U2' AS b_id, 1 AS n_rings, 3 AS corners, round_even(0.25 * s * s, 6) AS area, ox + 2.5 * s AS x0, 0.0::DOUBLE AS z_min, 3.0::DOUBLE AS z_max FROM t", False)
def solid_intersections(spark, sf):
    p, o = split(spark, sf)
    units = p.join(o.where("kind = 'unit'").select("object_id"), "object_id", "left_semi")
    i = solids.intersections(units, units).where("a_object_id < b_object_id")
    ring = F.col("rings")[0]
    return i.select(F.col("a_object_id").alias("a_id"), F.col("b_object_id").alias("b_id"), F.size("rings").alias("n_rings"), F.size(ring).alias("corners"), F.bround(polygons.signed_area(ring), 6).alias("area"), F.round(F.array_min(F.transform(ring, lambda q: q["x"])), 6).alias("x0"), "z_min", "z_max")


# a bow tie: two triangles of s * s; grown and shrunk boxes; a union with a hole; a wall's union
@query(_SITES + """ SELECT k, true AS crosses, round_even(s * s, 5) AS cleaned, round_even(18 * s * s + 18 * s * 0.5 + 32 * sin(pi() / 32) * 0.25, 5) AS grown, round_even((3 * s - 0.5) * (6 * s - 0.5), 5) AS shrunk, 2 AS frame_rings, round_even(84 * s * s, 5) AS frame, round_even(22.25 * s * s, 5) AS united, round_even(9 * s * s, 5) AS lessened FROM t""", False)
def polygon_sets(spark, sf):
    size = lambda c: F.bround(F.aggregate(c, F.lit(0.0), lambda t, r: t + polygons.signed_area(r)), 5)
    one = lambda *corners: F.array(_ring(*corners))
    box, bow = one((0, 0), (3, 0), (3, 6), (0, 6)), one((0, 0), (2, 2), (2, 0), (0, 2))
    ell, diamond = one((0, 0), (6, 0), (6, 3), (3, 3), (3, 6), (0, 6)), one((2.5, 1.5), (4, 0), (5.5, 1.5), (4, 3))
    big, inner = one((0, 0), (10, 0), (10, 10), (0, 10)), one((3, 3), (7, 3), (7, 7), (3, 7))
    s = stored(sites(spark, sf).select("k", box.alias("box"), bow.alias("bow"), ell.alias("ell"), diamond.alias("diamond"), big.alias("big"), inner.alias("inner")), "shapes")
    c = F.col
    return s.select(
        "k", overlay.self_crossing(c("bow")).alias("crosses"), size(overlay.largest(c("bow"))).alias("cleaned"), size(overlay.grown(c("box"), 0.5)).alias("grown"), size(overlay.grown(c("box"), -0.25)).alias("shrunk"),
        F.size(overlay.difference(c("big"), c("inner"))).alias("frame_rings"), size(overlay.difference(c("big"), c("inner"))).alias("frame"), size(overlay.union(c("box"), c("diamond"))).alias("united"), size(overlay.difference(c("ell"), c("box"))).alias("lessened"))


@query(_SITES + " SELECT 'K' || k || '/' || n AS object_id, t AS type, np AS n_parts, round_even(a, 3) AS area FROM t, LATERAL (VALUES ('P', 'prism', 1, 99*s*s), ('B', 'prism', 1, 27*s*s), ('S', 'prism', 1, 27*s*s), ('U1', 'prism', 1, 18*s*s), ('U2', 'prism', 1, 4.5*s*s), ('U3', 'prism', 1, 4*s*s), ('C', 'composite', 2, 14*s+7.5)) x(n, t, np, a)", False)
def solid_documents(spark, sf):
    p, _ = split(spark, sf)
    d = stored(solids.document(p), "documents")
    back = solids.part_measures(solids.from_document(d)).groupBy("object_id").agg(F.count("*").cast("int").alias("n_parts"), F.bround(F.sum("area"), 3).alias("area"))
    return d.select("object_id", F.get_json_object("solid", "$.type").alias("type")).join(back, "object_id")


@query(_SITES + " SELECT 'K' || k || '/' || n AS object_id, np AS part_no, c AS corners, z0::DOUBLE AS z_min, z1::DOUBLE AS z_max, round_even(x + ox, 3) AS first_x FROM t, LATERAL (VALUES ('P', 0, '4,4', -6.0, 0.0, 0.0), ('B', 0, '6', 0.0, 6.0, 0.0), ('S', 0, '6', 0.0, 3.0, 0.0), ('U1', 0, '4', 0.0, 3.0, 0.0), ('U2', 0, '4', 0.0, 3.0, 2.5 * s), ('U3', 0, '3', 3.0, 6.0, 3 * s), ('C', 0, '4', -2.0, 1.0, -2.0), ('C', 1, '4', -2.0, 1.0, 6 * s + 2.5)) v(n, np, c, z0, z1, x)", False)
def mesh_payload(spark, sf):
    p, _ = split(spark, sf)
    m = solids.meshes(p)
    return m.select("object_id", "part_no", F.array_join(F.transform("rings", lambda r: F.size(r).cast("string")), ",").alias("corners"), "z_min", "z_max", F.col("rings")[0][0][0].alias("first_x"))


@query(_SITES + " SELECT 'K' || k AS object_id, CASE WHEN k % 3 = 0 THEN 'GEOM_INVALID' WHEN k % 3 = 1 THEN 'GEOM_FLAT' ELSE 'GEOM_EMPTY' END AS rule FROM t", False)
def solid_validity(spark, sf):
    k = F.col("k")
    flat = F.when(k % 3 == 1, 1.0).otherwise(2.0)
    ring = F.when(k % 3 == 0, _ring((0, 0), (4, 2), (2, 0), (0, 2))).when(k % 3 == 1, _ring((0, 0), (2, 0), (0, 2))).otherwise(_ring((0, 0), (2, 2), (4, 4)))
    p = sites(spark, sf).select(F.concat(F.lit("K"), "k").alias("object_id"), F.lit(0).alias("part_no"), F.array(ring).alias("rings"), F.lit(1.0).alias("z_min"), flat.alias("z_max"))
    return solids.geometry_validity(p).select(F.col("object_a").alias("object_id"), "rule")


# footprints turned by 30 degrees with a dent and a slanted edge, laid along their main directions
@query(_SITES + " SELECT k, 4 AS corners, true AS same_area, round_even(pi() / 6, 2) AS turn FROM t", False)
def footprint_regular(spark, sf):
    c, n = 0.8660254037844386, 0.5
    at = lambda a, b: F.struct((F.col("ox") + (a * c - b * n) * F.col("s") * 4).alias("x"), (F.col("oy") + (a * n + b * c) * F.col("s") * 4).alias("y"))
    ring = F.array(at(0, 0), at(2, 0.01), at(4, 0), at(4.02, 3), at(0, 3.01))
    s = stored(sites(spark, sf).select("k", "s", F.array(ring).alias("r")), "rough").withColumn("t", overlay.regularised(F.col("r"))[0])
    return s.select("k", F.size("t").alias("corners"), (F.abs(F.abs(polygons.signed_area(F.col("t"))) - 12 * 16 * F.col("s") * F.col("s")) < 4 * F.col("s") * F.col("s")).alias("same_area"), F.bround(polygons.orientation(F.col("t")), 2).alias("turn"))


# two rooms a party wall apart make one envelope, a third far away a part of its own
@query(_SITES + " SELECT k, 2 AS n_parts, round_even(ox - 0.35, 6) AS x0, round_even(ox + 6 * s + 0.65, 6) AS x1, true AS area_fits FROM t", False)
def building_outline(spark, sf):
    room = F.explode(F.array(F.array(_ring((0, 0), (3, 0), (3, 4), (0, 4))), F.array(_ring((3, 0, 0.3, 0), (6, 0, 0.3, 0), (6, 4, 0.3, 0), (3, 4, 0.3, 0))), F.array(_ring((0, 0, 0, 200), (1, 0, 0, 200), (1, 1, 0, 200), (0, 1, 0, 200)))))
    rooms = sites(spark, sf).select("k", "s", room.alias("rings"))
    u = overlay.union_by(rooms, ["k", "s"], "rings", grow=0.35, simplify=0.05)
    side = lambda f: F.bround(f(F.transform(F.flatten("rings"), lambda p: p["x"])), 6)
    s = F.col("s")
    want = (6 * s + 1) * (4 * s + 0.7) + (s + 0.7) * (s + 0.7)
    return u.select("k", "n_parts", side(F.array_min).alias("x0"), side(F.array_max).alias("x1"), (F.abs(F.col("area") - want) < 1.0).alias("area_fits"))


# ---- unions of parts: a parent of two parts side by side, children across both, with a part far outside, and over the border

_UNITED = {
    "D": ("building", None, [[((0, 0), (3, 0), (3, 6), (0, 6))], [((3, 0), (6, 0), (6, 6), (3, 6))]], 0.0, 6.0),
    "E": ("storey", "D", [[((1, 1), (5, 1), (5, 2), (1, 2))]], 0.0, 3.0),
    "F": ("storey", "D", [[((1, 3), (2, 3), (2, 4), (1, 4))], [((10, 0), (12, 0), (12, 2), (10, 2))]], 3.0, 6.0),
    "G": ("storey", "D", [[((4, 2), (5, 2), (5, 4), (4, 4))], [((5, 2), (7, 2), (7, 4), (5, 4))]], 6.0, 9.0),
    "V": ("unit", "G", [[((4, 2), (6, 2), (6, 3), (4, 3))]], 6.0, 9.0),
}


def united(spark, sf):
    site = sites(spark, sf)
    name = lambda n: F.concat(F.lit("K"), "k", F.lit(f"/{n}")) if n else F.lit(None).cast("string")
    each = [
        F.struct(name(n).alias("object_id"), F.lit(i).alias("part_no"), F.array(*(_ring(*r) for r in rings)).alias("rings"), F.lit(lo).alias("z_min"), F.lit(hi).alias("z_max"), F.lit(kind).alias("kind"), name(up).alias("parent_id"))
        for n, (kind, up, all_, lo, hi) in _UNITED.items() for i, rings in enumerate(all_)
    ]
    p = stored(site.select(F.explode(F.array(*each)).alias("o")).select("o.*"), "united")
    return p.select("object_id", "part_no", "rings", "z_min", "z_max"), p.select("object_id", "kind", "parent_id").distinct()


@query(_SITES + """ SELECT 'K' || k || '/' || n AS object_id, 'K' || k || '/' || p AS parent_id, round_even(a, 6) AS outside FROM t, LATERAL (VALUES ('E', 'D', 0.0::DOUBLE), ('F', 'D', 4 * s * s), ('G', 'D', (s - 0.05) * 2 * s), ('V', 'G', 0.0::DOUBLE)) x(n, p, a)""", False)
def composite_containment(spark, sf):
    p, o = united(spark, sf)
    return solids.beyond_parent(p, o.where("parent_id is not null").select("object_id", "parent_id")).withColumn("outside", F.bround("outside", 6))


@query(_SITES + """ SELECT 'K' || k || '/G' AS object_id, round_even(6 * s * s, 6) AS floor, round_even(4 * s * s, 6) AS residue FROM t""", False)
def composite_unclaimed(spark, sf):
    p, o = united(spark, sf)
    of = lambda kind: p.join(o.where(F.col("kind") == kind).select("object_id", "parent_id"), "object_id")
    return solids.unclaimed(of("storey"), of("unit")).select("object_id", F.bround("floor", 6).alias("floor"), F.bround("residue", 6).alias("residue"))


_ALL = _NEAR.split("\nSELECT", 1)
_VALID = [
    _F.format(rule="VERT_OVERLAP", severity="error", a="U1", b="'K' || k || '/U2'", m="0.75 * s * s", c="3"),
    _F.format(rule="PLAN_CONTAINMENT", severity="error", a="U3", b="'K' || k || '/B'", m="(s - 0.05) ** 2 / 4", c="NULL") + " WHERE (s - 0.05) ** 2 / 4 > 0.25",
    _F.format(rule="UNASSIGNED_AREA", severity="info", a="S", b="NULL", m="4.75 * s * s", c="round_even(4.75 / 27, 6)"),
    "SELECT" + _ALL[1],
    _F.format(rule="AREA_MISMATCH", severity="warning", a="B", b="NULL", m="35.0", c="20 * s * s"),
    _F.format(rule="UNAUTHORISED_STOREY", severity="error", a="B", b="NULL", m="2", c="2 * 3 * 27 * s * s"),
    _F.format(rule="HIER_ORPHAN", severity="error", a="U3b", b="'K' || k || '/none'", m="NULL::DOUBLE", c="NULL").replace("'/U3b'", "'/L'"),
]


@query(_SITES + _ALL[0] + " " + " UNION ALL ".join(f"(SELECT *, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS rank FROM ({x}))" for x in _VALID), False)
def solid_validation(spark, sf):
    p, o = split(spark, sf)
    lost = sites(spark, sf).select(F.concat(F.lit("K"), "k", F.lit("/L")).alias("object_id"), F.lit("unit").alias("kind"), F.concat(F.lit("K"), "k", F.lit("/none")).alias("parent_id"), F.lit(None).cast("string").alias("corridor_kind"))
    site = sites(spark, sf).select(F.concat(F.lit("K"), "k", F.lit("/B")).alias("object_id"), (20 * F.col("s") * F.col("s")).alias("recorded_area_m2"), F.lit(2).alias("storeys_above_ground"), F.lit(4).alias("storey_estimate_from_scan"), F.lit(3.0).alias("floor_height_m"), F.lit(0.5).alias("facade_periodicity"))
    return _shown(solids.validate(p, o.unionByName(lost).join(site, "object_id", "left")))


# ---- exports of real plans

_OUT = f""", v AS (SELECT 'K' || k || '/' || n AS object_id, kind, np, nr, co, x * s + ox + dx AS east, y * s + oy + dy AS north, 0.0::DOUBLE AS up, hi - lo AS high FROM t, LATERAL (VALUES ('P', 'LandUse', 1, 2, 10, 0, 0, 0, 0, -6.0, 0.0), ('B', 'Building', 1, 1, 7, 0, 0, 0, 0, 0.0, 6.0), ('S', 'BuildingPart', 1, 1, 7, 0, 0, 0, 0, 0.0, 3.0), ('U1', 'Room', 1, 1, 5, 0, 0, 0, 0, 0.0, 3.0),
 ('U2', 'Room', 1, 1, 5, 2.5, 1.5, 0, 0, 0.0, 3.0), ('U3', 'Room', 1, 1, 4, 3, 0, 0, 0, 3.0, 6.0), ('C', 'Tunnel', 2, 2, 10, 0, 0, -2, -3, -2.0, 1.0)) q(n, kind, np, nr, co, x, y, dx, dy, lo, hi)),
c AS ({enu_inverse_sql('SELECT * FROM v')})"""


@query(_SITES + _OUT + " SELECT object_id, CASE WHEN np > 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS shape, np AS polygons, nr AS rings, co AS positions, round(lon * 1e8)::BIGINT // 100 AS lon_e6, round(lat * 1e8)::BIGINT // 100 AS lat_e6 FROM c", False)
def solid_geojson(spark, sf):
    p, o = split(spark, sf)
    out = files.plan_geojson(p, o.select("object_id", "kind"), ORIGIN)
    kind = F.get_json_object("feature", "$.geometry.type")
    text = F.get_json_object("feature", "$.geometry.coordinates")
    many = F.when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>")).otherwise(F.array(F.from_json(text, "array<array<array<double>>>")))
    rings = F.flatten(F.col("many"))
    out = out.select("object_id", kind.alias("shape"), many.alias("many"))
    return out.select("object_id", "shape", F.size("many").alias("polygons"), F.size(rings).alias("rings"), F.size(F.flatten(rings)).alias("positions"), _e6(rings[0][0][0]).alias("lon_e6"), _e6(rings[0][0][1]).alias("lat_e6"))


@query(_SITES + _OUT + " SELECT object_id, kind AS tag, np AS polygons, nr - np AS holes, printf('%.3f', high) AS height, round(lon * 1e8)::BIGINT // 100 AS lon_e6, round(lat * 1e8)::BIGINT // 100 AS lat_e6 FROM c", False)
def solid_citygml(spark, sf):
    p, o = split(spark, sf)
    e = files.plan_citygml(p, o, ORIGIN)
    count = lambda tag: ((F.length("element") - F.length(F.replace("element", F.lit(tag)))) / len(tag)).cast("int")
    at = F.split(F.xpath_string("element", F.lit("/*/polygon/exterior")), " ")
    return e.select("object_id", F.regexp_extract("element", "^<([A-Za-z]+) ", 1).alias("tag"), count("<polygon>").alias("polygons"), count("<interior>").alias("holes"), F.xpath_string("element", F.lit("/*/height")).alias("height"), _e6(at[0].cast("double")).alias("lon_e6"), _e6(at[1].cast("double")).alias("lat_e6"))
