"""Volumes of any plan: objects as parts, each a footprint of rings between two heights.

A table of parts has (object_id, part_no, rings, z_min, z_max); an object with several
parts is a chain of them, such as a corridor. Footprints may have holes. Pairs are found
by the boxes of parts, joined on cells; only what passes is measured exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import overlay, polygons
from ..schema import EPS, SEVERITIES, TOLERANCES, lookup
from ..shared import stored
from .spatial import box_pairs, overlap, plan_distance


def with_boxes(parts: DataFrame) -> DataFrame:
    """``parts`` with x0, y0, x1, y1 of their outer rings."""
    outer = F.flatten(F.col("rings"))
    side = lambda f, c: f(F.transform(outer, lambda p: p[c]))
    return parts.select("*", side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


def _rings_total(term) -> Column:
    return F.aggregate("rings", F.lit(0.0), lambda total, ring: total + term(ring))


def part_measures(parts: DataFrame) -> DataFrame:
    """Height, area without holes, volume, area of the walls (those of holes too) and box of each part, by columns alone."""
    first = F.abs(polygons.signed_area(F.col("rings")[0]))
    holes = F.aggregate(F.slice("rings", 2, F.size("rings")), F.lit(0.0), lambda total, ring: total + F.abs(polygons.signed_area(ring)))
    out = with_boxes(parts).withColumns({"height": F.col("z_max") - F.col("z_min"), "area": first - holes, "perimeter": _rings_total(polygons.perimeter)})
    return out.withColumns({"volume": F.col("area") * F.col("height"), "lateral_area": F.col("perimeter") * F.col("height")})


def solid_measures(parts: DataFrame) -> DataFrame:
    """One row for each object: area of the union of its footprints, sum of its parts' volumes, box, and centroid by volume."""
    m = part_measures(parts)
    cx, cy = polygons.centroid(F.col("rings")[0])
    m = m.withColumns({"cx": cx, "cy": cy})
    by_volume = lambda c: (F.sum(F.col(c) * F.col("volume")) / F.sum("volume"))
    total = m.groupBy("object_id").agg(F.count("*").alias("n_parts"), F.sum("volume").alias("volume"), F.sum("lateral_area").alias("lateral_area"), *(F.min(c).alias(c) for c in ("x0", "y0", "z_min")), *(F.max(c).alias(c) for c in ("x1", "y1", "z_max")), by_volume("cx").alias("cx"), by_volume("cy").alias("cy"), F.max("area").alias("one_area"))
    several = m.join(total.where("n_parts > 1").select("object_id"), "object_id", "left_semi")
    united = overlay.union_by(several, ["object_id"], "rings").select("object_id", F.col("area").alias("united"))
    return total.join(united, "object_id", "left").withColumn("area", F.coalesce("united", "one_area")).drop("united", "one_area")


def _named(parts: DataFrame, *columns: str) -> DataFrame:
    return with_boxes(parts).select("object_id", "part_no", "rings", "x0", "y0", "x1", "y1", "z_min", "z_max", *columns)


def shared_volumes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(a_object_id, b_object_id, volume, area, z_overlap)`` of all pairs of objects whose parts share space: parts' pairs add up.

    Of one table with itself, each pair is met once, its smaller id first.
    """
    own = _named(a)
    two = F.col("a_object_id") < F.col("b_object_id") if a is b else F.col("a_object_id") != F.col("b_object_id")
    pairs = box_pairs(own, own if a is b else _named(b)).where(two & (overlap("z") > 0) & (overlap("x") > 0) & (overlap("y") > 0))
    pairs = pairs.withColumn("area", overlay.shared(F.col("a_rings"), F.col("b_rings"))).where("area > 0")
    return pairs.withColumn("z", overlap("z")).groupBy("a_object_id", "b_object_id").agg(F.sum(F.col("area") * F.col("z")).alias("volume"), F.sum("area").alias("area"), F.max("z").alias("z_overlap"))


def intersections(a: DataFrame, b: DataFrame) -> DataFrame:
    """The parts that two tables of parts share: ``(a_object_id, b_object_id, rings, z_min, z_max)``."""
    pairs = box_pairs(_named(a), _named(b)).where((F.col("a_object_id") != F.col("b_object_id")) & (overlap("z") > EPS))
    out = pairs.select("a_object_id", "b_object_id", overlay.intersection(F.col("a_rings"), F.col("b_rings")).alias("rings"), F.greatest("a_z_min", "b_z_min").alias("z_min"), F.least("a_z_max", "b_z_max").alias("z_max"))
    return out.where(F.size("rings") > 0)


def clearances(a: DataFrame, b: DataFrame, most: float) -> DataFrame:
    """``(a_object_id, b_object_id, clearance)`` of objects not more than ``most`` apart in plan: the least over their parts."""
    near = box_pairs(_named(a), _named(b), grow=most).where(plan_distance() <= most)
    gap = F.greatest(F.lit(0.0), -overlap("z"))
    near = near.withColumn("plan", overlay.apart(F.col("a_rings"), F.col("b_rings"))).where(F.col("plan") <= most)
    return near.groupBy("a_object_id", "b_object_id").agg(F.min(F.hypot("plan", gap)).alias("clearance"))


def footprints(parts: DataFrame) -> DataFrame:
    """``(object_id, rings, area)``: each object's plan, the union of its parts' where it has several."""
    n = parts.groupBy("object_id").count()
    one = part_measures(parts.join(n.where("count = 1").select("object_id"), "object_id", "left_semi")).select("object_id", "rings", "area")
    several = parts.join(n.where("count > 1").select("object_id"), "object_id", "left_semi")
    return one.unionByName(overlay.union_by(several, ["object_id"], "rings").select("object_id", "rings", "area"))


def beyond_parent(parts: DataFrame, parents: DataFrame, grow: float = TOLERANCES["containment_buffer_m"], plans: DataFrame | None = None) -> DataFrame:
    """``(object_id, parent_id, outside)``: the area of each child's plan beyond its parent's, grown a little; plans are unions of parts, or ``plans`` if they are there already."""
    plans = stored(footprints(parts), "plans") if plans is None else plans
    up = plans.select(F.col("object_id").alias("parent_id"), F.col("rings").alias("p_rings"))
    pairs = parents.join(plans, "object_id").join(up, "parent_id")
    return pairs.select("object_id", "parent_id", overlay.outside(F.col("rings"), F.col("p_rings"), grow).alias("outside"))


def unclaimed(storeys: DataFrame, units: DataFrame) -> DataFrame:
    """``(object_id, floor, residue, rings)``: floor of each storey with units that none of them covers; ``units`` have parent_id."""
    own = units.select(F.col("parent_id").alias("object_id"), "rings")
    claimed = overlay.union_by(own, ["object_id"], "rings").select("object_id", F.col("rings").alias("claimed"))
    out = footprints(storeys).join(claimed, "object_id").withColumn("left", overlay.difference(F.col("rings"), F.col("claimed")))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda total, ring: total + polygons.signed_area(ring))
    return out.select("object_id", F.col("area").alias("floor"), size("left").alias("residue"), F.col("left").alias("rings"))


def best_shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each object of ``a`` the one of ``b`` with the largest shared plan area and their intersection over union; the smaller id of equals; null without any."""
    plans = lambda t: stored(with_boxes(footprints(t)), "plans")
    pairs = box_pairs(plans(a), plans(b)).withColumn("shared", overlay.shared(F.col("a_rings"), F.col("b_rings"))).where("shared > 0")
    rank = F.row_number().over(Window.partitionBy("a_object_id").orderBy(F.desc("shared"), "b_object_id"))
    best = pairs.withColumn("r", rank).where("r = 1").withColumn("area", F.col("shared"))
    best = best.select(F.col("a_object_id").alias("object_id"), F.col("b_object_id").alias("best_id"), F.col("area").alias("shared_m2"), (F.col("area") / (F.col("a_area") + F.col("b_area") - F.col("area"))).alias("iou"))
    return a.select("object_id").distinct().join(best, "object_id", "left")


def probe(parts: DataFrame, probes: DataFrame, with_z: bool = True) -> DataFrame:
    """``(probe_id, object_id)`` of points in parts, borders included, holes not; of columns through them without ``with_z``."""
    from .spatial import in_boxes

    met = in_boxes(probes, _named(parts))
    if with_z:
        met = met.where((F.col("z") >= F.col("z_min") - EPS) & (F.col("z") <= F.col("z_max") + EPS))
    inside = polygons.contains(F.col("rings")[0], F.col("x"), F.col("y"))
    edge = lambda ring: F.exists(polygons.edges(ring), lambda e: polygons.on_edge(e, F.col("x"), F.col("y")))
    in_hole = F.exists(F.slice("rings", 2, F.size("rings")), lambda ring: polygons.contains(ring, F.col("x"), F.col("y")) & ~edge(ring))
    return met.where(inside & ~in_hole).select("probe_id", "object_id", "z_min").distinct()


# ---- rules on parts; findings have the columns of those on boxes


def volumetric_overlap(parts: DataFrame, objects: DataFrame, tol: dict = TOLERANCES) -> DataFrame:
    """Units and corridors that share more than a trace of space; ``objects`` has object_id, kind, parent_id."""
    from .rules import finding

    kinds = objects.where(F.col("kind").isin("unit", "infrastructure")).select("object_id", "parent_id")
    own = parts.join(kinds.select("object_id"), "object_id", "left_semi")
    pairs = shared_volumes(own, own)
    up = lambda t: kinds.select(F.col("object_id").alias(f"{t}_object_id"), F.col("parent_id").alias(f"{t}_parent"))
    pairs = pairs.join(up("a"), "a_object_id").join(up("b"), "b_object_id")
    family = F.coalesce(F.col("a_parent") == F.col("b_object_id"), F.lit(False)) | F.coalesce(F.col("b_parent") == F.col("a_object_id"), F.lit(False))
    return finding(pairs.where(~family & (F.col("volume") > tol["overlap_volume_m3"])), "VERT_OVERLAP", "error", "a_object_id", "b_object_id", F.col("volume"), F.col("z_overlap"))


def plan_containment(parts: DataFrame, objects: DataFrame, tol: dict = TOLERANCES, plans: DataFrame | None = None) -> DataFrame:
    from .rules import finding

    parents = objects.where("parent_id is not null and kind <> 'air_rights'").select("object_id", "parent_id")
    out = beyond_parent(parts, parents, tol["containment_buffer_m"], plans).where(F.col("outside") > tol["containment_slack_m2"])
    return finding(out, "PLAN_CONTAINMENT", "error", "object_id", "parent_id", F.col("outside"))


def unassigned_area(parts: DataFrame, objects: DataFrame, tol: dict = TOLERANCES) -> DataFrame:
    from .rules import finding

    of = lambda kind: parts.join(objects.where(F.col("kind") == kind).select("object_id", "parent_id"), "object_id")
    left = unclaimed(of("storey"), of("unit")).where(F.col("residue") >= tol["gap_area_m2"])
    share = F.col("residue") / F.greatest(F.col("floor"), F.lit(1e-9))
    return finding(left, "UNASSIGNED_AREA", F.when(share > tol["common_area_fraction"], "warning").otherwise("info"), "object_id", None, F.col("residue"), share)


def corridor_clearance(parts: DataFrame, objects: DataFrame, tol: dict = TOLERANCES) -> DataFrame:
    from .rules import finding

    c = tol["clearance_m"]
    of = lambda *kinds: parts.join(objects.where(F.col("kind").isin(*kinds)).select("object_id"), "object_id", "left_semi")
    kind = objects.where("kind = 'infrastructure'").select(F.col("object_id").alias("a_object_id"), "corridor_kind")
    near = clearances(of("infrastructure"), of("building", "unit"), max(c.values())).join(kind, "a_object_id")
    need = lookup(F.col("corridor_kind"), {k: v for k, v in c.items() if k != "default"}, c["default"])
    near = near.withColumn("need", need).where("clearance < need")
    return finding(near, "INFRA_CLEARANCE", F.when(F.col("clearance") <= EPS, "error").otherwise("warning"), "b_object_id", "a_object_id", F.col("clearance"), F.col("need"))


def geometry_validity(parts: DataFrame) -> DataFrame:
    """Parts whose footprint is empty or crosses itself, or that have no height."""
    from .rules import finding

    m = part_measures(parts)
    empty, crossing, flat = F.coalesce(F.col("area"), F.lit(0.0)) <= 1e-6, overlay.self_crossing(F.col("rings")), F.col("height") <= EPS
    rule = F.when(F.col("crossing"), "GEOM_INVALID").when(empty, "GEOM_EMPTY").when(flat, "GEOM_FLAT")
    return finding(m.withColumn("crossing", crossing).withColumn("bad", rule).where("bad is not null"), F.col("bad"), "error", "object_id", None, F.col("volume"))


def validate(parts: DataFrame, objects: DataFrame, tol: dict = TOLERANCES) -> DataFrame:
    """All findings on objects of any plan, with the severity's rank.

    ``objects`` has object_id, kind and parent_id, and of the register's other columns what
    is known. Rules on shapes take parts and their unions; those on heights and records take
    each object's box and plan area.
    """
    from functools import reduce

    from . import rules

    kinds = {"seq": "long", "level": "int", "provenance": "string", "confidence": "double", "corridor_kind": "string", "recorded_area_m2": "double", "storeys_above_ground": "int", "storey_estimate_from_scan": "int", "floor_height_m": "double", "facade_periodicity": "double"}
    known = objects.select("*", *(F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in objects.columns)).drop("x0", "y0", "x1", "y1", "z_min", "z_max", "plan_area")
    boxes = with_boxes(parts).groupBy("object_id").agg(*(F.min(c).alias(c) for c in ("x0", "y0", "z_min")), *(F.max(c).alias(c) for c in ("x1", "y1", "z_max")))
    # unions, boxes and records are read by many rules each, and found once
    plans = stored(footprints(parts), "plans")
    boxed = stored(known.join(boxes, "object_id", "left").join(plans.select("object_id", F.col("area").alias("plan_area")), "object_id", "left"), "boxed")
    known = boxed.select(*known.columns)
    size = F.col("plan_area")
    found = [
        geometry_validity(parts), volumetric_overlap(parts, known, tol), rules.orphan_findings(known), plan_containment(parts, known, tol, plans), rules.vertical_containment(boxed, tol), rules.storey_continuity(boxed, tol),
        unassigned_area(parts, known, tol), corridor_clearance(parts, known, tol), rules.area_mismatch(boxed, tol, size), rules.unauthorised_storeys(boxed, tol, size), rules.provenance_review(known, tol),
    ]
    if "code" in objects.columns:
        found.append(rules.identifier_integrity(known))
    return reduce(DataFrame.unionByName, found).withColumn("rank", lookup(F.col("severity"), SEVERITIES))


# ---- documents


def document(parts: DataFrame, places: int = 4) -> DataFrame:
    """``(object_id, solid)``: an object's parts as a JSON text, rings closed and rounded."""
    r = lambda c: F.bround(c, places)
    closed = F.transform("rings", lambda ring: F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(r(p["x"]), r(p["y"]))))
    part = F.struct("part_no", closed.alias("rings"), r(F.col("z_min")).alias("z_min"), r(F.col("z_max")).alias("z_max"))
    all_ = parts.groupBy("object_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return all_.select("object_id", F.to_json(F.struct(F.when(F.size("parts") > 1, "composite").otherwise("prism").alias("type"), "parts")).alias("solid"))


def from_document(documents: DataFrame) -> DataFrame:
    """The parts of ``(object_id, solid)``; heights that stand upside down are turned."""
    schema = "type string, parts array<struct<part_no:int,rings:array<array<array<double>>>,z_min:double,z_max:double>>"
    p = documents.select("object_id", F.explode(F.from_json("solid", schema)["parts"]).alias("p"))
    ring = F.transform("p.rings", lambda ring: F.transform(F.slice(ring, 1, F.size(ring) - 1), lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))))
    return p.select("object_id", "p.part_no", ring.alias("rings"), F.least("p.z_min", "p.z_max").alias("z_min"), F.greatest("p.z_min", "p.z_max").alias("z_max"))


def meshes(parts: DataFrame) -> DataFrame:
    """What a viewer extrudes: rings and heights of each part, to three places."""
    ring = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(F.bround(p["x"], 3), F.bround(p["y"], 3))))
    return parts.select("object_id", "part_no", ring.alias("rings"), F.bround("z_min", 3).alias("z_min"), F.bround("z_max", 3).alias("z_max"))
