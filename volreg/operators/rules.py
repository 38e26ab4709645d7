"""The validation rules: each gives findings, one row each.

A finding has the rule's name, a severity, one or two objects, a measure in the rule's
unit and a second number for context.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AUTHORITATIVE, EPS, SEVERITIES, TOLERANCES, lookup
from .register import area, of_kind, volume
from .spatial import box_pairs, clearance, overlap, plan_distance, shared_area, shared_volume

FINDING = "rule string, severity string, object_a string, object_b string, measure double, context double"


def finding(df: DataFrame, rule: str | Column, severity: str | Column, a: str, b: str | None, measure: Column, context: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(lit(rule).alias("rule"), lit(severity).alias("severity"), F.col(a).alias("object_a"), (F.col(b) if b else F.lit(None).cast("string")).alias("object_b"), measure.cast("double").alias("measure"), (F.lit(None) if context is None else context).cast("double").alias("context"))


def volumetric_overlap(objects: DataFrame, tol: dict = TOLERANCES) -> DataFrame:
    """No two units or corridors share more than a trace of space; parents and children may."""
    own = of_kind(objects, "unit", "infrastructure").select("object_id", "parent_id", "seq", "x0", "y0", "x1", "y1", "z_min", "z_max")
    pairs = box_pairs(own, own).where(((F.col("a_x0") < F.col("b_x0")) | ((F.col("a_x0") == F.col("b_x0")) & (F.col("a_seq") < F.col("b_seq")))) & (overlap("z") > 0))
    family = F.coalesce(F.col("a_parent_id") == F.col("b_object_id"), F.lit(False)) | F.coalesce(F.col("b_parent_id") == F.col("a_object_id"), F.lit(False))
    return finding(pairs.where(~family & (shared_volume() > tol["overlap_volume_m3"])), "VERT_OVERLAP", "error", "a_object_id", "b_object_id", shared_volume(), overlap("z"))


def _with_parent(objects: DataFrame) -> DataFrame:
    parent = objects.select(F.col("object_id").alias("parent_id"), F.col("kind").alias("p_kind"), *(F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1", "z_min", "z_max")))
    return objects.where("parent_id is not null and kind <> 'air_rights'").join(parent, "parent_id")


def _plan_beyond(tol: dict) -> tuple[Column, Column, Column]:
    """Of a child with its parent: whether its plan leaves the parent's, by how much, and of how much."""
    grow = tol["containment_buffer_m"]
    inside = F.greatest(F.lit(0.0), F.least("x1", F.col("p_x1") + grow) - F.greatest("x0", F.col("p_x0") - grow)) * F.greatest(F.lit(0.0), F.least("y1", F.col("p_y1") + grow) - F.greatest("y0", F.col("p_y0") - grow))
    return area() - inside > tol["containment_slack_m2"], area() - inside, area()


def _height_beyond(tol: dict) -> tuple[Column, Column, Column]:
    z = tol["containment_z_m"]
    below, above = F.col("p_z_min") - F.col("z_min"), F.col("z_max") - F.col("p_z_max")
    off = (F.col("p_kind") != "parcel") & ((F.col("z_min") < F.col("p_z_min") - z) | (F.col("z_max") > F.col("p_z_max") + z))
    return off, F.greatest(below, above), F.least(below, above)


def plan_containment(objects: DataFrame, tol: dict = TOLERANCES) -> DataFrame:
    """A child's plan lies within its parent's, grown a little."""
    off, measure, context = _plan_beyond(tol)
    return finding(_with_parent(objects).where(off), "PLAN_CONTAINMENT", "error", "object_id", "parent_id", measure, context)


def vertical_containment(objects: DataFrame, tol: dict = TOLERANCES) -> DataFrame:
    """A child's height lies within its parent's; parcels bound nothing upwards."""
    off, measure, context = _height_beyond(tol)
    return finding(_with_parent(objects).where(off), "VERT_CONTAINMENT", "error", "object_id", "parent_id", measure, context)


def containment(objects: DataFrame, tol: dict = TOLERANCES) -> DataFrame:
    """What ``plan_containment`` and ``vertical_containment`` find, from one join with the parents: it shuffles all objects."""
    row = lambda rule, f: F.when(f[0], F.struct(F.lit(rule).alias("rule"), f[1].cast("double").alias("measure"), f[2].cast("double").alias("context")))
    found = F.array_compact(F.array(row("PLAN_CONTAINMENT", _plan_beyond(tol)), row("VERT_CONTAINMENT", _height_beyond(tol))))
    out = _with_parent(objects).select("object_id", "parent_id", F.explode(found).alias("f"))
    return finding(out, F.col("f.rule"), "error", "object_id", "parent_id", F.col("f.measure"), F.col("f.context"))


def orphan_findings(objects: DataFrame) -> DataFrame:
    from .hierarchy import orphans

    return finding(orphans(objects), "HIER_ORPHAN", "error", "object_id", "parent_id", F.lit(None))


def storey_continuity(objects: DataFrame, tol: dict = TOLERANCES) -> DataFrame:
    """Consecutive storeys of a building meet."""
    w = Window.partitionBy("parent_id").orderBy("level", "seq")
    s = of_kind(objects, "storey").where("parent_id is not null").withColumns({"upper": F.lead("object_id").over(w), "gap": F.lead("z_min").over(w) - F.col("z_max")})
    s = s.where(F.abs("gap") > tol["storey_join_m"])
    up = F.col("gap") > 0
    return finding(s, F.when(up, "STOREY_GAP").otherwise("STOREY_OVERLAP"), F.when(up, "warning").otherwise("error"), "object_id", "upper", F.abs("gap"))


def _union_area(boxes: Column) -> Column:
    """Area of the union of a few boxes (x0, y0, x1, y1): strips between the distinct x, covered lengths in each."""
    xs = F.array_sort(F.array_distinct(F.concat(F.transform(boxes, lambda b: b["x0"]), F.transform(boxes, lambda b: b["x1"]))))
    strips = F.transform(F.sequence(F.lit(1), F.size(xs) - 1), lambda i: F.struct(F.element_at(xs, i).alias("a"), F.element_at(xs, i + 1).alias("b")))

    def covered(strip: Column) -> Column:
        over = F.array_sort(F.transform(F.filter(boxes, lambda b: (b["x0"] <= strip["a"]) & (b["x1"] >= strip["b"])), lambda b: F.struct(b["y0"].alias("lo"), b["y1"].alias("hi"))))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("end"))
        step = lambda acc, y: F.struct((acc["sum"] + F.greatest(F.lit(0.0), y["hi"] - F.greatest(y["lo"], acc["end"]))).alias("sum"), F.greatest(acc["end"], y["hi"]).alias("end"))
        return F.aggregate(over, start, step, lambda acc: acc["sum"])

    return F.aggregate(strips, F.lit(0.0), lambda total, s: total + (s["b"] - s["a"]) * covered(s))


def unassigned_area(objects: DataFrame, tol: dict = TOLERANCES) -> DataFrame:
    """Floor that no unit of a storey claims, from the union of the units' plans."""
    storey = of_kind(objects, "storey").select("object_id", area().alias("floor"), "x0", "y0", "x1", "y1")
    units = of_kind(objects, "unit").select(F.col("parent_id").alias("object_id"), *(F.col(c).alias(f"u_{c}") for c in ("x0", "y0", "x1", "y1")))
    clipped = storey.join(units, "object_id").select("object_id", "floor", F.struct(F.greatest("x0", "u_x0").alias("x0"), F.greatest("y0", "u_y0").alias("y0"), F.least("x1", "u_x1").alias("x1"), F.least("y1", "u_y1").alias("y1")).alias("box"))
    # a storey's units are few
    by = clipped.groupBy("object_id", "floor").agg(F.collect_list(F.when((F.col("box.x0") < F.col("box.x1")) & (F.col("box.y0") < F.col("box.y1")), F.col("box"))).alias("boxes"))
    left = by.withColumn("residue", F.col("floor") - F.when(F.size("boxes") > 0, _union_area(F.col("boxes"))).otherwise(0.0)).where(F.col("residue") >= tol["gap_area_m2"])
    share = F.col("residue") / F.greatest(F.col("floor"), F.lit(1e-9))
    return finding(left, "UNASSIGNED_AREA", F.when(share > tol["common_area_fraction"], "warning").otherwise("info"), "object_id", None, F.col("residue"), share)


def corridor_clearance(objects: DataFrame, tol: dict = TOLERANCES) -> DataFrame:
    """Buildings and units keep a distance from corridors that depends on the corridor's kind."""
    c = tol["clearance_m"]
    most = max(c.values())
    corridors = of_kind(objects, "infrastructure").select("object_id", "corridor_kind", "x0", "y0", "x1", "y1", "z_min", "z_max")
    structures = of_kind(objects, "building", "unit").select("object_id", "x0", "y0", "x1", "y1", "z_min", "z_max")
    need = lookup(F.col("a_corridor_kind"), {k: v for k, v in c.items() if k != "default"}, c["default"])
    near = box_pairs(corridors, structures, grow=most).withColumns({"need": need, "d": clearance()}).where((plan_distance() <= F.col("need")) & (F.col("d") < F.col("need")))
    return finding(near, "INFRA_CLEARANCE", F.when(F.col("d") <= EPS, "error").otherwise("warning"), "b_object_id", "a_object_id", F.col("d"), F.col("need"))


def identifier_integrity(objects: DataFrame, code: str = "code") -> DataFrame:
    """Codes are there and unique; a double is paired with the latest earlier holder."""
    w = Window.partitionBy(code).orderBy("seq")
    held = objects.where(F.col(code).isNotNull()).withColumn("earlier", F.lag("object_id").over(w)).where("earlier is not null")
    return finding(objects.where(F.col(code).isNull()), "CODE_MISSING", "error", "object_id", None, F.lit(None)).union(finding(held, "CODE_DUPLICATE", "error", "object_id", "earlier", F.lit(None)))


def area_mismatch(objects: DataFrame, tol: dict = TOLERANCES, size: Column | None = None) -> DataFrame:
    r, size = F.col("recorded_area_m2"), area() if size is None else size
    off = objects.where(r.isNotNull() & (r != 0)).withColumn("pct", 100.0 * F.abs(size - r) / r).where(F.col("pct") > tol["area_mismatch_pct"])
    return finding(off, "AREA_MISMATCH", "warning", "object_id", None, F.bround("pct", 2), r)


def unauthorised_storeys(objects: DataFrame, tol: dict = TOLERANCES, size: Column | None = None) -> DataFrame:
    """More storeys scanned than sanctioned; the extra volume goes with the finding."""
    extra = F.col("storey_estimate_from_scan") - F.col("storeys_above_ground")
    b = of_kind(objects, "building").withColumn("extra", extra).where("extra > 0")
    sure = F.coalesce("facade_periodicity", F.lit(0.0)) >= tol["periodicity"]
    return finding(b, "UNAUTHORISED_STOREY", F.when(sure, "error").otherwise("warning"), "object_id", None, F.col("extra"), F.col("extra") * F.coalesce("floor_height_m", F.lit(3.0)) * (area() if size is None else size))


def provenance_review(objects: DataFrame, tol: dict = TOLERANCES) -> DataFrame:
    """One summary of inferred boundaries: the first by entry, their number, and how many are weak."""
    inferred = ~F.col("provenance").isin(AUTHORITATIVE)
    s = objects.agg(F.count_if(inferred).alias("n"), F.count_if(inferred & (F.col("confidence") < tol["low_confidence"])).alias("weak"), F.min_by("object_id", F.when(inferred, F.col("seq"))).alias("first")).where("n > 0")
    return finding(s, "PROVENANCE_REVIEW", "info", "first", None, F.col("n"), F.col("weak"))


def geometry_validity(objects: DataFrame) -> DataFrame:
    flat, empty = F.col("z_max") - F.col("z_min") <= EPS, (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    rule = F.when(empty, "GEOM_EMPTY").when(flat, "GEOM_FLAT").when(volume() <= 0, "GEOM_NO_VOLUME")
    return finding(objects.withColumn("bad", rule).where("bad is not null"), F.col("bad"), "error", "object_id", None, volume())


RULES = [geometry_validity, volumetric_overlap, orphan_findings, plan_containment, vertical_containment, storey_continuity, unassigned_area, corridor_clearance, area_mismatch, unauthorised_storeys, provenance_review]


def validate(objects: DataFrame) -> DataFrame:
    """All findings with the severity's rank; order by (rank, rule, object_a, object_b) to list them. Codes are judged where the register has them."""
    # the two rules on parents share their join
    rules = [containment, *(r for r in RULES if r not in (plan_containment, vertical_containment))]
    rules += [identifier_integrity] if "code" in objects.columns else []
    return reduce(DataFrame.unionByName, (rule(objects) for rule in rules)).withColumn("rank", lookup(F.col("severity"), SEVERITIES))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Counts of all three severities, 0 where there is none."""
    spark = findings.sparkSession
    every = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    n = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return every.join(F.broadcast(n), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def findings_for(findings: DataFrame, objects: DataFrame) -> DataFrame:
    """``(object_id, rule, object_a, object_b)``: findings on each object or on its parent, each once."""
    mentioned = findings.select("rule", "object_a", "object_b", F.explode(F.array_distinct(F.array_compact(F.array("object_a", "object_b")))).alias("on"))
    who = objects.select("object_id", F.explode(F.array_compact(F.array("object_id", "parent_id"))).alias("on"))
    return mentioned.join(who, "on").select("object_id", "rule", "object_a", "object_b").distinct()
