"""Identifiers in a register, answers to lookups by them, and findings as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import idcode
from ..schema import SEVERITIES, lookup


def coded(objects: DataFrame, lat: Column, lon: Column, state: str, district: str, tehsil: str) -> DataFrame:
    """``objects`` with ``geohash``, ``unit`` and ``code``: units are numbered in order of entry within a cell, layer and level."""
    placed = objects.withColumns({"geohash": idcode.geohash_encode(lat, lon), "code_level": F.abs("level")})
    units = idcode.mint_units(placed, ["geohash", "stratum", "code_level"], ["seq"])
    code = idcode.compact(F.lit(state), F.lit(district), F.lit(tehsil), F.col("geohash"), F.col("stratum"), F.col("code_level"), F.col("unit"))
    return units.withColumn("code", code).drop("code_level")


def by_code(objects: DataFrame, inputs: DataFrame, text: str = "code_text") -> DataFrame:
    """``inputs`` with what is wrong with a code, or the object that was entered first with it; codes may be in any spelling."""
    asked = inputs.withColumn("problem", idcode.problem(F.col(text))).withColumn("wanted", F.when(F.col("problem").isNull(), idcode.normalised(F.col(text))))
    first = objects.where("code is not null").groupBy(F.col("code").alias("wanted")).agg(F.min_by("object_id", "seq").alias("object_id"))
    return asked.join(first, "wanted", "left").withColumn("found", F.col("object_id").isNotNull()).drop("wanted")


def issue(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests (request_id, code, owner)`` with ``holder`` and ``verdict``: new, held (by the same owner) or taken.

    A code goes to whoever is in the register with it first, then to the smallest request.
    """
    there = objects.where("code is not null").groupBy("code").agg(F.min_by("owner", "seq").alias("holder"))
    known = requests.join(there, "code", "left")
    first = F.min_by("owner", "request_id").over(Window.partitionBy("code"))
    rank = F.row_number().over(Window.partitionBy("code").orderBy("request_id"))
    known = known.withColumns({"new": F.col("holder").isNull() & (rank == 1), "holder": F.coalesce("holder", first)})
    return known.withColumn("verdict", F.when(F.col("new"), "new").when(F.col("holder") == F.col("owner"), "held").otherwise("taken")).drop("new")


def search(objects: DataFrame, text: str, limit: int = 40) -> DataFrame:
    """Search over ids, names, owners, uses, kinds and codes; a whole code that an object has is the only answer."""
    from .register import search as plain

    whole = idcode.normalised(F.lit(text))
    exact = objects.where(idcode.problem(F.lit(text)).isNull() & (F.col("code") == whole)).orderBy("seq").limit(1)
    one = exact.select("object_id", "kind", "name", "owner", F.lit(0).alias("rank"), F.lit(1).cast("long").alias("n_found"))
    low = objects.withColumn("name_", F.col("name"))
    rest = plain(low.withColumn("use", F.concat_ws(" ", "use", "code")), text, limit)
    return one.union(rest.join(F.broadcast(one.agg(F.count("*").alias("one"))), F.col("one") == 0).drop("one"))


#: Parts of a finding's text: title, then its sentence with the measure and the context put in.
TEXTS = {
    "VERT_OVERLAP": ("Volumes overlap", "%a and %b share %m m3 over %c m of height"),
    "PLAN_CONTAINMENT": ("Plan reaches beyond its parent", "%m m2 of %a lie outside %b"),
    "VERT_CONTAINMENT": ("Height reaches beyond its parent", "%a reaches %m m beyond %b"),
    "HIER_ORPHAN": ("Parent is absent", "%a names %b, which is not in the register"),
    "STOREY_GAP": ("Gap between storeys", "%m m lie between %a and %b"),
    "STOREY_OVERLAP": ("Storeys overlap", "%a and %b overlap by %m m"),
    "UNASSIGNED_AREA": ("Floor without owner", "%m m2 of %a belong to no unit"),
    "INFRA_CLEARANCE": ("Too close to a corridor", "%a is %m m from %b, %c m are needed"),
    "CODE_MISSING": ("No identifier", "%a has no identifier"),
    "CODE_DUPLICATE": ("Identifier is used twice", "%a has the identifier of %b"),
    "AREA_MISMATCH": ("Recorded area differs", "%a differs by %m percent from its recorded %c m2"),
    "UNAUTHORISED_STOREY": ("More storeys than sanctioned", "%a has %m storeys more, %c m3"),
    "PROVENANCE_REVIEW": ("Boundaries to confirm", "%m objects are inferred, %c of them weakly"),
    "GEOM_EMPTY": ("Empty footprint", "%a has no area"),
    "GEOM_FLAT": ("No height", "%a has no height"),
    "GEOM_NO_VOLUME": ("No volume", "%a has no volume"),
}

#: Names of a finding's numbers.
MEASURES = {
    "VERT_OVERLAP": ("overlap_volume_m3", "z_overlap_m"), "PLAN_CONTAINMENT": ("outside_area_m2", "area_m2"), "VERT_CONTAINMENT": ("beyond_m", "other_side_m"), "STOREY_GAP": ("gap_m", None), "STOREY_OVERLAP": ("overlap_m", None),
    "UNASSIGNED_AREA": ("unassigned_area_m2", "fraction"), "INFRA_CLEARANCE": ("clearance_m", "required_m"), "AREA_MISMATCH": ("error_pct", "recorded_area_m2"), "UNAUTHORISED_STOREY": ("unauthorised_storeys", "unregistered_volume_m3"), "PROVENANCE_REVIEW": ("inferred", "low_confidence"),
}

BOX = ("x0", "y0", "x1", "y1", "z_min", "z_max")


def number(x: Column) -> Column:
    """To three places, half to even."""
    return F.format_string("%.3f", F.bround(x, 3) + 0.0)


def described(findings: DataFrame, objects: DataFrame) -> DataFrame:
    """Findings with title, detail, ``objects`` (a list), ``measure`` (names to numbers) and ``geometry``: where two objects meet, or the first one's box."""
    text = lookup(F.col("rule"), {k: v[1] for k, v in TEXTS.items()}, "")
    put = lambda t, mark, value: F.replace(t, F.lit(mark), F.coalesce(value, F.lit("-")))
    detail = put(put(put(put(text, "%m", number(F.col("measure"))), "%c", number(F.col("context"))), "%a", F.col("object_a")), "%b", F.col("object_b"))
    names = [lookup(F.col("rule"), {k: v[i] for k, v in MEASURES.items() if v[i]}) for i in (0, 1)]
    pairs = F.array(*(F.struct(n.alias("key"), F.bround(F.col(c), 3).alias("value")) for n, c in zip(names, ("measure", "context"), strict=True)))
    measure = F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull()))
    box = lambda t: objects.select(F.col("object_id").alias(f"object_{t}"), F.struct(*BOX).alias(f"box_{t}"))
    # texts come last, so that the joins shuffle findings without them
    out = findings.join(box("a"), "object_a", "left").join(box("b"), "object_b", "left")
    out = out.withColumns({"title": lookup(F.col("rule"), {k: v[0] for k, v in TEXTS.items()}, ""), "detail": detail, "objects": F.array_compact(F.array("object_a", "object_b")), "measures": measure})
    both = {"VERT_OVERLAP"}
    lo = lambda c: F.greatest(F.col(f"box_a.{c}"), F.col(f"box_b.{c}"))
    hi = lambda c: F.least(F.col(f"box_a.{c}"), F.col(f"box_b.{c}"))
    shared = F.struct(*(f(c).alias(c) for f, c in ((lo, "x0"), (lo, "y0"), (hi, "x1"), (hi, "y1"), (lo, "z_min"), (hi, "z_max"))))
    return out.withColumn("geometry", F.when(F.col("rule").isin(*both), shared).otherwise(F.col("box_a"))).drop("box_a", "box_b")


def filtered(findings: DataFrame, severity: str | None = None, rule: str | None = None) -> DataFrame:
    """The findings that are asked for; counts of a report stay those of all."""
    out = findings if severity is None else findings.where(F.col("severity") == severity)
    return out if rule is None else out.where(F.col("rule") == rule)


def checked(findings: DataFrame, objects: DataFrame, rules_run: int) -> DataFrame:
    """One row: how much was checked, the findings by severity, and whether the register is valid (has no error)."""
    n = objects.agg(F.count("*").alias("objects"), *(F.count_if(F.col("kind") == k).alias(f"{k}_objects") for k in ("unit", "storey", "building", "infrastructure")))
    s = findings.agg(*(F.count_if(F.col("severity") == k).alias(f"n_{k}") for k in SEVERITIES))
    return n.crossJoin(s).withColumns({"rules_run": F.lit(rules_run), "valid": F.col("n_error") == 0})  # one row each


def first_inferred(objects: DataFrame, authoritative: list[str], most: int = 50) -> DataFrame:
    """The first inferred objects by entry, and their place."""
    top = objects.where(~F.col("provenance").isin(authoritative)).orderBy("seq").limit(most)
    return top.select("object_id", F.row_number().over(Window.orderBy("seq")).alias("place"))  # at most ``most`` rows


def resolved(positions: DataFrame, origin) -> DataFrame:
    """``positions (x, y, lat, lon)`` with local ``px`` and ``py``: given ones, or from degrees; without either an error."""
    e, n, _ = origin.forward(F.col("lat"), F.col("lon"), F.lit(0.0))
    given, degrees = F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("lat").isNotNull() & F.col("lon").isNotNull()
    missing = F.raise_error(F.lit("give x and y, or lat and lon")).cast("double")
    pick = lambda own, other: F.when(given, F.col(own)).when(degrees, other).otherwise(missing)
    return positions.withColumns({"px": pick("x", e), "py": pick("y", n)})


def details(objects: DataFrame, origin) -> DataFrame:
    """Each object's centroid in degrees, how many children it has, and its ancestors, nearest first."""
    from .hierarchy import ancestors, children

    lat, lon, _ = origin.inverse((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.lit(0.0))
    up = ancestors(objects).groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("distance", "ancestor_id"))).alias("up"))  # as many as the hierarchy is deep
    below = children(objects).select("object_id", "n_children")
    out = objects.join(up, "object_id", "left").join(below, "object_id", "left")
    return out.select("object_id", lat.alias("lat"), lon.alias("lon"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce(F.array_join(F.transform("up", lambda x: x["ancestor_id"]), ","), F.lit("")).alias("ancestors"))


def conflicts(objects: DataFrame) -> DataFrame:
    """Codes that several owners hold: a register with any is refused."""
    by = objects.where("code is not null").groupBy("code").agg(F.count_distinct("owner").alias("n_owners"), F.count("*").alias("n_objects"), F.min_by("object_id", "seq").alias("first_object"))
    return by.where("n_owners > 1")
