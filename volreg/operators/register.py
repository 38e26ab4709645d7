"""Filters, lookups, search and totals of a register."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AUTHORITATIVE, KINDS, PROVENANCES, lookup


def area() -> Column:
    return (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))


def volume() -> Column:
    return area() * (F.col("z_max") - F.col("z_min"))


def of_kind(objects: DataFrame, *kinds: str) -> DataFrame:
    return objects.where(F.col("kind").isin(*kinds))


def list_objects(objects: DataFrame, kinds: list[str] | None = None, level: int | None = None, parent: str | None = None, limit: int = 5000) -> DataFrame:
    """Rows that meet all given conditions, in order of entry, up to the page's limit."""
    conditions = [F.col("kind").isin(kinds)] if kinds else []
    conditions += [F.col("level") == level] if level is not None else []
    conditions += [F.col("parent_id") == parent] if parent is not None else []
    return reduce(DataFrame.where, conditions, objects).orderBy("seq").limit(limit)


def add(objects: DataFrame, new: DataFrame) -> DataFrame:
    """The register with new rows; an id that is there already is an error when the rows are read."""
    both = objects.unionByName(new)
    twice = both.groupBy("object_id").agg(F.count("*").alias("n"))
    checked = both.join(twice, "object_id")
    return checked.where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("object id already in the register: "), "object_id")).cast("boolean")).otherwise(True)).drop("n").select(objects.columns)


def search(objects: DataFrame, text: str, limit: int = 40) -> DataFrame:
    """Case-folded substring search: an equal id first, then ids that begin so, then names, then the rest."""
    q = text.strip().lower()
    if not q:
        return objects.select("object_id", "kind", "name", "owner", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("n_found")).limit(0)
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("object_id", "name", "owner", "use", "kind")}
    found = objects.where(F.concat_ws(" ", *low.values()).contains(q))
    rank = F.when(low["object_id"] == q, 0).when(low["object_id"].startswith(q), 1).when(low["name"].contains(q), 2).otherwise(3)
    # all that are found are counted before the limit
    total = found.agg(F.count("*").alias("n_found"))
    top = found.select("object_id", "kind", "name", "owner", rank.alias("rank")).orderBy("rank", "object_id").limit(limit)
    return top.crossJoin(F.broadcast(total))  # one row by construction


def stats(objects: DataFrame) -> DataFrame:
    """Counts by kind and by origin, and totals, in one pass: ``(dimension, value, n, unit_area_m2, unit_volume_m3, z_low, z_high)``."""
    unit = F.col("kind") == "unit"
    base = objects.withColumns({"a": F.when(unit, area()), "v": F.when(unit, volume())})
    grouped = base.groupingSets([["kind"], ["provenance"], []], "kind", "provenance").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.bround(F.sum("a"), 2).alias("unit_area_m2"), F.bround(F.sum("v"), 2).alias("unit_volume_m3"), *([F.count("code").alias("n_codes")] if "code" in objects.columns else []), F.least(F.min("z_min"), F.min("z_max")).alias("z_low"), F.greatest(F.max("z_min"), F.max("z_max")).alias("z_high"))
    name = F.when(F.col("g") == 1, "kind").when(F.col("g") == 2, "provenance").otherwise("all")
    return grouped.select(name.alias("dimension"), F.coalesce("kind", "provenance", F.lit("all")).alias("value"), "n", "unit_area_m2", "unit_volume_m3", *(["n_codes"] if "code" in objects.columns else []), "z_low", "z_high")


def extent(objects: DataFrame) -> DataFrame:
    return objects.agg(*(F.min(c).alias(c) for c in ("x0", "y0", "z_min")), *(F.max(c).alias(c) for c in ("x1", "y1", "z_max")), F.count("*").alias("n"))


def payload(objects: DataFrame) -> DataFrame:
    """The measures shown with an object, rounded to three places (half to even)."""
    r = lambda c: F.bround(c, 3)
    return objects.select(
        "object_id", "kind", "stratum", lookup(F.col("kind"), KINDS).alias("default_stratum"), F.col("provenance").isin(AUTHORITATIVE).alias("authoritative"), r(F.col("confidence")).alias("confidence"), r(area()).alias("area_m2"), r(volume()).alias("volume_m3"), r(F.col("z_max") - F.col("z_min")).alias("height_m"),
        r((F.col("x0") + F.col("x1")) / 2).alias("cx"), r((F.col("y0") + F.col("y1")) / 2).alias("cy"), r((F.col("z_min") + F.col("z_max")) / 2).alias("cz"))


def unknown_enumerations(objects: DataFrame) -> DataFrame:
    return objects.where(~F.col("kind").isin(*KINDS) | ~F.col("provenance").isin(*PROVENANCES))
