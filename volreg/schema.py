"""Columns of a register, its enumerations and the rules' tolerances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A register: one row for each volume. ``seq`` is the order of entry, the last tie-breaker everywhere.
OBJECT_COLUMNS = [
    "seq", "object_id", "kind", "parent_id", "name", "owner", "use", "level", "stratum", "provenance", "confidence",
    "x0", "y0", "x1", "y1", "z_min", "z_max", "corridor_kind", "recorded_area_m2", "storeys_above_ground",
    "storey_estimate_from_scan", "floor_height_m", "facade_periodicity",
]

# Kinds with their default layer; layers with labels; origins with their weight; severities in order.
KINDS = {"parcel": "G", "building": "G", "storey": "B", "unit": "B", "infrastructure": "I", "air_rights": "A"}
STRATA = {"G": "Surface parcel", "B": "Above-ground unit", "U": "Sub-surface unit", "A": "Air rights", "I": "Infrastructure corridor"}
AUTHORITATIVE = ["surveyed", "approved_plan", "existing_record"]
PROVENANCES = [*AUTHORITATIVE, "extracted", "derived", "assumed"]
SEVERITIES = {"error": 0, "warning": 1, "info": 2}

# Tolerances of the rules.
TOLERANCES = {
    "overlap_volume_m3": 0.05,
    "containment_slack_m2": 0.25,
    "containment_buffer_m": 0.05,
    "containment_z_m": 0.05,
    "gap_area_m2": 1.0,
    "common_area_fraction": 0.42,
    "storey_join_m": 0.15,
    "area_mismatch_pct": 5.0,
    "periodicity": 0.25,
    "low_confidence": 0.6,
    "clearance_m": {"metro": 3.0, "water": 1.0, "storm": 1.0, "power": 1.5, "default": 1.0},
}
EPS = 0.001


def lookup(key: Column, values: dict, default=None) -> Column:
    """A small fixed mapping as one CASE; no join."""
    out = F
    for k, v in values.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def severity_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEVERITIES.items()), "severity string, rank int")
