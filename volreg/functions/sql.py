"""The library's functions for SQL users: ``register_functions(spark)``, then plain ``spark.sql``.

Scalars are SQL functions, so Catalyst puts their bodies into the query; corridor parts are
a table function that takes a table's partitions in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..shared import on_workers
from .idcode import BASE36, GEOHASH

_RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
_UP = "IF(i % 2 = 0, lon > (s.c + s.d) / 2, lat > (s.a + s.b) / 2)"
_V = f"(s.v * 2 + IF({_UP}, 1, 0))"
_HALVES = f"""named_struct(
 'a', IF(i % 2 = 1 AND {_UP}, (s.a + s.b) / 2, s.a), 'b', IF(i % 2 = 1 AND NOT {_UP}, (s.a + s.b) / 2, s.b),
 'c', IF(i % 2 = 0 AND {_UP}, (s.c + s.d) / 2, s.c), 'd', IF(i % 2 = 0 AND NOT {_UP}, (s.c + s.d) / 2, s.d),
 'v', IF(i % 5 = 4, 0, {_V}), 'code', IF(i % 5 = 4, concat(s.code, substr('{GEOHASH}', {_V} + 1, 1)), s.code))"""
_EDGE = "(r[i - 1].x * r[i % size(r)].y - r[i % size(r)].x * r[i - 1].y)"

#: Name with arguments, result, body.
FUNCTIONS = {
    "volreg_geohash(lat DOUBLE, lon DOUBLE, places INT)": ("STRING", f"""CASE WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN
 aggregate(sequence(0, 5 * places - 1), named_struct('a', -90D, 'b', 90D, 'c', -180D, 'd', 180D, 'v', 0, 'code', ''), (s, i) -> {_HALVES}, s -> s.code) END"""),
    "volreg_base36(value BIGINT, places INT)": ("STRING", "CASE WHEN value >= 0 AND value < pow(36, places) THEN lpad(conv(value, 10, 36), places, '0') END"),
    "volreg_check(payload STRING)": ("STRING", f"aggregate(transform(split(upper(payload), ''), c -> instr('{BASE36}', c) - 1), 36, (p, v) -> 2 * IF((p + v) % 36 = 0, 36, (p + v) % 36) % 37, p -> substr('{BASE36}', (37 - p) % 36 + 1, 1))"),
    f"volreg_ring_area(r {_RING})": ("DOUBLE", f"aggregate(sequence(1, size(r)), 0D, (total, i) -> total + {_EDGE}) / 2"),
    f"volreg_ring_length(r {_RING})": ("DOUBLE", "aggregate(sequence(1, size(r)), 0D, (total, i) -> total + hypot(r[i % size(r)].x - r[i - 1].x, r[i % size(r)].y - r[i - 1].y))"),
    "volreg_metres_per_pixel(lat DOUBLE, zoom INT)": ("DOUBLE", "cos(radians(lat)) * 2 * pi() * 6378137 / (256 * pow(2, zoom))"),
}


@udtf(returnType="corridor STRING, part_no INT, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, length DOUBLE, z_min DOUBLE, z_max DOUBLE")
class CorridorParts:
    """Rows (corridor, x, y, invert, width, height) of an alignment, in order, to one rectangle for each span; only the last point is kept."""

    def __init__(self) -> None:
        self.last, self.part = None, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        a, self.last = self.last, row
        if a is None:
            return
        dx, dy = row.x - a.x, row.y - a.y
        length = (dx * dx + dy * dy) ** 0.5
        if length > 0:
            ox, oy = -dy / length * a.width / 2, dx / length * a.width / 2
            ring = [(p.x + k * ox, p.y + k * oy) for p, k in ((a, 1), (a, -1), (row, -1), (row, 1))]
            yield a.corridor, self.part, ring, length, min(a.invert, row.invert), max(a.invert, row.invert) + a.height
        self.part += 1


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; their names."""
    on_workers(spark)
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("volreg_corridor_parts", CorridorParts)
    return [*(head.split("(")[0] for head in FUNCTIONS), "volreg_corridor_parts"]
