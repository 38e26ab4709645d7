"""Self-locating identifiers as column expressions: geohash, base 36, check character.

A code has 25 characters and a check: jurisdiction 2 + 3 + 3, geohash 10, layer 1,
level 2 and unit 4 in base 36.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import STRATA, lookup
from .geodesy import let

# The alphabets of geohash and of base 36.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PRECISION = 10
MAX_LEVEL = 36**2 - 1
MAX_UNIT = 36**4 - 1
METRES_PER_DEGREE = (111_132.0, 111_320.0)
_CODE = "^[0-9A-Z]{8}[0-9B-HJKMNP-Z]{10}[GBUAI][0-9A-Z]{6}[0-9A-Z]$"


def _cell_number(value: Column, half: float, bits: int) -> Column:
    """Which of 2 ** bits equal cells between -half and half a value is in; a border belongs to the lower cell.

    Borders are exact numbers, so a number that rounding put beside its cell is put right by them.
    """
    step = 2 * half / 2**bits
    last = 2**bits - 1

    def right(i: Column) -> Column:
        low = i * step - half
        return F.when((value <= low) & (i > 0), i - 1).when((value > low + step) & (i < last), i + 1).otherwise(i)

    guess = F.least(F.greatest(F.ceil((value + half) / step).cast("long") - 1, F.lit(0)), F.lit(last))
    return let(guess, right)


#: Characters by the three bits of the coordinate that begins, then the two of the other.
_MIXED = "".join(GEOHASH[(a >> 2) << 4 | (a >> 1 & 1) << 2 | (a & 1) | (b >> 1) << 3 | (b & 1) << 1] for a in range(8) for b in range(4))


def _bits(number: Column, width: int, start: int, turn: int) -> Column:
    """Of a coordinate whose turn is at even (0) or odd (1) places, its bits among five places of the code from ``start`` on."""
    lo, hi = (start - turn + 1) // 2, (start + 5 - turn + 1) // 2
    return F.shiftright(number, width - hi).bitwiseAND(2 ** (hi - lo) - 1).cast("int")


def geohash_encode(lat: Column, lon: Column, precision: int = PRECISION) -> Column:
    """Bits of the cells in turn, longitude first; a coordinate on a middle goes to the lower half. Out of range is an error."""
    n = 5 * precision
    # a character has three bits of one coordinate and two of the other in turn: it is looked up by both, beginning with longitude
    many, few = (n + 1) // 2, n // 2
    east, north = _cell_number(lon, 180.0, many), _cell_number(lat, 90.0, few)
    char = lambda c, i: F.substring(F.lit(_MIXED), _bits(c["east"], many, 5 * i, 0) * (4 if i % 2 == 0 else 1) + _bits(c["north"], few, 5 * i, 1) * (1 if i % 2 == 0 else 4) + 1, F.lit(1))
    text = let(F.struct(east.alias("east"), north.alias("north")), lambda c: F.concat(*(char(c, i) for i in range(precision))))
    fine = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(fine, text).otherwise(F.raise_error(F.concat(F.lit("position out of range: "), lat.cast("string"), F.lit(" "), lon.cast("string"))))


def geohash_bounds(code: Column) -> Column:
    """Struct (lat_lo, lat_hi, lon_lo, lon_hi) of a cell; null for a character that is none."""
    start = F.struct(F.lit(-90.0).alias("lat_lo"), F.lit(90.0).alias("lat_hi"), F.lit(-180.0).alias("lon_lo"), F.lit(180.0).alias("lon_hi"))
    value = lambda i: F.instr(F.lit(GEOHASH), F.substring(code, F.floor(i / 5).cast("int") + 1, F.lit(1))) - 1

    def halve(s: Column, i: Column) -> Column:
        bit = F.floor(value(i) / F.pow(F.lit(2.0), 4 - i % 5)).cast("long") % 2 == 1
        east = i % 2 == 0
        lat, lon = (s["lat_lo"] + s["lat_hi"]) / 2, (s["lon_lo"] + s["lon_hi"]) / 2
        return F.struct(F.when(~east & bit, lat).otherwise(s["lat_lo"]).alias("lat_lo"), F.when(~east & ~bit, lat).otherwise(s["lat_hi"]).alias("lat_hi"), F.when(east & bit, lon).otherwise(s["lon_lo"]).alias("lon_lo"), F.when(east & ~bit, lon).otherwise(s["lon_hi"]).alias("lon_hi"))

    box = F.aggregate(F.sequence(F.lit(0), 5 * F.length(code) - 1), start, halve)
    return F.when(code.rlike(f"^[{GEOHASH}]+$"), box)


def base36(value: Column, width: int) -> Column:
    """Fixed width, upper case; too large or negative is an error."""
    fits = (value >= 0) & (value < 36**width)
    return F.when(fits, F.lpad(F.conv(value.cast("string"), 10, 36), width, "0")).otherwise(F.raise_error(F.concat(F.lit("does not fit in base 36: "), value.cast("string"))))


def unbase36(text: Column) -> Column:
    return F.conv(text, 36, 10).cast("long")


def check_character(payload: Column) -> Column:
    """ISO 7064, MOD 37,36, over upper-case base 36."""
    # a sum of 36 counts as 36, not as 0
    step = lambda p, c: 2 * (F.pmod(p + F.instr(F.lit(BASE36), c) - 2, F.lit(36)) + 1) % 37
    p = F.aggregate(F.split(F.upper(payload), ""), F.lit(36), step)
    return F.substring(F.lit(BASE36), (37 - p) % 36 + 1, F.lit(1))


def jurisdiction(code: Column, width: int) -> Column:
    """Upper case, zeros on the left, cut to the width."""
    return F.lpad(F.upper(code), width, "0")


def compact(state: Column, district: Column, tehsil: Column, geohash: Column, stratum: Column, level: Column, unit: Column) -> Column:
    payload = F.concat(jurisdiction(state, 2), jurisdiction(district, 3), jurisdiction(tehsil, 3), F.upper(geohash), stratum, base36(level, 2), base36(unit, 4))
    return let(payload, lambda p: F.concat(p, check_character(p)))


def punctuated(code: Column) -> Column:
    """The compact form with separators, the geohash in lower case."""
    part = lambda a, n: code.substr(a, n)
    return F.concat_ws("-", part(1, 2), part(3, 3), part(6, 3), F.lower(part(9, 10)), part(19, 3), part(22, 4), part(26, 1))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), r"[\s-]", "")


def _problem(code: Column) -> Column:
    return F.when(code.isNull() | (F.length(code) != 26), "length").when(~code.rlike(_CODE), "malformed").when(check_character(code.substr(1, 25)) != code.substr(26, 1), "check").otherwise(F.lit(None))


def problem(text: Column) -> Column:
    """What is wrong with a code in any spelling; null if nothing is."""
    return let(normalised(text), _problem)


def _fields(code: Column) -> Column:
    part = lambda a, n: code.substr(a, n)
    return F.struct(part(1, 2).alias("state"), part(3, 3).alias("district"), part(6, 3).alias("tehsil"), F.lower(part(9, 10)).alias("geohash"), part(19, 1).alias("stratum"), unbase36(part(20, 2)).cast("int").alias("level"), unbase36(part(22, 4)).cast("int").alias("unit"), part(26, 1).alias("check"))


def examined(text: Column) -> Column:
    """Struct of ``problem`` (null if there is none) and ``fields`` (null if there is one), found in one go."""
    return let(normalised(text), lambda code: let(_problem(code), lambda p: F.struct(p.alias("problem"), F.when(p.isNull(), _fields(code)).alias("fields"))))


def parsed(text: Column) -> Column:
    """Struct of a code's parts; null if it is not valid."""
    return examined(text)["fields"]


def signed_level(stratum: Column, level: Column) -> Column:
    return F.when(stratum.isin("U", "I"), -level).otherwise(level)


def described(stratum: Column, level: Column, unit: Column) -> Column:
    side = F.when(stratum.isin("U", "I"), "below").otherwise("above")
    where = F.when(level == 0, F.lit("ground level")).otherwise(F.concat(F.lit("level "), level, F.lit(" "), side, F.lit(" ground")))
    return F.concat(lookup(stratum, STRATA), F.lit(", "), where, F.lit(", unit #"), unit)


def drift(bounds: Column, lat: Column, lon: Column) -> Column:
    """Metres from a cell's middle to a position."""
    mid_lat, mid_lon = (bounds["lat_lo"] + bounds["lat_hi"]) / 2, (bounds["lon_lo"] + bounds["lon_hi"]) / 2
    return F.hypot((lat - mid_lat) * METRES_PER_DEGREE[0], (lon - mid_lon) * METRES_PER_DEGREE[1] * F.cos(F.radians(mid_lat)))


def inside(bounds: Column, lat: Column, lon: Column) -> Column:
    return lat.between(bounds["lat_lo"], bounds["lat_hi"]) & lon.between(bounds["lon_lo"], bounds["lon_hi"])


def mint_units(objects: DataFrame, cell: list[str], order: list[str]) -> DataFrame:
    """Unit numbers from 0 in order of entry within each cell, where nobody prefers a number.

    A cell of 1.1 by 0.6 metres holds few objects, so a window suffices.
    """
    return objects.withColumn("unit", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1)


def mint_preferred(objects: DataFrame, cell: list[str], schema: str) -> DataFrame:
    """First free number at or above ``preferred`` (0 if null or out of range), in order of ``seq`` within a cell."""

    def assign(batches):
        # a partition has whole cells, one after another; of a cell's taken numbers, each leads to one that may be free
        own, after = None, {}

        def free(n: int) -> int:
            seen = []
            while n in after:
                seen.append(n)
                n = after[n]
            for x in seen:
                after[x] = n
            return n

        for rows in batches:
            numbers = []
            for *key, p in zip(*(rows[c] for c in cell), rows["preferred"], strict=True):
                if key != own:
                    own, after = key, {}
                n = free(int(p) if p == p and p is not None and 0 <= p <= MAX_UNIT else 0)
                after[n] = n + 1
                numbers.append(n)
            yield rows.assign(unit=numbers)

    return objects.repartition(*cell).sortWithinPartitions(*cell, "seq").mapInPandas(assign, schema)
