"""Coordinates as column expressions: local east-north-up, UTM, web mercator; datum fit on the driver."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid.
A, INVERSE_F = 6378137.0, 298.257223563
FLAT = 1 / INVERSE_F
E2 = FLAT * (2 - FLAT)
B = A * (1 - FLAT)
EP2 = E2 / (1 - E2)


def to_ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    p, l = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + h) * F.cos(p) * F.cos(l), (n + h) * F.cos(p) * F.sin(l), (n * (1 - E2) + h) * F.sin(p)


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """One pass of Bowring's formula: exact to well under a millimetre near the surface."""
    r = F.hypot(x, y)
    t = F.atan2(z * A, r * B)
    lat = F.atan2(z + EP2 * B * F.pow(F.sin(t), 3), r - E2 * A * F.pow(F.cos(t), 3))
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    # near the poles the height comes from z
    h = F.when(r > 1e-3, r / F.cos(lat) - n).otherwise(F.abs(z) - B)
    return F.degrees(lat), F.degrees(F.atan2(y, x)), h


class Local(NamedTuple):
    """East, north, up at an origin; its constants are numbers in the plan."""

    lat: float
    lon: float
    height: float = 0.0

    def _frame(self):
        p, l = math.radians(self.lat), math.radians(self.lon)
        n = A / math.sqrt(1 - E2 * math.sin(p) ** 2)
        origin = ((n + self.height) * math.cos(p) * math.cos(l), (n + self.height) * math.cos(p) * math.sin(l), (n * (1 - E2) + self.height) * math.sin(p))
        east = (-math.sin(l), math.cos(l), 0.0)
        north = (-math.sin(p) * math.cos(l), -math.sin(p) * math.sin(l), math.cos(p))
        up = (math.cos(p) * math.cos(l), math.cos(p) * math.sin(l), math.sin(p))
        return origin, (east, north, up)

    def forward(self, lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
        origin, axes = self._frame()
        d = [c - o for c, o in zip(to_ecef(lat, lon, h), origin, strict=True)]
        return tuple(d[0] * a[0] + d[1] * a[1] + d[2] * a[2] for a in axes)

    def inverse(self, e: Column, n: Column, u: Column) -> tuple[Column, Column, Column]:
        return from_ecef(*self._ecef(e, n, u))

    def _ecef(self, e: Column, n: Column, u: Column) -> list[Column]:
        origin, (x, y, z) = self._frame()
        return [F.lit(origin[i]) + e * x[i] + n * y[i] + u * z[i] for i in range(3)]

    def ground(self, e: Column, n: Column, made) -> Column:
        """``made(lat, lon)`` of a place at height 0, where no generated code finds what is common, as in arrays of corners: steps are computed once."""
        x, y, z = self._ecef(e, n, F.lit(0.0))

        def at(c: Column) -> Column:
            r = c["r"]
            t = F.atan2(c["z"] * A, r * B)
            lat = let(t, lambda t: F.atan2(c["z"] + EP2 * B * F.pow(F.sin(t), 3), r - E2 * A * F.pow(F.cos(t), 3)))
            return made(F.degrees(lat), F.degrees(c["lon"]))

        flat = let(F.struct(x.alias("x"), y.alias("y")), lambda p: F.struct(F.hypot(p["x"], p["y"]).alias("r"), F.atan2(p["y"], p["x"]).alias("lon"), z.alias("z")))
        return let(flat, at)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)
_SCALE, _EASTING, _SOUTH = 0.9996, 500_000.0, 10_000_000.0


def utm_forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in the position's own zone (Krueger's series of third order)."""
    p, l = F.radians(lat), F.radians(lon - (6 * utm_zone(lon) - 183))
    k = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(p)) - k * F.atanh(k * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(l)), F.atanh(F.sin(l) / F.sqrt(1 + t * t))
    e = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    n = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return _EASTING + _SCALE * _RADIUS * e, F.when(lat < 0, _SOUTH).otherwise(0.0) + _SCALE * _RADIUS * n


def utm_inverse(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    x = (north - F.when(south, _SOUTH).otherwise(0.0)) / (_SCALE * _RADIUS)
    y = (east - _EASTING) / (_SCALE * _RADIUS)
    xi = x - sum(b * F.sin(2 * j * x) * F.cosh(2 * j * y) for j, b in enumerate(_BETA, 1))
    eta = y - sum(b * F.cos(2 * j * x) * F.sinh(2 * j * y) for j, b in enumerate(_BETA, 1))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return F.degrees(lat), 6 * zone - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))


TILE = 256


def mercator(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Pixel position in the world image of a zoom level."""
    world = TILE * 2.0**zoom
    p = F.radians(lat)
    return (lon + 180) / 360 * world, (1 - F.ln(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2 * world


def mercator_inverse(px: Column, py: Column, zoom: int) -> tuple[Column, Column]:
    world = TILE * 2.0**zoom
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * py / world)))), px / world * 360 - 180


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return F.cos(F.radians(lat)) * 2 * math.pi * A / (TILE * F.pow(F.lit(2.0), zoom))


class Fit(NamedTuple):
    rotation: np.ndarray
    translation: np.ndarray
    scale: float
    active: list[int]
    rms: float
    worst: float = 0.0

    def apply(self, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
        """The fitted transform as column arithmetic."""
        m = self.scale * self.rotation
        return tuple(float(m[i, 0]) * x + float(m[i, 1]) * y + float(m[i, 2]) * z + float(self.translation[i]) for i in range(3))


def fit_similarity(observed: np.ndarray, reference: np.ndarray, sigma: np.ndarray, reject: float = 4.0, max_share: float = 0.35, rounds: int = 8) -> Fit:
    """Least-squares rotation, shift and scale of a handful of control points; the worst is dropped while it is an outlier."""
    active = list(range(len(observed)))
    sigma = np.maximum(sigma, 1e-3)
    while True:
        x, y = observed[active], reference[active]
        mx, my = x.mean(0), y.mean(0)
        u, d, vt = np.linalg.svd((y - my).T @ (x - mx) / len(x))
        sign = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
        rotation = u @ sign @ vt
        scale = float((d * np.diag(sign)).sum() / ((x - mx) ** 2).sum(1).mean())
        shift = my - scale * rotation @ mx
        away = np.linalg.norm(y - (scale * x @ rotation.T + shift), axis=1)
        worst = int((away / sigma[active]).argmax())
        rounds -= 1
        if rounds < 0 or (away / sigma[active])[worst] <= reject or len(active) <= max(3, math.ceil((1 - max_share) * len(observed))):
            return Fit(rotation, shift, scale, active, float(np.sqrt((away**2).mean())), float(away.max()))
        del active[worst]
