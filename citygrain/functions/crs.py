"""Closed-form map projections as column expressions, by EPSG code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoids (semi-major axis, inverse flattening) and the Lambert projection of EPSG:6372.
WGS84, GRS80 = (6_378_137.0, 298.257223563), (6_378_137.0, 298.257222101)
LAMBERT_6372 = {"lon0": -102.0, "lat0": 12.0, "lat1": 17.5, "lat2": 29.5, "fe": 2_500_000.0, "fn": 0.0}
UTM_SCALE = 0.9996


def is_projected(epsg: int) -> bool:
    """True for metric projections, False for degrees; an unknown code raises ValueError."""
    if epsg in (4326, 4269, 6365, 4979):
        return False
    if epsg in (3857, 6372) or 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return True
    raise ValueError(f"EPSG:{epsg} is not supported")


def _squares(ellipsoid: tuple[float, float]) -> tuple[float, float, float]:
    a, inverse = ellipsoid
    f = 1 / inverse
    return a, math.sqrt(f * (2 - f)), f / (2 - f)


def _mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = WGS84[0]
    return r * F.radians(lon), r * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def _mercator_back(x: Column, y: Column) -> tuple[Column, Column]:
    r = WGS84[0]
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)


def _lambert_constants() -> tuple[float, float, float, float, float]:
    a, e, _ = _squares(GRS80)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = (math.radians(LAMBERT_6372[k]) for k in ("lat0", "lat1", "lat2"))
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    scale = a * m(p1) / (n * t(p1) ** n)
    return e, n, scale, scale * t(p0) ** n, math.radians(LAMBERT_6372["lon0"])


def _lambert(lon: Column, lat: Column) -> tuple[Column, Column]:
    e, n, scale, rho0, lon0 = _lambert_constants()
    p = F.radians(lat)
    s = e * F.sin(p)
    t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    rho, theta = scale * F.pow(t, F.lit(n)), n * (F.radians(lon) - lon0)
    return LAMBERT_6372["fe"] + rho * F.sin(theta), LAMBERT_6372["fn"] + rho0 - rho * F.cos(theta)


def _lambert_back(x: Column, y: Column) -> tuple[Column, Column]:
    e, n, scale, rho0, lon0 = _lambert_constants()
    dx, dy = x - LAMBERT_6372["fe"], F.lit(rho0) - (y - LAMBERT_6372["fn"])
    rho = F.sqrt(dx * dx + dy * dy)
    t = F.pow(rho / scale, F.lit(1 / n))
    p = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(5):
        s = e * F.sin(p)
        p = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    return F.degrees(F.atan2(dx, dy) / n + lon0), F.degrees(p)


def _utm_series(n: float) -> tuple[float, list[float], list[float]]:
    radius = 1 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, alpha, beta


def _utm(epsg: int, lon: Column, lat: Column) -> tuple[Column, Column]:
    a, e, n = _squares(WGS84)
    radius, alpha, _ = _utm_series(n)
    central = math.radians((epsg % 100) * 6 - 183)
    p, l = F.radians(lat), F.radians(lon) - central  # noqa: E741
    t = F.sinh(F.atanh(F.sin(p)) - e * F.atanh(e * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(l)), F.atanh(F.sin(l) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = UTM_SCALE * a * radius
    return 500_000.0 + k * x, (10_000_000.0 if epsg >= 32700 else 0.0) + k * y


def _utm_back(epsg: int, x: Column, y: Column) -> tuple[Column, Column]:
    a, e, n = _squares(WGS84)
    radius, _, beta = _utm_series(n)
    k = UTM_SCALE * a * radius
    eta, xi = (x - 500_000.0) / k, (y - (10_000_000.0 if epsg >= 32700 else 0.0)) / k
    e0, x0 = eta, xi
    for j, c in enumerate(beta, 1):
        e0 = e0 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        x0 = x0 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(x0) / F.cosh(e0))
    p = chi
    goal = F.atanh(F.sin(chi))
    for _ in range(5):
        p = F.asin(F.tanh(goal + e * F.atanh(e * F.sin(p))))
    return F.degrees(F.atan2(F.sinh(e0), F.cos(x0))) + ((epsg % 100) * 6 - 183), F.degrees(p)


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one reference system in another; longitude comes before latitude."""
    if source == target:
        return x, y
    if is_projected(source):
        back = {3857: _mercator_back, 6372: _lambert_back}.get(source) or (lambda a, b: _utm_back(source, a, b))
        x, y = back(x, y)
    if not is_projected(target):
        return x, y
    forth = {3857: _mercator, 6372: _lambert}.get(target) or (lambda a, b: _utm(target, a, b))
    return forth(x, y)


def transform_ring(ring: Column, source: int, target: int) -> Column:
    def one(p: Column) -> Column:
        x, y = transform(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, one)
