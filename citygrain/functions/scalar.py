"""Scalar functions as column expressions, and the small numeric solvers behind their parameters."""

from __future__ import annotations

import math
import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres on a sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def sigmoid(x: Column, k: float, x0: float, invert: bool = True) -> Column:
    """Logistic of x, falling in x for k > 0, or rising if ``invert``; no exponent overflows."""
    t = (F.lit(float(k)) * (x - F.lit(float(x0)))) * (1.0 if invert else -1.0)
    small = F.exp(-F.abs(t))
    return F.when(t >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def sigmoid_error(x: Column, k: float, x0: float, target: float) -> Column:
    return F.pow(sigmoid(x, k, x0) - F.lit(float(target)), 2)


def decay_constant(k: float, x0: float, target: float, bounds: tuple[float, float] = (-20.0, 20.0)) -> float:
    """The x within ``bounds`` at which the rising sigmoid of slope k around x0 is nearest to ``target``: closed form, clipped."""
    low, high = bounds
    if k == 0:
        return min(max(x0, low), high)
    logit = math.log(target / (1 - target)) if 0 < target < 1 else math.copysign(math.inf, target - 0.5)
    return min(max(x0 + logit / k, low), high)


def sigmoid_constant(positive_limit: float, mid_limit: float, bounds: tuple[float, float] = (-20.0, 20.0)) -> float:
    """Mean of the constants for three quarters and one quarter, with the points halfway to the limit as slopes."""
    if not all(isinstance(v, int | float) for v in (positive_limit, mid_limit)):
        raise ValueError("limits must be numbers")
    if positive_limit <= mid_limit:
        raise ValueError("the positive limit must lie above the middle")
    half = (positive_limit - mid_limit) / 2
    return (decay_constant(mid_limit + half, mid_limit, 0.75, bounds) + decay_constant(mid_limit - half, mid_limit, 0.25, bounds)) / 2


def walk_speed(grade: Column) -> Column:
    """Walking speed in km/h on a slope."""
    return 4.0 * F.exp(-3.5 * F.abs(grade))


def minutes(length_m: Column, speed_kmh: float | Column) -> Column:
    return length_m * 60 / (speed_kmh * 1000)


def months_between(spark: SparkSession, start: date | str, end: date | str) -> DataFrame:
    """(year, month, first_day, last_day) of the months that begin within start and end."""
    days = F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"), F.expr("interval 1 day"))
    firsts = spark.range(1).select(F.explode(F.filter(days, lambda d: F.dayofmonth(d) == 1)).alias("first_day"))
    return firsts.select(F.year("first_day").alias("year"), F.month("first_day").alias("month"), "first_day", F.last_day("first_day").alias("last_day"))


def tile_key(properties: Column, satellite: str) -> Column:
    """Tile of an item: the grid square, or path and row of three digits each."""
    if satellite == "sentinel-2-l2a":
        return properties["s2:mgrs_tile"]
    return F.concat(F.lpad(properties["landsat:wrs_path"], 3, "0"), F.lpad(properties["landsat:wrs_row"], 3, "0"))


def cloud_share(properties: Column, satellite: str) -> Column:
    return properties["s2:high_proba_clouds_percentage" if satellite == "sentinel-2-l2a" else "landsat:cloud_cover_land"].try_cast("double")


_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(\*\*|[-+*/()]))")


def band_expression(equation: str, bands: list[str]) -> Column:
    """A band equation as a column; only the bands, numbers and + - * / ** ( ) are allowed. Division by zero gives null.

    An empty equation is the first band.
    """
    if not equation.strip():
        return F.col(bands[0])
    tokens, at = [], 0
    while at < len(equation.rstrip()):
        m = _TOKEN.match(equation, at)
        if not m or (m[1] and m[1] not in bands):
            raise ValueError(f"not allowed in a band equation: {equation[at : at + 12]!r}")
        tokens.append(m[0].strip())
        at = m.end()

    def atom() -> Column:
        t = tokens.pop(0)
        if t == "(":
            inner = total()
            if not tokens or tokens.pop(0) != ")":
                raise ValueError("a bracket is not closed")
            return inner
        if t == "-":
            return -power()
        if t == "+":
            return power()
        return F.col(t) if t in bands else F.lit(float(t))

    def power() -> Column:
        base = atom()
        if tokens and tokens[0] == "**":
            tokens.pop(0)
            return F.pow(base, power())
        return base

    def product() -> Column:
        left = power()
        while tokens and tokens[0] in "*/" and tokens[0] != "**":
            left = left * power() if tokens.pop(0) == "*" else F.try_divide(left, power())
        return left

    def total() -> Column:
        left = product()
        while tokens and tokens[0] in "+-":
            left = left + product() if tokens.pop(0) == "+" else left - product()
        return left

    out = total()
    if tokens:
        raise ValueError(f"unexpected {tokens[0]!r} in a band equation")
    return out


def timestamp_text(style: str = "datetime", template: str | None = None) -> str:
    """The present time as text; styles datetime, date and time."""
    formats = {"datetime": "%Y-%m-%d %H:%M:%S", "date": "%Y-%m-%d", "time": "%H:%M:%S"}
    if template is None and style not in formats:
        raise ValueError(f"unknown style {style!r}")
    return datetime.now().strftime(template or formats[style])


def weighted_average(weight: Column, value: Column) -> Column:
    """Sum of products over the sum of all known weights (a missing value still has its weight)."""
    return F.try_divide(F.sum(weight * value), F.sum(weight))
