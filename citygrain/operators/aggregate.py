"""Aggregates of points by bins, and of census variables between areas and points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citygrain.functions.convert import coerce_numeric, numeric_columns, require, slice_columns, zero_to
from citygrain.operators.joins import PREDICATES, nearest_polygon, spatial_join

FUNCTIONS: dict[str, Callable[[str], Column]] = {
    "mean": F.avg, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp, "median": lambda c: F.percentile(c, 0.5),
}


def _known(c: str) -> Column:
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c))


def group_points_by_bins(
    points: DataFrame, bins: DataFrame, bin_id: str, columns: str | list[str], func: str | dict[str, str | Callable] = "mean", fill_missing: bool = True,
    fill_value: float | dict[str, float] = 0.0, zero_replacement: float | dict[str, float] | None = None, drop_columns: list[str] | None = None, predicate: str = "within", cell: float | None = None,
) -> DataFrame:
    """All bins with the aggregates of the points that meet the predicate; NaN counts as missing.

    ``func`` is one function or one per column: mean, sum, count, min, max, std (of a sample), median, or a grouped
    aggregate pandas UDF or any function from a column to an aggregate. Zeros are replaced before gaps are filled.
    Points on a shared boundary count in each bin they touch, if the predicate asks for it.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    if not isinstance(points, DataFrame) or not isinstance(bins, DataFrame):
        raise TypeError("points and bins must be tables")
    require(bins, [bin_id])
    require(points, columns)
    if predicate not in PREDICATES:
        raise ValueError(f"unknown predicate {predicate!r}")
    functions = func if isinstance(func, dict) else dict.fromkeys(columns, func)
    if missing := [c for c in columns if c not in functions]:
        raise ValueError(f"no function for columns: {missing}")
    if unknown := [f for f in functions.values() if isinstance(f, str) and f not in FUNCTIONS]:
        raise ValueError(f"unknown functions: {unknown}")
    for value in (fill_value, zero_replacement):
        if value is not None and not isinstance(value, int | float | dict):
            raise TypeError("fill and zero replacement must be numbers or dicts of numbers")
    narrow = points.select("x", "y", *[_known(c).alias(c) for c in columns]) if bin_id not in points.columns else points
    joined = spatial_join(narrow, bins, bin_id, predicate, "inner", cell)
    found = joined.groupBy(bin_id).agg(*[(FUNCTIONS[functions[c]](c) if isinstance(functions[c], str) else functions[c](F.col(c))).alias(f"_agg_{c}") for c in columns])
    out = bins.drop(*[c for c in columns if c in bins.columns]).join(found, bin_id, "left")
    for c in columns:
        zero = zero_replacement.get(c) if isinstance(zero_replacement, dict) else zero_replacement
        fill = fill_value.get(c) if isinstance(fill_value, dict) else fill_value
        value = zero_to(F.col(f"_agg_{c}"), zero)
        out = out.withColumn(c, F.coalesce(value, F.lit(fill)) if fill_missing and fill is not None else value).drop(f"_agg_{c}")
    return out.drop(*(drop_columns or []))


def count_points(points: DataFrame, polygons: DataFrame, polygon_id: str, cell: float | None = None) -> DataFrame:
    """(polygon_id, points_count); points outside all polygons count under a null id."""
    return spatial_join(points, polygons, polygon_id, "intersects", "left", cell).groupBy(polygon_id).agg(F.count("*").alias("points_count"))


def polygons_to_points(points: DataFrame, polygons: DataFrame, polygon_id: str, start: int = 0, end: int = -1, avg_columns: list[str] | None = None, cell: float | None = None) -> DataFrame:
    """``points`` with the polygon id and values: shares of totals, full values for ``avg_columns``.

    A total is divided by the polygon's number of points; without points it stays. Points outside keep nulls; a point on
    a shared boundary gets a row for each polygon. Unknown id: KeyError; bad column range: ValueError.
    """
    require(polygons, [polygon_id], KeyError)
    values = [c for c in slice_columns(polygons, start, end) if c not in (polygon_id, "geometry")]
    averaged = {c for c in (avg_columns or []) if c in polygons.columns}
    joined = spatial_join(points, polygons, polygon_id, "intersects", "left", cell)
    counts = joined.where(F.col(polygon_id).isNotNull()).groupBy(polygon_id).agg(F.count("*").alias("_count"))
    shares = coerce_numeric(polygons.select(polygon_id, *values), values).join(counts, polygon_id, "left")
    shares = shares.select(polygon_id, *[(F.col(c) if c in averaged else F.when(F.col("_count") > 0, F.col(c) / F.col("_count")).otherwise(F.col(c))).alias(c) for c in values])
    return joined.join(shares, polygon_id, "left")


def sociodemographic_aggregates(numeric: list[str], averaged: list[str] | None = None, weights: dict[str, str] | None = None) -> list[Column]:
    """Aggregates of a group: weighted means over pairs that are both known, means, else sums; 0 where all is missing."""
    if weights is not None and not isinstance(weights, dict):
        raise TypeError("weights must be a dict of column to weight column")
    averaged, weights = averaged or [], weights or {}
    out = []
    for c in numeric:
        if c in weights:
            w = F.when(F.col(c).isNotNull(), F.col(weights[c]))
            value = F.try_divide(F.sum(F.col(c) * w), F.sum(w))
        else:
            value = F.avg(c) if c in averaged else F.sum(c)
        out.append(F.coalesce(value.cast("double"), F.lit(0.0)).alias(c))
    return out


def group_sociodemographic(df: DataFrame, numeric: list[str], averaged: list[str] | None = None, weights: dict[str, str] | None = None) -> dict[str, float]:
    """The aggregates of a whole table as a dict; an empty table gives an empty one, unknown columns are left out."""
    if weights is not None and not isinstance(weights, dict):
        raise TypeError("weights must be a dict of column to weight column")
    require(df, [*(averaged or []), *(weights or {}), *(weights or {}).values()])
    numeric = [c for c in numeric if c in df.columns]
    if df.isEmpty() or not numeric:
        return {}
    return coerce_numeric(df, numeric).agg(*sociodemographic_aggregates(numeric, averaged, weights)).first().asDict()


def points_to_polygons(
    points: DataFrame, polygons: DataFrame, polygon_id: str, string_columns: list[str] | None = None, weights: dict[str, str] | None = None, averaged: list[str] | None = None,
    include_nearest: bool = False, point_id: str | None = None, cell: float | None = None,
) -> DataFrame:
    """One row per polygon that has points: the aggregates of their numeric columns, and the polygon id last.

    With ``include_nearest`` points outside all polygons go to the nearest boundary, ties to the smallest id.
    """
    if points.isEmpty() or polygons.isEmpty():
        raise ValueError("points and polygons must not be empty")
    require(polygons, [polygon_id], KeyError)
    require(points, [*(string_columns or []), *(averaged or []), *(weights or {}), *(weights or {}).values()], KeyError)
    if include_nearest and point_id is None:
        raise ValueError("the nearest polygon needs a point id")
    numeric = [c for c in numeric_columns(points) if c not in {*(string_columns or []), "x", "y", point_id}]
    joined = spatial_join(points, polygons, polygon_id, "intersects", "left", cell)
    if include_nearest:
        outside = joined.where(F.col(polygon_id).isNull())
        nearest = nearest_polygon(outside, point_id, polygons, polygon_id).select(F.col(point_id), F.col(polygon_id).alias("_nearest"))
        joined = joined.join(nearest, point_id, "left").withColumn(polygon_id, F.coalesce(polygon_id, "_nearest")).drop("_nearest")
    known = coerce_numeric(joined.where(F.col(polygon_id).isNotNull()), numeric)
    out = known.groupBy(polygon_id).agg(*sociodemographic_aggregates(numeric, averaged, weights))
    return out.select(*numeric, polygon_id)
