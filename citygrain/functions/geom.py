"""Geometries as arrays of (x, y) structs, and predicates on them as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
POLYGON = f"array<{RING}>"


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Polygon of one closed ring, from the east and south corner on."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(x1, y0), corner(x0, y0), corner(x0, y1), corner(x1, y1), corner(x1, y0)))


def points_of(polygon: Column) -> Column:
    return F.flatten(polygon)


def bounds(polygon: Column) -> dict[str, Column]:
    """minx, miny, maxx, maxy of a polygon."""
    xs, ys = F.transform(points_of(polygon), lambda p: p["x"]), F.transform(points_of(polygon), lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def _segments(ring: Column) -> Column:
    return F.arrays_zip(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).alias("a"), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))).alias("b"))


def line_length(line: Column) -> Column:
    """Sum of the lengths of a line's parts, in the units of its coordinates."""
    return F.aggregate(_segments(line), F.lit(0.0), lambda t, s: t + F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2)))


def ring_area(ring: Column) -> Column:
    """Signed area, positive for a ring that turns left."""
    return F.aggregate(_segments(ring), F.lit(0.0), lambda t, s: t + (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def polygon_area(polygon: Column) -> Column:
    """Area of the first ring less that of the holes."""
    return F.abs(ring_area(polygon[0])) - F.aggregate(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.lit(0.0), lambda t, r: t + F.abs(ring_area(r)))


def position(x: Column, y: Column, polygon: Column) -> Column:
    """1 inside, 0 on the boundary, -1 outside; rings by the even-odd rule."""
    segments = F.flatten(F.transform(polygon, _segments))

    def side(s: Column) -> Column:
        return (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (x - s["a"]["x"])

    def on(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return (side(s) == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["y"] > y) != (b["y"] > y)) & ((side(s) > 0) == (b["y"] > a["y"]))

    odd = F.size(F.filter(segments, crosses)) % 2 == 1
    return F.when(F.exists(segments, on), 0).when(odd, 1).otherwise(-1)


def boundary_distance(x: Column, y: Column, polygon: Column) -> Column:
    """Distance from a point to the nearest part of a polygon's boundary."""

    def distance(s: Column) -> Column:
        a, b = s["a"], s["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.least(F.greatest(((x - a["x"]) * dx + (y - a["y"]) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.sqrt(F.pow(x - (a["x"] + t * dx), 2) + F.pow(y - (a["y"] + t * dy), 2))

    return F.array_min(F.transform(F.flatten(F.transform(polygon, _segments)), distance))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, turning left, not closed; the points themselves if fewer than three differ."""
    points = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(points) < 3:
        return points

    def chain(order: np.ndarray) -> list:
        out: list = []
        for p in order.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def clip_half_plane(polygon: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """The part of a polygon (open list of corners) where a*x + b*y <= c."""
    if not len(polygon):
        return polygon
    value = polygon @ np.array([a, b]) - c
    after, value_after = np.roll(polygon, -1, axis=0), np.roll(value, -1)
    out = []
    for p, q, v, w in zip(polygon, after, value, value_after, strict=True):
        if v <= 0:
            out.append(p)
        if (v < 0 < w) or (w < 0 < v):
            out.append(p + (q - p) * (v / (v - w)))
    return np.array(out).reshape(-1, 2)


def clip_to_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Sutherland-Hodgman: a polygon cut by a convex window that turns left (open lists of corners)."""
    for p, q in zip(window, np.roll(window, -1, axis=0), strict=True):
        normal = np.array([q[1] - p[1], p[0] - q[0]])
        subject = clip_half_plane(subject, normal[0], normal[1], float(normal @ p))
    return subject


def area_of(polygon: np.ndarray) -> float:
    if len(polygon) < 3:
        return 0.0
    x, y = polygon[:, 0], polygon[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)
