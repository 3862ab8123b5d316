"""Voronoi cells within an area, and convex hulls of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrain.functions.geom import POLYGON, area_of, clip_to_convex, convex_hull
from citygrain.operators.joins import nearest_nodes
from citygrain.session import durable

#: Points that a tile should hold; a tile is worked on with the eight around it.
TILE_POINTS = 2_000
#: Corners that a task keeps before it hands them on, and parts that a group's corners are joined in before the last step.
HULL_CORNERS, HULL_PARTS = 500_000, 64
_POINTS = "array<struct<x:double,y:double>>"


def hulls(points: DataFrame, group: str) -> DataFrame:
    """(group, geometry): the convex hull of the points (x, y) of each group; groups of fewer than three places give null.

    The hull of parts is the hull of their corners: each task first cuts what it reads to the corners of each group, so
    only corners are shuffled; these are joined in parts, and then per group. Rows without coordinates do not count.
    """
    kind = points.schema[group].dataType.simpleString()
    schema = f"`{group}` {kind}, x double, y double"

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            kept.append(_corners(batch, group))
            if len(kept) > 1 and sum(map(len, kept)) > HULL_CORNERS:
                kept = [_corners(pd.concat(kept), group)]
                if len(kept[0]) > HULL_CORNERS // 2:
                    yield kept.pop()
        if kept:
            yield _corners(pd.concat(kept), group)

    def ring(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        found = convex_hull(own[["x", "y"]].dropna().to_numpy())
        closed = [{"x": float(a), "y": float(b)} for a, b in [*found, found[0]]] if len(found) > 2 else None
        return pd.DataFrame({group: [key[0]], "geometry": [[closed] if closed else None]})

    own = points.select(group, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    parts = own.mapInPandas(reduce, schema).withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(HULL_PARTS)))
    joined = parts.groupBy(group, "_part").applyInPandas(lambda own: _corners(own, group), schema)
    return joined.groupBy(group).applyInPandas(ring, f"`{group}` {kind}, geometry {POLYGON}")


def _corners(rows: pd.DataFrame, group: str) -> pd.DataFrame:
    """The corners of the hull of each group of ``rows``; a group without any place keeps one row."""
    out = []
    for key, own in rows.groupby(group, dropna=False, sort=False):
        found = convex_hull(own[["x", "y"]].dropna().to_numpy())
        found = found if len(found) else np.full((1, 2), np.nan)
        out.append(pd.DataFrame({group: pd.Series([key] * len(found), dtype=rows[group].dtype), "x": found[:, 0], "y": found[:, 1]}))
    return pd.concat(out) if out else rows[[group, "x", "y"]]


def cut_cells(cells: np.ndarray, count: np.ndarray, seeds: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex cells, each cut by the bisector of its seed and one other point: all cells at once.

    ``cells`` has corners in order, padded to the same number; ``count`` says how many are real.
    """
    n, most, _ = cells.shape
    normal = others - seeds
    bound = ((others**2).sum(1) - (seeds**2).sum(1)) / 2
    real = np.arange(most) < count[:, None]
    value = np.where(real, cells[:, :, 0] * normal[:, :1] + cells[:, :, 1] * normal[:, 1:] - bound[:, None], 0.0)
    after = np.where(np.arange(most)[None] + 1 < count[:, None], np.arange(1, most + 1)[None], 0) % most
    following, ahead = np.take_along_axis(value, after, 1), np.take_along_axis(cells, after[:, :, None], 1)
    inside = real & (value <= 0)
    crosses = real & ((value < 0) & (following > 0) | (value > 0) & (following < 0))
    share = np.where(crosses, value / np.where(crosses, value - following, 1.0), 0.0)
    between = cells + (ahead - cells) * share[:, :, None]
    corners = np.stack([cells, between], 2).reshape(n, 2 * most, 2)
    keep = np.stack([inside, crosses], 2).reshape(n, 2 * most)
    order = np.argsort(~keep, 1, kind="stable")
    left = keep.sum(1)
    width = max(int(left.max(initial=0)), 1)
    return np.take_along_axis(corners, order[:, :width, None], 1), left


def _reach(cells: np.ndarray, count: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Distance within which another point can still cut a cell: twice that of its farthest corner."""
    far = np.hypot(cells[:, :, 0] - seeds[:, :1], cells[:, :, 1] - seeds[:, 1:])
    return 2 * np.where(np.arange(cells.shape[1]) < count[:, None], far, 0.0).max(1, initial=0.0)


def cells_of(own: np.ndarray, every: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners, how many are real) of the frame cut by the bisectors of each own point and the others, near ones first."""
    cells, count = np.repeat(frame[None], len(own), 0), np.full(len(own), len(frame))
    for lo in range(0, len(own), 512):
        some = own[lo : lo + 512]
        d = np.hypot(some[:, :1] - every[:, 0], some[:, 1:] - every[:, 1])
        d[d == 0] = np.inf
        mine, many = cells[lo : lo + 512, : len(frame)], count[lo : lo + 512]
        near, sorted_to = np.empty((len(some), 0), int), 0
        todo, k = np.arange(len(some)), 0
        while len(todo) and k < len(every):
            if k >= sorted_to:
                sorted_to = min(len(every), max(32, 4 * sorted_to))
                near = np.argpartition(d, sorted_to - 1, 1)[:, :sorted_to] if sorted_to < len(every) else np.argsort(d, 1)
                near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1, kind="stable"), 1)
            far = d[todo, near[todo, k]]
            todo = todo[(far <= _reach(mine[todo], many[todo], some[todo])) & np.isfinite(far) & (many[todo] > 0)]
            if len(todo):
                cut, left = cut_cells(mine[todo], many[todo], some[todo], every[near[todo, k]])
                if cut.shape[1] > mine.shape[1]:
                    mine = np.concatenate([mine, np.zeros((len(some), cut.shape[1] - mine.shape[1], 2))], 1)
                mine[todo, : cut.shape[1]], many[todo] = cut, left
            k += 1
        if mine.shape[1] > cells.shape[1]:
            cells = np.concatenate([cells, np.zeros((len(own), mine.shape[1] - cells.shape[1], 2))], 1)
        cells[lo : lo + 512, : mine.shape[1]], count[lo : lo + 512] = mine, many
    return cells, count


def voronoi(points: DataFrame, area: list[tuple[float, float]], point_id: str, tile_points: int = TILE_POINTS, most_broadcast: int | None = None) -> DataFrame:
    """(point_id, area, geometry): the part of ``area`` (ring in a metric plane) nearest to each point (x, y).

    A cell is the area's box (a convex area itself) cut by the bisectors to other points, near ones first, until none can cut it any more, and
    then the area cut by the cell: exact in its size, where a concave area may keep bridges of no width. Points of
    equal place share a cell; of these the smallest id keeps it. Points are worked on by tile with the tiles around. A
    cell that reaches farther is checked at its corners: the point nearest to a corner cuts the cell if it is nearer than
    the cell's own point; such cells are cut and checked again until no corner is nearer to another point. So no
    task ever sees more than a tile, and what is left open is searched for by nearest neighbours (``most_broadcast`` as there).
    """
    ring = np.array(area, float)
    ring = ring[:-1] if len(ring) > 1 and np.array_equal(ring[0], ring[-1]) else ring
    x, y = ring[:, 0], ring[:, 1]
    if x @ np.roll(y, -1) - y @ np.roll(x, -1) < 0:
        ring = ring[::-1]
    seeds = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min(point_id).alias(point_id))
    seeds = durable(seeds)
    span = seeds.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).first()
    kind = points.schema[point_id].dataType.simpleString()
    low, high = ring.min(0), ring.max(0)
    # A convex area is itself what the cells are cut from.
    corners_of_ring = convex_hull(ring)
    convex = abs(area_of(corners_of_ring) - area_of(ring)) <= 1e-12 * area_of(ring)
    frame = corners_of_ring if convex else np.array([low, [high[0], low[1]], high, [low[0], high[1]]])
    extent = float(max((span[2] or 0) - (span[0] or 0), (span[3] or 0) - (span[1] or 0), *(high - low))) + 1e-9
    tiles = 1
    while span[4] and span[4] / (tiles * tiles) > tile_points / 9:
        tiles *= 2
    size = extent / tiles
    columns = [point_id, "x", "y", "cell", "open"]
    state = f"`{point_id}` {kind}, x double, y double, cell {_POINTS}, open boolean"

    def rows(ids: pd.Series, own: np.ndarray, cells: np.ndarray, count: np.ndarray, open_: np.ndarray) -> pd.DataFrame:
        corners = [[{"x": p, "y": q} for p, q in c[:k].tolist()] for c, k in zip(cells, count.tolist(), strict=True)]
        return pd.DataFrame({point_id: ids.to_numpy(), "x": own[:, 0], "y": own[:, 1], "cell": pd.Series(corners, dtype=object), "open": open_}, columns=columns)

    def tile_cells(own: pd.DataFrame) -> pd.DataFrame:
        mine = own[own["_own"]].reset_index(drop=True)
        at = mine[["x", "y"]].to_numpy()
        cells, count = cells_of(at, own[["x", "y"]].to_numpy(), frame)
        return rows(mine[point_id], at, cells, count, (count > 0) & (_reach(cells, count, at) > size))

    def cut_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch[["x", "y"]].to_numpy()
            cells, count = _padded(batch["cell"])
            found = [np.array([(p["x"], p["y"]) for p in c]).reshape(-1, 2) for c in batch["cutters"]]
            for k in range(max(map(len, found), default=0)):
                some = np.flatnonzero([len(c) > k for c in found])
                cut, left = cut_cells(cells[some], count[some], at[some], np.array([found[i][k] for i in some]))
                if cut.shape[1] > cells.shape[1]:
                    cells = np.concatenate([cells, np.zeros((len(at), cut.shape[1] - cells.shape[1], 2))], 1)
                cells[some, : cut.shape[1]], count[some] = cut, left
            yield rows(batch[point_id], at, cells, count, np.array([len(c) > 0 for c in found]) & (count > 0))

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            areas, shapes = [], []
            for corners in batch["cell"]:
                cell = np.array([(p["x"], p["y"]) for p in corners]).reshape(-1, 2)
                part = np.empty((0, 2)) if len(cell) < 3 else cell if convex else clip_to_convex(ring, cell)
                areas.append(area_of(part))
                shapes.append([[{"x": float(a), "y": float(b)} for a, b in [*part, part[0]]]] if len(part) > 2 else None)
            yield pd.DataFrame({point_id: batch[point_id].to_numpy(), "area": np.array(areas, float), "geometry": pd.Series(shapes, dtype=object)})

    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    tx, ty = (F.floor((F.col(c) - float(o or 0)) / size) for c, o in (("x", span[0]), ("y", span[1])))
    spread = seeds.withColumn("_o", F.explode(around)).select("x", "y", point_id, (tx + F.col("_o.i")).alias("_tx"), (ty + F.col("_o.j")).alias("_ty"), ((F.col("_o.i") == 0) & (F.col("_o.j") == 0)).alias("_own"))
    found = durable(spread.groupBy("_tx", "_ty").applyInPandas(tile_cells, state))
    done, rest = found.where("not open"), found.where("open")
    numbered = None
    while not rest.isEmpty():
        if numbered is None:
            numbered = durable(seeds.select("x", "y").withColumn("_seed", F.monotonically_increasing_id()))
        corner = F.explode("cell").alias("c")
        corners = rest.select(point_id, F.col("x").alias("px"), F.col("y").alias("py"), corner).select(point_id, "px", "py", "c.x", "c.y")
        limits = {"most_broadcast": most_broadcast} if most_broadcast is not None else {}
        nearest = nearest_nodes(corners, numbered, True, True, node_id="_seed", **limits)
        own = F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
        nearer = nearest.where(F.col("distance_node") < own * (1 - 1e-9) - 1e-12).select(point_id, "_seed").distinct()
        at = nearer.join(numbered, "_seed").groupBy(point_id).agg(F.collect_list(F.struct("x", "y")).alias("cutters"))
        todo = rest.select(point_id, "x", "y", "cell").join(at, point_id, "left").withColumn("cutters", F.coalesce("cutters", F.array().cast(_POINTS)))
        found = durable(todo.mapInPandas(cut_again, state))
        done, rest = done.unionByName(found.where("not open")), found.where("open")
    return done.mapInPandas(clip, f"`{point_id}` {kind}, area double, geometry {POLYGON}")


def _padded(cells: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    count = np.array([len(c) for c in cells], int)
    out = np.zeros((len(cells), max(int(count.max(initial=0)), 1), 2))
    for i, c in enumerate(cells):
        out[i, : len(c)] = np.array([(p["x"], p["y"]) for p in c]).reshape(-1, 2)
    return out, count


def clip_polygons(polygons: DataFrame, polygon_id: str, window: list[tuple[float, float]]) -> DataFrame:
    """(polygon_id, area, geometry) of the outer rings cut by a convex window; what lies outside gives no row."""
    frame = convex_hull(np.array(window, float))
    kind = polygons.schema[polygon_id].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, areas, shapes = [], [], []
            for i, shape in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = clip_to_convex(np.array([(p["x"], p["y"]) for p in shape[0][:-1]]), frame) if shape and shape[0] else np.empty((0, 2))
                if area_of(part) > 0:
                    ids.append(i)
                    areas.append(area_of(part))
                    shapes.append([[{"x": float(a), "y": float(b)} for a, b in [*part, part[0]]]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(areas, pa.float64()), pa.array(shapes, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))], names=[polygon_id, "area", "geometry"])

    return polygons.select(polygon_id, "geometry").mapInArrow(kernel, f"`{polygon_id}` {kind}, area double, geometry {POLYGON}")
