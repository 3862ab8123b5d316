"""Points near other points, and the region that holds a point, by a quadtree made from a sample.

The sample gives a quadtree whose leaves hold about as many points each. Points are sent to their leaf and, near a
border, to the leaves they reach into. Each leaf loads an R-tree in bulk and probes it with its own points; exact
geometry decides, and a pair counts only in the leaf that owns its reference point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Points looked at to lay out the quadtree, and points that a leaf should hold. Both only steer the layout.
SAMPLE_POINTS = 50_000
LEAF_POINTS = 30_000
#: A leaf that cannot be split further and holds more than this is worked on in pieces, each pair of pieces once.
PIECE_POINTS = 100_000
NODE = 16
#: Edges from which a polygon is cut to what each leaf needs.
LARGE_POLYGON = 64


def str_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The order of sort-tile-recursive packing: strips by x, within them by y."""
    n = len(x)
    slab = max(1, int(np.ceil(np.sqrt(-(-n // NODE))))) * NODE
    strip = np.empty(n, np.int64)
    strip[np.argsort(x, kind="stable")] = np.arange(n) // slab
    return np.lexsort((y, strip))


class RTree:
    """Static R-tree over boxes, packed by sort-tile-recursive bulk loading and probed for many boxes at once."""

    def __init__(self, boxes: np.ndarray):
        self.order = str_order(boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3])
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            cut = np.arange(0, len(below), NODE)
            low, high = np.minimum.reduceat(below[:, :2], cut), np.maximum.reduceat(below[:, 2:], cut)
            self.levels.append(np.hstack([low, high]))

    def probe(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of probing box, index of loaded box) of all pairs that overlap or touch."""
        if not len(self.levels[0]) or not len(boxes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        who, node = np.arange(len(boxes)), np.zeros(len(boxes), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            if depth < len(self.levels) - 1:
                first = node * NODE
                many = np.minimum(first + NODE, len(level)) - first
                who = np.repeat(who, many)
                node = np.repeat(first, many) + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            a, b = boxes[who], level[node]
            hit = (a[:, 0] <= b[:, 2]) & (a[:, 2] >= b[:, 0]) & (a[:, 1] <= b[:, 3]) & (a[:, 3] >= b[:, 1])
            who, node = who[hit], node[hit]
        return who, self.order[node]


def _interleave(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


@dataclass
class Quadtree:
    """Leaves as ranges of Morton codes: ``first`` has the code at which each leaf begins, in order."""

    x0: float
    y0: float
    side: float
    depth: int
    first: np.ndarray
    pieces: np.ndarray

    def code(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        top = (1 << self.depth) - 1
        cell = self.side / (1 << self.depth)
        i, j = (np.clip((v - o) / cell, 0, top).astype(np.int64) for v, o in ((x, self.x0), (y, self.y0)))
        return (_interleave(i) | (_interleave(j) << np.uint64(1))).astype(np.int64)

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, self.code(x, y), "right") - 1

    def boxes(self) -> np.ndarray:
        """(x0, y0, x1, y1) of the leaves."""
        ends = np.append(self.first[1:], 1 << (2 * self.depth))
        size = np.sqrt((ends - self.first).astype(float)) * self.side / (1 << self.depth)
        even = lambda c: sum(((c >> (2 * k)) & 1) << k for k in range(self.depth))
        cell = self.side / (1 << self.depth)
        x, y = self.x0 + even(self.first) * cell, self.y0 + even(self.first >> 1) * cell
        return np.column_stack([x, y, x + size, y + size])

    def leaves_of(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of box, leaf) of all pairs that overlap or touch."""
        return RTree(self.boxes()).probe(boxes)


def build_quadtree(x: np.ndarray, y: np.ndarray, root: tuple[float, float, float], total: int, smallest: float, leaf_points: int = LEAF_POINTS, piece_points: int = PIECE_POINTS) -> Quadtree:
    """Split the root square until a leaf has about ``leaf_points`` of ``total`` points, judged by the sample x, y.

    No leaf becomes smaller than ``smallest``. A leaf still too full then is given pieces.
    """
    depth = int(np.clip(np.floor(np.log2(root[2] / smallest)), 0, 24))
    tree = Quadtree(*root, depth, np.zeros(1, np.int64), np.ones(1, np.int64))
    codes = np.sort(tree.code(x, y))
    share = max(2.0, leaf_points * max(1, len(codes)) / max(total, 1))
    weight = max(total, 1) / max(1, len(codes))
    first, pieces, stack = [], [], [(0, 0)]
    while stack:
        at, level = stack.pop()
        span = 1 << (2 * (depth - level))
        inside = int(np.searchsorted(codes, at + span) - np.searchsorted(codes, at))
        if inside > share and level < depth:
            stack += [(at + k * (span >> 2), level + 1) for k in (3, 2, 1, 0)]
        else:
            first.append(at)
            pieces.append(min(4095, max(1, int(np.ceil(inside * weight / piece_points)))) if level == depth else 1)
    return Quadtree(*root, depth, np.array(first, np.int64), np.array(pieces, np.int64))


def valid_location(lon: Column, lat: Column) -> Column:
    """Both coordinates known and possible, and not the 0/0 that stands for a missing place."""
    return lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) <= 180) & (F.abs(lat) <= 90) & ~((lon == 0) & (lat == 0))


def _sample(points: DataFrame, rows: int | None, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    total = points.count() if rows is None else rows
    taken = points.select("lon", "lat").sample(min(1.0, size / max(total, 1)), seed=11).limit(2 * size).toPandas()
    return taken["lon"].to_numpy(float), taken["lat"].to_numpy(float), total


def _cube(lon: np.ndarray, lat: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index, plane x, plane y, own) of the points on the faces of a cube around the sphere, laid side by side.

    Each point has its own face and, within ``margin`` of an edge, the neighbouring ones. Neither the poles nor
    the 180th meridian are borders here, and a metre has nearly the same length all over a face.
    """
    a, b = np.radians(lon), np.radians(lat)
    xyz = np.column_stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)])
    main = np.argmax(np.abs(xyz), axis=1) * 2 + (np.take_along_axis(xyz, np.argmax(np.abs(xyz), axis=1)[:, None], 1)[:, 0] < 0)
    index, px, py, own = [], [], [], []
    for face in range(6):
        axis, sign = face // 2, 1 - 2 * (face % 2)
        toward = xyz[:, axis] * sign
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = xyz[:, (axis + 1) % 3] / toward, xyz[:, (axis + 2) % 3] / toward
        here = np.flatnonzero((toward > 0.1) & (np.abs(u) <= 1 + margin) & (np.abs(v) <= 1 + margin))
        index.append(here)
        px.append(u[here] + 4 * face)
        py.append(v[here])
        own.append(main[here] == face)
    return tuple(np.concatenate(x) for x in (index, px, py, own))


def haversine_m(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    lat1, lat2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(h)))


def _mix(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def near_pairs(points: DataFrame, radius_m: float = 20.0, rows: int | None = None, leaf_points: int = LEAF_POINTS, piece_points: int = PIECE_POINTS) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: pairs of different ids at most ``radius_m`` apart on the sphere, each once.

    ``points`` is (id, lon, lat); further columns are ignored. Null ids, missing or impossible coordinates and 0/0
    do not count; repeated rows count once; an id with several places is near if one of them is. ``rows`` is the
    number of points if known. Up to a few kilometres of radius. Points in one spot make all their pairs, as asked.
    """
    points = points.select(F.col("id").cast("long").alias("id"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    points = points.where(F.col("id").isNotNull() & valid_location(F.col("lon"), F.col("lat")))
    lon, lat, total = _sample(points, rows, SAMPLE_POINTS)
    reach = 3.1 * radius_m / EARTH_M  # the plane stretches a length at most threefold, in the corners of a face
    _, x, y, own = _cube(lon, lat, 0.0)
    tree = build_quadtree(x[own], y[own], (-1.5, -16.0, 32.0), total, 4 * reach, leaf_points, piece_points)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lon, lat = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            index, x, y, own = _cube(lon, lat, 2 * reach)
            home = np.where(own, tree.leaf(x, y), -1)
            corners = np.column_stack([tree.leaf(x + dx, y + dy) for dx in (-reach, reach) for dy in (-reach, reach)])
            corners.sort(axis=1)
            fresh = np.column_stack([np.ones(len(x), bool), corners[:, 1:] != corners[:, :-1]])
            at, col = np.nonzero(fresh)
            leaf = corners[at, col]
            mine = leaf == home[at]
            k = tree.pieces[leaf]
            piece = (_mix(ids[index[at]]) % k.astype(np.uint64)).astype(np.int64)
            parts = [(at, leaf, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), mine, np.ones(len(at), bool))]
            big = k > 1
            if big.any():
                parts = [tuple(v[~big] for v in parts[0])]
                a, n = np.flatnonzero(big), k[big]
                each = np.repeat(a, n)
                other = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                parts.append((at[each], leaf[each], other, piece[each], np.zeros(len(each), bool), np.ones(len(each), bool)))
                asks = mine[each]
                each, other = each[asks], other[asks]
                parts.append((at[each], leaf[each], piece[each], other, np.ones(len(each), bool), np.zeros(len(each), bool)))
            at, leaf, one, two, asks, stays = (np.concatenate([p[i] for p in parts]) for i in range(6))
            who = index[at]
            task = (leaf << 24) | (one << 12) | two
            arrays = [task, ids[who], lon[who], lat[who], x[at], y[at], asks, stays]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=["task", "id", "lon", "lat", "x", "y", "asks", "stays"])

    def pairs(table: pa.Table) -> pa.Table:
        ids, lon, lat, x, y, asks, stays = (table.column(c).to_numpy() for c in ("id", "lon", "lat", "x", "y", "asks", "stays"))
        asks, stays = np.flatnonzero(asks), np.flatnonzero(stays)
        loaded = RTree(np.column_stack([x, y, x, y])[stays])
        found = []
        for lo in range(0, len(asks), 20_000):
            some = asks[lo : lo + 20_000]
            a, b = loaded.probe(np.column_stack([x[some] - reach, y[some] - reach, x[some] + reach, y[some] + reach]))
            a, b = some[a], stays[b]
            later = ids[a] < ids[b]
            a, b = a[later], b[later]
            near = haversine_m(lon[a], lat[a], lon[b], lat[b]) <= radius_m
            found.append((ids[a[near]], ids[b[near]]))
        one, two = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        return pa.table({"id_a": pa.array(one, pa.int64()), "id_b": pa.array(two, pa.int64())})

    schema = "task long, id long, lon double, lat double, x double, y double, asks boolean, stays boolean"
    sent = points.distinct().mapInArrow(spread, schema)
    return sent.groupBy("task").applyInArrow(pairs, "id_a long, id_b long").distinct()


def _in_ring(px: np.ndarray, py: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per point and edge: does a ray to the right cross it; does the point lie on it."""
    side = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    on = (side == 0) & (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
    cross = ((y1 > py) != (y2 > py)) & ((side > 0) == (y2 > y1)) & (side != 0)
    return cross, on


def _edges_by_leaf(lists: list[pa.Array], who: np.ndarray, leaf: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """(list number per pair of polygon and leaf, or -1 where the leaf lies outside; edge lists x1, y1, x2, y2).

    Of a large polygon a leaf needs the edges beside or right of it within its span of y, since the rays go right. If none
    is in the leaf, it lies within or outside as a whole.
    """
    off = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
    x1, y1, x2, y2 = (c.flatten().to_numpy() for c in lists)
    take, sizes, parts = np.full(len(who), -1), [], []
    for pair, (polygon, (bx0, by0, bx1, by1)) in enumerate(zip(who.tolist(), boxes[leaf].tolist(), strict=True)):
        own = slice(off[polygon], off[polygon + 1])
        edge = [x1[own], y1[own], x2[own], y2[own]]
        if len(edge[0]) > LARGE_POLYGON:
            ax, ay, cx, cy = edge
            band = (np.maximum(ay, cy) >= by0) & (np.minimum(ay, cy) <= by1) & (np.maximum(ax, cx) >= bx0)
            edge = [v[band] for v in edge]
            if not (np.minimum(edge[0], edge[2]) <= bx1).any():
                cross, _ = _in_ring((bx0 + bx1) / 2, (by0 + by1) / 2, *edge)
                if cross.sum() % 2 == 0:
                    continue
                edge = [np.array(v) for v in ((bx0, bx1, bx1, bx0), (by0, by0, by1, by1), (bx1, bx1, bx0, bx0), (by0, by1, by1, by0))]
        take[pair] = len(parts)
        parts.append(edge)
        sizes.append(len(edge[0]))
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return take, [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p[i] for p in parts]) if parts else np.empty(0))) for i in range(4)]


def locate(points: DataFrame, regions: DataFrame, region_id: str, geometry: str = "geometry", rows: int | None = None, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """(id, lon, lat, region_id) of the points that lie in or on a region.

    ``regions`` has polygons ``array<array<struct<x,y>>>`` (rings, holes by the even-odd rule) in the same
    coordinates; a polygon that runs past x = 180 or -180 is also met from the other side. Points that are not
    valid, null ids and null or empty polygons give no row; repeated rows count once. If several regions hold a
    point, it gets the one with the smallest id. A leaf gets only the edges of a large polygon that can decide there, and
    a leaf that lies within it whole gets its own four sides instead, so a country over a dense city is not repeated.
    """
    points = points.select(F.col("id").cast("long").alias("id"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    points = points.where(F.col("id").isNotNull() & valid_location(F.col("lon"), F.col("lat")))
    lon, lat, total = _sample(points, rows, SAMPLE_POINTS)
    points = points.distinct()
    tree = build_quadtree(lon, lat, (-180.0, -180.0, 360.0), total, 360.0 / (1 << 20), leaf_points)
    name = regions.schema[region_id].dataType.simpleString()
    segment = F.expr(f"flatten(transform({geometry}, r -> transform(sequence(1, size(r) - 1), i -> struct(r[i-1].x as x1, r[i-1].y as y1, r[i].x as x2, r[i].y as y2))))")
    edges = regions.select(F.col(region_id).alias("region"), F.expr(f"filter({geometry}, r -> size(r) > 2)").alias(geometry)).where(F.size(geometry) > 0).select("region", segment.alias("e"))
    low, high = F.array_min("e.x1"), F.array_max("e.x1")
    edges = edges.withColumn("shift", F.explode(F.expr("filter(array(0.0D, -360.0D, 360.0D), s -> s = 0 or (s < 0 and array_max(e.x1) > 180) or (s > 0 and array_min(e.x1) < -180))")))
    edges = edges.select("region", (low + F.col("shift")).alias("x0"), F.array_min("e.y1").alias("y0"), (high + F.col("shift")).alias("x1"), F.array_max("e.y1").alias("y1"), *[(F.transform(f"e.{c}", lambda v: v + F.col("shift")) if c[0] == "x" else F.col(f"e.{c}")).alias(f"s_{c}") for c in ("x1", "y1", "x2", "y2")])

    def send_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lon, lat = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            leaf = tree.leaf(lon, lat)
            task = (leaf << 24) | (_mix(ids) % tree.pieces[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(task), *batch.columns], names=["task", "id", "lon", "lat"])

    def send_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)])
            who, leaf = tree.leaves_of(box)
            k = tree.pieces[leaf]
            each = np.repeat(np.arange(len(who)), k)
            piece = np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
            lists = [batch.column(i) for i in range(5, 9)]
            size = np.diff(lists[0].offsets.to_numpy())
            if (size > LARGE_POLYGON).any():
                take, lists = _edges_by_leaf(lists, who, leaf, tree.boxes())
                each, back = each[take[each] >= 0], each
                piece = piece[take[back] >= 0]
                columns = [*batch.take(pa.array(who[each])).columns[:5], *[c.take(pa.array(take[each])) for c in lists]]
            else:
                columns = batch.take(pa.array(who[each])).columns
            yield pa.RecordBatch.from_arrays([pa.array((leaf[each] << 24) | piece), *columns], names=["task", *batch.schema.names])

    def match(own: pa.Table, areas: pa.Table) -> pa.Table:
        empty = own.select(["id", "lon", "lat"]).slice(0, 0).append_column("region", areas.column("region").slice(0, 0))
        if not own.num_rows or not areas.num_rows:
            return empty
        lon, lat = own.column("lon").to_numpy(), own.column("lat").to_numpy()
        areas = areas.sort_by("region").combine_chunks()
        tree_of_areas = RTree(np.column_stack([areas.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")]))
        lists = {c: areas.column(f"s_{c}").combine_chunks() for c in ("x1", "y1", "x2", "y2")}
        off = lists["x1"].offsets.to_numpy() - lists["x1"].offsets[0].as_py()
        flat = {c: v.flatten().to_numpy() for c, v in lists.items()}
        best = np.full(len(lon), len(areas))
        for lo in range(0, len(lon), 20_000):
            x, y = lon[lo : lo + 20_000], lat[lo : lo + 20_000]
            p, r = tree_of_areas.probe(np.column_stack([x, y, x, y]))
            many = off[r + 1] - off[r]
            pair = np.repeat(np.arange(len(p)), many)
            edge = np.repeat(off[r], many) + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
            cross, on = _in_ring(x[p[pair]], y[p[pair]], *(flat[c][edge] for c in ("x1", "y1", "x2", "y2")))
            held = (np.bincount(pair, cross, len(p)).astype(int) % 2 == 1) | (np.bincount(pair, on, len(p)) > 0)
            np.minimum.at(best, lo + p[held], r[held])
        hit = np.flatnonzero(best < len(areas))
        return own.select(["id", "lon", "lat"]).take(pa.array(hit)).append_column("region", areas.column("region").take(pa.array(best[hit])))

    lists = ", ".join(f"s_{c} array<double>" for c in ("x1", "y1", "x2", "y2"))
    left = points.mapInArrow(send_points, "task long, id long, lon double, lat double").groupBy("task")
    right = edges.mapInArrow(send_regions, f"task long, region {name}, x0 double, y0 double, x1 double, y1 double, {lists}").groupBy("task")
    return left.cogroup(right).applyInArrow(match, f"id long, lon double, lat double, region {name}").withColumnRenamed("region", region_id)
