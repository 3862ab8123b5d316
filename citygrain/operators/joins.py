"""Spatial joins by grid cells, and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrain.functions import geom
from citygrain.operators.proximity import EARTH_M, NODE, haversine_m, str_order
from citygrain.operators.skew import SALTS, hot_keys
from citygrain.session import durable

PREDICATES = {"within": (1,), "intersects": (0, 1), "touches": (0,), "contains": (), "crosses": ()}
#: Targets up to this number are sent to every task; more are searched by rings of grid cells.
MOST_BROADCAST = 500_000
#: Cells of polygons, and corners in them, up to which polygons are sent to every task instead of shuffling the points.
MOST_CELLS, MOST_CORNERS = 200_000, 2_000_000


def spatial_join(points: DataFrame, polygons: DataFrame, polygon_id: str, predicate: str = "intersects", how: str = "inner", cell: float | None = None, x: str = "x", y: str = "y", geometry: str = "geometry") -> DataFrame:
    """The columns of ``points`` and the id of each polygon that meets the predicate; an equi-join over grid cells.

    Polygons are repeated for the cells their bounds cover, points have one cell; the exact position decides. Points
    only lie ``within`` (inside), ``touch`` (on the boundary) or ``intersect`` (both); they contain and cross nothing.
    ``cell`` is the cell size; by default polygons lie on grids by their own size (each covers a few cells), and points
    have a cell on each of these grids, so that neither large nor small polygons make many rows. With ``how="left"`` points without a match
    stay, with a null id. Null coordinates and null or empty polygons match nothing; a polygon id that is also a
    column of ``points`` raises RuntimeError. Polygons with few cells and corners are sent to all tasks, and points are
    not shuffled; otherwise cells that hold a large part of the points are split, and the polygons of these repeated.
    """
    if predicate not in PREDICATES:
        raise ValueError(f"unknown predicate {predicate!r}; use one of {', '.join(PREDICATES)}")
    if polygon_id in points.columns:
        raise RuntimeError(f"the points already have a column {polygon_id!r}")
    shapes = polygons.where(F.size(geometry) > 0).select(F.col(polygon_id), F.col(geometry).alias("_shape"))
    shapes = shapes.withColumns({f"_{k}": v for k, v in geom.bounds(F.col("_shape")).items()})
    extent = F.greatest(F.col("_maxx") - F.col("_minx"), F.col("_maxy") - F.col("_miny"), F.lit(1e-9))
    level = F.lit(0) if cell is not None else (2 * F.ceil(F.log2(extent) / 2)).cast("int")
    shapes = shapes.withColumn("_level", level)
    size = F.lit(float(cell)) if cell is not None else F.pow(F.lit(2.0), F.col("_level"))
    low = lambda c: F.floor(F.col(c) / size)
    covered = (low("_maxx") - low("_minx") + 1) * (low("_maxy") - low("_miny") + 1)
    corners = F.aggregate("_shape", F.lit(0), lambda n, r: n + F.size(r))
    # One row per level; levels are exponents of sizes, so there are some hundreds at most.
    levels, cells, weight = [], 0, 0
    for r in shapes.groupBy("_level").agg(F.sum(covered).alias("n"), F.sum(covered * corners).alias("w")).collect():
        levels, cells, weight = [*levels, r["_level"]], cells + (r["n"] or 0), weight + (r["w"] or 0)
    shapes = shapes.withColumn("_cx", F.explode(F.sequence(low("_minx"), low("_maxx")))).withColumn("_cy", F.explode(F.sequence(low("_miny"), low("_maxy"))))
    # A left join must keep each point once if nothing matches, so the levels are only spread before an inner join.
    if how != "inner" and len(levels) > 1:
        hits = spatial_join(points.select(x, y).distinct(), polygons, polygon_id, predicate, "inner", None, x, y, geometry)
        hits = hits.select(F.col(x).alias("_hx"), F.col(y).alias("_hy"), F.col(polygon_id))
        return points.join(hits, (F.col(x) == F.col("_hx")) & (F.col(y) == F.col("_hy")), how).select(*points.columns, polygon_id)
    keyed = points.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels or [0]])) if len(levels) > 1 else F.lit(levels[0] if levels else 0))
    keyed = keyed.withColumns({"_cx": low(x), "_cy": low(y)})
    places = PREDICATES[predicate]
    inside = geom.position(F.col(x), F.col(y), F.col("_shape")).isin(*places) if places else F.lit(False)
    box = F.col(x).between(F.col("_minx"), F.col("_maxx")) & F.col(y).between(F.col("_miny"), F.col("_maxy"))
    if cells <= MOST_CELLS and weight <= MOST_CORNERS:
        keyed, shapes = keyed.withColumn("_salt", F.lit(0)), F.broadcast(shapes.withColumn("_salt", F.lit(0)))
    else:
        place = F.xxhash64("_level", "_cx", "_cy")
        hot = hot_keys(keyed.select(place.alias("_cell")), "_cell", max(1, len(levels)) * points.count())
        spread = F.pmod(F.xxhash64(*[c for c, t in points.dtypes if not t.startswith("map")]), F.lit(SALTS)).cast("int")
        keyed = keyed.withColumn("_salt", F.when(place.isin(hot), spread).otherwise(0) if hot else F.lit(0))
        every = F.sequence(F.lit(0), F.lit(SALTS - 1))
        shapes = shapes.withColumn("_salt", F.explode(F.when(place.isin(hot), every).otherwise(F.array(F.lit(0)))) if hot else F.lit(0))
    left, right = keyed.alias("p"), shapes.alias("s")
    match = (F.col("p._level") == F.col("s._level")) & (F.col("p._cx") == F.col("s._cx")) & (F.col("p._cy") == F.col("s._cy")) & (F.col("p._salt") == F.col("s._salt")) & box & inside
    return left.join(right, match, how).select(*[F.col(f"p.{c}") for c in points.columns], F.col(f"s.{polygon_id}"))


def nearest_polygon(points: DataFrame, point_id: str, polygons: DataFrame, polygon_id: str, x: str = "x", y: str = "y", geometry: str = "geometry", cell: float | None = None, most_corners: int = MOST_CORNERS) -> DataFrame:
    """(point_id, polygon_id, boundary_distance): the polygon whose boundary is nearest, ties to the smallest id.

    Polygons of at most ``most_corners`` corners are sent to every task as a tree of their edges, and nothing is shuffled.
    More are searched by rings of grid cells of doubling size until a point has a boundary no farther than a cell.
    """
    corners = polygons.where(F.size(geometry) > 0).agg(F.sum(F.aggregate(geometry, F.lit(0), lambda n, r: n + F.size(r)))).first()[0] or 0
    if cell is None and 0 < corners <= most_corners:
        return _nearest_by_tree(points, point_id, polygons, polygon_id, x, y, geometry)
    shapes = polygons.where(F.size(geometry) > 0).select(polygon_id, F.col(geometry).alias("_shape"))
    shapes = shapes.withColumns({f"_{k}": v for k, v in geom.bounds(F.col("_shape")).items()})
    world = shapes.agg(F.min("_minx"), F.min("_miny"), F.max("_maxx"), F.max("_maxy"), F.avg(F.greatest(F.col("_maxx") - F.col("_minx"), F.col("_maxy") - F.col("_miny")))).first()
    rest = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(point_id, F.col(x).alias("_x"), F.col(y).alias("_y"))
    schema_out = [point_id, polygon_id, "boundary_distance"]
    if world[0] is None:
        return rest.limit(0).select(point_id).join(polygons.select(polygon_id).limit(0)).withColumn("boundary_distance", F.lit(0.0))
    span = points.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    reach = max([world[2], span[2] or world[2]]) - min([world[0], span[0] or world[0]]) + max([world[3], span[3] or world[3]]) - min([world[1], span[1] or world[1]])
    size, done = cell or (world[4] or 1.0), None
    while True:
        final = size >= reach
        low = lambda c, d=0: F.floor(F.col(c) / size) + d  # noqa: B023, E731
        spread = shapes.withColumn("_cx", F.explode(F.sequence(low("_minx", -1), low("_maxx", 1)))).withColumn("_cy", F.explode(F.sequence(low("_miny", -1), low("_maxy", 1))))
        near = rest.withColumns({"_cx": low("_x"), "_cy": low("_y")}).join(spread, ["_cx", "_cy"])
        best = near.withColumn("_d", geom.boundary_distance(F.col("_x"), F.col("_y"), F.col("_shape"))).groupBy(point_id).agg(F.min(F.struct(F.col("_d"), F.col(polygon_id))).alias("_best"))
        found = best.select(point_id, F.col(f"_best.{polygon_id}").alias(polygon_id), F.col("_best._d").alias("boundary_distance"))
        found = found if final else found.where(F.col("boundary_distance") <= size)
        if final:
            return (found if done is None else done.unionByName(found)).select(*schema_out)
        found = durable(found)
        done = found if done is None else done.unionByName(found)
        rest = durable(rest.join(found.select(point_id), point_id, "left_anti"))
        if rest.isEmpty():
            return done.select(*schema_out)
        size *= 4


def _nearest_by_tree(points: DataFrame, point_id: str, polygons: DataFrame, polygon_id: str, x: str, y: str, geometry: str) -> DataFrame:
    segments = F.explode(F.flatten(F.transform(geometry, geom._segments))).alias("s")
    table = polygons.where(F.size(geometry) > 0).select(F.col(polygon_id).alias("id"), segments).select("id", *[F.col(f"s.{e}.{c}").cast("double").alias(f"{e}{c}") for e in "ab" for c in "xy"]).where("id is not null").toArrow()
    ids = pa.concat_arrays(table.column("id").chunks).dictionary_encode() if table.num_rows else pa.array([], table.schema.field("id").type).dictionary_encode()
    names = ids.dictionary
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    edges = np.column_stack([table.column(f"{e}{c}").to_numpy() for e in "ab" for c in "xy"]) if table.num_rows else np.empty((0, 4))
    shared = points.sparkSession.sparkContext.broadcast((rank[ids.indices.to_numpy()], edges, names.take(pc.sort_indices(names))))
    kinds = {c: points.schema[c].dataType.simpleString() for c in (point_id,)} | {polygon_id: polygons.schema[polygon_id].dataType.simpleString()}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, edges, names = shared.value
        index = BoundaryIndex(owner, edges)
        for batch in batches:
            who, far = index.query(batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(who)), pa.array(far)], names=[point_id, polygon_id, "boundary_distance"])

    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(point_id, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return placed.mapInArrow(kernel, f"`{point_id}` {kinds[point_id]}, `{polygon_id}` {kinds[polygon_id]}, boundary_distance double")


class BoxTree:
    """Boxes of two or three dimensions in a packed tree, searched for what may be nearest to many points at once.

    A branch is left once something else is surely nearer, so far points meet few boxes too.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.order = str_order(x, y)
        self.levels = [(low[self.order], high[self.order])]
        while len(self.levels[-1][0]) > 1:
            below_low, below_high = self.levels[-1]
            cut = np.arange(0, len(below_low), NODE)
            self.levels.append((np.minimum.reduceat(below_low, cut), np.maximum.reduceat(below_high, cut)))

    def candidates(self, p: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, index of box) of all boxes that can be nearest, distances known up to ``slack`` of themselves."""
        who, node, bound = np.arange(len(p)), np.zeros(len(p), np.int64), np.full(len(p), np.inf)
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[depth]
            if depth < len(self.levels) - 1:
                first = node * NODE
                many = np.minimum(first + NODE, len(low)) - first
                who = np.repeat(who, many)
                node = np.repeat(first, many) + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            below, above = p[who] - low[node], p[who] - high[node]
            near = np.sqrt((np.maximum(np.maximum(-below, above), 0.0) ** 2).sum(1))
            far = np.sqrt((np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1))
            np.minimum.at(bound, who, far)
            keep = near <= bound[who] * (1 + slack) + 1e-15
            who, node = who[keep], node[keep]
        return who, self.order[node]


class NearestIndex:
    """Nearest target in the plane, or on the sphere by the directions from its centre; of targets in one place the smallest id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, sphere: bool):
        order = np.lexsort((ids, y, x))
        ids, x, y = ids[order], x[order], y[order]
        first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.empty(0, bool)
        self.ids, self.x, self.y, self.sphere = ids[first], x[first], y[first], sphere
        at = self._at(self.x, self.y)
        self.tree = BoxTree(self.x, self.y, at, at)

    def _at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not self.sphere:
            return np.column_stack([x, y])
        a, b = np.radians(x), np.radians(y)
        return np.column_stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)])

    def query(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(target id, distance) per point; equal distances go to the smallest id."""
        best, which = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for lo in range(0, len(x), 4096):
            p, t = self.tree.candidates(self._at(x[lo : lo + 4096], y[lo : lo + 4096]), 1e-8)
            p = p + lo
            d = haversine_m(x[p], y[p], self.x[t], self.y[t]) if self.sphere else np.sqrt((x[p] - self.x[t]) ** 2 + (y[p] - self.y[t]) ** 2)
            order = np.lexsort((self.ids[t], d, p))
            p, t, d = p[order], t[order], d[order]
            head = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.empty(0, bool)
            best[p[head]], which[p[head]] = d[head], self.ids[t[head]]
        return which, best


class BoundaryIndex:
    """The polygon whose boundary is nearest, over its edges; of equal edges that of the smallest polygon."""

    def __init__(self, owner: np.ndarray, edges: np.ndarray):
        order = np.lexsort((owner, *edges.T[::-1]))
        owner, edges = owner[order], edges[order]
        first = np.concatenate([[True], (edges[1:] != edges[:-1]).any(1)]) if len(edges) else np.empty(0, bool)
        self.owner, self.edges = owner[first], edges[first]
        a, b = self.edges[:, :2], self.edges[:, 2:]
        self.tree = BoxTree(*((a + b) / 2).T, np.minimum(a, b), np.maximum(a, b))

    def query(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, distance) per point; equal distances go to the smallest owner."""
        best, which = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        at = np.column_stack([x, y])
        for lo in range(0, len(x), 1024):
            p, e = self.tree.candidates(at[lo : lo + 1024], 1e-12)
            p = p + lo
            ax, ay, bx, by = self.edges[e].T
            dx, dy = bx - ax, by - ay
            square = dx * dx + dy * dy
            t = np.clip(np.divide((x[p] - ax) * dx + (y[p] - ay) * dy, square, out=np.zeros(len(p)), where=square > 0), 0, 1)
            d = np.sqrt((x[p] - (ax + t * dx)) ** 2 + (y[p] - (ay + t * dy)) ** 2)
            order = np.lexsort((self.owner[e], d, p))
            p, e, d = p[order], e[order], d[order]
            head = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.empty(0, bool)
            best[p[head]], which[p[head]] = d[head], self.owner[e[head]]
        return which, best


def nearest_nodes(points: DataFrame, nodes: DataFrame, projected: bool, return_distance: bool = False, x: str = "x", y: str = "y", node_id: str = "osmid", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``points`` with the id of the nearest node, and ``distance_node`` if asked: Euclidean if projected, else metres on a sphere.

    Nodes are sent to all tasks if there are at most ``most_broadcast``; more are joined by rings of grid cells. Equal
    distances go to the smallest id. Null coordinates of points raise ValueError; nodes without coordinates do not count.
    """
    if points.where(F.col(x).isNull() | F.col(y).isNull()).limit(1).count():
        raise ValueError("points without coordinates have no nearest node")
    usable = nodes.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(node_id).isNotNull()).select(F.col(node_id).cast("long").alias("_n"), F.col("x").cast("double").alias("_nx"), F.col("y").cast("double").alias("_ny"))
    kept = [c for c in points.columns if c not in (node_id, "distance_node")]
    points = points.select(*kept)
    count = usable.limit(most_broadcast + 1).count()
    if count == 0:
        raise ValueError("there are no nodes with coordinates")
    if count > most_broadcast:
        out = _nearest_by_rings(points, usable, projected, x, y)
    else:
        table = usable.toPandas()
        shared = points.sparkSession.sparkContext.broadcast((table["_n"].to_numpy(), table["_nx"].to_numpy(), table["_ny"].to_numpy()))

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in batches:
                index = index or NearestIndex(*shared.value, not projected)
                who, far = index.query(batch.column(x).to_numpy(zero_copy_only=False).astype(float), batch.column(y).to_numpy(zero_copy_only=False).astype(float))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(who), pa.array(far)], names=[*batch.schema.names, "_n", "_d"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
        out = points.mapInArrow(kernel, f"{fields}, _n long, _d double")
    columns = [*kept, F.col("_n").alias(node_id)] + ([F.col("_d").alias("distance_node")] if return_distance else [])
    return out.select(*columns)


def _ring_size(wide: float, high: float, n: int) -> float:
    """Size of the first cells, of about four nodes; by area, as on a long strip cells by extent would hold very many."""
    return 2 * max((wide * high / n) ** 0.5, max(wide, high) / n, 1e-9)


def _nearest_by_rings(points: DataFrame, nodes: DataFrame, projected: bool, x: str, y: str) -> DataFrame:
    from citygrain.functions.scalar import haversine

    keyed = durable(points.withColumn("_key", F.monotonically_increasing_id()))
    span = nodes.agg(F.min("_nx"), F.min("_ny"), F.max("_nx"), F.max("_ny"), F.count("*")).first()
    size, rest, done = _ring_size(span[2] - span[0], span[3] - span[1], span[4]), keyed, None
    own = keyed.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    own = span if own[0] is None else own
    reach = max(span[2], own[2]) - min(span[0], own[0]) + max(span[3], own[3]) - min(span[1], own[1])
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while True:
        final = size >= reach
        around = nodes
        if not projected:
            # As in NearestIndex, nodes also lie at x - 360 and x + 360; only copies that share a cell with a point can be met.
            turned = nodes.withColumn("_nx", F.explode(F.array(F.col("_nx") - 360, F.col("_nx") + 360)))
            around = nodes.unionByName(turned.where(F.col("_nx").between(own[0] - 2 * size, own[2] + 2 * size)))
        spread = around.withColumn("_o", F.explode(offsets)).withColumns({"_cx": F.floor(F.col("_nx") / size) + F.col("_o.i"), "_cy": F.floor(F.col("_ny") / size) + F.col("_o.j")}).drop("_o")
        near = rest.withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)}).join(spread, ["_cx", "_cy"])
        plane = F.sqrt(F.pow(F.col(x) - F.col("_nx"), 2) + F.pow(F.col(y) - F.col("_ny"), 2))
        d = plane if projected else haversine(F.col(x), F.col(y), F.col("_nx"), F.col("_ny"))
        best = near.groupBy("_key").agg(F.min(F.struct(d.alias("d"), F.col("_n").alias("n"))).alias("_best"))
        # A cell in degrees is no shorter than its extent along the parallel at the highest latitude reached.
        sure = F.lit(size) if projected else F.radians(F.lit(size)) * EARTH_M * F.cos(F.radians(F.least(F.abs(F.col("_lat")) + size, F.lit(90.0))))
        found = rest.select("_key", F.col(y).alias("_lat")).join(best, "_key")
        found = (found if final else found.where(F.col("_best.d") <= sure)).select("_key", F.col("_best.n").alias("_n"), F.col("_best.d").alias("_d"))
        if final:
            every = found if done is None else done.unionByName(found)
            return keyed.join(every, "_key").drop("_key")
        found = durable(found)
        done = found if done is None else done.unionByName(found)
        rest = durable(rest.join(found.select("_key"), "_key", "left_anti"))
        if rest.isEmpty():
            return keyed.join(done, "_key").drop("_key")
        size *= 4
