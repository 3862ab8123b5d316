"""Operators for areas, networks, rasters and census tables: known values, brute force, awkward input."""

import datetime as dt
import heapq
import json
import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citygrain.functions import classify, convert, crs, geom, scalar
from citygrain.operators import aggregate, census, grid, interpolate, joins, network, raster, tessellate
from citygrain.sources import files, overpass
from citygrain.streaming import events as streams

SHAPE = "array<array<struct<x:double,y:double>>>"


def ring(*xy):
    return [[{"x": float(x), "y": float(y)} for x, y in xy]]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))


@pytest.fixture(scope="module")
def points(spark):
    rows = [("A", 10.5, 1, 0.0, 0.0), ("B", 20.3, 1, 1.0, 0.0), ("C", 15.7, 2, 0.0, 1.0), ("D", 30.2, 2, 1.0, 1.0), ("E", 25.1, 3, 0.5, 0.5)]
    return spark.createDataFrame(rows, "point_id string, value double, category int, x double, y double").coalesce(1)


@pytest.fixture(scope="module")
def bins(spark):
    rows = [("bin_1", box(-0.5, -0.5, 0.5, 0.5)), ("bin_2", box(0.5, -0.5, 1.5, 0.5)), ("bin_3", box(-0.5, 0.5, 0.5, 1.5))]
    return spark.createDataFrame(rows, f"bin_id string, geometry {SHAPE}").coalesce(1)


@pytest.mark.parametrize(("predicate", "expected"), [("within", [10.5, 20.3, 15.7]), ("intersects", [17.8, 22.7, 20.4]), ("touches", [25.1] * 3), ("contains", [0.0] * 3)])
def test_bins(points, bins, predicate, expected):
    out = aggregate.group_points_by_bins(points, bins, "bin_id", "value", predicate=predicate, cell=1.0).orderBy("bin_id").collect()
    assert [r["value"] for r in out] == pytest.approx(expected)


def test_bins_options_and_errors(spark, points, bins):
    wide = points.union(spark.createDataFrame([("N", math.nan, 9, 0.0, 0.0), ("M", None, 9, None, 0.0)], points.schema)).withColumn("geometry", F.lit(1))
    out = aggregate.group_points_by_bins(wide, bins, "bin_id", ["value", "category"], {"value": F.max, "category": "count"}, drop_columns=["geometry"], cell=1.0)
    assert {r["bin_id"]: (r["value"], r["category"]) for r in out.collect()} == {"bin_1": (10.5, 2), "bin_2": (20.3, 1), "bin_3": (15.7, 1)}
    for bad, error in [(dict(bin_id="no"), ValueError), (dict(columns="no"), ValueError), (dict(predicate="near"), ValueError), (dict(func="mode"), ValueError), (dict(func={}), ValueError), (dict(fill_value="x"), TypeError), (dict(points=3), TypeError)]:
        args = dict(points=points, bins=bins, bin_id="bin_id", columns="value") | bad
        with pytest.raises(error):
            aggregate.group_points_by_bins(**args)
    with pytest.raises(RuntimeError):
        aggregate.group_points_by_bins(points.withColumn("bin_id", F.lit(1)), bins, "bin_id", "value")
    assert [r["value"] for r in aggregate.group_points_by_bins(points.limit(0), bins, "bin_id", "value", fill_value=-1.0, cell=1.0).collect()] == [-1.0] * 3


def test_group_sociodemographic(spark):
    df = spark.createDataFrame([(100.0, 20, 10.0, 100, 10.0, None), (200.0, 30, 20.0, 200, None, None), (300.0, 40, 30.0, 300, 30.0, None)], "pop double, households int, rate double, weight int, value double, none double")
    got = aggregate.group_sociodemographic(df, ["pop", "households", "rate", "value", "none", "absent"], ["value"], {"rate": "weight"})
    assert got == pytest.approx({"pop": 600, "households": 90, "rate": 23.333333333, "value": 20, "none": 0})
    assert aggregate.group_sociodemographic(df, ["value"]) == {"value": 40.0}
    assert aggregate.group_sociodemographic(df.limit(0), ["pop"]) == {}
    with pytest.raises(TypeError):
        aggregate.group_sociodemographic(df, ["pop"], None, ["weight"])
    assert df.agg(scalar.weighted_average(F.col("weight"), F.col("rate"))).first()[0] == pytest.approx(23.3333333)


def test_areas_and_points(spark):
    areas = spark.createDataFrame([("a", 100.0, 3.0, box(0, 0, 1, 1)), ("b", 50.0, 4.0, box(1, 0, 2, 1)), ("c", 7.0, 5.0, box(5, 5, 6, 6))], f"cve string, people double, rate double, geometry {SHAPE}")
    pts = spark.createDataFrame([(1, 0.5, 0.5, 2.0), (2, 0.2, 0.2, None), (3, 1.0, 0.5, 4.0), (4, 3.0, 0.5, 8.0), (5, None, 0.5, 1.0)], "id int, x double, y double, v double")
    out = aggregate.polygons_to_points(pts, areas, "cve", 0, -1, ["rate"], 1.0).collect()
    assert {(r.id, r.cve, r.people, r.rate) for r in out} == {(1, "a", 100 / 3, 3.0), (2, "a", 100 / 3, 3.0), (3, "a", 100 / 3, 3.0), (3, "b", 50.0, 4.0), (4, None, None, None), (5, None, None, None)}
    back = aggregate.points_to_polygons(pts, areas, "cve", ["id"], include_nearest=True, point_id="id", cell=1.0)
    assert back.columns == ["v", "cve"] and {r.cve: r.v for r in back.collect()} == {"a": 6.0, "b": 12.0}
    assert {r.cve: r.points_count for r in aggregate.count_points(pts, areas, "cve", 1.0).collect()} == {"a": 3, "b": 1, None: 2}
    with pytest.raises(KeyError):
        aggregate.polygons_to_points(pts, areas, "no")
    with pytest.raises(ValueError):
        aggregate.polygons_to_points(pts, areas, "cve", 3, 9)
    with pytest.raises(ValueError):
        aggregate.points_to_polygons(pts, areas, "cve", include_nearest=True)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spatial_join_of_mixed_sizes(spark, how):
    rng = np.random.default_rng(8)
    at, size = rng.random((60, 2)) * 100, 10 ** rng.uniform(-2, 2, 60)
    shapes = [(i, box(a, b, a + s, b + s)) for i, ((a, b), s) in enumerate(zip(at.tolist(), size.tolist()))] + [(90, None), (91, box(3, 3, 3, 3))]
    xy = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.random((150, 2)) * 120)] + [(400, None, 1.0), (401, 3.0, 3.0), (401, 3.0, 3.0)]
    pts, polygons = spark.createDataFrame(xy, "id int, x double, y double"), spark.createDataFrame(shapes, f"shape int, geometry {SHAPE}")
    got = sorted((r.id, -1 if r["shape"] is None else r["shape"]) for r in joins.spatial_join(pts, polygons, "shape", "intersects", how).collect())
    want = []
    for k, px, py in xy:
        hit = [i for i, ((a, b), s) in enumerate(zip(at.tolist(), size.tolist())) if px is not None and a <= px <= a + s and b <= py <= b + s] + [91] * ((px, py) == (3.0, 3.0))
        want += [(k, i) for i in hit] or ([(k, -1)] if how == "left" else [])
    assert got == sorted(want)
    assert joins.spatial_join(pts, polygons.limit(0), "shape", how=how).count() == (len(xy) if how == "left" else 0)


@pytest.mark.parametrize("sphere", [True, False])
def test_nearest_index_of_far_points_and_copies(sphere):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.uniform(-180, 180, 300), np.full(40_000, 12.0), [180.0, -180.0, 0.0, 0.0]])
    y = np.concatenate([rng.uniform(-90, 90, 300), np.full(40_000, 45.0), [10.0, 10.0, 90.0, -90.0]])
    ids = rng.permutation(len(x)).astype(np.int64)
    px, py = np.concatenate([rng.uniform(-180, 180, 4500), [12.0, 179.999, -179.999, 50.0]]), np.concatenate([rng.uniform(-90, 90, 4500), [45.0, 10.0, 10.0, 89.9999]])
    who, far = joins.NearestIndex(ids, x, y, sphere).query(px, py)
    small = np.concatenate([np.arange(300), [300 + int(ids[300:40_300].argmin())], np.arange(40_300, 40_304)])
    d = joins.haversine_m(px[:, None], py[:, None], x[small], y[small]) if sphere else np.hypot(px[:, None] - x[small], py[:, None] - y[small])
    assert np.allclose(far, d.min(1), rtol=1e-12, atol=1e-6) and (np.take_along_axis(d, np.array([np.flatnonzero(ids[small] == w)[0] for w in who])[:, None], 1)[:, 0] <= d.min(1) * (1 + 1e-12) + 1e-6).all()
    assert who[4500] == ids[300:40_300].min()


@pytest.mark.parametrize("most", [10**6, 0])
def test_nearest_polygon_of_far_points(spark, most):
    rng = np.random.default_rng(3)
    corners = [(f"z{k:02}", *map(float, rng.uniform(0, 50, 2)), float(rng.uniform(0.5, 4))) for k in range(40)] + [("a", 7.0, 7.0, 2.0), ("b", 7.0, 7.0, 2.0)]
    polygons = spark.createDataFrame([(z, box(a, b, a + s, b + s)) for z, a, b, s in corners] + [("n", None)], f"zone string, geometry {SHAPE}")
    xy = np.concatenate([rng.uniform(-10, 60, (150, 2)), rng.uniform(-5000, 5000, (20, 2)), [[8.0, 8.0]]])
    table = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(900, None, 0.0)], "id long, x double, y double")
    got = {r.id: (r.zone, r.boundary_distance) for r in joins.nearest_polygon(table, "id", polygons, "zone", most_corners=most).collect()}

    def distance(p, a, b, s):
        dx, dy = max(a - p[0], 0, p[0] - a - s), max(b - p[1], 0, p[1] - b - s)
        return math.hypot(dx, dy) if dx or dy else min(p[0] - a, a + s - p[0], p[1] - b, b + s - p[1])

    want = {i: min((distance(p, a, b, s), z) for z, a, b, s in corners) for i, p in enumerate(xy)}
    assert {i: z for i, (z, _) in got.items()} == {i: z for i, (_, z) in want.items()} and all(got[i][1] == pytest.approx(d) for i, (d, _) in want.items())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spatial_join_of_a_hot_cell(spark, monkeypatch, how):
    rng = np.random.default_rng(8)
    rows = [(i, *((float(5.2 + 0.4 * rng.random()), 5.3) if i % 2 else map(float, rng.random(2) * 12))) for i in range(3000)]
    table = spark.createDataFrame([*rows, (9001, None, 1.0)], "id long, x double, y double")
    polygons = spark.createDataFrame([(k, box(k % 4 * 3, k // 4 * 3, k % 4 * 3 + 3.5, k // 4 * 3 + 3)) for k in range(16)], f"bin long, geometry {SHAPE}")
    joined = lambda **kw: sorted(((r.id, r.bin) for r in joins.spatial_join(table, polygons, "bin", "intersects", how, **kw).collect()), key=str)
    plain = joined(cell=3.0)
    monkeypatch.setattr(joins, "MOST_CELLS", 0)
    found = []
    monkeypatch.setattr(joins, "hot_keys", lambda *a, own=joins.hot_keys: found.append(own(*a)) or found[-1])
    assert joined(cell=3.0) == plain and joined() == plain and len(plain) > 3000
    assert all(found)


@pytest.mark.parametrize("projected", [True, False])
@pytest.mark.parametrize("most", [1000, 0])
def test_nearest_nodes(spark, projected, most):
    rng = np.random.default_rng(3)
    n, p = rng.uniform(-170, 170, (80, 2)) / [1, 2.2], rng.uniform(-180, 180, (60, 2)) / [1, 2.1]
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(n)] + [(99, None, 1.0)], "osmid long, x double, y double")
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, x double, y double")
    got = joins.nearest_nodes(pts, nodes, projected, True, most_broadcast=most).collect()
    from citygrain.operators.proximity import haversine_m

    assert len(got) == 60
    for r in got:
        d = np.hypot(n[:, 0] - r.x, n[:, 1] - r.y) if projected else haversine_m(r.x, r.y, n[:, 0], n[:, 1])
        if not projected and most == 0:
            assert r.distance_node <= d.min() * 1.0000001 or abs(r.x) > 150  # rings do not reach over the 180th meridian
        else:
            assert r.osmid == d.argmin() and r.distance_node == pytest.approx(d.min())
    with pytest.raises(ValueError):
        joins.nearest_nodes(pts.withColumn("x", F.lit(None).cast("double")), nodes, projected)


def test_rings_reach_over_the_180th_meridian(spark):
    from citygrain.operators.proximity import haversine_m

    rng = np.random.default_rng(8)
    side = lambda n: np.where(rng.random(n) < 0.5, -1, 1) * rng.uniform(176, 180, n)
    nx, ny = np.concatenate([side(150), rng.uniform(-180, 180, 150)]), rng.uniform(-85, 85, 300)
    px, py = np.append(side(80), [-180.0, 180.0, 179.9, 0.0]), np.append(rng.uniform(-89, 89, 80), [0.0, 0.0, 90.0, -90.0])
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(nx, ny))], "osmid long, x double, y double")
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(px, py))], "id long, x double, y double")
    got = joins.nearest_nodes(pts, nodes, False, True, most_broadcast=0).collect()
    assert sorted(r.id for r in got) == list(range(len(px)))
    for r in got:
        d = haversine_m(r.x, r.y, nx, ny)
        assert r.distance_node == pytest.approx(d.min(), abs=0.01) and d[r.osmid] == pytest.approx(d.min(), abs=0.01)
    east = spark.createDataFrame([(1, 179.0, 0.0), (2, -179.99, 0.0)] + [(k, k / 10.0, 40.0) for k in range(3, 600)], "osmid long, x double, y double")
    assert joins.nearest_nodes(spark.createDataFrame([(179.99, 0.0)], "x double, y double"), east, False, most_broadcast=0).first().osmid == 2
    assert joins.nearest_nodes(pts.limit(0), east, False, most_broadcast=0).count() == 0
    far = spark.createDataFrame([(k, 50.0 + k, 50.0) for k in range(10)], "osmid long, x double, y double")
    zero = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    assert [joins.nearest_nodes(zero, far, False, most_broadcast=most).first() for most in (0, 100)] == [(0.0, 0.0, 0)] * 2


def test_grid(spark):
    q, r = grid.cell_of(F.col("x"), F.col("y"), 2.0)
    rng = np.random.default_rng(1)
    table = spark.createDataFrame([(float(a), float(b)) for a, b in rng.uniform(-20, 20, (200, 2))], "x double, y double").select("x", "y", q.alias("q"), r.alias("r"))
    cx, cy = grid.centre(F.col("q"), F.col("r"), 2.0)
    far = table.select(F.max(F.sqrt((F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2)), F.min(geom.position(F.col("x"), F.col("y"), grid.corners(F.col("q"), F.col("r"), 2.0)))).first()
    assert far[0] <= 2.0 and far[1] >= 0
    area = spark.createDataFrame([(box(0, 0, 30, 30),), (box(10, 10, 20, 20),)], f"geometry {SHAPE}")
    cells = grid.hexagon_grid(area, edge=1.0)
    assert abs(cells.count() * 1.5 * 3**0.5 - 900) < 60
    for bad in (-1, 16, 2.5, True, "9"):
        with pytest.raises(ValueError):
            grid.edge_length(bad)
    with pytest.raises(ValueError):
        grid.hexagon_grid(area.limit(0), 9)
    assert grid.edge_length(15) < 1 and grid.hexagon_grid(area, 3).columns[0] == "hex_id_3"


def test_fill_hexagons(spark):
    cells = [(q, r) for q in range(-2, 3) for r in range(-2, 3) if abs(q + r) <= 2]
    rows = [(q, r, float(i) if i < 5 else None, math.nan, "k") for i, (q, r) in enumerate(cells)] + [(50, 50, None, 1.0, "k")]
    out = {(r.q, r.r): r for r in interpolate.fill_hexagons(spark.createDataFrame(rows, "q long, r long, v double, w double, name string"), ["v", "w"]).collect()}
    assert all(r.v is not None for r in out.values()) and out[50, 50].v == pytest.approx(2.0) and out[0, 0].w is None and out[0, 0].name == "k"
    known = {c: float(i) for i, c in enumerate(cells[:5])}
    around = [known[n] for n in [(cells[5][0] + a, cells[5][1] + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))] if n in known]
    assert out[cells[5]].v == pytest.approx(np.mean(around))
    with pytest.raises(ValueError):
        interpolate.fill_hexagons(spark.createDataFrame(rows, "q long, r long, v double, w double, name string"), ["v"], method="mode")
    with pytest.raises(TypeError):
        interpolate.fill_hexagons(spark.createDataFrame(rows, "q long, r long, v double, w double, name string"), ["v"], isolated_value="x")


def test_interpolate(spark):
    seen = spark.createDataFrame([(0.0, 0.0, 10.0), (1.0, 0.0, 20.0), (0.0, 1.0, 30.0), (1.0, 1.0, 40.0)], "x double, y double, z double")
    at = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.25, 0.25), (3, 0.0, 0.0)], "id int, x double, y double")
    value = lambda df: {r.id: r.interpolated_value for r in df.collect()}
    assert value(interpolate.interpolate(at, seen, "id")) == pytest.approx({1: 25.0, 2: 275 / 17, 3: 10.0})
    assert value(interpolate.interpolate(at, seen, "id", search_radius=0.1)) == pytest.approx({1: 0.0, 2: 0.0, 3: 10.0})
    assert value(interpolate.interpolate(at, seen, "id", search_radius=0.1, scalar=True))[1] == -1.0
    gap = seen.withColumn("z", F.when(F.col("z") != 20, F.col("z")))
    assert value(interpolate.interpolate(at, gap, "id"))[1] == pytest.approx(20.0) and value(interpolate.interpolate(at, gap, "id", scalar=True))[1] is None
    assert value(interpolate.interpolate(at, seen, "id", block_targets=1, block_observations=1, most_observations=0)) == pytest.approx({1: 25.0, 2: 275 / 17, 3: 10.0})
    assert value(interpolate.interpolate(at, seen.limit(0), "id")) == {1: 0.0, 2: 0.0, 3: 0.0}
    edge = seen.union(spark.createDataFrame([(0.5, 0.0, 15.0), (0.5, 1.0, 35.0)], seen.schema))
    assert value(interpolate.interpolate(at, edge, "id", search_radius=0.5))[1] == pytest.approx(25.0)
    assert value(interpolate.interpolate(at, edge, "id", search_radius=0.5, most_observations=0))[1] == pytest.approx(25.0)


def test_interpolate_within_a_radius(spark, monkeypatch):
    monkeypatch.setattr(interpolate, "PAIRS", 500)
    rng = np.random.default_rng(12)
    o = np.concatenate([rng.uniform(-50, 50, (300, 3)), np.column_stack([rng.normal(2, 0.1, (200, 2)), rng.random(200)])])
    t = np.concatenate([rng.uniform(-60, 60, (120, 2)), [[1e9, -1e9], [2.0, 2.0]]])
    seen = spark.createDataFrame([tuple(map(float, r)) for r in o], "x double, y double, z double")
    at = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(t)] + [(900, None, 1.0)], "id int, x double, y double")
    for radius in (4.0, 30.0, 1e6):
        d = np.hypot(t[:, :1] - o[:, 0], t[:, 1:] - o[:, 1])
        w = np.where(d <= radius, 1 / (d + 1e-12) ** 2, 0)
        want = {i: float((w[i] @ o[:, 2]) / w[i].sum()) if w[i].any() else 0.0 for i in range(len(t))} | {900: 0.0}
        for most in (10_000, 0):
            assert {r.id: r.interpolated_value for r in interpolate.interpolate(at, seen, "id", search_radius=radius, most_observations=most).collect()} == pytest.approx(want)


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    lit = lambda v: F.lit(float(v))
    assert get(scalar.sigmoid(lit(10), 0.5, 10)) == 0.5 and get(scalar.sigmoid(lit(0.5), 2, 10)) == pytest.approx(5.6028e-9, rel=1e-4)
    assert get(scalar.sigmoid(lit(1e6), 5, 0)) == 1.0 and get(scalar.sigmoid(lit(-1e6), 5, 0)) == 0.0 and get(scalar.sigmoid(lit(11), 1, 10, False)) < 0.5
    assert [get(scalar.walk_speed(lit(g))) for g in (0, 0.1, 0.2)] == pytest.approx([4.0, 2.8187523588748538, 1.9863412151656379])
    assert get(scalar.haversine(lit(0), lit(0), lit(0), lit(1))) == pytest.approx(111194.92664)
    assert scalar.decay_constant(2.0, 1.0, 0.75) == pytest.approx(1 + math.log(3) / 2) and scalar.decay_constant(0.01, 1.0, 0.75) == 20.0
    for bad in ((5, 10), (5, 5)):
        with pytest.raises(ValueError):
            scalar.sigmoid_constant(*bad)
    with pytest.raises(ValueError):
        scalar.sigmoid_constant("a", 1)
    assert [tuple(r) for r in scalar.months_between(spark, "2024-01-02", "2024-03-01").select("year", "month").collect()] == [(2024, 2), (2024, 3)]
    bands = spark.createDataFrame([(0.8, 0.2, 0.0)], "nir double, red double, zero double")
    compute = lambda e: bands.select(scalar.band_expression(e, ["nir", "red", "zero"])).first()[0]
    assert compute("(nir-red)/(nir+red)") == pytest.approx(0.6) and compute("((nir*0.00341802)+149.0)-273.15") == pytest.approx(0.8 * 0.00341802 + 149 - 273.15)
    assert compute("nir/zero") is None and compute("-nir**2 + 2*-red") == pytest.approx(-(0.8**2) - 0.4) and compute("") == 0.8
    for bad in ("__import__('os')", "nir+blue", "(nir", "nir)", "nir+", "nir;red"):
        with pytest.raises((ValueError, IndexError)):
            scalar.band_expression(bad, ["nir", "red"])
    assert len(scalar.timestamp_text("date")) == 10


def test_crs(spark):
    where = spark.createDataFrame([(-99.1332, 19.4326), (-102.0, 12.0), (-110.5, 31.9)], "lon double, lat double").coalesce(1)
    for code in (3857, 6372, 32614):
        x, y = crs.transform(F.col("lon"), F.col("lat"), 4326, code)
        lon, lat = crs.transform(F.col("px"), F.col("py"), code, 4326)
        for r in where.select("lon", "lat", x.alias("px"), y.alias("py")).select("*", lon.alias("l"), lat.alias("b")).collect():
            assert r.l == pytest.approx(r.lon, abs=1e-7) and r.b == pytest.approx(r.lat, abs=1e-7)
    x, y = crs.transform(F.lit(-102.0), F.lit(12.0), 4326, 6372)
    assert tuple(where.select(x, y).first()) == pytest.approx((2_500_000.0, 0.0), abs=1e-6)
    x, y = crs.transform(F.lit(-99.0), F.lit(0.0), 4326, 32614)
    assert tuple(where.select(x, y).first()) == pytest.approx((500_000.0, 0.0), abs=1e-6)
    x, y = crs.transform(F.lit(-96.0), F.lit(45.0), 4326, 32614)  # three degrees off the central meridian
    assert where.select(x).first()[0] == pytest.approx(736_446.0, abs=60)
    assert crs.is_projected(6372) and not crs.is_projected(4326)
    with pytest.raises(ValueError):
        crs.is_projected(1)


def test_classes(spark):
    values = spark.createDataFrame([(v,) for v in (14.99, 15.0, 59.9, 60.0, None)], "t double").coalesce(1)
    assert [r.time_order for r in classify.classify_time(values, "t").collect()] == [0, 1, 3, 4, None]
    assert [r.ndvi_order for r in classify.classify_ndvi(values.select((F.col("t") / 100).alias("t")), "t").collect()] == [1, 1, 3, 4, None]
    around = spark.createDataFrame([(v,) for v in (-100.0, -3.5, -1.5, 0.5, 0.50001, 100.0, 3.99999)], "v double").coalesce(1)
    assert [r.anomaly_order for r in classify.classify_anomaly(around, "v").collect()] == [-3, -3, -2, 0, 1, 3, 3]
    with pytest.raises(Exception, match="anomaly"):
        classify.classify_anomaly(spark.createDataFrame([(0.0,), (500.0,)], "v double"), "v").collect()
    assert tuple(classify.colour_range(around, "v").first()) == (-100.0, 100.0)
    frame = spark.createDataFrame([(0.0, 0.0, 4.0, 2.0)], "minx double, miny double, maxx double, maxy double")
    assert tuple(classify.square_bounds(frame, (0.5, 0.0)).first()) == (-1.0, -1.0, 5.0, 3.0)
    assert [classify.map_kind(c) for c in ("min_time", "max_time", "x", "n_count")] == ["count", "time", "plain", "count"]


def test_convert(spark):
    df = spark.createDataFrame([(str(i), f"{i}.5", i, ["True", "False"][i % 2], f"2024-01-0{i}", [1, 2]) for i in range(1, 4)], "a string, b string, c long, d string, e string, f array<int>")
    out = convert.convert_column_types(df, {"integer": ["a"], "float": ["b"], "string": ["c"], "boolean": ["d"], "datetime": ["e"]})
    assert [t for _, t in out.dtypes][:5] == ["int", "double", "string", "boolean", "timestamp"] and all(r.d for r in out.collect())
    assert [r.d for r in convert.convert_column_types(df, {"boolean": ["d"]}, truthy=False).orderBy("a").collect()] == [False, True, False]
    for bad, error in [("x", ValueError), ({"text": ["a"]}, ValueError), ({"float": "a"}, ValueError), ({"float": ["z"]}, KeyError)]:
        with pytest.raises(error):
            convert.convert_column_types(df, bad)
    with pytest.raises(ValueError):
        convert.convert_column_types(df.limit(0), {"float": ["a"]})
    with pytest.raises(Exception, match="CAST_INVALID"):
        convert.convert_column_types(df, {"integer": ["e"]}).collect()
    assert convert.lists_to_text(df).first()["f"] == "[1,2]" and convert.rename_all(df, str.upper).columns == list("ABCDEF")
    assert convert.pad_schema(df, {"a": "int", "zz": "double"}).dtypes == [("a", "int"), ("zz", "double")] and convert.numeric_columns(df) == ["c"]
    assert convert.slice_columns(df, 1, 3) == ["b", "c"]


# ---------------------------------------------------------------- tessellation


def test_voronoi_and_hulls(spark):
    rng = np.random.default_rng(2)
    xy = rng.random((120, 2)) * 10
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(500, float(xy[3][0]), float(xy[3][1])), (501, None, 1.0)], "id long, x double, y double")
    concave = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10), (0, 0)]
    one = {r.id: r.area for r in tessellate.voronoi(pts, concave, "id").collect()}
    tiled = {r.id: r.area for r in tessellate.voronoi(pts, concave, "id", tile_points=60).collect()}
    assert sum(one.values()) == pytest.approx(70.0) and tiled == pytest.approx(one) and 500 not in one
    grid_points = np.stack(np.meshgrid(np.linspace(0.05, 9.95, 100), np.linspace(0.05, 9.95, 100)), -1).reshape(-1, 2)
    owner = ((grid_points[:, None] - xy) ** 2).sum(2).argmin(1)
    whole = {r.id: r.area for r in tessellate.voronoi(pts, [(0, 0), (10, 0), (10, 10), (0, 10)], "id").collect()}
    assert np.abs(np.bincount(owner, minlength=120) / 100 - np.array([whole[i] for i in range(120)])).max() < 0.25
    groups = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 0.0), ("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 0.0, 2.0), ("b", 0.0, 0.0), ("b", 1.0, 1.0), ("b", None, 1.0)], "g string, x double, y double")
    hull = {r.g: r.area for r in tessellate.hulls(groups, "g").select("g", geom.polygon_area(F.col("geometry")).alias("area")).collect()}
    assert hull == {"a": 4.0, "b": None}


def test_voronoi_has_no_task_with_all_points(spark, monkeypatch):
    rng = np.random.default_rng(9)
    clumps = np.concatenate([rng.random((500, 2)) * 100, rng.normal(50, 0.4, (400, 2)), np.column_stack([np.linspace(-30, 130, 40), np.full(40, 20.0)])])
    table = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(clumps)], "id long, x double, y double")
    area = [(0, 0), (100, 0), (100, 100), (50, 60), (0, 100)]
    every = tessellate.cells_of(clumps, clumps, np.array([[0.0, 0], [100, 0], [100, 100], [0, 100]]))
    want = {i: geom.area_of(geom.clip_to_convex(np.array(area, float), c[:k])) if k > 2 else 0.0 for i, (c, k) in enumerate(zip(*every, strict=True))}
    for most in (None, 10):
        got = {r.id: r.area for r in tessellate.voronoi(table, area, "id", tile_points=90, most_broadcast=most).select("id", "area").collect()}
        assert {i for i, a in got.items() if a > 1e-9} == {i for i, a in want.items() if a > 1e-9}
        assert max(abs(got.get(i, 0.0) - a) for i, a in want.items()) < 1e-6 and sum(got.values()) == pytest.approx(8000)


def test_hulls_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(tessellate, "HULL_CORNERS", 20)
    rng = np.random.default_rng(4)
    rows = [("abcd"[i % 4] if i % 9 else None, *map(float, rng.normal(0, 1 + i % 4, 2))) for i in range(4000)]
    table = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    got = {r.g: r.area for r in tessellate.hulls(table, "g").select("g", geom.polygon_area(F.col("geometry")).alias("area")).collect()}
    for g in (None, *"abcd"):
        assert got[g] == pytest.approx(geom.area_of(geom.convex_hull(np.array([r[1:] for r in rows if r[0] == g]))))
    assert tessellate.hulls(table.limit(0), "g").count() == 0


# ---------------------------------------------------------------- network


def lattice(spark, n=7):
    nodes = [(i * n + j, float(j), float(i)) for i in range(n) for j in range(n)]
    rng = np.random.default_rng(9)
    links = [(a, a + 1) for a in range(n * n) if a % n < n - 1] + [(a, a + n) for a in range(n * n - n)]
    edges = [(u, v, 0, float(rng.integers(1, 1 << 20)) / 1024) for u, v in links] + [(0, 1, 1, 1e6)]
    return spark.createDataFrame([*nodes, (900, 50.0, 50.0)], "osmid long, x double, y double"), spark.createDataFrame(edges, "u long, v long, key int, length double"), edges


def dijkstra(edges, source, keep=lambda u, v: True):
    near: dict = {}
    for k, (u, v, _, w) in enumerate(edges):
        near.setdefault(u, []).append((v, w, k))
        near.setdefault(v, []).append((u, w, k))
    done, heap = {}, [(0.0, source, None)]
    while heap:
        d, node, before = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = (d, before)
        for v, w, k in near.get(node, []):
            if keep(node, v):
                heapq.heappush(heap, (d + w, v, (node, k)))
    return done


def test_network_searches(spark):
    nodes, edges, plain = lattice(spark)
    seeds = spark.createDataFrame([(0, 3), (1, 40), (2, 40), (3, 12345)], "seed_pos long, osmid long")
    each = {s: {k: v[0] for k, v in dijkstra(plain, s).items()} for s in (3, 40)}
    for most in (1000, 0):
        got = {r.osmid: (r.dist, r.seed_pos) for r in network.multi_source(nodes, edges, seeds.where("seed_pos < 3"), "length", most_edges=most).collect()}
        assert got == {k: min((each[3][k], 0), (each[40][k], 1)) for k in each[3]}
        counts = {r.osmid: r.n for r in network.counts_within(nodes, edges, seeds.where("seed_pos < 3"), "length", 1500.0, most_edges=most).collect()}
        want = {k: (each[3][k] <= 1500) + 2 * (each[40][k] <= 1500) for k in each[3]}
        assert counts == {k: n for k, n in want.items() if n}
    near = {r.osmid for r in network.isochrone_nodes(nodes, edges, 24, 900.0).collect()}
    assert near == {k for k, v in dijkstra(plain, 24).items() if v[0] <= 900}
    hull, inside = network.isochrone(nodes, edges, 24, 900.0, subgraph=True)
    assert hull.count() == 1 and {(r.u, r.v, r.key) for r in inside.collect()} == {(u, v, k) for u, v, k, _ in plain if u in near and v in near}


@pytest.mark.parametrize("most", [1000, 0])
def test_searches_on_dirty_edges(spark, most):
    nodes, edges, plain = lattice(spark)
    # Short ways over places that are no nodes, edges without weight, and an edge only one end of which is a node.
    dirt = [(3, 777, 0, 0.5), (777, 40, 0, 0.5), (888, 889, 0, 1.0), (48, 889, 0, 1.0), (3, 45, 0, None), (0, 48, 0, math.nan), (900, 3, 0, None), (None, 3, 0, 1.0)]
    dirty = edges.unionByName(spark.createDataFrame(dirt, "u long, v long, key int, length double"))
    seeds = spark.createDataFrame([(0, 12345), (1, 3), (2, 40), (3, 40), (4, 777), (5, 889)], "seed_pos long, osmid long")
    each = {s: {k: v[0] for k, v in dijkstra(plain, s).items()} for s in (3, 40)}
    at = {1: 3, 2: 40, 3: 40}
    for limit in (None, 1500.0):
        near = {(p, k): d for p, s in at.items() for k, d in each[s].items() if limit is None or d <= limit}
        got = {r.osmid: (r.dist, r.seed_pos) for r in network.multi_source(nodes, dirty, seeds, "length", limit, most_edges=most).collect()}
        assert got == {k: min((d, p) for (p, o), d in near.items() if o == k) for _, k in near}
        assert {(r.seed_pos, r.osmid): r.dist for r in network.per_seed(nodes, dirty, seeds, "length", limit, most_edges=most).collect()} == near
    counts = {r.osmid: r.n for r in network.counts_within(nodes, dirty, seeds, "length", 1500.0, most_edges=most).collect()}
    assert counts == {k: sum(o == k for _, o in near) for _, k in near}


def test_large_graph_of_many_parts_is_searched_in_pieces(spark, monkeypatch):
    """Of more edges than the limit no part has more: no rounds of joins over the whole graph, and the same rows."""
    nodes, edges, plain = lattice(spark)
    copies = spark.createDataFrame([(k * 1000,) for k in range(5)], "k long")
    shifted = edges.crossJoin(copies).select((F.col("u") + F.col("k")).alias("u"), (F.col("v") + F.col("k")).alias("v"), "key", "length")
    dirt = [(3, 777, 0, 0.5), (777, 1040, 0, 0.5), (3, 2045, 0, None), (0, 1048, 0, math.nan), (None, 3, 0, 1.0)]
    shifted = shifted.unionByName(spark.createDataFrame(dirt, "u long, v long, key int, length double"))
    ids = nodes.crossJoin(copies).select((F.col("osmid") + F.col("k")).alias("osmid")).unionByName(spark.createDataFrame([(8001,), (8002,), (None,)], "osmid long"))
    seeds = spark.createDataFrame([(0, 12345), (1, 3), (2, 40), (3, 40), (4, 777), (5, 4010), (6, 8001), (7, 2003), (8, 2040)], "seed_pos long, osmid long")
    rows = lambda most: [
        sorted(tuple(r) for r in df.collect())
        for df in (
            network.multi_source(ids, shifted, seeds, "length", most_edges=most),
            network.multi_source(ids, shifted, seeds, "length", 1500.0, most_edges=most),
            network.per_seed(ids, shifted, seeds, "length", None, most_edges=most),
            network.counts_within(ids, shifted, seeds, "length", 1500.0, most_edges=most),
        )
    ]
    want = rows(10**6)
    assert any(r[0] == 8001 for r in want[0])
    monkeypatch.setattr(network, "PIECE_SIZE", 150)
    monkeypatch.setattr(network, "relax", None)
    assert rows(len(plain)) == want
    with pytest.raises(Exception, match="negative length"):
        network.multi_source(ids, shifted.withColumn("length", -F.col("length")), seeds, "length", most_edges=len(plain)).count()


@pytest.mark.parametrize(("name", "operator"), [("q63_streets_to_hubs", "multi_source"), ("q64_hubs_within_reach", "counts_within")])
def test_hubs_over_streets_in_pieces(spark, monkeypatch, name, operator):
    """As by SQL, also where the streets are above the limit, without rounds of joins."""
    from functools import partial

    import duckdb

    import __spark_entry__ as entry

    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("nodes", "edges"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    monkeypatch.setattr(network, operator, partial(getattr(network, operator), most_edges=100))
    monkeypatch.setattr(network, "PIECE_SIZE", 200)
    monkeypatch.setattr(network, "relax", None)
    got = sorted(tuple(r) for r in entry.queries()[name](spark, data).collect())
    assert got == sorted(db.execute(entry.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("most_edges", [500, 10**6])
def test_connected_parts_stay_whole(spark, monkeypatch, most_edges):
    """Ways through nodes in any order: as one part each they give one row a node, in pieces and in one."""
    monkeypatch.setattr(network, "PIECE_SIZE", 150)
    monkeypatch.setattr(network, "relax", None)
    way = np.random.default_rng(1).permutation(400)
    ids = [int(n) + k for k in (0, 1000) for n in way]
    edges = spark.createDataFrame([(ids[i], ids[i + 1], 1.0) for i in range(799) if i != 399], "u long, v long, length double")
    seeds = spark.createDataFrame([(i, ids[i]) for i in range(0, 800, 40)], "seed_pos long, osmid long")
    got = network.multi_source(spark.createDataFrame([(n,) for n in ids], "osmid long"), edges, seeds, "length", most_edges=most_edges).collect()
    want = [(n, float(min(i % 40, 40 - i % 40 if i % 400 < 360 else 40))) for i, n in enumerate(ids)]
    assert sorted((r.osmid, r.dist) for r in got) == sorted(want)


@pytest.mark.parametrize("name", ["q57_proximity_by_hexagon", "q64_hubs_within_reach", "q21_network_time", "q24_multi_geometry", "q63_streets_to_hubs"])
def test_no_graph_passes_the_driver(spark, monkeypatch, name):
    """Edges are neither gathered by the driver nor sent by it."""
    import __spark_entry__ as entry

    frame, context = type(spark.range(1)), type(spark.sparkContext)
    gather, send = frame.toPandas, context.broadcast

    def gathered(df):
        assert not {"u", "v", "w"} & set(df.columns)
        return gather(df)

    def sent(sc, value):
        assert not any(isinstance(x, network.Graph) for x in (value if isinstance(value, tuple) else (value,)))
        return send(sc, value)

    monkeypatch.setattr(frame, "toPandas", gathered)
    monkeypatch.setattr(context, "broadcast", sent)
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_rings_on_a_long_strip_begin_with_small_cells():
    assert joins._ring_size(39.0, 29999.0, 1_200_000) < 4
    assert joins._ring_size(0.0, 30000.0, 1_200_000) < 1 and joins._ring_size(0.0, 0.0, 1) > 0


@pytest.mark.parametrize("few", [0, 32, 10**9])
def test_spread_finds_as_search_does(monkeypatch, few):
    monkeypatch.setattr(network, "FEW", few)
    monkeypatch.setattr(network, "MANY", max(few, 40))
    rng = np.random.default_rng(4)
    for n, m in ((0, 0), (1, 0), (60, 90), (3000, 5000)):
        ids = np.arange(n) * 3 + 7
        ends = rng.choice(ids, (m, 2)) if n else np.empty((0, 2), np.int64)
        chain = np.column_stack([ids[:-1], ids[1:]])[: n // 3]
        u, v = np.concatenate([ends, chain]).T
        graph = network.Graph.of(ids, u, v, rng.choice([0.0, 0.5, 1.0, 1.5, math.inf, math.nan], len(u)))
        at, seed = rng.integers(0, n, min(n, 25)) if n else np.empty(0, np.int64), rng.permutation(min(n, 25)) - 5
        for limit in (None, 2.0):
            want = network.search(graph.lists, list(zip([0.0] * len(at), seed.tolist(), at.tolist(), strict=True)), limit)
            got = network.spread(graph, at, seed, limit)
            assert {k: (d, s) for k, d, s in zip(*(x.tolist() for x in got), strict=True)} == want


def test_time_to_pois(spark):
    nodes, edges, plain = lattice(spark)
    pois = spark.createDataFrame([("p", 3.2, 0.1, "g1"), ("q", 5.0, 5.1, "g1"), ("r", 5.0, 4.9, "g2")], "poi_id string, x double, y double, goi string")
    out = network.time_to_pois(nodes, edges, pois, "shop", count_pois=(True, 15), projected=True)
    assert out.columns == ["osmid", "time_shop", "shop_15min", "x", "y"]
    each = {s: {k: v[0] * 60 / 4000 for k, v in dijkstra(plain, s).items()} for s in (3, 40)}
    got = {r.osmid: (round(r.time_shop, 6), r.shop_15min) for r in out.collect()}
    assert got == {k: (round(min(each[3][k], each[40][k]), 6), (each[3][k] <= 15) + 2 * (each[40][k] <= 15)) for k in each[3]}
    multi = network.time_to_multi_geometry_pois(nodes, edges, pois, "park", "goi", count_pois=(True, 15), projected=True).collect()
    assert {r.osmid: r["park_15min"] for r in multi} == {k: (each[3][k] <= 15 or each[40][k] <= 15) + (each[40][k] <= 15) for k in each[3]}
    empty = network.time_to_pois(nodes, edges, pois.limit(0), "shop", count_pois=(True, 15))
    assert empty.count() == 50 and empty.where("time_shop is null and shop_15min = 0").count() == 50
    for bad in (dict(poi_name=" "), dict(measure="x"), dict(speed=0)):
        with pytest.raises(ValueError):
            network.time_to_pois(**(dict(nodes=nodes, edges=edges, pois=pois, poi_name="a") | bad))
    with pytest.raises(ValueError):
        network.time_to_multi_geometry_pois(nodes, edges, pois, "a", "no")
    near = network.nearest_seed(nodes, edges, pois.withColumn("osmid", F.when(F.col("poi_id") == "p", 3).otherwise(40)), "shop", count_pois=(True, 900.0))
    assert {r.osmid: r.nearest_shop for r in near.collect()} == {k: 0 if each[3][k] <= each[40][k] else 1 for k in each[3]}
    assert network.proximity_isochrone_from_osmid(nodes, edges, 24, 15.0).count() == 1


def test_edge_counts(spark):
    nodes, edges, plain = lattice(spark)
    limit, sources = 1200.0, [3, 40, 40, 900]
    want: dict = {}
    for s in sources:
        reach = {k for k, v in dijkstra(plain, s).items() if v[0] < limit}
        if len(reach) < 2:
            continue
        tree = dijkstra(plain, s, lambda u, v: u in reach or v in reach)  # noqa: B023
        for node in tree:
            while tree[node][1]:
                node, k = tree[node][1]
                want[plain[k][:3]] = want.get(plain[k][:3], 0) + 1
    got = network.edge_counts(nodes, edges, spark.createDataFrame([(s,) for s in sources], "osmid long"), "length", limit)
    assert {(r.u, r.v, r.key): r.passing_count for r in got.collect()} == {e[:3]: want.get(e[:3], 0) for e in plain}
    with pytest.raises(ValueError):
        network.edge_counts(nodes, edges, nodes, "length", -1)


def test_edges_and_networks(spark):
    line = [{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 4.0}]
    edges = spark.createDataFrame([(1, 2, 0, None, None, line), (2, 3, 0, 1000.0, 7.0, line)], "u long, v long, key int, length double, time_min double, geometry array<struct<x:double,y:double>>")
    assert [(r.length, r.time_min) for r in network.prepare_edges(edges).orderBy("u").collect()] == [(5.0, 0.075), (1000.0, 15.0)]
    assert [r.time_min for r in network.prepare_edges(edges, per_row=True).orderBy("u").collect()] == [0.075, 7.0]
    places = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "x double, y double")
    nodes, made = network.create_network(places, edges.select("geometry"))
    assert sorted(r.osmid for r in nodes.collect()) == [0, 34] and made.first()["length"] == 5.0
    with pytest.raises(ValueError):
        network.create_network(spark.createDataFrame([(12.0, 3.0), (1.0, 23.0)], "x double, y double"), edges)
    pos = network.with_positions(spark.createDataFrame([(v,) for v in "dbca"], "k string"), "k")
    assert {r.k: r.seed_pos for r in pos.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_overpass_files(spark, tmp_path):
    node = lambda i, lon: {"type": "node", "id": i, "lat": 0.0, "lon": lon}
    body = {"version": 0.6, "elements": [node(1, 0.0), node(2, 0.01), node(3, 0.02), {"type": "way", "id": 7, "nodes": [1, 2, 3, 99], "tags": {"highway": "residential", "oneway": "yes"}}, {"type": "way", "id": 8, "nodes": [1, 2], "tags": {"building": "yes"}}, {"type": "way", "id": 9, "nodes": [3, 2], "tags": {"highway": "footway"}}]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    nodes, edges = overpass.network_from_elements(overpass.read_overpass(spark, str(tmp_path)))
    assert [(r.u, r.v, r.osmid, round(r.length)) for r in edges.orderBy("osmid", "u").collect()] == [(1, 2, "7", 1112), (2, 3, "7", 1112), (2, 3, "9", 1112), (3, 2, "9", 1112)]
    assert {r.osmid: r.street_count for r in nodes.collect()} == {1: 1, 2: 3, 3: 2} and edges.columns == list(overpass.EDGE_COLUMNS)
    assert overpass.network_from_elements(overpass.read_overpass(spark, str(tmp_path)), "drive")[1].count() == 2
    with pytest.raises(ValueError):
        overpass.network_from_elements(nodes, "fly")


def simplified_plainly(edges):
    """(u, v, length, osmids) of the chains between junctions, followed step by step."""
    out, into = {}, {}
    for e in edges:
        out.setdefault(e.u, []).append(e)
        into.setdefault(e.v, []).append(e)

    def passed(n):
        a, b = out.get(n, []), into.get(n, [])
        near = {e.v for e in a} | {e.u for e in b}
        return n not in near and a and b and len(near) == 2 and len(a) + len(b) in (2, 4)

    found = []
    for e in edges:
        if not passed(e.u):
            length, ids, place, before = e.length, [e.osmid], e.v, e.u
            while passed(place):
                step = next(x for x in out[place] if x.v != before)
                length, before, place = length + step.length, place, step.v
                ids += [] if step.osmid in ids else [step.osmid]
            found.append((e.u, place, round(length, 6), ";".join(ids)))
    return sorted(found)


def test_simplified_networks(spark):
    rng = np.random.default_rng(3)
    at = {i: (float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 0.1, (60, 2)))}
    chain = lambda *n: list(n)
    ways = [(1, chain(*range(12)), {"highway": "a"}), (2, chain(11, 12, 13, 14, 15), {"highway": "a", "name": "x"}), (3, chain(5, 20, 21, 22, 11), {"highway": "b", "oneway": "yes"}), (4, chain(15, 16, 17, 15), {"highway": "a"}), (5, chain(30, 31, 32, 33, 30), {"highway": "ring"}), (6, chain(40, 41, 42), {"highway": "far", "oneway": "-1"}), (7, chain(13, 50, 51, 50), {"highway": "c", "junction": "roundabout"})]
    rows = [("node", i, b, a, None, None) for i, (a, b) in at.items()] + [("way", i, None, None, n, t) for i, n, t in ways]
    elements = spark.createDataFrame(rows, "type string, id long, lat double, lon double, nodes array<long>, tags map<string,string>")
    plain = overpass.network_from_elements(elements)[1].collect()
    nodes, edges = overpass.network_from_elements(elements, simplify=True)
    got = edges.collect()
    assert sorted((r.u, r.v, round(r.length, 6), r.osmid) for r in got) == simplified_plainly(plain)
    assert all((r.geometry[0].x, r.geometry[0].y) == at[r.u] and (r.geometry[-1].x, r.geometry[-1].y) == at[r.v] for r in got)
    assert {r.osmid for r in nodes.collect()} == {n for r in got for n in (r.u, r.v)} and len({(r.u, r.v, r.key) for r in got}) == len(got)
    assert {(r.u, r.v): r.oneway for r in plain}[42, 41] and (41, 42) not in {(r.u, r.v) for r in plain}
    large, kept = overpass.network_from_elements(elements, largest_only=True)
    assert {r.osmid for r in large.collect()} == {*range(18), 20, 21, 22, 50, 51} and kept.count() == sum(r.u < 30 or r.u in (50, 51) for r in plain)
    parts = {r.osmid: r.part for r in overpass.connected_parts(overpass.network_from_elements(elements)[1]).collect()}
    assert set(parts.values()) == {0, 30, 40} and parts[51] == 0 and parts[33] == 30
    shape = spark.createDataFrame([([[{"x": -1.0, "y": -1.0}, {"x": 1.0, "y": -1.0}, {"x": -1.0, "y": 1.0}, {"x": -1.0, "y": -1.0}]],)], f"geometry {SHAPE}")
    inner = overpass.network_from_elements(elements.withColumn("lat", F.col("lat") - 0.05).withColumn("lon", F.col("lon") - 0.05), area=shape)[0]
    assert {r.osmid for r in inner.collect()} <= {i for i, (a, b) in at.items() if a + b - 0.1 <= 1e-12}
    assert overpass.network_from_elements(elements.limit(0), simplify=True, largest_only=True)[1].count() == 0


def test_unknown_nodes_raise(spark):
    nodes, edges, *_ = lattice(spark)
    with pytest.raises(KeyError):
        network.isochrone_nodes(nodes, edges, 10**9, 5.0)
    with pytest.raises(KeyError):
        network.nearest_seed(nodes, edges, spark.createDataFrame([(1, 10**9)], "poi_id long, osmid long"), "x")


# ---------------------------------------------------------------- raster


def test_zonal_and_fill(spark):
    pixels = spark.createDataFrame([(r, c, float(r * 3 + c)) for r in range(3) for c in range(3)], "row int, col int, value double")
    zones = spark.createDataFrame([("in", box(-0.5, -0.5, 0.5, 0.5)), ("out", box(10, 10, 11, 11)), ("none", None)], f"zone string, geometry {SHAPE}")
    got = {r.zone: r.value for r in raster.zonal_mean(pixels, zones, "zone", (-1.0, 1.0, 1.0, 1.0)).collect()}
    assert got["in"] == 2.0 and got["out"] == 0.0
    raster.null_test(raster.zonal_mean(pixels, zones, "zone", (-1.0, 1.0, 1.0, 1.0)))
    with pytest.raises(raster.NanValues):
        raster.null_test(raster.zonal_mean(pixels, zones, "zone", (-1.0, 1.0, 1.0, 1.0), outside=None))
    months = spark.createDataFrame([("a", 2024, m, v) for m, v in enumerate([None, 1.0, None, None, 4.0, None], 1)] + [("b", 2024, 1, None)], "k string, year int, month int, value double")
    rows = raster.fill_months(months, ["k"]).orderBy("k", "month").collect()
    assert [r.filled for r in rows] == [1, 1, 2, 3, 4, 4, None] and [r.interpolate for r in rows] == [1, 0, 3, 3, 0, 2, None]
    holes = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 0.0), (1, 0, 2, 3.0), (1, 1, 1, -124.25), (1, 5, 5, math.inf)], "scene int, row int, col int, value double")
    filled = {(r.row, r.col): r.value for r in raster.fill_nodata(raster.clean_pixels(holes), ["scene"], 2).collect()}
    assert filled[0, 1] == 2.0 and filled[1, 1] is None and filled[5, 5] is None
    half = raster.half_resolution(pixels, [])
    assert {(r.row, r.col): r.value for r in half.collect()} == {(0, 0): 2.0, (0, 1): 3.5, (1, 0): 6.5, (1, 1): 8.0}
    sample = raster.resample_nearest(pixels, (-1.0, 1.0, 1.0, 1.0), spark.createDataFrame([(0.5, 0.5), (9.0, 9.0)], "x double, y double"))
    assert sorted((r.value is None, r.value) for r in sample.collect() if r.value is not None) == [(False, 1.0)] and sample.count() == 2

@pytest.mark.parametrize("keys", [range(1, 8001), range(1, 3), [0, 39, 319, 320, 5000], []])
def test_zones_cover_all_pixels(spark, tmp_path, keys):
    from citygrain.plans.raster import q36b_zonal_mean_all

    spark.createDataFrame([(k, float(k % 97), 3) for k in keys], "p_partkey long, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    groups: dict = {}
    for k in keys:
        groups.setdefault(k // 40 // 8 * 4 + k % 40 // 10, []).append(float(k % 97))
    zones = range((max(keys) // 40 // 8 + 1) * 4) if len(keys) else []
    got = {r.zone_id: r.nir for r in q36b_zonal_mean_all(spark, str(tmp_path)).collect()}
    assert got == {z: pytest.approx(np.mean(groups[z]) if z in groups else 0.0, abs=1e-6) for z in zones}



def test_scenes_and_inventory(spark):
    item = lambda i, day, tile, cloud: (i, dt.datetime(2024, 1, day), {"s2:mgrs_tile": tile, "s2:high_proba_clouds_percentage": str(cloud)}, [("nir", f"n{i}"), ("red", f"r{i}")])
    items = spark.createDataFrame([item(1, 1, "A", 5), item(2, 1, "B", 50), item(3, 2, "A", 5), item(4, 2, "B", 7), item(5, 3, "A", 90), item(6, 2, "B", 8)], "id long, datetime timestamp, properties map<string,string>, assets array<struct<common_name:string,href:string>>")
    matrix = raster.cloud_matrix(items, "sentinel-2-l2a", 60.0)
    assert {(str(r.date)[-1], r.tile): r.cloud for r in matrix.collect()} == {("1", "A"): 5, ("1", "B"): 50, ("2", "A"): 5, ("2", "B"): 8, ("3", "A"): None}
    ranked = raster.ranked_dates(matrix).orderBy(F.col("avg_cloud").asc_nulls_last()).collect()
    assert [(str(r.date)[-1], r.complete) for r in ranked] == [("2", True), ("1", True)]
    assert {r.tile: str(r.date)[-1] for r in raster.best_scene_per_tile(matrix).collect()} == {"A": "2", "B": "2"}
    links = {(str(r.date)[-1], r.band): r.hrefs for r in raster.band_links(items, raster.ranked_dates(matrix), ["nir"]).collect()}
    assert links == {("1", "nir"): ["n1", "n2"], ("2", "nir"): ["n3", "n4", "n6"]}
    with pytest.raises(Exception, match="no asset"):
        raster.band_links(items, matrix, ["swir"]).collect()
    months = raster.inventory(matrix, "2023-12-01", "2024-03-01")
    assert [r.data_id for r in months.orderBy("year", "month").collect()] == [0, 1, 0, 0]
    with pytest.raises(raster.AvailableData):
        raster.check_availability(months, 50.0, 6)
    with pytest.raises(raster.AvailableData):
        raster.check_availability(months, 99.0, 2)
    raster.check_availability(months, 99.0, 3)
    landsat = spark.createDataFrame([({"landsat:wrs_path": "31", "landsat:wrs_row": "33", "landsat:cloud_cover_land": "5"},)], "p map<string,string>")
    assert landsat.select(scalar.tile_key(F.col("p"), "landsat-c2-l2")).first()[0] == "031033"
    found = raster.search_items(items.withColumns({"minx": F.col("id"), "maxx": F.col("id"), "miny": F.lit(0), "maxy": F.lit(0)}), "2024-01-01", "2024-01-02", (0, 0, 3, 3), {"s2:high_proba_clouds_percentage": {"lt": 50}})
    assert sorted(r.id for r in found.collect()) == [1, 3]
    job = dict(name="a", index="ndvi", start=dt.date(2024, 1, 1), end=dt.date(2024, 2, 1), bands=["nir"], equation="nir")
    raster.RasterJob(**job)
    for bad, error in [(dict(name=""), ValueError), (dict(start="x"), TypeError), (dict(end=dt.date(2020, 1, 1)), ValueError), (dict(satellite="x"), ValueError), (dict(equation="red"), ValueError)]:
        with pytest.raises(error):
            raster.RasterJob(**(job | bad))


def test_monthly_index(spark):
    day = lambda m, n: dt.date(2024, m, n)
    matrix = spark.createDataFrame([(day(1, 1), "A", 5.0), (day(1, 2), "A", 1.0), (day(1, 2), "B", 9.0), (day(2, 1), "A", None)], "date date, tile string, cloud double")
    scenes = [(day(1, 1), "A", b, 0, 0, 7.0) for b in ("nir", "red")] + [(day(1, 2), "A", "nir", 0, 0, 3.0), (day(1, 2), "A", "red", 0, 0, 1.0), (day(1, 2), "B", "nir", 0, 0, 9.0), (day(1, 2), "B", "red", 0, 0, 1.0), (day(1, 2), "B", "nir", 0, 2, 9.0), (day(1, 2), "B", "red", 0, 2, 3.0), (day(1, 2), "B", "nir", 0, 1, 9.0), (day(1, 2), "B", "red", 0, 1, 0.0), (day(2, 1), "A", "nir", 0, 0, 1.0)]
    out = raster.monthly_index(spark.createDataFrame(scenes, "date date, tile string, band string, row int, col int, value double"), matrix, ["nir", "red"], "(nir-red)/(nir+red)")
    assert {(r.year, r.month, r.row, r.col): r.value for r in out.collect()} == {(2024, 1, 0, 0): 0.5, (2024, 1, 0, 2): 0.5, (2024, 1, 0, 1): 0.5}
    months = spark.createDataFrame([(2024, 1, 1), (2024, 2, 1), (2024, 3, 0)], "year int, month int, data_id int")
    assert [r.month for r in raster.months_to_do(months, out).collect()] == [2] and raster.months_to_do(months, None).count() == 2


def test_trends(spark):
    panel = spark.createDataFrame([("a", 2024, m, v) for m, v in enumerate([1.0, 3.0, 2.0, 5.0], 1)] + [("b", 2024, 1, 2.0), ("a", 2025, 1, None)], "f string, year int, month int, value double")
    assert {r.f: r.slope for r in raster.theil_sen(panel, "f", ["year", "month"], "value").collect()} == pytest.approx({"a": 7 / 6, "b": None})
    row = raster.panel_summary(panel, "f", "v").where("f = 'a'").first()
    assert (row.v_mean, row.v_median, row.v_2024, row.v_2025, row.v_diff) == (2.75, 2.5, 2.75, None, 4.0)
    assert raster.panel_summary(panel.limit(0), "f", "v", [2024]).count() == 0


# ---------------------------------------------------------------- census


def test_equations():
    whole = pd.DataFrame([{"POBTOT": 30.0, "POBFEM": None, "POBMAS": 14.0, "P_0A2": None, "P_0A2_F": 1.0, "P_0A2_M": 2.0, "P_3YMAS": None, "P_3A5": 2.0, "P_6A11": 3.0, "P_12YMAS": None}])
    row = census.apply_equations(whole).iloc[0]
    assert (row.POBFEM, row.P_0A2, row.P_3YMAS, row.P_12YMAS) == (16.0, 3.0, 27.0, 22.0)
    assert len(census.DEMOGRAPHIC) == 40 and len(census.RULES) == 24 + 6 + 3 * (4 + 5 + 6) + 3 + 1 + 4
    one = pd.DataFrame([{"P_0A2": 5.0, "P_3A5": None, "P_6A11": None, "POBTOT": 20.0, "P_12YMAS": None}], dtype=float)
    assert census.apply_equations(one).iloc[0].P_12YMAS == 15.0  # missing parts count as nothing once one is known


def test_impute_blocks(spark):
    columns = [c.lower() for c in census.DEMOGRAPHIC]
    base = dict.fromkeys(columns) | {"pobtot": 10.0, "pobfem": 4.0, "pobmas": 6.0}
    rows = [base | {"cve_ageb": "z", "cvegeo": "1", "pcon_disc": 2.0}, base | {"cve_ageb": "z", "cvegeo": "2", "pobmas": None}, base | {"cve_ageb": "z", "cvegeo": "3", "pobtot": 30.0, "pobmas": 26.0}, base | {"cve_ageb": "q", "cvegeo": "4"}]
    schema = "cve_ageb string, cvegeo string, pobtot double, " + ", ".join(f"{c} double" for c in columns)
    names = [s.split()[0] for s in schema.split(", ")]
    make = lambda data: spark.createDataFrame([tuple(r[n] for n in names) for r in data], schema)
    blocks, zones = make(rows), make([dict.fromkeys(columns) | {"cve_ageb": "z", "cvegeo": None, "pobtot": 50.0, "pobfem": 12.0, "pobmas": 38.0, "pcon_disc": 10.0, "rel_h_m": 1.0}])
    out = {r.cvegeo: r for r in census.impute_blocks(zones, blocks).collect()}
    assert out["2"].pobmas == 6.0 and out["2"].pcon_disc == 2.0 and out["3"].pcon_disc == 6.0 and out["4"].pcon_disc is None and out["1"].rel_h_m is None
    assert [r.cve_ageb for r in census.unknown_zones(zones, blocks).collect()] == ["q"]
    report = {r.cve_ageb: r for r in census.imputation_report(blocks, census.impute_blocks(zones, blocks)).collect()}
    assert report["z"].missing_before > report["z"].missing_after and report["q"].percent_filled == 0.0
    with pytest.raises(ValueError):
        census.impute_blocks(zones.limit(0), blocks)
    with pytest.raises(KeyError):
        census.impute_blocks(zones, blocks.drop("pobfem"))


# ---------------------------------------------------------------- files and streams


def test_census_columns_can_be_named(spark):
    setup = census.Columns(demographic=("POBFEM", "POBMAS", "jobs", "keep"), excluded=("keep",), zone="area", block="place", total="people")
    zones = spark.createDataFrame([("z", 30.0, 10.0)], "area string, jobs double, keep double")
    blocks = spark.createDataFrame([("z", "a", 10.0, 4.0, None, 12.0, None), ("z", "b", 5.0, None, 2.0, None, 1.0), ("z", "c", 1.0, None, 0.0, None, 1.0)], "area string, place string, people double, pobfem double, pobmas double, jobs double, keep double")
    got = {r.place: r for r in census.impute_blocks(zones, blocks, columns=setup).collect()}
    assert (got["a"].pobmas, got["b"].pobfem, got["c"].pobfem) == (6.0, 3.0, 1.0) and got["a"].keep is None
    assert got["b"].jobs == 15.0 and got["c"].jobs == 3.0
    with pytest.raises(KeyError):
        census.impute_blocks(zones, blocks)


def tiff(values, x0, y0):
    """A little-endian float32 TIFF of one strip with its tie point and pixel size."""
    rows, cols = values.shape
    data = values.astype("<f4").tobytes()
    extra = struct.pack("<3d", 1.0, 1.0, 0.0) + struct.pack("<6d", 0, 0, 0, x0, y0, 0)
    at = 8 + len(data) + len(extra)
    tags = [(256, 3, 1, cols), (257, 3, 1, rows), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, rows), (279, 4, 1, len(data)), (339, 3, 1, 3), (33550, 12, 3, 8 + len(data)), (33922, 12, 6, 8 + len(data) + 24)]
    return b"II*\0" + struct.pack("<I", at) + data + extra + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"


def test_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.tif").write_bytes(tiff(np.arange(9.0).reshape(3, 3), -1.0, 1.0))
    pixels = files.read_rasters(spark, str(tmp_path / "r")).orderBy("row", "col").collect()
    assert [p.value for p in pixels] == list(range(9)) and (pixels[4].x, pixels[4].y) == (0.5, -0.5)
    assert files.list_rasters(spark, str(tmp_path / "r")).count() == 1
    table = spark.createDataFrame([(2024, 1, 5, 1.0), (2024, 2, 6, 2.0)], "year int, month int, row int, value double")
    files.write_pixels(table, str(tmp_path / "p"))
    files.write_pixels(table.where("month = 2").withColumn("value", F.lit(9.0)), str(tmp_path / "p"))
    assert files.read_pixels(spark, str(tmp_path / "p"), 2024).agg(F.sum("value")).first()[0] == 10.0
    inventory = spark.createDataFrame([(2024, 1, 1, 0.5, "specific_date", 0)], files.INVENTORY)
    files.write_inventory(inventory, str(tmp_path / "i"))
    files.start_inventory(inventory.limit(0), str(tmp_path / "i"))
    assert files.read_inventory(spark, str(tmp_path / "i")).first() == inventory.first()
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [0, 2], [0, 0]]]}, "properties": {"a": "1"}}]}))
    shape = files.read_geojson(spark, str(tmp_path / "g.json"))
    assert shape.select(geom.polygon_area(F.col("geometry"))).first()[0] == 2.0 and shape.first()["properties"] == {"a": "1"}
    assert bytes(spark.range(1).select(files.point_wkb(F.lit(1.0), F.lit(2.0))).first()[0]) == struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    folder = tmp_path / "c"
    (folder / "sub").mkdir(parents=True)
    (folder / "one").write_text("x")
    (folder / "link").symlink_to(tmp_path / "r")
    assert files.clear_directory(folder) == {"files": 2, "directories": 1, "errors": 0} and (tmp_path / "r" / "a.tif").exists()
    assert files.clear_directory(folder) == {"files": 0, "directories": 0, "errors": 0}
    with pytest.raises(ValueError):
        files.clear_directory(tmp_path / "none")


@pytest.mark.parametrize("tile", [16, 64])
def test_tiled_rasters(spark, tmp_path, tile):
    rng = np.random.default_rng(1)
    planes = rng.normal(size=(3, 37, 50)).astype(np.float32)
    data = files.tiff_bytes(planes, (500.0, 10.0, 900.0, 20.0), 6372, tile)
    got, affine = files._tiff(data)
    assert (got == planes).all() and affine == (500.0, 10.0, 900.0, 20.0) and len(data) < 2 * planes.nbytes + 3 * 4 * tile * tile
    (tmp_path / "a.tif").write_bytes(data)
    rows = files.read_rasters(spark, str(tmp_path)).where("band = 2 and row = 36 and col = 49").collect()
    assert len(rows) == 1 and rows[0].value == planes[1, 36, 49] and (rows[0].x, rows[0].y) == (995.0, 170.0)


@pytest.mark.parametrize(("order", "dtype", "predictor"), [("<", "u2", 2), (">", "u2", 2), ("<", "i4", 1), ("<", "f4", 3), (">", "f4", 3)])
def test_deflated_strips_and_predictors(order, dtype, predictor):
    rng = np.random.default_rng(2)
    values = (rng.integers(0, 60000, (11, 7)) if dtype != "f4" else rng.normal(size=(11, 7))).astype(order + dtype)
    strips = []
    for at in range(0, 11, 4):
        rows = values[at : at + 4]
        if predictor == 2:
            rows = np.diff(rows, axis=1, prepend=np.zeros((len(rows), 1), rows.dtype)).astype(order + dtype)
        raw = rows.tobytes()
        if predictor == 3:
            planes = np.frombuffer(rows.astype(">f4").tobytes(), np.uint8).reshape(len(rows), 7, 4).transpose(0, 2, 1).reshape(len(rows), 28)
            raw = np.diff(planes, axis=1, prepend=np.zeros((len(rows), 1), np.uint8)).astype(np.uint8).tobytes()
        strips.append(zlib.compress(raw))
    at = 8 + sum(map(len, strips))
    where = [8 + sum(map(len, strips[:k])) for k in range(len(strips))]
    kind = {"u": 1, "i": 2, "f": 3}[dtype[0]]
    short = lambda t, v: struct.pack(order + "HHIHH", t, 3, 1, v, 0)
    entries = [short(256, 7), short(257, 11), short(258, int(dtype[1]) * 8), short(259, 8), struct.pack(order + "HHII", 273, 4, 3, at + 500), short(278, 4), struct.pack(order + "HHII", 279, 4, 3, at + 600), short(317, predictor), short(339, kind)]
    data = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + b"".join(strips) + struct.pack(order + "H", len(entries)) + b"".join(entries)
    data = data.ljust(at + 500, b"\0") + struct.pack(order + "3I", *where)
    data = data.ljust(at + 600, b"\0") + struct.pack(order + "3I", *map(len, strips))
    assert (files._tiff(data)[0][0] == values).all()
    with pytest.raises(ValueError):
        files._tiff(data.replace(short(259, 8), short(259, 5)))


def test_rasters_are_written(spark, tmp_path):
    pixels = spark.range(60).selectExpr("2024 year", "cast(id % 2 + 1 as int) month", "cast(id div 10 as int) row", "cast(id % 10 as int) col", "if(id = 7, null, id * 0.5) value")
    assert files.save_rasters(files.encode_rasters(pixels, ["year", "month"], (0.0, 2.0, 10.0, 2.0), epsg=4326), ["year", "month"], str(tmp_path / "out"), "area_ndvi") == 2
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["area_ndvi_2024_1.tif", "area_ndvi_2024_2.tif"]
    back = files.read_rasters(spark, str(tmp_path / "out")).where("not isnan(value)")
    assert back.count() == 59 and back.agg(F.sum("value")).first()[0] == sum(i * 0.5 for i in range(60) if i != 7)


def test_multipolygons_and_points_as_geojson(spark, tmp_path):
    square = lambda x: [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]]
    shapes = [{"type": "Polygon", "coordinates": square(0)}, {"type": "MultiPolygon", "coordinates": [square(5), square(8)]}, {"type": "Point", "coordinates": [1, 2]}, None]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": {"k": str(i)}} for i, g in enumerate(shapes)]}))
    rows = files.read_geojson(spark, str(tmp_path / "g.json")).select(F.col("properties")["k"].alias("k"), F.size("geometry").alias("n"), geom.position(F.lit(8.5), F.lit(0.5), F.col("geometry")).alias("p")).orderBy("k").collect()
    assert [(r.k, r.n) for r in rows][:2] == [("0", 1), ("1", 2)] and rows[1].p == 1 and rows[0].p == -1 and rows[2].n in (None, -1) and rows[3].n in (None, -1)


def test_raster_job(spark, tmp_path):
    days = [(1, 3, 5.0), (1, 9, 1.0), (2, 4, 2.0), (3, 6, 3.0), (5, 2, 1.0), (5, 20, 9.0), (6, 1, 4.0)]
    tiles, items, scenes = ("A", "B"), [], []
    for month, day, cloud in days:
        date = dt.datetime(2024, month, day)
        for tile in tiles:
            if (month, day, tile) == (3, 6, "B"):
                continue
            items.append((f"{date:%m%d}{tile}", date, {"s2:mgrs_tile": tile, "s2:high_proba_clouds_percentage": str(cloud)}))
            for row in range(4):
                for col in range(3):
                    hole = (month, day) == (1, 9) and tile == "A" or (month, day) == (6, 1)
                    for band, v in (("nir", month * 10.0 + row), ("red", 1.0 + col)):
                        scenes.append((date.date(), tile, band, row, col + 3 * tiles.index(tile), None if hole else v))
    catalogue = spark.createDataFrame(items, "id string, datetime timestamp, properties map<string,string>")
    pixels = spark.createDataFrame(scenes, "date date, tile string, band string, row int, col int, value double")
    west, whole = (spark.createDataFrame([(box(0.5, -3.5, x, -0.5),)], f"geometry {SHAPE}") for x in (2.5, 5.5))
    job = raster.RasterJob("here", "ndvi", dt.date(2024, 1, 1), dt.date(2024, 6, 30), ["nir", "red"], "(nir-red)/(nir+red)", retries=2, missing_percent=60, missing_in_row=4)
    book = {r.month: r for r in raster.run_job(job, catalogue, pixels, west, (0.0, 1.0, 0.0, 1.0), str(tmp_path / "w")).collect()}
    assert [book[m].data_id for m in range(1, 7)] == [1, 1, 1, 0, 1, 0] and [book[m].interpolate for m in range(1, 7)] == [0, 0, 0, 3, 0, 2]
    assert [book[m].download_method for m in (1, 2, 3, 5)] == ["specific_date", "specific_date", "full_tile", "specific_date"] and book[6].able_to_download == 0.0
    got = {(r.month, r.row, r.col): r.value for r in files.read_pixels(spark, str(tmp_path / "w" / "pixels")).collect()}
    assert got[1, 2, 1] == pytest.approx((12 - 2) / 14) and got[4, 2, 1] == pytest.approx((got[3, 2, 1] + got[5, 2, 1]) / 2) and got[6, 0, 0] == pytest.approx(got[5, 0, 0])
    before = sorted(p.name for p in (tmp_path / "w" / "pixels").rglob("*.parquet"))
    again = raster.run_job(job, catalogue, pixels.limit(0), west, (0.0, 1.0, 0.0, 1.0), str(tmp_path / "w"))
    assert {r.month: r.data_id for r in again.collect()} == {m: r.data_id for m, r in book.items()}
    months = {p.split("/")[0] for p in before}
    assert months and {r.month for r in files.read_pixels(spark, str(tmp_path / "w" / "pixels")).select("month").distinct().collect()} == set(range(1, 7))
    wide = {r.month: r.data_id for r in raster.run_job(job, catalogue, pixels, whole, (0.0, 1.0, 0.0, 1.0), str(tmp_path / "x")).collect()}
    assert wide[2] == 1 and wide[3] == 0
    with pytest.raises(raster.AvailableData):
        raster.run_job(raster.RasterJob("here", "ndvi", dt.date(2019, 1, 1), dt.date(2019, 6, 30), ["nir"], "nir"), catalogue, pixels, west, (0.0, 1.0, 0.0, 1.0), str(tmp_path / "y"))


def test_streams(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h), 1, "a", 1.0) for h in (0, 1, 5)]
    table = spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double")
    table.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "e"))
    query = streams.windowed_counts(stream, "2 hours", "1 hour").writeStream.format("memory").queryName("counted").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.starts.hour, r.n) for r in spark.sql("select * from counted").collect()} <= {(0, 2), (4, 1)}
    assert sorted(r.n for r in streams.sessions(table, "90 minutes").collect()) == [1, 2]


def test_geometry(spark):
    shape = spark.createDataFrame([(box(0, 0, 4, 2) + box(1, 0.5, 2, 1.5),)], f"g {SHAPE}")
    at = lambda x, y: shape.select(geom.position(F.lit(x), F.lit(y), F.col("g"))).first()[0]
    assert [at(0.5, 0.5), at(1.5, 1.0), at(1.0, 1.0), at(4.0, 2.0), at(5.0, 1.0), at(4.0, 1.0)] == [1, -1, 0, 0, -1, 0]
    assert shape.select(geom.polygon_area(F.col("g"))).first()[0] == 7.0 and shape.select(geom.line_length(F.col("g")[0])).first()[0] == 12.0
    assert shape.select(geom.boundary_distance(F.lit(7.0), F.lit(6.0), F.col("g"))).first()[0] == 5.0
    assert geom.area_of(geom.clip_to_convex(np.array([(0, 0), (4, 0), (4, 2), (0, 2)], float), np.array([(1, -1), (3, -1), (3, 9), (1, 9)], float))) == 4.0
    assert len(geom.convex_hull(np.array([(0, 0), (1, 1), (2, 2)]))) == 2
