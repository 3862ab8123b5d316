"""Queries over points, areas, grids, classes and interpolation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygrain.functions import classify, convert, crs, geom, scalar
from citygrain.operators import aggregate, grid, interpolate, joins, tessellate
from citygrain.plans import views
from citygrain.plans.views import with_views
from citygrain.sources.tables import table

HEX_EDGE = 2.0
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(c: str, n: int = 4):
    return F.round(c, n).alias(c)


_INSIDE = "p.x > b.x0 AND p.x < b.x0 + 8 AND p.y > b.y0 AND p.y < b.y0 + 8"
_MEETS = "p.x >= b.x0 AND p.x <= b.x0 + 8 AND p.y >= b.y0 AND p.y <= b.y0 + 8"
_IN_AREA = "p.x >= a.x0 AND p.x <= a.x0 + 12 AND p.y >= a.y0 AND p.y <= a.y0 + 12"


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(trunc(c_acctbal) AS INTEGER) AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_mktsegment <> '' AS c_mktsegment, TRY_CAST(c_name AS DOUBLE) AS c_name FROM customer")
def q01_cast_columns(spark: SparkSession, d: str) -> DataFrame:
    cast = convert.convert_column_types(table(spark, d, "customer"), {"string": ["c_custkey"], "integer": ["c_acctbal"], "float": ["c_nationkey"], "boolean": ["c_mktsegment"]})
    return convert.coerce_numeric(cast, ["c_name"])


@query(f"{with_views('points', 'bins')} SELECT b.bin_id, round(coalesce(avg(p.value), 0), 4) AS value FROM bins b LEFT JOIN points p ON {_INSIDE} GROUP BY b.bin_id")
def q02_bins_mean_within(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.group_points_by_bins(views.points(spark, d), views.bins(spark), "bin_id", "value", cell=8.0)
    return out.select("bin_id", _round("value"))


@query(f"{with_views('points', 'bins')} SELECT b.bin_id, round(coalesce(sum(p.value), 0), 4) AS value, coalesce(max(p.weight), 0) AS weight FROM bins b LEFT JOIN points p ON {_MEETS} GROUP BY b.bin_id")
def q03_bins_sum_intersects(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.group_points_by_bins(views.points(spark, d), views.bins(spark), "bin_id", ["value", "weight"], {"value": "sum", "weight": "max"}, predicate="intersects", cell=8.0)
    return out.select("bin_id", _round("value"), F.col("weight").cast("int").alias("weight"))


@query(f"{with_views('points', 'bins')} SELECT b.bin_id, round(median(p.value), 4) AS value, round(stddev_samp(p.weight), 4) AS weight, count(p.id) AS id FROM bins b LEFT JOIN points p ON {_INSIDE} GROUP BY b.bin_id HAVING count(p.id) > 0 UNION ALL SELECT bin_id, NULL, NULL, NULL FROM bins b WHERE NOT EXISTS (SELECT 1 FROM points p WHERE {_INSIDE})")
def q04_bins_median_std(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.group_points_by_bins(views.points(spark, d), views.bins(spark), "bin_id", ["value", "weight", "id"], {"value": "median", "weight": "std", "id": "count"}, fill_missing=False, cell=8.0)
    return out.select("bin_id", _round("value"), _round("weight"), "id")


@query(f"{with_views('points', 'bins')} SELECT b.bin_id, coalesce(CASE WHEN count(p.id) = 0 THEN NULL ELSE CASE WHEN min(p.weight) - 1 = 0 THEN 0.5 ELSE min(p.weight) - 1 END END, -1.0) AS rank FROM bins b LEFT JOIN points p ON {_MEETS} AND (p.x = b.x0 OR p.x = b.x0 + 8 OR p.y = b.y0 OR p.y = b.y0 + 8) GROUP BY b.bin_id")
def q05_bins_zero_replaced_touching(spark: SparkSession, d: str) -> DataFrame:
    points = views.points(spark, d).withColumn("rank", (F.col("weight") - 1).cast("double"))
    return aggregate.group_points_by_bins(points, views.bins(spark), "bin_id", "rank", "min", True, -1.0, 0.5, ["geometry"], "touches", 8.0)


@query("SELECT c_mktsegment, round(sum(c_nationkey * c_acctbal) / sum(c_nationkey), 6) AS average FROM customer GROUP BY c_mktsegment")
def q06_weighted_average(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "customer").groupBy("c_mktsegment").agg(scalar.weighted_average(F.col("c_nationkey"), F.col("c_acctbal")).alias("average"))
    return out.select("c_mktsegment", _round("average", 6))


@query("""WITH s AS (SELECT l_suppkey, l_quantity, CASE WHEN l_linenumber % 3 > 0 THEN l_discount END AS l_discount, l_tax FROM lineitem)
SELECT l_suppkey, round(sum(l_quantity), 4) AS l_quantity, round(coalesce(sum(l_discount * l_quantity) / nullif(sum(CASE WHEN l_discount IS NOT NULL THEN l_quantity END), 0), 0), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM s GROUP BY l_suppkey""")
def q07_group_sociodemographic(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")))
    out = rows.groupBy("l_suppkey").agg(*aggregate.sociodemographic_aggregates(["l_quantity", "l_discount", "l_tax"], ["l_tax"], {"l_discount": "l_quantity"}))
    return out.select("l_suppkey", _round("l_quantity"), _round("l_discount", 6), _round("l_tax", 6))


@query(f"""{with_views('points', 'areas')}, n AS (SELECT a.area_id, count(p.id) AS n FROM areas a LEFT JOIN points p ON {_IN_AREA} GROUP BY a.area_id)
SELECT p.id, a.area_id, round(a.people / greatest(n.n, 1), 6) AS people, a.rate FROM points p LEFT JOIN areas a ON {_IN_AREA} LEFT JOIN n ON n.area_id = a.area_id""")
def q08_polygons_to_points(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.polygons_to_points(views.points(spark, d).select("id", "x", "y"), views.areas(spark, d), "area_id", 0, -1, ["rate"], 12.0)
    return out.select("id", "area_id", _round("people", 6), "rate")


@query(f"""{with_views('points', 'areas')} SELECT a.area_id, round(sum(p.value * p.weight) / sum(p.weight), 4) AS value, CAST(sum(p.weight) AS DOUBLE) AS weight FROM points p JOIN areas a ON {_IN_AREA} GROUP BY a.area_id""")
def q09_points_to_polygons(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.points_to_polygons(views.points(spark, d), views.areas(spark, d), "area_id", ["id"], {"value": "weight"}, cell=12.0)
    return out.select("area_id", _round("value"), "weight")


@query(f"""{with_views('points', 'areas')}, far AS (SELECT * FROM points p WHERE NOT EXISTS (SELECT 1 FROM areas a WHERE {_IN_AREA})),
d AS (SELECT p.id, a.area_id, sqrt(pow(greatest(a.x0 - p.x, 0, p.x - a.x0 - 12), 2) + pow(greatest(a.y0 - p.y, 0, p.y - a.y0 - 12), 2)) AS boundary_distance FROM far p CROSS JOIN areas a)
SELECT id, arg_min(area_id, (boundary_distance, area_id)) AS area_id, round(min(boundary_distance), 6) AS boundary_distance FROM d GROUP BY id""")
def q10_nearest_polygon(spark: SparkSession, d: str) -> DataFrame:
    areas = views.areas(spark, d).select("area_id", "geometry")
    outside = joins.spatial_join(views.points(spark, d).select("id", "x", "y"), areas, "area_id", "intersects", "left", 12.0).where("area_id is null").drop("area_id")
    return joins.nearest_polygon(outside, "id", areas, "area_id").select("id", "area_id", _round("boundary_distance", 6))


_HAVERSINE = "2 * 6371000e0 * atan2(sqrt(h), sqrt(1 - h))"


@query(f"""{with_views('points', 'pois')}, d AS (SELECT p.id, s.id AS osmid, pow(sin(radians(s.y - p.y) / 2), 2) + cos(radians(p.y)) * cos(radians(s.y)) * pow(sin(radians(s.x - p.x) / 2), 2) AS h FROM points p CROSS JOIN pois s)
SELECT id, arg_min(osmid, ({_HAVERSINE.replace(' ', '')}, osmid)) AS osmid, round(min({_HAVERSINE}), 3) AS distance_node FROM d GROUP BY id""")
def q11_nearest_on_sphere(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.pois(spark, d).withColumnRenamed("id", "osmid")
    out = joins.nearest_nodes(views.points(spark, d).select("id", "x", "y"), nodes, False, True)
    return out.select("id", "osmid", _round("distance_node", 3))


@query(f"""{with_views('points', 'pois')}, d AS (SELECT p.id, s.id AS osmid, pow(s.x - p.x, 2) + pow(s.y - p.y, 2) AS q FROM points p CROSS JOIN pois s)
SELECT id, arg_min(osmid, (q, osmid)) AS osmid, round(sqrt(min(q)), 6) AS distance_node FROM d GROUP BY id""")
def q12_nearest_in_plane(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.pois(spark, d).withColumnRenamed("id", "osmid")
    return joins.nearest_nodes(views.points(spark, d).select("id", "x", "y"), nodes, True, True).select("id", "osmid", _round("distance_node", 6))


@query(f"""{with_views('points', 'pois')}, d AS (SELECT p.id, s.id AS osmid, pow(s.x - p.x, 2) + pow(s.y - p.y, 2) AS q FROM points p CROSS JOIN pois s)
SELECT id, arg_min(osmid, (q, osmid)) AS osmid, round(sqrt(min(q)), 6) AS distance_node FROM d GROUP BY id""")
def q12b_nearest_by_rings(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.pois(spark, d).withColumnRenamed("id", "osmid")
    return joins.nearest_nodes(views.points(spark, d).select("id", "x", "y"), nodes, True, True, most_broadcast=0).select("id", "osmid", _round("distance_node", 6))


@query(f"{with_views('points')} SELECT id, round(1 / (1 + exp(-(0.5 * (x - 10)))), 9) AS rising, round(1 / (1 + exp(0.25 * (y - 30))), 9) AS falling, round(pow(1 / (1 + exp(-(0.5 * (x - 10)))) - 0.25, 2), 9) AS error FROM points")
def q13_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return views.points(spark, d).select("id", F.round(scalar.sigmoid(x, 0.5, 10), 9).alias("rising"), F.round(scalar.sigmoid(y, 0.25, 30, invert=False), 9).alias("falling"), F.round(scalar.sigmoid_error(x, 0.5, 10, 0.25), 9).alias("error"))


@query("SELECT l_orderkey, l_linenumber, round(4.0 * exp(-3.5 * abs(l_discount)), 9) AS speed, round(l_extendedprice * 60 / (4.0 * exp(-3.5 * abs(l_discount)) * 1000), 6) AS time_min FROM lineitem")
def q14_walk_speed(spark: SparkSession, d: str) -> DataFrame:
    speed = scalar.walk_speed(F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(speed, 9).alias("speed"), F.round(scalar.minutes(F.col("l_extendedprice"), speed), 6).alias("time_min"))


_W = "1 / pow(sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2)) + 1e-12, 2)"


@query(f"{with_views('points', 'pois')} SELECT s.id, round(sum({_W} * p.value) / sum({_W}), 4) AS interpolated_value FROM pois s CROSS JOIN points p GROUP BY s.id")
def q16_idw(spark: SparkSession, d: str) -> DataFrame:
    seen = views.points(spark, d).select("x", "y", F.col("value").alias("z"))
    return interpolate.interpolate(views.pois(spark, d), seen, "id").select("id", _round("interpolated_value"))


@query(f"""{with_views('points', 'pois')} SELECT s.id, round(coalesce(sum({_W} * CASE WHEN p.id % 5 > 0 THEN p.value ELSE 0 END) / sum({_W}), 0), 4) AS interpolated_value
FROM pois s LEFT JOIN points p ON sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2)) <= 1.5 GROUP BY s.id""")
def q17_idw_radius(spark: SparkSession, d: str) -> DataFrame:
    seen = views.points(spark, d).select("x", "y", F.when(F.col("id") % 5 > 0, F.col("value")).alias("z"))
    return interpolate.interpolate(views.pois(spark, d), seen, "id", search_radius=1.5).select("id", _round("interpolated_value"))


_ROOT = f"{grid.ROOT3!r}"
_AXIAL = f"""a AS (SELECT *, (x * ({_ROOT} / 3) - y / 3) / {HEX_EDGE} AS q0, y * (2 / 3e0) / {HEX_EDGE} AS r0 FROM points),
b AS (SELECT *, round(q0) AS rq, round(r0) AS rr, round(-q0 - r0) AS rs FROM a),
c AS (SELECT *, abs(rq - q0) AS dq, abs(rr - r0) AS dr, abs(rs - (-q0 - r0)) AS ds FROM b),
hex AS (SELECT id, value, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM c)"""


@query(f"{with_views('points')}, {_AXIAL} SELECT q || ':' || r AS hex_id, count(*) AS n, round(avg(value), 4) AS value FROM hex GROUP BY 1")
def q18_hexagon_means(spark: SparkSession, d: str) -> DataFrame:
    q, r = grid.cell_of(F.col("x"), F.col("y"), HEX_EDGE)
    cells = views.points(spark, d).select(q.alias("q"), r.alias("r"), "value")
    return cells.groupBy(grid.cell_id(F.col("q"), F.col("r")).alias("hex_id")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("value"))


@query(f"""{with_views('areas')}, cell AS (SELECT q, r, {HEX_EDGE} * {_ROOT} * (q + r / 2e0) AS cx, {HEX_EDGE} * 1.5 * r AS cy FROM range(-40, 60) AS a(q), range(-5, 40) AS b(r))
SELECT DISTINCT q || ':' || r AS hex_id, q, r FROM cell JOIN areas ON cx BETWEEN x0 AND x0 + 12 AND cy BETWEEN y0 AND y0 + 12""")
def q19_hexagon_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.hexagon_grid(views.areas(spark, d), edge=HEX_EDGE).drop("geometry")


def _sweeps(n: int) -> str:
    """``n`` sweeps over cells c0; further ones change nothing once all that can be filled is."""
    out = []
    for k in range(n):
        alone = "CASE WHEN n.q IS NULL THEN (SELECT avg(v) FROM c0) END" if k == 0 else "NULL"
        out.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.q, c.r, coalesce(c.v, n.v, {alone}) AS v FROM c{k} c LEFT JOIN (SELECT q + dq AS q, r + dr AS r, avg(v) AS v FROM c{k}, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)) AS o(dq, dr)
  GROUP BY q + dq, r + dr) n ON n.q = c.q AND n.r = c.r)""")
    return ",\n".join(out)


@query(f"""{with_views('points')}, {_AXIAL}, c0 AS (SELECT q, r, CASE WHEN avg(value) > 6000 THEN avg(value) END AS v FROM hex GROUP BY q, r), {_sweeps(20)} SELECT q, r, round(v, 4) AS v FROM c20""")
def q20_hexagon_fill(spark: SparkSession, d: str) -> DataFrame:
    """Cells of small means count as missing, so that holes lie side by side and many sweeps are needed."""
    q, r = grid.cell_of(F.col("x"), F.col("y"), HEX_EDGE)
    cells = views.points(spark, d).select(q.alias("q"), r.alias("r"), "value").groupBy("q", "r").agg(F.avg("value").alias("v"))
    holes = cells.withColumn("v", F.when(F.col("v") > 6000, F.col("v")))
    return interpolate.fill_hexagons(holes, ["v"]).select("q", "r", _round("v"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 15 THEN '15 minutes or less' WHEN l_quantity < 30 THEN '15 minutes to 30 minutes' WHEN l_quantity < 45 THEN '30 minutes to 45 minutes' WHEN l_quantity < 60 THEN '45 minutes to 60 minutes' ELSE '60 or more minutes' END AS time_class, CASE WHEN l_quantity < 15 THEN 0 WHEN l_quantity < 30 THEN 1 WHEN l_quantity < 45 THEN 2 WHEN l_quantity < 60 THEN 3 ELSE 4 END AS time_order FROM lineitem")
def q42_time_class(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify_time(table(spark, d, "lineitem"), "l_quantity").select("l_orderkey", "l_linenumber", "time_class", "time_order")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN v < 0.1 THEN 'Artificial surface/Water/Rock' WHEN v < 0.2 THEN 'Bare soil' WHEN v < 0.4 THEN 'Low vegetation density' WHEN v < 0.6 THEN 'Moderate vegetation density' ELSE 'High vegetation density' END AS ndvi_class FROM (SELECT *, l_quantity / 64e0 AS v FROM lineitem)")
def q43_ndvi_class(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify_ndvi(table(spark, d, "lineitem").withColumn("v", F.col("l_quantity") / 64.0), "v").select("l_orderkey", "l_linenumber", "ndvi_class")


@query("""WITH m AS (SELECT p_partkey, p_size - (SELECT avg(p_size) FROM part) AS a FROM part)
SELECT p_partkey, round(a, 6) AS anomaly, CASE WHEN a <= -3.5 THEN '7. Less temperature' WHEN a <= -1.5 THEN '6.' WHEN a <= -0.5 THEN '5.' WHEN a <= 0.5 THEN '4. Near overall mean' WHEN a <= 1.5 THEN '3.' WHEN a <= 3.5 THEN '2.' ELSE '1. More temperature' END AS anomaly_class FROM m""")
def q44_anomaly_class(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify_anomaly(table(spark, d, "part"), "p_size").select("p_partkey", _round("anomaly", 6), "anomaly_class")


@query(f"""{with_views('points')}, b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, min(value) AS v0, max(value) AS v1 FROM points), s AS (SELECT *, greatest(x1 - x0, y1 - y0) AS side FROM b)
SELECT (x0 + x1) / 2 - (side / 2 + side * 0.25 / 2) AS minx, (y0 + y1) / 2 - (side / 2 + side * 0.5 / 2) AS miny, (x0 + x1) / 2 + (side / 2 + side * 0.25 / 2) AS maxx, (y0 + y1) / 2 + (side / 2 + side * 0.5 / 2) AS maxy,
CASE WHEN v0 < 0 AND v1 > 0 THEN -greatest(abs(v0), abs(v1)) ELSE v0 END AS vmin, CASE WHEN v0 < 0 AND v1 > 0 THEN greatest(abs(v0), abs(v1)) ELSE v1 END AS vmax FROM s""")
def q45_bounds(spark: SparkSession, d: str) -> DataFrame:
    points = views.points(spark, d)
    square = classify.square_bounds(points, (0.25, 0.5), "x", "y", "x", "y")
    colours = classify.colour_range(points, "value")
    return square.select("*", *[colours.select(c).scalar().alias(c) for c in ("vmin", "vmax")])


@query(f"""{with_views('pois')}, s AS (SELECT x, y, min(id) AS id FROM pois GROUP BY x, y),
line AS (SELECT p.id, p.x AS px, p.y AS py, q.id AS k, q.x - p.x AS a, q.y - p.y AS b, (q.x * q.x + q.y * q.y - p.x * p.x - p.y * p.y) / 2 AS c FROM s p JOIN s q ON p.id <> q.id UNION ALL
  SELECT id, x, y, k, a, b, c FROM s, (VALUES (-1, 1e0, 0e0, 64e0), (-2, -1e0, 0e0, 0e0), (-3, 0e0, 1e0, 64e0), (-4, 0e0, -1e0, 0e0)) AS w(k, a, b, c)),
corner AS (SELECT l.id, l.px, l.py, (l.c * m.b - m.c * l.b) / (l.a * m.b - m.a * l.b) AS x, (l.a * m.c - m.a * l.c) / (l.a * m.b - m.a * l.b) AS y FROM line l JOIN line m ON l.id = m.id AND l.k < m.k AND abs(l.a * m.b - m.a * l.b) > 1e-12),
kept AS (SELECT DISTINCT id, px, py, round(x, 7) AS x, round(y, 7) AS y FROM corner v WHERE NOT EXISTS (SELECT 1 FROM line l WHERE l.id = v.id AND l.a * v.x + l.b * v.y > l.c + 1e-7)),
turn AS (SELECT *, lead(x, 1, first_x) OVER o AS nx, lead(y, 1, first_y) OVER o AS ny FROM (SELECT *, first_value(x) OVER w AS first_x, first_value(y) OVER w AS first_y FROM kept WINDOW w AS (PARTITION BY id ORDER BY atan2(y - py, x - px), x, y))
  WINDOW o AS (PARTITION BY id ORDER BY atan2(y - py, x - px), x, y))
SELECT id, round(sum(x * ny - nx * y) / 2, 3) AS area FROM turn GROUP BY id""")
def q48_voronoi_area(spark: SparkSession, d: str) -> DataFrame:
    """The area of each cell; the SQL tries all corners of all pairs of bisectors."""
    cells = tessellate.voronoi(views.pois(spark, d), [(0, 0), (64, 0), (64, 64), (0, 64), (0, 0)], "id")
    return cells.select("id", F.round("area", 3).alias("area"))


@query(f"{with_views('areas')} SELECT area_id, (least(x0 + 12, 30) - greatest(x0, 5)) * (least(y0 + 12, 50) - greatest(y0, 10)) AS area FROM areas WHERE least(x0 + 12, 30) > greatest(x0, 5) AND least(y0 + 12, 50) > greatest(y0, 10)")
def q49_clip_polygons(spark: SparkSession, d: str) -> DataFrame:
    return tessellate.clip_polygons(views.areas(spark, d), "area_id", [(5, 10), (30, 10), (30, 50), (5, 50)]).select("area_id", "area")


@query(f"""{with_views('points')}, p AS (SELECT DISTINCT weight, x, y FROM points),
side AS (SELECT a.weight, a.x AS ax, a.y AS ay, b.x AS ox, b.y AS oy FROM p a JOIN p b ON a.weight = b.weight AND (a.x, a.y) <> (b.x, b.y) WHERE NOT EXISTS (
  SELECT 1 FROM p c WHERE c.weight = a.weight AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0
    AND ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 OR (c.x - b.x) * (a.x - b.x) + (c.y - b.y) * (a.y - b.y) < 0)))))
SELECT g.weight, s.area FROM (SELECT DISTINCT weight FROM points) g LEFT JOIN (SELECT weight, round(sum(ax * oy - ox * ay) / 2, 6) AS area FROM side GROUP BY weight HAVING sum(ax * oy - ox * ay) > 0) s ON s.weight = g.weight""")
def q50_hulls(spark: SparkSession, d: str) -> DataFrame:
    hulls = tessellate.hulls(views.points(spark, d), "weight")
    return hulls.select("weight", F.round(geom.polygon_area(F.col("geometry")), 6).alias("area"))


@query(f"{with_views('areas')} SELECT area_id, 144e0 AS area, 48e0 AS length, x0 AS minx, y0 + 12 AS maxy FROM areas")
def q51_polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    shape = F.col("geometry")
    box = geom.bounds(shape)
    return views.areas(spark, d).select("area_id", geom.polygon_area(shape).alias("area"), geom.line_length(shape[0]).alias("length"), box["minx"].alias("minx"), box["maxy"].alias("maxy"))


_IN_ZONE = """seg AS (SELECT cve_ageb, r[i].x AS x1, r[i].y AS y1, r[i + 1].x AS x2, r[i + 1].y AS y2 FROM (SELECT cve_ageb, r, unnest(range(1, len(r))) AS i FROM (SELECT cve_ageb, unnest(geometry) AS r FROM zones))),
place AS (SELECT osmid, min(x) AS x, min(y) AS y FROM nodes WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 AND NOT (x = 0 AND y = 0) GROUP BY osmid),
hit AS (SELECT p.osmid, b.cve_ageb FROM place p JOIN (SELECT cve_ageb, min(x1) AS x0, max(x1) AS xm, min(y1) AS y0, max(y1) AS ym FROM seg GROUP BY 1) b ON p.x BETWEEN x0 AND xm AND p.y BETWEEN y0 AND ym),
held AS (SELECT h.osmid, h.cve_ageb FROM hit h JOIN place p USING (osmid) JOIN seg s USING (cve_ageb) GROUP BY 1, 2
  HAVING count(*) FILTER (WHERE (y1 > p.y) <> (y2 > p.y) AND ((x2 - x1) * (p.y - y1) - (y2 - y1) * (p.x - x1) > 0) = (y2 > y1)) % 2 = 1)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """One row per street junction with a possible place."""
    nodes = table(spark, d, "nodes").where(F.col("x").between(-180, 180) & F.col("y").between(-90, 90) & ~((F.col("x") == 0) & (F.col("y") == 0)))
    return nodes.groupBy("osmid").agg(F.min("x").alias("x"), F.min("y").alias("y"))


@query(f"WITH {_IN_ZONE} SELECT h.cve_ageb, count(*) AS points_count FROM place p LEFT JOIN held h USING (osmid) GROUP BY h.cve_ageb")
def q60_junctions_by_zone(spark: SparkSession, d: str) -> DataFrame:
    """Junctions per zone of the census, those of no zone under null."""
    return aggregate.count_points(_placed(spark, d), table(spark, d, "zones").select("cve_ageb", "geometry"), "cve_ageb")


@query(f"WITH {_IN_ZONE} SELECT z.cve_ageb, round(coalesce(avg(street_count), 0), 6) AS street_count FROM zones z LEFT JOIN held h USING (cve_ageb) LEFT JOIN (SELECT osmid, max(street_count) AS street_count FROM nodes GROUP BY osmid) n USING (osmid) GROUP BY z.cve_ageb")
def q61_streets_by_zone(spark: SparkSession, d: str) -> DataFrame:
    """Mean number of streets at the junctions of each zone."""
    streets = table(spark, d, "nodes").groupBy("osmid").agg(F.max("street_count").cast("double").alias("street_count"))
    points = _placed(spark, d).join(streets, "osmid")
    out = aggregate.group_points_by_bins(points, table(spark, d, "zones").select("cve_ageb", "geometry"), "cve_ageb", "street_count", predicate="intersects")
    return out.select("cve_ageb", F.round("street_count", 6).alias("street_count"))


@query(f"""WITH {_IN_ZONE} SELECT osmid, round(6378137 * radians(x), 4) AS x, round(6378137 * ln(tan(pi() / 4 + radians(y) / 2)), 4) AS y FROM place WHERE abs(y) <= 85""")
def q62_mercator(spark: SparkSession, d: str) -> DataFrame:
    x, y = crs.transform(F.col("x"), F.col("y"), 4326, 3857)
    return _placed(spark, d).where(F.abs("y") <= 85).select("osmid", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))
