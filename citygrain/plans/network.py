"""Queries over street networks, with SQL that relaxes distances by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygrain.functions import classify, geom
from citygrain.operators import grid, network
from citygrain.plans import views
from citygrain.plans.views import with_views
from citygrain.sources import overpass
from citygrain.sources.tables import table

LIMIT = 30.0


def _reach(seeds: str, weight: str = "length", limit: str = "1e300") -> str:
    """CTE ``d`` (seed, node, dist) of the nodes within a limit of each seed."""
    return f"""{with_views('net_nodes', 'net_edges', 'seeds', recursive=True)}, ue AS (SELECT u, v, {weight} AS w FROM net_edges UNION ALL SELECT v, u, {weight} FROM net_edges),
d(seed, node, dist) USING KEY (seed, node) AS (SELECT seed, node, 0e0 FROM ({seeds}) UNION
  SELECT x.seed, x.v, x.nd FROM (SELECT d.seed, ue.v, min(d.dist + ue.w) AS nd FROM d JOIN ue ON d.node = ue.u WHERE d.dist + ue.w <= {limit} GROUP BY 1, 2) x
  LEFT JOIN recurring.d r ON r.seed = x.seed AND r.node = x.v WHERE r.dist IS NULL OR x.nd < r.dist)"""


_ALL = "SELECT DISTINCT 0 AS seed, osmid AS node FROM seeds"
_EACH = "SELECT seed_pos AS seed, osmid AS node FROM seeds"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"{with_views('net_edges')} SELECT u, v, key, length, round(length * 60 / 5000.0, 9) AS time_min FROM net_edges")
def q15_edge_costs(spark: SparkSession, d: str) -> DataFrame:
    return network.prepare_edges(views.net_edges(spark, d), 5.0).withColumn("time_min", F.round("time_min", 9))


@query(f"{_reach(_ALL, 'length * 60 / 4000e0')} SELECT node AS osmid, round(dist, 9) AS time_poi, n.x, n.y FROM d JOIN net_nodes n ON n.osmid = d.node")
def q21_network_time(spark: SparkSession, d: str) -> DataFrame:
    return q21_times(spark, d).withColumn("time_poi", F.round("time_poi", 9))


def q21_times(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.net_nodes(spark, d)
    at = views.seeds(spark, d).join(nodes, "osmid").select("seed_pos", "x", "y")
    return network.time_to_pois(nodes, views.net_edges(spark, d), at, "poi", projected=True)


@query(f"{_reach(_EACH, limit=str(LIMIT))} SELECT node AS osmid, count(*) AS n FROM d GROUP BY node")
def q22_network_count(spark: SparkSession, d: str) -> DataFrame:
    return network.counts_within(views.net_nodes(spark, d), views.net_edges(spark, d), views.seeds(spark, d), "length", LIMIT)


@query(f"{_reach(_EACH, limit=str(LIMIT))} SELECT node AS osmid, min(dist) AS dist, arg_min(seed, (dist, seed)) AS seed_pos FROM d GROUP BY node")
def q23_nearest_poi(spark: SparkSession, d: str) -> DataFrame:
    return network.multi_source(views.net_nodes(spark, d), views.net_edges(spark, d), views.seeds(spark, d), "length", LIMIT)


@query(f"{_reach(_ALL)} SELECT node AS osmid, dist FROM d")
def q23b_relaxed_by_rounds(spark: SparkSession, d: str) -> DataFrame:
    return network.multi_source(views.net_nodes(spark, d), views.net_edges(spark, d), views.seeds(spark, d), "length", most_edges=0).select("osmid", "dist")


@query(f"""{_reach('SELECT DISTINCT seed_pos % 7 AS seed, osmid AS node FROM seeds', 'length * 60 / 4000e0')} SELECT node AS osmid, round(min(dist), 9) AS time_park, count(*) FILTER (WHERE dist <= 0.3) AS "park_0.3min", n.x, n.y FROM d JOIN net_nodes n ON n.osmid = d.node GROUP BY ALL""")
def q24_multi_geometry(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.net_nodes(spark, d)
    at = views.seeds(spark, d).join(nodes, "osmid").select((F.col("seed_pos") % 7).alias("park_id"), "x", "y")
    out = network.time_to_multi_geometry_pois(nodes, views.net_edges(spark, d), at, "park", "park_id", count_pois=(True, 0.3), projected=True)
    return out.withColumn("time_park", F.round("time_park", 9))


@query(f"{_reach('SELECT 0 AS seed, 45 AS node', limit='40')} SELECT node AS osmid, dist FROM d")
def q25_isochrone_nodes(spark: SparkSession, d: str) -> DataFrame:
    return network.isochrone_nodes(views.net_nodes(spark, d), views.net_edges(spark, d), 45, 40.0)


@query(f"""{_reach(_ALL, 'length * 60 / 4000e0')}, a AS (SELECT dist, (n.x * ({3**0.5!r} / 3) - n.y / 3) / 2.71828 AS q0, n.y * (2 / 3e0) / 2.71828 AS r0 FROM d JOIN net_nodes n ON n.osmid = d.node),
b AS (SELECT *, round(q0) AS rq, round(r0) AS rr, round(-q0 - r0) AS rs FROM a), c AS (SELECT *, abs(rq - q0) AS dq, abs(rr - r0) AS dr, abs(rs - (-q0 - r0)) AS ds FROM b),
h AS (SELECT dist, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM c)
SELECT q || ':' || r AS hex_id, count(*) AS n_nodes, round(avg(dist), 9) AS time_poi, CASE WHEN avg(dist) < 15 THEN '15 minutes or less' WHEN avg(dist) < 30 THEN '15 minutes to 30 minutes' WHEN avg(dist) < 45 THEN '30 minutes to 45 minutes' WHEN avg(dist) < 60 THEN '45 minutes to 60 minutes' ELSE '60 or more minutes' END AS time_class FROM h GROUP BY q, r""")
def q57_proximity_by_hexagon(spark: SparkSession, d: str) -> DataFrame:
    """From points of interest to mean minutes per hexagon: nearest nodes, network times, cells, classes."""
    q, r = grid.cell_of(F.col("x"), F.col("y"), 2.71828)
    cells = q21_times(spark, d).select(grid.cell_id(q, r).alias("hex_id"), "time_poi")
    means = cells.groupBy("hex_id").agg(F.count("*").alias("n_nodes"), F.avg("time_poi").alias("time_poi"))
    return classify.classify_time(means, "time_poi").select("hex_id", "n_nodes", F.round("time_poi", 9).alias("time_poi"), "time_class")


@query(f"""{_reach('SELECT 0 AS seed, 45 AS node', limit='40')}, p AS MATERIALIZED (SELECT x, y FROM d JOIN net_nodes n ON n.osmid = d.node),
side AS (SELECT a.x AS ax, a.y AS ay, b.x AS ox, b.y AS oy FROM p a JOIN p b ON (a.x, a.y) <> (b.x, b.y) WHERE NOT EXISTS (
  SELECT 1 FROM p c WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0
    AND ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 OR (c.x - b.x) * (a.x - b.x) + (c.y - b.y) * (a.y - b.y) < 0))))
SELECT round(sum(ax * oy - ox * ay) / 2, 6) AS area FROM side""")
def q26_isochrone_hull(spark: SparkSession, d: str) -> DataFrame:
    hull = network.isochrone(views.net_nodes(spark, d), views.net_edges(spark, d), 45, 40.0)
    return hull.select(F.round(geom.polygon_area(F.col("geometry")), 6).alias("area"))


_APART = "length + ((u * 7919 + v * 104729) % 100003) / 1e9"


@query(f"""{with_views('net_nodes', 'net_edges', 'seeds', recursive=True)}, ue AS MATERIALIZED (SELECT u, v, u AS eu, v AS ev, {_APART} AS w FROM net_edges UNION ALL SELECT v, u, u, v, {_APART} FROM net_edges),
d(seed, node, dist) USING KEY (seed, node) AS (SELECT seed_pos, osmid, 0e0 FROM seeds UNION
  SELECT x.seed, x.v, x.nd FROM (SELECT d.seed, ue.v, min(d.dist + ue.w) AS nd FROM d JOIN ue ON d.node = ue.u WHERE d.dist + ue.w < 12 GROUP BY 1, 2) x LEFT JOIN recurring.d r ON r.seed = x.seed AND r.node = x.v WHERE r.dist IS NULL OR x.nd < r.dist),
near AS MATERIALIZED (SELECT * FROM d WHERE seed IN (SELECT seed FROM d GROUP BY seed HAVING count(*) > 1)),
tree AS MATERIALIZED (SELECT n.seed, ue.v AS node, arg_min({{'p': n.node, 'u': ue.eu, 'v': ue.ev}}, n.dist + ue.w) AS via FROM near n JOIN ue ON ue.u = n.node JOIN seeds s ON s.seed_pos = n.seed WHERE ue.v <> s.osmid GROUP BY ALL),
up(seed, place, eu, ev) AS (SELECT seed, via.p, via.u, via.v FROM tree UNION ALL SELECT up.seed, t.via.p, t.via.u, t.via.v FROM up JOIN tree t ON t.seed = up.seed AND t.node = up.place),
n AS (SELECT eu, ev, count(*) AS n FROM up GROUP BY ALL)
SELECT u, v, key, CAST(coalesce(n.n, 0) AS INTEGER) AS passing_count FROM net_edges LEFT JOIN n ON eu = u AND ev = v""")
def q27_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lengths are set apart by a little, so that no two paths are equal."""
    edges = views.net_edges(spark, d).withColumn("length", F.col("length") + ((F.col("u") * 7919 + F.col("v") * 104729) % 100003) / F.lit(1e9))
    out = network.edge_counts(views.net_nodes(spark, d), edges, views.seeds(spark, d).select("osmid"), "length", 12.0)
    return out.select("u", "v", "key", "passing_count")


@query(f"""{with_views('net_edges')} SELECT (100 + u % 40) * 100000 + 10000 + u // 40 AS u, (100 + v % 40) * 100000 + 10000 + v // 40 AS v, 0 AS key, 1e0 AS length FROM net_edges""")
def q46_create_network(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.struct((F.col(c) % 40 + 100.0).alias("x"), (F.floor(F.col(c) / 40) + 10000.0).alias("y"))
    nodes = views.net_nodes(spark, d).select((F.col("x") + 100).alias("x"), (F.col("y") + 10000).alias("y"))
    lines = views.net_edges(spark, d).select(F.array(at("u"), at("v")).alias("geometry"))
    return network.create_network(nodes, lines)[1].select("u", "v", "key", "length")


@query(f"""{with_views('net_edges', 'net_nodes')}, chosen AS (SELECT osmid FROM net_nodes WHERE (x - 20) * (x - 20) + (y - 10) * (y - 10) <= 64) SELECT u, v, key, length FROM net_edges WHERE u IN (SELECT osmid FROM chosen) OR v IN (SELECT osmid FROM chosen)""")
def q47_edges_touching(spark: SparkSession, d: str) -> DataFrame:
    """Edges that reach into a circle."""
    chosen = views.net_nodes(spark, d).where((F.col("x") - 20) * (F.col("x") - 20) + (F.col("y") - 10) * (F.col("y") - 10) <= 64)
    return network.ends_in(views.net_edges(spark, d), chosen)


_TAGS = overpass.TAG_COLUMNS
_BOTH = f"""place AS (SELECT id, arg_min(lon, elem_id) AS x, arg_min(lat, elem_id) AS y FROM overpass_elements WHERE type = 'node' AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 GROUP BY id),
way AS (SELECT id, arg_min(nodes, elem_id) AS nodes, arg_min(tags, elem_id) AS tags FROM overpass_elements WHERE type = 'way' AND coalesce(tags['highway'], '') <> '' GROUP BY id),
step AS (SELECT id, tags, i, nodes[i] AS a, nodes[i + 1] AS b, lower(coalesce(tags['oneway'], CASE WHEN tags['junction'] = 'roundabout' THEN 'yes' END, 'no')) AS said FROM (SELECT id, nodes, tags, unnest(range(1, len(nodes))) AS i FROM way)),
each AS (SELECT id, tags, i, a AS u, b AS v, 0 AS back, said IN ('yes', 'true', '1') AS oneway FROM step WHERE said NOT IN ('-1', 'reverse') UNION ALL
  SELECT id, tags, i, b, a, 1, said IN ('-1', 'reverse') FROM step WHERE said NOT IN ('yes', 'true', '1')),
edge AS (SELECT s.u, s.v, CAST(row_number() OVER (PARTITION BY s.u, s.v ORDER BY s.id, s.i, s.back) - 1 AS INTEGER) AS key, CAST(s.id AS VARCHAR) AS osmid, s.oneway, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, {', '.join(f"s.tags['{t}'] AS {t}" for t in _TAGS)},
  2 * 6371000 * atan2(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)), sqrt(1 - pow(sin(radians(b.y - a.y) / 2), 2) - cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) AS length
  FROM each s JOIN place a ON a.id = s.u JOIN place b ON b.id = s.v)"""


@query(f"WITH {_BOTH} SELECT u, v, key, osmid, oneway, round(length, 4) AS length, ux, uy, vx, vy, {', '.join(_TAGS)} FROM edge")
def q52_network_from_elements(spark: SparkSession, d: str) -> DataFrame:
    """All columns of the edges, the line as its ends."""
    edges = overpass.network_from_elements(table(spark, d, "overpass_elements"))[1]
    ends = [F.element_at("geometry", i)[c].alias(f"{n}{c}") for i, n in ((1, "u"), (-1, "v")) for c in "xy"]
    return edges.select("u", "v", "key", "osmid", "oneway", F.round("length", 4).alias("length"), *ends, *_TAGS)


@query(f"""WITH RECURSIVE {_BOTH}, near AS (SELECT u AS n, v AS o, 1 AS o1 FROM edge UNION ALL SELECT v, u, 0 FROM edge),
passed AS MATERIALIZED (SELECT n FROM near GROUP BY n HAVING count(DISTINCT o) = 2 AND count(*) IN (2, 4) AND sum(o1) > 0 AND sum(o1) < count(*) AND max(CAST(n = o AS INTEGER)) = 0),
e AS MATERIALIZED (SELECT u, v, key, length FROM edge), walk(u, key, first, before, v, length, n) AS (SELECT u, key, v, u, v, length, 2 FROM e WHERE u NOT IN (SELECT n FROM passed) UNION ALL
  SELECT w.u, w.key, w.first, w.v, e.v, w.length + e.length, w.n + 1 FROM walk w JOIN passed p ON p.n = w.v JOIN e ON e.u = w.v AND e.v <> w.before)
SELECT u, v, round(length, 3) AS length, n AS n_points FROM walk WHERE v NOT IN (SELECT n FROM passed)""")
def q52b_simplified(spark: SparkSession, d: str) -> DataFrame:
    """Edges between junctions only."""
    edges = overpass.network_from_elements(table(spark, d, "overpass_elements"), simplify=True)[1]
    return edges.select("u", "v", F.round("length", 3).alias("length"), F.size("geometry").alias("n_points"))


def _streets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Junctions and streets as they were recorded, with reloaded rows, bad ends and missing lengths."""
    nodes = table(spark, d, "nodes").groupBy("osmid").agg(F.max("street_count").alias("street_count"))
    return nodes, table(spark, d, "edges").select("u", "v", "key", "length")


_STREETS = """ids AS MATERIALIZED (SELECT osmid, max(street_count) AS street_count FROM nodes WHERE osmid IS NOT NULL GROUP BY osmid),
near AS MATERIALIZED (SELECT a, b, min(w) AS w FROM (SELECT u AS a, v AS b, length AS w FROM edges UNION ALL SELECT v, u, length FROM edges) WHERE w IS NOT NULL AND NOT isnan(w) AND a IN (SELECT osmid FROM ids) AND b IN (SELECT osmid FROM ids) GROUP BY a, b)"""


@query(f"""WITH RECURSIVE {_STREETS}, d(node, dist) USING KEY (node) AS (SELECT osmid, 0e0 FROM ids WHERE street_count >= 5 UNION
  SELECT x.b, x.nd FROM (SELECT near.b, min(d.dist + near.w) AS nd FROM d JOIN near ON d.node = near.a GROUP BY 1) x LEFT JOIN recurring.d r ON r.node = x.b WHERE r.dist IS NULL OR x.nd < r.dist)
SELECT node AS osmid, round(dist, 4) AS dist FROM d""")
def q63_streets_to_hubs(spark: SparkSession, d: str) -> DataFrame:
    """Distance over the recorded streets to the nearest junction of five streets or more."""
    nodes, edges = _streets(spark, d)
    seeds = nodes.where("street_count >= 5").select(F.col("osmid").alias("seed_pos"), "osmid")
    return network.multi_source(nodes, edges, seeds, "length").select("osmid", F.round("dist", 4).alias("dist"))


@query(f"""WITH RECURSIVE {_STREETS}, d(seed, node, dist) USING KEY (seed, node) AS (SELECT osmid, osmid, 0e0 FROM ids WHERE street_count >= 5 UNION
  SELECT x.seed, x.b, x.nd FROM (SELECT d.seed, near.b, min(d.dist + near.w) AS nd FROM d JOIN near ON d.node = near.a WHERE d.dist + near.w <= 600 GROUP BY 1, 2) x
  LEFT JOIN recurring.d r ON r.seed = x.seed AND r.node = x.b WHERE r.dist IS NULL OR x.nd < r.dist)
SELECT node AS osmid, count(*) AS n FROM d GROUP BY node""")
def q64_hubs_within_reach(spark: SparkSession, d: str) -> DataFrame:
    """How many junctions of five streets or more lie within 600 m over the recorded streets."""
    nodes, edges = _streets(spark, d)
    seeds = nodes.where("street_count >= 5").select(F.col("osmid").alias("seed_pos"), "osmid")
    return network.counts_within(nodes, edges, seeds, "length", 600.0)


@query("SELECT edge_id, u, v, highway FROM edges WHERE highway IN ('trunk', 'trunk_link', 'motorway', 'motorway_link', 'primary', 'primary_link')")
def q65_main_streets(spark: SparkSession, d: str) -> DataFrame:
    return classify.main_streets(table(spark, d, "edges").select("edge_id", "u", "v", "highway"))
