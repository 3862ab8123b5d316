"""Queries over scene catalogues, pixels, panels and event windows, with their SQL."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygrain.functions import geom
from citygrain.operators import raster
from citygrain.plans import views
from citygrain.plans.views import with_views
from citygrain.session import shared_folder
from citygrain.sources import files
from citygrain.sources.tables import table
from citygrain.streaming import events as streams

SATELLITE = "sentinel-2-l2a"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_MATRIX = f"{with_views('items')}, matrix AS (SELECT date, tile, CASE WHEN c <= 60 THEN c END AS cloud FROM (SELECT date, tile, arg_max(cloud, (datetime, id)) AS c FROM items GROUP BY date, tile))"


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return raster.cloud_matrix(views.items(spark, d), SATELLITE, 60.0)


@query(f"{_MATRIX} SELECT CAST(date AS VARCHAR) AS date, tile, cloud FROM matrix")
def q28_cloud_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).withColumn("date", F.col("date").cast("string"))


@query(f"{_MATRIX} SELECT CAST(date AS VARCHAR) AS date, round(avg(cloud), 6) AS avg_cloud, count(cloud) AS n_clear, count(cloud) = (SELECT count(DISTINCT tile) FROM matrix) AS complete FROM matrix GROUP BY date HAVING count(cloud) > 0")
def q28b_ranked_dates(spark: SparkSession, d: str) -> DataFrame:
    return raster.ranked_dates(_matrix(spark, d)).withColumns({"avg_cloud": F.round("avg_cloud", 6), "date": F.col("date").cast("string")})


@query(f"{_MATRIX}, m AS (SELECT date, avg(cloud) AS mean FROM matrix GROUP BY date) SELECT tile, CAST(arg_min(date, (cloud, mean, date)) AS VARCHAR) AS date, min(cloud) AS cloud FROM matrix JOIN m USING (date) WHERE cloud IS NOT NULL GROUP BY tile")
def q29_best_scene(spark: SparkSession, d: str) -> DataFrame:
    return raster.best_scene_per_tile(_matrix(spark, d)).withColumn("date", F.col("date").cast("string"))


@query(f"{with_views('items')} SELECT CAST(date AS VARCHAR) AS date, b AS band, array_to_string(list_sort(list(b || '-' || id)), ',') AS hrefs FROM items, (VALUES ('nir'), ('red')) AS v(b) WHERE date IN (SELECT date FROM items WHERE cloud < 1) GROUP BY date, b")
def q29b_band_links(spark: SparkSession, d: str) -> DataFrame:
    items = views.items(spark, d)
    clear = raster.search_items(items, "1990-01-01", "2030-01-01", properties={"eo:cloud_cover": {"lt": 1}})
    return raster.band_links(items, clear.select(F.to_date("datetime").alias("date")), ["nir", "red"]).select(F.col("date").cast("string").alias("date"), "band", F.array_join("hrefs", ",").alias("hrefs"))


@query(f"""{with_views('items')}, months AS (SELECT CAST(m AS DATE) AS m FROM range(TIMESTAMP '1994-06-01', TIMESTAMP '2003-01-01', INTERVAL 1 MONTH) AS r(m))
SELECT year(m) AS year, month(m) AS month, CAST(EXISTS (SELECT 1 FROM items i WHERE year(i.date) = year(m) AND month(i.date) = month(m) AND i.cloud < 2) AS INTEGER) AS data_id FROM months""")
def q30_inventory(spark: SparkSession, d: str) -> DataFrame:
    clear = raster.cloud_matrix(views.items(spark, d).where(F.col("properties")["s2:high_proba_clouds_percentage"].cast("double") < 2), SATELLITE)
    return raster.inventory(clear, "1994-06-01", "2002-12-31").drop("able_to_download")


@query(f"""{with_views('panel')}, w AS (SELECT feature, year, month, count(*) OVER s AS n, sum(CASE WHEN value > 0.05 THEN 1 ELSE 0 END) OVER s AS total FROM panel WINDOW s AS (PARTITION BY feature ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT feature, year, month, CASE WHEN n = 3 THEN CAST(total AS BIGINT) END AS window_sum FROM w""")
def q31_rolling_gate(spark: SparkSession, d: str) -> DataFrame:
    months = views.panel(spark, d).withColumn("data_id", (F.col("value") > 0.05).cast("int"))
    return raster.rolling_availability(months, 3, ["feature"]).select("feature", "year", "month", "window_sum")


@query("SELECT l_suppkey AS row, l_linenumber AS col, arg_min(l_quantity, (l_shipdate, l_orderkey)) AS value FROM lineitem WHERE l_quantity > 5 GROUP BY ALL")
def q32_mosaic_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col"), F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("value"), F.struct("l_shipdate", "l_orderkey").alias("source"))
    return raster.mosaic_first(rows, ["row", "col"], "source")


@query(f"""{with_views('pixels')} SELECT row, col, round((nir - red) / nullif(nir + red, 0), 9) AS "index" FROM pixels""")
def q33_band_index(spark: SparkSession, d: str) -> DataFrame:
    wide = views.pixels(spark, d)
    long = wide.select("row", "col", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("value")) for b in ("nir", "red")])).alias("e")).select("row", "col", "e.*")
    return raster.band_index(long, ["row", "col"], ["nir", "red"], "(nir-red)/(nir+red)").withColumn("index", F.round("index", 9))


@query(f"{with_views('pixels')} SELECT row // 2 AS row, col // 2 AS col, round(avg(nir), 6) AS nir FROM pixels GROUP BY ALL")
def q34_half_resolution(spark: SparkSession, d: str) -> DataFrame:
    return raster.half_resolution(views.pixels(spark, d), [], "nir").withColumn("nir", F.round("nir", 6))


@query(f"""{with_views('daily')}, n AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY day) AS i FROM daily),
w AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(value IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni, first_value(value IGNORE NULLS) OVER a AS nv FROM n
  WINDOW b AS (PARTITION BY feature ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY feature ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT feature, CAST(day AS VARCHAR) AS day, round(CASE WHEN value IS NOT NULL THEN value WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END, 6) AS filled,
CASE WHEN value IS NOT NULL THEN 0 WHEN pi IS NULL AND ni IS NULL THEN NULL WHEN pi IS NULL THEN 1 WHEN ni IS NULL THEN 2 ELSE 3 END AS interpolate FROM w""")
def q35_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    out = raster.fill_months(views.daily(spark, d), ["feature"], order=["day"])
    return out.select("feature", F.col("day").cast("string").alias("day"), F.round("filled", 6).alias("filled"), "interpolate")


_ZONES = "SELECT i AS zone_id, (i % 4) * 10e0 + 0.5 AS x0, (i // 4) * 8e0 + 0.5 AS y0 FROM (SELECT unnest(range((max(row) // 8 + 1) * 4)) AS i FROM pixels)"


def _zones(pixels: DataFrame, wide: float, tall: float) -> DataFrame:
    """Four zones for each eight rows of pixels, as far as the pixels go."""
    ids = pixels.agg(F.max("row").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), (F.floor(F.col("last") / 8) + 1) * 4 - 1)).alias("id"))
    x, y = (F.col("id") % 4) * 10 + 0.5, F.floor(F.col("id") / 4) * 8 + 0.5
    return ids.select(F.col("id").alias("zone_id"), geom.rectangle(x, -y - tall, x + wide, -y).alias("geometry"))


def _means(wide: int, tall: int) -> str:
    return f"""{with_views('pixels')}, zone AS ({_ZONES}) SELECT z.zone_id, round(coalesce(avg(p.nir), 0), 6) AS nir FROM zone z
LEFT JOIN pixels p ON p.col <= z.x0 + {wide} AND p.col + 1 >= z.x0 AND p.row <= z.y0 + {tall} AND p.row + 1 >= z.y0 GROUP BY z.zone_id"""


@query(_means(7, 5))
def q36_zonal_mean(spark: SparkSession, d: str) -> DataFrame:
    """Zones with gaps between them, over the whole extent of the pixels."""
    pixels = views.pixels(spark, d).select("row", "col", "nir")
    return raster.zonal_mean(pixels, _zones(pixels, 7, 5), "zone_id", (0.0, 1.0, 0.0, 1.0), value="nir").withColumn("nir", F.round("nir", 6))


@query(_means(9, 7))
def q36b_zonal_mean_all(spark: SparkSession, d: str) -> DataFrame:
    """Zones that meet each pixel at least once."""
    pixels = views.pixels(spark, d).select("row", "col", "nir")
    return raster.zonal_mean(pixels, _zones(pixels, 9, 7), "zone_id", (0.0, 1.0, 0.0, 1.0), value="nir").withColumn("nir", F.round("nir", 6))


@query(f"""{with_views('pixels')}, tri AS (SELECT i, i * 6e0 + 0.25 AS x0, y * 9e0 + 0.25 AS y0 FROM range(6) AS a(i), (SELECT unnest(range(max(row) // 9 + 1)) AS y FROM pixels)),
cell AS (SELECT t.*, p.row, p.col, p.nir FROM tri t JOIN pixels p ON p.col + 1 >= x0 AND p.col <= x0 + 5 AND p.row + 1 >= y0 AND p.row <= y0 + 8
  WHERE (greatest(p.col, x0) - x0) / 5 + (greatest(p.row, y0) - y0) / 8 <= 1)
SELECT t.i * 1000000 + CAST((t.y0 - 0.25) / 9 AS BIGINT) AS zone_id, round(coalesce(avg(c.nir), 0), 6) AS nir, count(c.nir) AS n FROM tri t LEFT JOIN cell c ON c.i = t.i AND c.y0 = t.y0 GROUP BY t.i, t.y0""")
def q36c_zonal_mean_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Right-angled triangles: a pixel of their box counts only if it touches the triangle."""
    pixels = views.pixels(spark, d).select("row", "col", "nir")
    ids = pixels.agg(F.max("row").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 9))).alias("y")).select("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("i"))
    x, y = F.col("i") * 6 + 0.25, F.col("y") * 9 + 0.25
    at = lambda a, b: F.struct(a.cast("double").alias("x"), (-b).cast("double").alias("y"))
    zones = ids.select((F.col("i") * 1_000_000 + F.col("y")).alias("zone_id"), F.array(F.array(at(x, y), at(x + 5, y), at(x, y + 8), at(x, y))).alias("geometry"))
    affine = (0.0, 1.0, 0.0, 1.0)
    n = pixels.join(raster.zone_cells(zones, "zone_id", affine), ["row", "col"]).groupBy("zone_id").agg(F.count("nir").alias("n"))
    return raster.zonal_mean(pixels, zones, "zone_id", affine, value="nir").join(n, "zone_id", "left").select("zone_id", F.round("nir", 6).alias("nir"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""{with_views('pixels')}, g AS (SELECT a.i AS gx, b.i AS gy FROM range(30) AS a(i), (SELECT unnest(range(CAST(floor(max(row) * 0.75e0) AS BIGINT) + 1)) AS i FROM pixels) b)
SELECT gx, gy, nir FROM g LEFT JOIN pixels ON row = floor((gy + 0.5e0) / 0.75e0) AND col = floor((gx + 0.5e0) * 1.375e0 - 0.25e0)""")
def q56_resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Values at the centres of a coarser grid with another origin."""
    pixels = views.pixels(spark, d).select("row", "col", "nir")
    rows = pixels.agg(F.max("row").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), (F.col("last") * 0.75).cast("long"))).alias("gy"))
    grid = rows.withColumn("gx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long")))).select("gx", "gy", ((F.col("gx") + 0.5) * 1.375 - 0.25).alias("x"), (-(F.col("gy") + 0.5) / 0.75).alias("y"))
    return raster.resample_nearest(pixels, (0.0, 1.0, 0.0, 1.0), grid).select("gx", "gy", "nir")


_YEARS = list(range(1995, 2002))


@query(f"""{with_views('panel')}, n AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY year, month) AS i FROM panel),
slope AS (SELECT a.feature, median((b.value - a.value) / (b.i - a.i)) AS tend FROM n a JOIN n b ON b.feature = a.feature AND b.i > a.i GROUP BY a.feature),
y AS (SELECT feature, year, max(value) AS hi, min(value) AS lo, avg(value) AS mean FROM panel GROUP BY ALL),
yy AS (SELECT feature, avg(hi) AS hi, avg(lo) AS lo, {', '.join(f'max(mean) FILTER (WHERE year = {y}) AS y{y}' for y in _YEARS)} FROM y GROUP BY feature),
t AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median FROM panel GROUP BY feature)
SELECT t.feature, round(t.mean, 9) + 0e0 AS v_mean, round(t.std, 9) + 0e0 AS v_std, round(t.median, 9) + 0e0 AS v_median, round(s.tend, 9) + 0e0 AS v_tend, round(yy.hi, 9) + 0e0 AS v_avg_yearly_max, round(yy.lo, 9) + 0e0 AS v_avg_yearly_min, round(yy.hi - yy.lo, 9) + 0e0 AS v_diff, {', '.join(f'round(y{y}, 9) + 0e0 AS v_{y}' for y in _YEARS)}
FROM t JOIN yy USING (feature) LEFT JOIN slope s USING (feature)""")
def q37_panel_summary(spark: SparkSession, d: str) -> DataFrame:
    out = raster.panel_summary(views.panel(spark, d), "feature", "v", _YEARS)
    return out.select("feature", *[(F.round(c, 9) + 0.0).alias(c) for c in out.columns if c != "feature"])


@query(f"""{with_views('panel')}, n AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY year, month) AS i FROM panel)
SELECT a.feature, round(median((b.value - a.value) / (b.i - a.i)), 9) + 0e0 AS slope FROM n a JOIN n b ON b.feature = a.feature AND b.i > a.i GROUP BY a.feature""")
def q39_sen_slope(spark: SparkSession, d: str) -> DataFrame:
    return raster.theil_sen(views.panel(spark, d), "feature", ["year", "month"], "value").where("slope is not null").withColumn("slope", F.round("slope", 9) + 0.0)


_NEAR = ", ".join(f"{f}_value(CASE WHEN value IS NOT NULL THEN {along} END IGNORE NULLS) OVER {w} AS p{k}, {f}_value(value IGNORE NULLS) OVER {w} AS v{k}" for k, (f, along, w) in enumerate((("last", "col", "l"), ("first", "col", "r"), ("last", "row", "u"), ("first", "row", "d"))))
_WEIGHTS = [f"coalesce(CASE WHEN abs(p{k} - {along}) <= 50 THEN 1e0 / abs(p{k} - {along}) END, 0)" for k, along in enumerate(("col", "col", "row", "row"))]


@query(f"""{with_views('pixels')}, holes AS (SELECT row, col, CASE WHEN red > 10 THEN CAST(nir AS FLOAT) END AS value FROM pixels), near AS (SELECT *, {_NEAR} FROM holes WINDOW
  l AS (PARTITION BY row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY row ORDER BY col ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
  u AS (PARTITION BY col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d AS (PARTITION BY col ORDER BY row ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
w AS (SELECT *, {', '.join(f'{x} AS w{k}' for k, x in enumerate(_WEIGHTS))} FROM near)
SELECT 1 AS scene, row, col, round(coalesce(CAST(value AS DOUBLE), ({' + '.join(f'w{k} * coalesce(v{k}, 0)' for k in range(4))}) / nullif({' + '.join(f'w{k}' for k in range(4))}, 0)), 3) AS value FROM w""")
def q53_nodata_fill(spark: SparkSession, d: str) -> DataFrame:
    holes = views.pixels(spark, d).select(F.lit(1).alias("scene"), "row", "col", F.when(F.col("red") > 10, F.col("nir")).alias("value"))
    return raster.fill_nodata(raster.clean_pixels(holes), ["scene"]).withColumn("value", F.round("value", 3))


_JOB = f"""{_MATRIX}, last AS (SELECT date, tile, max(id) AS id FROM items WHERE date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' GROUP BY date, tile),
m AS (SELECT x.date, x.tile, x.cloud, last.id, year(x.date) AS year, month(x.date) AS month FROM matrix x JOIN last ON last.date = x.date AND last.tile = x.tile),
mean AS (SELECT date, year, month, avg(cloud) AS mean, count(cloud) AS n FROM m GROUP BY ALL), tiles AS (SELECT count(DISTINCT tile) AS t FROM m),
best AS (SELECT year, month, arg_min(date, (mean, date)) AS date FROM mean, tiles WHERE n = t GROUP BY ALL),
pick AS (SELECT m.year, m.month, m.tile, m.id FROM m JOIN best b ON b.date = m.date UNION ALL
  SELECT year, month, tile, arg_min(id, (cloud, mean, date)) FROM (SELECT m.*, mean.mean FROM m JOIN mean USING (date)) WHERE cloud IS NOT NULL AND (year, month) NOT IN (SELECT (year, month) FROM best) GROUP BY ALL),
ok AS (SELECT year, month FROM pick, tiles GROUP BY ALL HAVING count(DISTINCT tile) = max(t)),
pixel AS (SELECT p.year, p.month, r AS row, CAST(right(tile, 1) AS INTEGER) * 2 + c AS col, CAST(CAST(100 + id % 89 + r - (1 + id % 41 + c) AS DOUBLE) / (100 + id % 89 + r + (1 + id % 41 + c)) AS FLOAT) AS value
  FROM pick p SEMI JOIN ok ON ok.year = p.year AND ok.month = p.month, range(2) AS a(r), range(2) AS b(c)),
months AS (SELECT year(CAST(m AS DATE)) AS year, month(CAST(m AS DATE)) AS month FROM range(TIMESTAMP '1993-01-01', TIMESTAMP '1998-01-01', INTERVAL 1 MONTH) AS r(m)),
every AS (SELECT g.year, g.month, c.row, c.col, CAST(p.value AS DOUBLE) AS value, row_number() OVER (PARTITION BY c.row, c.col ORDER BY g.year, g.month) AS i FROM months g, (SELECT DISTINCT row, col FROM pixel) c
  LEFT JOIN pixel p ON p.year = g.year AND p.month = g.month AND p.row = c.row AND p.col = c.col),
w AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(value IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni, first_value(value IGNORE NULLS) OVER a AS nv FROM every
  WINDOW b AS (PARTITION BY row, col ORDER BY year, month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY row, col ORDER BY year, month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT year, month, row, col, coalesce(value, CASE WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END) AS value FROM w)"""


@query(f"{_JOB} SELECT year, month, col // 5 AS zone_id, round(avg(value), 4) AS value FROM filled GROUP BY ALL")
def q58_raster_job(spark: SparkSession, d: str) -> DataFrame:
    """From a catalogue and scenes to the monthly panel of two zones: dates, fallback, null test, files, gap filling, zonal means."""
    items = views.items(spark, d)
    tile = F.col("properties")["s2:mgrs_tile"]
    last = items.groupBy(F.to_date("datetime").alias("date"), tile.alias("tile")).agg(F.max("id").alias("id"))
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)])).alias("p")
    nir, red = 100 + F.col("id") % 89 + F.col("p.r"), 1 + F.col("id") % 41 + F.col("p.c")
    bands = F.explode(F.array(F.struct(F.lit("nir").alias("band"), nir.cast("double").alias("value")), F.struct(F.lit("red").alias("band"), red.cast("double").alias("value")))).alias("b")
    col = (F.substring("tile", -1, 1).cast("int") * 2 + F.col("p.c")).alias("col")
    scenes = last.select("date", "tile", "id", cells).select("date", "tile", F.col("p.r").alias("row"), col, bands).select("date", "tile", "b.band", "row", "col", "b.value")
    job = raster.RasterJob("area", "index", date(1993, 1, 1), date(1997, 12, 31), ["nir", "red"], "(nir-red)/(nir+red)", max_cloud=60.0, missing_percent=101.0, missing_in_row=1000, retries=1)
    zones = spark.range(2).select(F.col("id").alias("zone_id"), geom.rectangle(F.col("id") * 5 + 0.25, F.lit(-1.75), F.col("id") * 5 + 4.75, F.lit(-0.25)).alias("geometry"))
    affine, folder = (0.0, 1.0, 0.0, 1.0), f"{shared_folder(spark)}/raster-{uuid.uuid4().hex}"
    months = raster.run_job(job, items, scenes, zones, affine, folder)
    panel = raster.zonal_mean(files.read_pixels(spark, f"{folder}/pixels"), zones, "zone_id", affine, ["year", "month"], months=months)
    return panel.select("year", "month", "zone_id", F.round("value", 4).alias("value"))


@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS starts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q54_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed_counts(table(spark, d, "events"), "6 hours").withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 2 HOUR AS ends, count(*) AS n FROM s GROUP BY user_id, run""")
def q55_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(spark, d, "events"), "2 hours")
