"""Raster time series as pixel tables: scene choice, mosaics, band algebra, gap filling, zonal statistics and trends."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citygrain.functions import geom
from citygrain.functions.convert import require
from citygrain.functions.scalar import band_expression, cloud_share, months_between, tile_key
from citygrain.session import durable
from citygrain.sources import files

# What stands for no data in a pixel.
NODATA = (0.0, -124.25)
#: Years that become columns if none are named; more raise.
MOST_YEARS = 1_000
SATELLITES = ("sentinel-2-l2a", "landsat-c2-l2")


class AvailableData(Exception):
    """Too few scenes to go on."""


class NanValues(Exception):
    """An area has no value."""


@dataclass
class RasterJob:
    """Settings of a monthly raster series; checked when made."""

    name: str
    index: str
    start: date
    end: date
    bands: list[str]
    equation: str
    satellite: str = "sentinel-2-l2a"
    epsg: int = 6372
    max_cloud: float | None = None
    missing_percent: float = 50.0
    missing_in_row: int = 6
    half_resolution: bool = False
    retries: int = 5
    properties: dict = field(default_factory=dict)

    def __post_init__(self):
        if not isinstance(self.name, str) or not self.name.strip() or not isinstance(self.index, str) or not self.index.strip():
            raise ValueError("the area and the index need names")
        if not isinstance(self.start, date) or not isinstance(self.end, date):
            raise TypeError("start and end must be dates")
        if self.start >= self.end:
            raise ValueError("the start must lie before the end")
        if self.satellite not in SATELLITES:
            raise ValueError(f"unknown satellite {self.satellite!r}")
        if not self.bands or not isinstance(self.bands, list):
            raise ValueError("bands must be a list of names")
        band_expression(self.equation, self.bands)


def area_of_interest(features: DataFrame, radius: float) -> DataFrame:
    """(geometry, minx, miny, maxx, maxy): the box around all features (minx..maxy columns), widened by ``radius``."""
    box = features.agg((F.min("minx") - radius).alias("minx"), (F.min("miny") - radius).alias("miny"), (F.max("maxx") + radius).alias("maxx"), (F.max("maxy") + radius).alias("maxy"))
    return box.withColumn("geometry", geom.rectangle(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))


def search_items(items: DataFrame, start: date | str, end: date | str, box: tuple[float, float, float, float] | None = None, properties: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Catalogue items of a time range that overlap a box and meet property limits such as {"eo:cloud_cover": {"lt": 15}}."""
    out = items.where(F.to_date("datetime").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    if box is not None:
        out = out.where((F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1]))
    tests = {"lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "eq": lambda c, v: c == v}
    for name, limits in (properties or {}).items():
        for test, value in limits.items():
            out = out.where(tests[test](F.col("properties")[name].try_cast("double"), value))
    return out


def asset_of_band(assets, band: str):
    """Link of the asset with a common band name; an item without it raises when run."""
    found = F.filter(assets, lambda a: a["common_name"] == band)
    return F.when(F.size(found) > 0, found[0]["href"]).otherwise(F.raise_error(F.lit(f"no asset with band {band}")).cast("string"))


def cloud_matrix(items: DataFrame, satellite: str, max_cloud: float | None = None) -> DataFrame:
    """(date, tile, cloud): the share of clouds of the last item per date and tile, null above the limit."""
    rows = items.select(F.to_date("datetime").alias("date"), tile_key(F.col("properties"), satellite).alias("tile"), cloud_share(F.col("properties"), satellite).alias("cloud"), F.struct("datetime", "id").alias("_at"))
    last = rows.groupBy("date", "tile").agg(F.max_by("cloud", "_at").alias("cloud"))
    return last if max_cloud is None else last.withColumn("cloud", F.when(F.col("cloud") <= max_cloud, F.col("cloud")))


def ranked_dates(matrix: DataFrame) -> DataFrame:
    """(date, avg_cloud, n_clear, complete): dates with any clear tile; order by avg_cloud, nulls last, to rank them."""
    tiles = matrix.agg(F.countDistinct("tile")).scalar()
    by_date = matrix.groupBy("date").agg(F.avg("cloud").alias("avg_cloud"), F.count("cloud").alias("n_clear"))
    return by_date.where("n_clear > 0").select("date", "avg_cloud", "n_clear", (F.col("n_clear") == tiles).alias("complete"))


def best_scene_per_tile(matrix: DataFrame) -> DataFrame:
    """(tile, date, cloud) of the least clouded date per tile; ties go to the date of less average cloud, then the earlier."""
    mean = matrix.groupBy("date").agg(F.avg("cloud").alias("avg_cloud"))
    rows = matrix.where(F.col("cloud").isNotNull()).join(mean, "date")
    return rows.groupBy("tile").agg(F.min(F.struct("cloud", "avg_cloud", "date")).alias("m")).select("tile", "m.date", "m.cloud")


def band_links(items: DataFrame, dates: DataFrame, bands: list[str]) -> DataFrame:
    """(date, band, hrefs) of the items on the chosen dates."""
    chosen = items.withColumn("date", F.to_date("datetime")).join(dates.select("date").distinct(), "date", "left_semi")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), asset_of_band(F.col("assets"), b).alias("href")) for b in bands]))
    return chosen.select("date", each.alias("e")).groupBy("date", "e.band").agg(F.array_sort(F.collect_list("e.href")).alias("hrefs"))


def inventory(dates: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """(year, month, data_id, able_to_download): every month that begins within start and end, and whether scenes exist."""
    have = dates.select(F.year("date").alias("year"), F.month("date").alias("month")).distinct().withColumn("_has", F.lit(1))
    months = months_between(dates.sparkSession, start, end).select("year", "month")
    return months.join(have, ["year", "month"], "left").select("year", "month", F.coalesce("_has", F.lit(0)).alias("data_id"), F.lit(None).cast("double").alias("able_to_download"))


def rolling_availability(months: DataFrame, n: int, keys: list[str] | None = None, value: str = "data_id") -> DataFrame:
    """Adds window_sum over ``n`` months, null where fewer came before. One row a month, so one series stays small."""
    span = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("year", "month").rowsBetween(1 - n, 0)
    return months.withColumn("window_sum", F.when(F.count("*").over(span) == n, F.sum(value).over(span)))


def check_availability(months: DataFrame, missing_percent: float = 50.0, missing_in_row: int = 6) -> None:
    """Raises AvailableData if too many months lack data, or ``missing_in_row`` of them follow each other."""
    total, missing = months.agg(F.count("*"), F.count_if(F.col("data_id") == 0)).first()
    if total and round(missing / total, 2) * 100 >= missing_percent:
        raise AvailableData(f"{missing} of {total} months lack data")
    if rolling_availability(months, missing_in_row).where("window_sum = 0").limit(1).count():
        raise AvailableData(f"{missing_in_row} months in a row lack data")


def clean_pixels(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Null for no-data values, infinities and NaN; the rest as float."""
    c = F.col(value).cast("float")
    return pixels.withColumn(value, F.when(~F.isnan(c) & (F.abs(c) != float("inf")) & ~c.isin(*NODATA), c))


def mosaic_first(pixels: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """The value of the first source with data per pixel: one aggregate, no sort of the sources."""
    return pixels.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def crop(pixels: DataFrame, box: tuple[float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    return pixels.where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))


def half_resolution(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Means of two by two pixels (row, col), known ones only."""
    return pixels.groupBy(*keys, F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.avg(value).alias(value))


def resample_nearest(pixels: DataFrame, affine: tuple[float, float, float, float], grid: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Values at the centres (x, y) of another grid: ``affine`` is (x origin, pixel width, y origin, pixel height) of the pixels."""
    x0, dx, y0, dy = affine
    at = grid.withColumns({"row": F.floor((F.lit(y0) - F.col(y)) / dy), "col": F.floor((F.col(x) - x0) / dx)})
    return at.join(pixels, ["row", "col"], "left").drop("row", "col")


def band_index(pixels: DataFrame, keys: list[str], bands: list[str], equation: str, band: str = "band", value: str = "value") -> DataFrame:
    """(keys, index): the equation over the bands of each pixel; bands are brought side by side with a fixed list."""
    wide = pixels.groupBy(*keys).pivot(band, bands).agg(F.first(value, ignorenulls=True))
    return wide.select(*keys, band_expression(equation, bands).alias("index"))


def fill_nodata(pixels: DataFrame, keys: list[str], max_distance: int = 50, value: str = "value") -> DataFrame:
    """Missing pixels as the inverse-distance mean of the nearest known ones left, right, above and below, within reach."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).alias("v")))
    out, names = pixels.withColumn("_k", known), []
    for name, line, along in (("h", "row", "col"), ("v", "col", "row")):
        back = Window.partitionBy(*keys, line).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        ahead = Window.partitionBy(*keys, line).orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"_{name}0", F.last("_k", True).over(back)).withColumn(f"_{name}1", F.last("_k", True).over(ahead))
        names += [f"_{name}0", f"_{name}1"]
    far = lambda n: F.abs(F.col(f"{n}.r") - F.col("row")) + F.abs(F.col(f"{n}.c") - F.col("col"))
    weight = {n: F.when(far(n) <= max_distance, 1.0 / far(n)) for n in names}
    add = lambda terms: reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0.0)) for t in terms])
    filled = F.try_divide(add([weight[n] * F.col(f"{n}.v") for n in names]), add(weight.values()))
    return out.withColumn(value, F.coalesce(F.col(value).cast("double"), filled)).drop("_k", *names)


def fill_months(series: DataFrame, keys: list[str], value: str = "value", order: list[str] | None = None) -> DataFrame:
    """Adds ``filled`` and ``interpolate``: leading gaps take the next value (1), trailing ones the last (2), inner ones a line (3).

    The line goes by place in the series. 0 marks values that were there; a series without any value stays null.
    """
    order = order or ["year", "month"]
    rank = Window.partitionBy(*keys).orderBy(*order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    rows = series.withColumn("_i", F.row_number().over(rank)).withColumn("_k", known)
    rows = rows.withColumn("_p", F.last("_k", True).over(rank.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first("_k", True).over(rank.rowsBetween(0, Window.unboundedFollowing)))
    p, n = F.col("_p"), F.col("_n")
    line = p["v"] + (n["v"] - p["v"]) * (F.col("_i") - p["i"]) / (n["i"] - p["i"])
    gap = F.col(value).isNull()
    filled = F.when(~gap, F.col(value)).when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).otherwise(line)
    case = F.when(~gap, 0).when(p.isNull() & n.isNull(), F.lit(None)).when(p.isNull(), 1).when(n.isNull(), 2).otherwise(3)
    return rows.withColumns({"filled": filled, "interpolate": case}).drop("_i", "_k", "_p", "_n")


def zonal_mean(pixels: DataFrame, zones: DataFrame, zone_id: str, affine: tuple[float, float, float, float], keys: list[str] | None = None, value: str = "value", outside: float | None = 0.0, months: DataFrame | None = None) -> DataFrame:
    """(keys, zone_id, value): mean of the pixels each zone touches; a zone that meets no pixel has ``outside``.

    ``affine`` is (x origin, pixel width, y origin, pixel height). A pixel counts if the zone overlaps or touches its
    square. Zones are repeated for the pixels of their bounds and joined by (row, col). ``months`` has the ``keys`` if they
    are known, else they are looked up in the pixels.
    """
    keys = keys or []
    cells = zone_cells(zones, zone_id, affine)
    joined = pixels.withColumns({"row": F.col("row").cast("long"), "col": F.col("col").cast("long")}).join(cells, ["row", "col"])
    found = joined.groupBy(*keys, zone_id).agg(F.avg(value).alias(value), F.lit(True).alias("_met"))
    every = zones.select(zone_id).distinct()
    if keys:
        # Every zone gets every month; the list of months is one small array. An inventory has it without a scan of the pixels.
        have = (pixels if months is None else months).select(*keys).distinct()
        every = every.withColumn("_k", F.explode(have.agg(F.collect_list(F.struct(*keys))).scalar())).select(zone_id, "_k.*")
    out = every.join(found, [*keys, zone_id], "left")
    return out.select(*keys, zone_id, F.when(F.col("_met").isNull(), F.lit(outside).cast("double")).otherwise(F.col(value)).alias(value))


def zone_cells(zones: DataFrame, zone_id: str, affine: tuple[float, float, float, float]) -> DataFrame:
    """(zone_id, row, col): the pixels that each zone overlaps or touches."""
    x0, dx, y0, dy = affine
    shapes = zones.where(F.size("geometry") > 0).select(zone_id, F.col("geometry").alias("_shape"))
    shapes = shapes.withColumns({f"_{k}": v for k, v in geom.bounds(F.col("_shape")).items()})
    cols = F.sequence(F.floor((F.col("_minx") - x0) / dx), F.floor((F.col("_maxx") - x0) / dx))
    rows = F.sequence(F.floor((F.lit(y0) - F.col("_maxy")) / dy), F.floor((F.lit(y0) - F.col("_miny")) / dy))
    cells = shapes.withColumn("col", F.explode(cols)).withColumn("row", F.explode(rows))
    left, top = F.col("col") * dx + x0, F.lit(y0) - F.col("row") * dy
    return cells.where(_touches(F.col("_shape"), left, top - dy, left + dx, top)).select(zone_id, "row", "col")


def _touches(shape, x0, y0, x1, y1):
    """Does a polygon meet a box: a corner of one in the other, or edges that cross."""
    corners = [geom.position(a, b, shape) >= 0 for a, b in ((x0, y0), (x0, y1), (x1, y0), (x1, y1))]
    ends = F.exists(geom.points_of(shape), lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))

    def crosses(s):
        a, b = s["a"], s["b"]
        side = lambda x, y: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        values = [side(x, y) for x, y in ((x0, y0), (x0, y1), (x1, y0), (x1, y1))]
        apart = (F.greatest(a["x"], b["x"]) < x0) | (F.least(a["x"], b["x"]) > x1) | (F.greatest(a["y"], b["y"]) < y0) | (F.least(a["y"], b["y"]) > y1)
        return ~apart & (F.least(*values) <= 0) & (F.greatest(*values) >= 0)

    segments = F.flatten(F.transform(shape, geom._segments))
    return reduce(lambda a, b: a | b, corners) | ends | F.exists(segments, crosses)


def monthly_index(scenes: DataFrame, matrix: DataFrame, bands: list[str], equation: str, max_distance: int = 50, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(year, month, row, col, value): one index raster a month from scene pixels (date, tile, band, row, col, value).

    Each tile takes its least clouded date of the month (the dates that a search would try first), tiles are laid over
    each other in the order of their names, bands are brought side by side, and gaps are filled from near pixels. All
    months are one plan; months without a clear scene are missing, to be filled by ``fill_months``.
    """
    months = matrix.withColumns({"year": F.year("date"), "month": F.month("date")})
    mean = matrix.groupBy("date").agg(F.avg("cloud").alias("_mean"))
    best = months.where(F.col("cloud").isNotNull()).join(mean, "date").groupBy("year", "month", "tile").agg(F.min(F.struct("cloud", "_mean", "date")).alias("m")).select("year", "month", "tile", "m.date")
    chosen = clean_pixels(scenes).join(best, ["date", "tile"])
    if box is not None:
        chosen = crop(chosen, box)
    keys = ["year", "month", "row", "col"]
    mosaic = mosaic_first(chosen, [*keys, "band"], "tile")
    return fill_nodata(clean_pixels(band_index(mosaic, keys, bands, equation), "index").withColumnRenamed("index", "value"), ["year", "month"], max_distance)


def months_to_do(months: DataFrame, done: DataFrame | None) -> DataFrame:
    """The months of an inventory that have scenes and are not written yet, so that a stopped job can go on."""
    todo = months.where("data_id = 1")
    return todo if done is None else todo.join(done.select("year", "month").distinct(), ["year", "month"], "left_anti")


def null_test(zonal: DataFrame, value: str = "value") -> None:
    """Raises NanValues if a zone has no value."""
    if zonal.where(F.col(value).isNull()).limit(1).count():
        raise NanValues("a zone has no value")


def theil_sen(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, slope): median of the slopes of all pairs of a series, by place in its order; null values are left out.

    A series is one array per key (a few values a year); the pairs are taken within it, so nothing is joined.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v")))).alias("_s"))
    kind = df.schema[key].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slopes = []
            for series in batch.column(1):
                v = np.asarray(series.values, float)
                i, j = np.triu_indices(len(v), 1)
                slopes.append(float(np.median((v[j] - v[i]) / (j - i))) if len(v) > 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slopes, pa.float64())], names=[key, "slope"])

    return rows.select(key, F.transform("_s", lambda s: s["_v"]).alias("_v")).mapInArrow(kernel, f"`{key}` {kind}, slope double")


def panel_summary(panel: DataFrame, key: str, index: str, years: list[int] | None = None, value: str = "value") -> DataFrame:
    """One row per feature of a (feature, year, month, value) panel: mean, std, median, trend, yearly extremes, yearly means.

    Columns ``{index}_mean, _std, _median, _tend, _avg_yearly_max, _avg_yearly_min, _diff`` and ``{index}_{year}``. The
    yearly aggregates come from one pass per feature and year; without ``years`` they are looked up first.
    """
    require(panel, [key, "year", "month", value])
    if years is None:
        years = [r[0] for r in panel.select("year").distinct().orderBy("year").limit(MOST_YEARS + 1).collect()]
        if len(years) > MOST_YEARS:
            raise ValueError(f"more than {MOST_YEARS} years; name those that should be columns")
    by_year = panel.groupBy(key, "year").agg(F.max(value).alias("_max"), F.min(value).alias("_min"), F.avg(value).alias("_avg"))
    yearly = by_year.groupBy(key).agg(F.avg("_max").alias(f"{index}_avg_yearly_max"), F.avg("_min").alias(f"{index}_avg_yearly_min"), *[F.max(F.when(F.col("year") == y, F.col("_avg"))).alias(f"{index}_{y}") for y in years])
    total = panel.groupBy(key).agg(F.avg(value).alias(f"{index}_mean"), F.stddev_samp(value).alias(f"{index}_std"), F.percentile(value, 0.5).alias(f"{index}_median"))
    trend = theil_sen(panel, key, ["year", "month"], value).withColumnRenamed("slope", f"{index}_tend")
    out = total.join(trend, key, "left").join(yearly, key)
    return out.withColumn(f"{index}_diff", F.col(f"{index}_avg_yearly_max") - F.col(f"{index}_avg_yearly_min"))


def raster_summary(pixels: DataFrame, zones: DataFrame, zone_id: str, affine: tuple[float, float, float, float], index: str, years: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary per zone, long panel) of monthly pixels (year, month, row, col, value)."""
    panel = zonal_mean(pixels, zones, zone_id, affine, ["year", "month"])
    return panel_summary(panel, zone_id, index, years), panel


def run_job(job: RasterJob, items: DataFrame, scenes: DataFrame, area: DataFrame, affine: tuple[float, float, float, float], folder: str) -> DataFrame:
    """The monthly rasters of a job, written to ``folder``/pixels by month; returns the inventory, also kept in ``folder``/inventory.

    ``items`` is the catalogue, ``scenes`` the pixels (date, tile, band, row, col, value), ``area`` polygons in ``geometry`` whose
    pixels must all have a value (the null test). A month is tried on its least clouded dates that have all tiles, up to
    ``retries`` of them, then with the best date of each tile; all open months go through an attempt in one plan. What is
    written stays: a job that is started again goes on with the months not yet tried. Months without scenes, and those that
    failed, are then filled from the months around, with the case in ``interpolate``. Too few scenes: AvailableData.
    """
    spark = items.sparkSession
    found = search_items(items, job.start, job.end, properties=job.properties or None)
    if found.isEmpty():
        raise AvailableData("no scenes")
    matrix = durable(cloud_matrix(found, job.satellite, job.max_cloud))
    dated = matrix.withColumns({"year": F.year("date"), "month": F.month("date")})
    ranked = ranked_dates(matrix)
    months = inventory(ranked, job.start, job.end)
    check_availability(months, job.missing_percent, job.missing_in_row)
    book, store = f"{folder}/inventory", f"{folder}/pixels"
    files.start_inventory(months.withColumns({"download_method": F.lit("none"), "interpolate": F.lit(0)}), book)
    # One row a month of the job's period.
    state = {(r["year"], r["month"]): r.asDict() for r in files.read_inventory(spark, book).collect()}
    cells = durable(zone_cells(area.select(F.lit(1).alias("_zone"), "geometry"), "_zone", affine).select("row", "col").distinct())
    wanted = cells.count()
    order = Window.partitionBy("year", "month").orderBy("avg_cloud", "date")
    complete = ranked.where("complete").withColumns({"year": F.year("date"), "month": F.month("date")}).withColumn("_at", F.row_number().over(order) - 1).where(F.col("_at") < job.retries)
    dates = {(r["year"], r["month"], r["_at"]): r["date"] for r in complete.collect()}
    months_kind = "year int, month int, date date"

    def book_it() -> None:
        rows = [tuple(r[c] for c in ("year", "month", "data_id", "able_to_download", "download_method", "interpolate")) for _, r in sorted(state.items())]
        files.write_inventory(spark.createDataFrame(rows, files.INVENTORY), book)

    for attempt in range(job.retries + 1):
        open_ = [k for k, r in state.items() if r["data_id"] == 1 and r["able_to_download"] is None]
        tried = [(*k, dates.get((*k, attempt))) for k in open_ if attempt == job.retries or (*k, attempt) in dates]
        if tried:
            chosen = F.broadcast(spark.createDataFrame(tried, months_kind).withColumnRenamed("date", "_date"))
            own = dated.join(chosen, ["year", "month"]).where(F.col("_date").isNull() | (F.col("_date") == F.col("date"))).select(*matrix.columns)
            pixels = durable(monthly_index(scenes, own, job.bands, job.equation))
            known = pixels.where(F.col("value").isNotNull()).join(cells, ["row", "col"], "left_semi").groupBy("year", "month").agg(F.count("*").alias("n"))
            passed = [(r["year"], r["month"]) for r in known.where(F.col("n") == wanted).collect()]
            if passed:
                good = F.broadcast(spark.createDataFrame(passed, "year int, month int"))
                files.write_pixels(pixels.join(good, ["year", "month"], "left_semi"), store)
            for k in passed:
                state[k] |= {"able_to_download": 1.0, "download_method": "full_tile" if attempt == job.retries else "specific_date"}
            book_it()
    for r in state.values():
        if r["data_id"] == 1 and r["able_to_download"] is None:
            r |= {"data_id": 0, "able_to_download": 0.0}
    if all(r["data_id"] == 0 for r in state.values()):
        raise AvailableData("no month passed the null test")
    gaps = [k for k, r in sorted(state.items()) if r["data_id"] == 0]
    if gaps:
        cases = fill_months(spark.createDataFrame([(1, *k, 1.0 if r["data_id"] else None) for k, r in state.items()], "one int, year int, month int, value double"), ["one"])
        for r in cases.collect():
            state[r["year"], r["month"]]["interpolate"] = r["interpolate"]
        had = files.read_pixels(spark, store).select("year", "month", "row", "col", "value").join(F.broadcast(spark.createDataFrame([k for k in state if k not in gaps], "year int, month int")), ["year", "month"], "left_semi")
        empty = had.select("row", "col").distinct().select(F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.lit(m).alias("month")) for y, m in gaps])).alias("k"), "row", "col").select("k.year", "k.month", "row", "col", F.lit(None).cast("double").alias("value"))
        filled = fill_months(had.unionByName(empty), ["row", "col"]).where(F.col("interpolate") != 0).select("year", "month", "row", "col", F.col("filled").alias("value"))
        files.write_pixels(durable(filled.join(F.broadcast(spark.createDataFrame(gaps, "year int, month int")), ["year", "month"], "left_semi")), store)
    book_it()
    return files.read_inventory(spark, book)
