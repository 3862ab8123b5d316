"""Files in and out: inventories, pixel partitions, raster bytes, geometries as JSON or WKB, and a directory cleaner."""

from __future__ import annotations

import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INVENTORY = "year int, month int, data_id int, able_to_download double, download_method string, interpolate int"
GEOJSON = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INVENTORY).option("header", True).csv(path)


def write_inventory(df: DataFrame, path: str) -> None:
    """One row a month, replaced as a whole, so a job that stopped can go on from it."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def start_inventory(df: DataFrame, path: str) -> None:
    """Write the first inventory only where none is."""
    df.coalesce(1).write.mode("ignore").option("header", True).csv(path)


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Months are partitions; those in ``pixels`` are replaced, others stay."""
    pixels.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def read_pixels(spark: SparkSession, path: str, year: int | None = None, month: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if year is not None:
        df = df.where(F.col("year") == year)
    return df if month is None else df.where(F.col("month") == month)


def list_rasters(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """(path, length, modificationTime) of the raster files below a folder, without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, values by number) of the first directory of a classic TIFF."""
    order = "<" if data[:2] == b"II" else ">"
    if struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("only classic TIFF files are supported")
    at = struct.unpack(order + "I", data[4:8])[0]
    forms = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind in forms:
            form = order + forms[kind] * count
            size = struct.calcsize(form)
            where = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
            tags[tag] = struct.unpack(form, data[where : where + size])
    return order, tags


def _tiff(data: bytes) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """(band, row, col) values and (x origin, pixel width, y origin, pixel height) of a TIFF in strips or tiles, plain or deflated."""
    order, tags = _tags(data)
    packed = tags.get(259, (1,))[0]
    if packed not in (1, 8, 32946):
        raise ValueError(f"TIFF compression {packed} is not supported; only none and deflate are")
    bands, kind, predictor = tags.get(277, (1,))[0], tags.get(339, (1,))[0], tags.get(317, (1,))[0]
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{tags[258][0] // 8}")
    height, width = tags[257][0], tags[256][0]
    mixed = tags.get(284, (1,))[0] == 1
    tiled = 322 in tags
    tall, wide = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, (height,))[0], height), width)
    depth = bands if mixed else 1
    down, across = -(-height // tall), -(-width // wide)
    out = np.zeros((bands, down * tall, across * wide), dtype.newbyteorder("="))
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    for k, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, (i, j) = k // (down * across), divmod(k % (down * across), across)
        raw = data[at : at + size] if packed == 1 else zlib.decompress(data[at : at + size]) if size else b""
        rows = tall if tiled else min(tall, height - i * tall)
        if not raw:
            continue
        if predictor == 3:
            # Bytes of a row lie by significance, high ones first, each as the difference to the one before.
            lines = np.frombuffer(raw, np.uint8).reshape(rows, -1, depth)
            lines = np.cumsum(lines, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, wide * depth)
            block = np.ascontiguousarray(lines.transpose(0, 2, 1)).view(f">{dtype.kind}{dtype.itemsize}").reshape(rows, wide, depth)
        else:
            block = np.frombuffer(raw, dtype)[: rows * wide * depth].reshape(rows, wide, depth)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
        planes = slice(0, bands) if mixed else slice(plane, plane + 1)
        out[planes, i * tall : i * tall + rows, j * wide : (j + 1) * wide] = block.transpose(2, 0, 1)
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    return out[:, :height, :width], (tie[3] - tie[0] * scale[0], scale[0], tie[4] + tie[1] * scale[1], scale[1])


def tiff_bytes(planes: np.ndarray, affine: tuple[float, float, float, float], epsg: int | None = None, tile: int = 256) -> bytes:
    """A tiled, deflated float32 GeoTIFF of (band, row, col) values; ``affine`` as ``read_rasters`` has it."""
    bands, height, width = planes.shape
    down, across = -(-height // tile), -(-width // tile)
    whole = np.full((bands, down * tile, across * tile), np.nan, "<f4")
    whole[:, :height, :width] = planes
    blocks = [zlib.compress(whole[:, i * tile : (i + 1) * tile, j * tile : (j + 1) * tile].transpose(1, 2, 0).tobytes()) for i in range(down) for j in range(across)]
    x0, dx, y0, dy = affine
    tags = [(256, "I", (width,)), (257, "I", (height,)), (258, "H", (32,) * bands), (259, "H", (8,)), (262, "H", (1,)), (277, "H", (bands,)), (284, "H", (1,)), (322, "I", (tile,)), (323, "I", (tile,))]
    tags += [(324, "I", tuple(8 + n for n in np.cumsum([0, *map(len, blocks)])[:-1].tolist())), (325, "I", tuple(map(len, blocks))), (339, "H", (3,) * bands), (33550, "d", (dx, dy, 0.0)), (33922, "d", (0.0, 0.0, 0.0, x0, y0, 0.0))]
    if epsg is not None:
        # Keys: directory version, model type (projected 1, geographic 2), raster type area, code of the system.
        geographic = epsg in (4326, 4269, 4979, 6365)
        tags.append((34735, "H", (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg)))
    body = b"".join(blocks)
    at = 8 + len(body) + len(body) % 2
    entries, extra, free = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, form, values in tags:
        packed = struct.pack(f"<{len(values)}{form}", *values)
        kind = {"H": 3, "I": 4, "d": 12}[form]
        if len(packed) <= 4:
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind, len(values), free + len(extra))
            extra += packed
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra


def encode_rasters(pixels: DataFrame, keys: list[str], affine: tuple[float, float, float, float], value: str = "value", epsg: int | None = None) -> DataFrame:
    """(keys, content): one GeoTIFF per key of pixels (keys, row, col, value), from row and column 0 on; missing pixels are NaN.

    A raster is made by one task, so it must fit there (as for the readers of such files).
    """
    kinds = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def encode(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        plane = np.full((1, int(own["row"].max()) + 1, int(own["col"].max()) + 1), np.nan, np.float32)
        plane[0, own["row"].to_numpy(int), own["col"].to_numpy(int)] = own[value].to_numpy(float)
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "content": [tiff_bytes(plane, affine, epsg)]})

    return pixels.select(*keys, "row", "col", value).groupBy(*keys).applyInPandas(encode, f"{kinds}, content binary")


def save_rasters(rasters: DataFrame, keys: list[str], folder: str, prefix: str) -> int:
    """Write each raster of ``encode_rasters`` as ``{prefix}_{key}_{key}.tif`` into a folder that all executors share; the number written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path = Path(folder) / f"{'_'.join([prefix, *(str(row[k]) for k in keys)])}.tif"
                # Under another name first, so that a task that is run again never leaves half a file.
                part = path.with_suffix(f".{uuid.uuid4().hex}.part")
                part.write_bytes(row["content"])
                part.replace(path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    Path(folder).mkdir(parents=True, exist_ok=True)
    return rasters.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_rasters(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """(path, band, row, col, value, x, y): the pixels of (Geo)TIFF files in strips or tiles, plain or deflated, with their centres."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                planes, (x0, dx, y0, dy) = _tiff(content)
                for b, plane in enumerate(planes, 1):
                    row, col = np.indices(plane.shape)
                    row, col = row.ravel(), col.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(row)), pa.array(np.full(len(row), b, np.int32)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(plane.ravel().astype(np.float32)), pa.array(x0 + (col + 0.5) * dx), pa.array(y0 - (row + 0.5) * dy)], names=["path", "band", "row", "col", "value", "x", "y"])

    return files.mapInArrow(kernel, "path string, band int, row int, col int, value float, x double, y double")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry) of Polygon and MultiPolygon features, one collection a file; the rings of all parts in one list.

    By the even-odd rule the rings of parts that do not overlap are one polygon with holes. Other geometries have null.
    """
    raw = spark.read.option("multiLine", True).schema(GEOJSON).json(path)
    each = raw.select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    rings = F.when(F.col("kind") == "Polygon", F.from_json("c", "array<array<array<double>>>")).when(F.col("kind") == "MultiPolygon", F.flatten(F.from_json("c", "array<array<array<array<double>>>>")))
    return each.withColumn("r", rings).select("properties", F.transform("r", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("geometry"))


def point_wkb(x: Column, y: Column) -> Column:
    """A point as little-endian well-known binary, built from the bits of its coordinates."""

    @F.pandas_udf("binary")
    def encode(a: pd.Series, b: pd.Series) -> pd.Series:
        rows = np.zeros(len(a), np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")]))
        rows["order"], rows["kind"], rows["x"], rows["y"] = 1, 1, a.to_numpy(float), b.to_numpy(float)
        whole = rows.tobytes()
        known = ~(np.isnan(rows["x"]) | np.isnan(rows["y"]))
        return pd.Series([whole[i * 21 : i * 21 + 21] if k else None for i, k in enumerate(known.tolist())], dtype=object)

    return encode(x, y)


def clear_directory(path: str | Path) -> dict[str, int]:
    """Delete what a folder holds: {'files', 'directories', 'errors'}; links are unlinked, never followed. No folder: ValueError."""
    folder = Path(path)
    if not folder.exists() or not folder.is_dir():
        raise ValueError(f"{folder} is no directory")
    done = {"files": 0, "directories": 0, "errors": 0}
    for entry in folder.iterdir():
        try:
            if entry.is_dir() and not entry.is_symlink():
                shutil.rmtree(entry)
                done["directories"] += 1
            else:
                entry.unlink()
                done["files"] += 1
        except OSError:
            done["errors"] += 1
    return done
