"""Gap filling on a hexagon grid and inverse-distance interpolation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrain.functions.convert import require
from citygrain.operators.grid import neighbours
from citygrain.session import durable

#: Observations up to which they are sent to every task (48 MB), so that nothing is repeated.
MOST_OBSERVATIONS = 2_000_000
#: Beyond it, rows of the two sides that one task weighs against each other.
BLOCK_TARGETS, BLOCK_OBSERVATIONS = 50_000, 500_000
#: Distances that a kernel holds at a time.
PAIRS = 4_000_000
METHODS = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "min": F.min, "max": F.max}


def fill_hexagons(cells: DataFrame, columns: list[str], max_iterations: int = 100, method: str = "mean", fill_isolated: bool = True, isolated_value: float | None = None) -> DataFrame:
    """``cells`` (q, r, values, ...) with missing values taken from the six cells around, sweep by sweep.

    All cells of a sweep see the values before it, so the order of rows does not matter. A cell without any neighbouring
    row gets ``isolated_value`` or the mean of the column. It ends when nothing is missing, nothing changes, or after
    ``max_iterations``. Each sweep is one self-join and is written to the checkpoint folder. Cells must be distinct.
    """
    require(cells, ["q", "r", *columns])
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; use one of {', '.join(METHODS)}")
    if isolated_value is not None and not isinstance(isolated_value, int | float):
        raise TypeError("the value for isolated cells must be a number")
    extra = [c for c in cells.columns if c not in {"q", "r", *columns}]
    known = cells.select("q", "r", *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    means = known.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    count = known.agg(*[F.count(c).alias(c) for c in columns], F.count("*").alias("_rows")).first().asDict()
    rows = count.pop("_rows")
    state, missing = known, sum(rows - n for n in count.values())
    for sweep in range(max_iterations):
        if not missing:
            break
        ring = state.select(F.explode(neighbours(F.col("q"), F.col("r"))).alias("n"), *columns).select("n.q", "n.r", *columns)
        around = ring.groupBy("q", "r").agg(*[METHODS[method](c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_has"))
        nearby = state.join(around, ["q", "r"], "left")
        alone = {c: F.when(F.col("_has").isNull(), F.lit(means[c] if isolated_value is None else float(isolated_value))) if fill_isolated and sweep == 0 else F.lit(None).cast("double") for c in columns}
        state = durable(nearby.select("q", "r", *[F.coalesce(F.col(c), F.col(f"_n_{c}"), alone[c]).alias(c) for c in columns]))
        left = sum(rows - n for n in state.agg(*[F.count(c).alias(c) for c in columns]).first())
        if left == missing:
            break
        missing = left
    return cells.select("q", "r", *extra).join(state, ["q", "r"]) if extra else state


def interpolate(
    targets: DataFrame, observations: DataFrame, target_id: str, power: float = 2.0, search_radius: float | None = None, scalar: bool = False,
    block_targets: int = BLOCK_TARGETS, block_observations: int = BLOCK_OBSERVATIONS, most_observations: int = MOST_OBSERVATIONS,
) -> DataFrame:
    """(target_id, interpolated_value): inverse-distance weighted mean of z of ``observations`` (x, y, z) at each target (x, y).

    The radius is inclusive, 0 means none. Without observations in reach the value is 0; an observation without a z
    keeps its weight. With ``scalar`` these are -1 and null. Up to ``most_observations`` are sent to every task, and only
    sums per target are shuffled. More meet the targets by grid cells if there is a radius (cells too full for a task are
    split by the adaptive join); without one each target needs all of them: blocks of targets meet blocks of
    observations, each pair once, and only sums leave a block. Rows without coordinates do not count.
    """
    t = targets.select(F.col(target_id).alias("_id"), F.col("x").cast("double").alias("_tx"), F.col("y").cast("double").alias("_ty"))
    o = observations.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.when(~F.isnan("z"), F.col("z").cast("double")).alias("z"))
    placed = t.where(F.col("_tx").isNotNull() & F.col("_ty").isNotNull())
    totals = [F.sum(c).alias(c) for c in ("_w", "_wz", "_n", "_nz")]
    if o.limit(most_observations + 1).count() <= most_observations:
        sums = _shared_sums(placed, o, power, search_radius or None).groupBy("_id").agg(*totals)
    elif search_radius:
        d = F.sqrt(F.pow(F.col("_tx") - F.col("x"), 2) + F.pow(F.col("_ty") - F.col("y"), 2))
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        cell = lambda c: F.floor(F.col(c) / search_radius)
        o = o.withColumn("_o", F.explode(around)).select("x", "y", "z", (cell("x") + F.col("_o.i")).alias("_cx"), (cell("y") + F.col("_o.j")).alias("_cy"))
        pairs = placed.withColumns({"_cx": cell("_tx"), "_cy": cell("_ty")}).join(o, ["_cx", "_cy"]).where(d <= search_radius)
        w = 1 / F.pow(d + 1e-12, F.lit(float(power)))
        sums = pairs.groupBy("_id").agg(F.sum(w).alias("_w"), F.sum(w * F.coalesce("z", F.lit(0.0))).alias("_wz"), F.count("*").alias("_n"), F.count("z").alias("_nz"))
    else:
        sums = _block_sums(placed, o, power, block_targets, block_observations).groupBy("_id").agg(*totals)
    value = F.col("_wz") / F.col("_w")
    if scalar:
        value = F.when(F.col("_n") == F.col("_nz"), value)
    out = t.select("_id").distinct().join(sums.where("_n > 0"), "_id", "left")
    return out.select(F.col("_id").alias(target_id), F.when(F.col("_n").isNull(), F.lit(-1.0 if scalar else 0.0)).otherwise(value).alias("interpolated_value"))


def _all_sums(tx: np.ndarray, ty: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, power: float) -> list[np.ndarray]:
    """Sums of weights and of weighted values, and numbers of observations and known values, over all observations."""
    known = np.nan_to_num(z, nan=0.0)
    w, wz = np.zeros(len(tx)), np.zeros(len(tx))
    step = max(1, PAIRS // max(1, len(x)))
    for k in range(0, len(tx), step):
        inverse = 1.0 / (np.sqrt((tx[k : k + step, None] - x) ** 2 + (ty[k : k + step, None] - y) ** 2) + 1e-12) ** power
        w[k : k + step], wz[k : k + step] = inverse.sum(1), inverse @ known
    return [w, wz, np.full(len(tx), len(x), np.int64), np.full(len(tx), int((~np.isnan(z)).sum()), np.int64)]


class _Cells:
    """Observations sorted by the cells of a grid as wide as the radius; near ones are three runs of this order."""

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, radius: float):
        self.radius, self.low = radius, (np.floor(x.min() / radius), np.floor(y.min() / radius)) if len(x) else (0.0, 0.0)
        cx, cy = self._cell(x, y)
        order = np.lexsort((cy, cx))
        self.x, self.y, self.z, self.cx, self.cy = x[order], y[order], z[order], cx[order], cy[order]
        self.column, self.first = np.unique(self.cx, return_index=True)
        self.first = np.append(self.first, len(x))
        # Rank of the column and the row within it as one number, so that a search is over one sorted array.
        self.key = np.searchsorted(self.column, self.cx) * (1 << 40) + self.cy.clip(0, (1 << 39) - 1)

    def _cell(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((np.floor(v / self.radius) - o).clip(-(1 << 39), (1 << 39) - 1).astype(np.int64) for v, o in ((x, self.low[0]), (y, self.low[1])))

    def runs(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, behind last) of the three runs per place."""
        cx, cy = self._cell(x, y)
        first, last = np.zeros((len(x), 3), np.int64), np.zeros((len(x), 3), np.int64)
        for k, step in enumerate((-1, 0, 1)):
            at = np.minimum(np.searchsorted(self.column, cx + step), max(len(self.column) - 1, 0))
            has = (self.column[at] == cx + step) if len(self.column) else np.zeros(len(x), bool)
            first[:, k] = np.where(has, np.searchsorted(self.key, at * (1 << 40) + (cy - 1).clip(0, (1 << 39) - 1)), 0)
            last[:, k] = np.where(has & (cy >= -1), np.searchsorted(self.key, at * (1 << 40) + (cy + 1).clip(0, (1 << 39) - 1), "right"), first[:, k])
        return first, last

    def sums(self, tx: np.ndarray, ty: np.ndarray, power: float) -> list[np.ndarray]:
        first, last = self.runs(tx, ty)
        many = (last - first).sum(1)
        out = [np.zeros(len(tx)), np.zeros(len(tx)), np.zeros(len(tx), np.int64), np.zeros(len(tx), np.int64)]
        part = np.cumsum(many) // PAIRS
        for k in np.unique(part):
            some = np.flatnonzero(part == k)
            size = (last - first)[some].ravel()
            who = np.repeat(np.repeat(some, 3), size)
            where = np.repeat(first[some].ravel(), size) + np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
            d = np.sqrt((tx[who] - self.x[where]) ** 2 + (ty[who] - self.y[where]) ** 2)
            near = d <= self.radius
            who, where, w, z = who[near], where[near], 1.0 / (d[near] + 1e-12) ** power, self.z[where[near]]
            for total, value in zip(out, (w, w * np.nan_to_num(z, nan=0.0), None, ~np.isnan(z)), strict=True):
                total += np.bincount(who, value, len(tx)).astype(total.dtype)
        return out


def _shared_sums(targets: DataFrame, observations: DataFrame, power: float, radius: float | None) -> DataFrame:
    table = observations.toPandas()
    shared = targets.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy(float) for c in "xyz"))
    kind = targets.schema["_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, z = shared.value
        cells = _Cells(x, y, z, radius) if radius is not None else None
        for batch in batches:
            tx, ty = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2))
            found = cells.sums(tx, ty, power) if cells is not None else _all_sums(tx, ty, x, y, z, power)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v) for v in found]], names=["_id", "_w", "_wz", "_n", "_nz"])

    return targets.mapInArrow(kernel, f"_id {kind}, _w double, _wz double, _n long, _nz long")


def _block_sums(targets: DataFrame, observations: DataFrame, power: float, block_targets: int, block_observations: int) -> DataFrame:
    nt, no = max(1, -(-targets.count() // block_targets)), max(1, -(-observations.count() // block_observations))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = targets.withColumn("_bt", F.pmod(F.xxhash64("_id"), F.lit(nt)).cast("int")).withColumn("_bo", every(no))
    right = observations.withColumn("_bo", F.pmod(F.xxhash64("x", "y"), F.lit(no)).cast("int")).withColumn("_bt", every(nt))
    kind = targets.schema["_id"].dataType.simpleString()

    def sums(own: pa.Table, seen: pa.Table) -> pa.Table:
        found = _all_sums(own.column("_tx").to_numpy(), own.column("_ty").to_numpy(), seen.column("x").to_numpy(), seen.column("y").to_numpy(), seen.column("z").to_numpy().astype(float), power)
        return pa.table({"_id": own.column("_id"), **dict(zip(("_w", "_wz", "_n", "_nz"), found, strict=True))})

    return left.groupBy("_bt", "_bo").cogroup(right.groupBy("_bt", "_bo")).applyInArrow(sums, f"_id {kind}, _w double, _wz double, _n long, _nz long")
