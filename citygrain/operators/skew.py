"""Hot keys: finding them, salting joins around them, and broadcasts behind a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the rows from which a key counts as hot. At most 1 / HOT_SHARE keys can be hot, so the list is bounded.
HOT_SHARE = 0.02
#: Parts a hot key is split into.
SALTS = 16
#: Rows of the sample that hot keys are looked for in (on average). It only steers the salting, never a result.
SAMPLE_ROWS = 20_000


def hot_keys(df: DataFrame, key: str, rows: int | None = None, share: float = HOT_SHARE) -> list:
    """Keys that hold at least ``share`` of the rows, judged by a sample; at most ``1 / share`` values.

    ``rows`` is the number of rows if it is known (a Parquet count comes from metadata alone); otherwise they
    are counted. Null is never hot, since null keys are not joined.
    """
    total = df.count() if rows is None else rows
    if not total:
        return []
    sample = df.select(key).sample(min(1.0, SAMPLE_ROWS / total), seed=7).where(F.col(key).isNotNull())
    counts = sample.groupBy(key).count().orderBy(F.desc("count")).limit(int(1 / share)).collect()
    floor = max(share * min(total, SAMPLE_ROWS), 2)
    return [r[0] for r in counts if r["count"] >= floor]


def salted_join(left: DataFrame, right: DataFrame, on: list[str], hot_on: str, hot: list, spread: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join in which the rows of hot keys are spread over ``salts`` tasks.

    ``right`` must be the small side per key (one row or few); its rows of hot keys are repeated ``salts``
    times. ``spread`` is hashed to choose the part of a left row. Without hot keys it is a plain join.
    """
    if not hot:
        return left.join(right, on, how)
    is_hot = F.col(hot_on).isin(hot)
    left = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    right = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
