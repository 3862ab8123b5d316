"""Casts and column handling with eager checks and lazy results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"string": "string", "integer": "int", "float": "double", "boolean": "boolean", "datetime": "timestamp"}


def convert_column_types(df: DataFrame, types: dict[str, list[str]], truthy: bool = True) -> DataFrame:
    """Cast columns by type name: string, integer, float, boolean, datetime; a value that does not fit raises.

    With ``truthy`` a text is true unless it is empty (and null is true), as objects are in Python; otherwise it is
    parsed. Null stays null in all other types. Unknown types, no list or an empty table: ValueError; unknown column: KeyError.
    """
    if df is None or not isinstance(types, dict):
        raise ValueError("a table and a dict of type names to column lists are needed")
    for kind, columns in types.items():
        if kind not in TYPES:
            raise ValueError(f"unknown type {kind!r}; use one of {', '.join(TYPES)}")
        if not isinstance(columns, list):
            raise ValueError(f"columns of type {kind!r} must be a list")
        if missing := [c for c in columns if c not in df.columns]:
            raise KeyError(f"no such columns: {missing}")
    if df.isEmpty():
        raise ValueError("the table is empty")
    out = {}
    for kind, columns in types.items():
        for c in columns:
            if kind == "boolean" and truthy:
                text = isinstance(df.schema[c].dataType, T.StringType)
                out[c] = F.coalesce(F.col(c) != "" if text else F.col(c).cast("double") != 0, F.lit(True))
            else:
                out[c] = F.col(c).cast(TYPES[kind])
    return df.withColumns(out)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast to double; what is no number, and NaN, becomes null."""
    number = {c: F.col(c).cast("string").try_cast("double") for c in columns}
    return df.withColumns({c: F.when(~F.isnan(v), v) for c, v in number.items()})


def rename_all(df: DataFrame, change, keep: tuple[str, ...] = ("geometry",)) -> DataFrame:
    """Rename every column by a function (such as str.upper) but those to keep."""
    return df.toDF(*[c if c in keep else change(c) for c in df.columns])


def slice_columns(df: DataFrame, start: int = 0, end: int = -1) -> list[str]:
    """Names of the columns from ``start`` to before ``end``; -1 is the end of the table. Out of range: ValueError."""
    count = len(df.columns)
    stop = count if end == -1 else end
    if not 0 <= start < count or not start < stop <= count:
        raise ValueError(f"column range {start}:{end} does not fit {count} columns")
    return df.columns[start:stop]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def pad_schema(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Project to the required columns, a missing one being null of its type."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in required.items()])


def lists_to_text(df: DataFrame) -> DataFrame:
    """Array columns become JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields])


def zero_to(c: Column, value: float | None) -> Column:
    return c if value is None else F.when(c == 0, F.lit(value)).otherwise(c)


def finite(c: Column) -> Column:
    """Null for infinities and NaN."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def known_values(columns: list[str]) -> Column:
    """How many of the columns have a value."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def require(df: DataFrame, columns: list[str], error: type[Exception] = ValueError) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise error(f"missing columns: {missing}")
