"""Several values packed in one field, split into one value per row with its place.

The Arrow string buffer of the field is scanned as a whole: quote parity and condition masks tell which delimiters
separate, the separators give the offsets of the children, the children become a list array, and the lists are
flattened with the ordinals of their parents. No row is looked at by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrain.operators.buffers import code, codes, last_index, next_index, passes, slices, string_bytes

# What separates; words before and after a slash that make it part of a unit.
SEPARATORS = b";|\t\n"
UNIT_BEFORE = "km m mi mile miles milla millas meilen ft nm".split()
UNIT_AFTER = "h hr hrs hour hora heure s sec seg std min".split()
PAIRS = {ord("["): ord("]"), ord("("): ord(")"), ord("{"): ord("}")}
BLANKS = b" \t\r\n"
_ANY = r"""[;,|/\t\n'"\[({]"""


def _in(data: np.ndarray, values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table[data]


def split_lists(column: pa.Array) -> pa.ListArray:
    """List array of the values in each entry, an empty string for an empty place.

    ``; |`` tab and line end separate, as do a comma, a slash and blanks between quoted values, unless they stand
    within quotes or in the parentheses of a condition after ``@``. A comma between digits that a unit follows is
    a decimal comma; a slash between unit words separates nothing. Values come without surrounding blanks, quotes
    and brackets. Quotes without a partner are ordinary text. Null and empty entries give one empty value.
    """
    data, off = string_bytes(column)
    n, size = len(off) - 1, len(data)
    if not size:
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array([""] * n, pa.string()))
    row = np.repeat(np.arange(n), np.diff(off))
    first, last = off[:-1][row], off[1:][row] - 1
    at = np.arange(size)
    solid = ~_in(data, BLANKS)
    prev_solid = np.concatenate([[-1], last_index(solid)[:-1]])
    prev_solid = np.where(prev_solid >= first, prev_solid, -1)
    before = np.where(prev_solid >= 0, data[prev_solid], 0)

    def parity(quote: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.cumsum(quote)
        base = np.concatenate([[0], total])[off]
        odd = (np.diff(base) & 1).astype(bool)
        quote = quote & ~odd[row]
        total = np.cumsum(quote)
        base = np.concatenate([[0], total])[off[:-1]]
        return quote, ((total - base[row]) & 1).astype(bool)

    double, inside_double = parity(data == 34)
    single = (data == 39) & ~inside_double
    # Single quotes count as quotes only in entries where the first of them opens a value.
    opening = single & ((before == 0) | _in(before, b"[({;,|/"))
    total = np.concatenate([[0], np.cumsum(single)])[off]
    first_single = single & (np.cumsum(single) - total[:-1][row] == 1)
    quoting = np.zeros(n, bool)
    quoting[row[first_single & opening]] = True
    single, inside_single = parity(single & quoting[row])
    inside = inside_double | inside_single
    quote = double | single

    start_condition = (data == 40) & (before == 64) & ~inside
    opened, closed = last_index(start_condition), last_index((data == 41) & ~inside)
    condition = (opened >= first) & (opened > closed)
    free = ~inside & ~condition

    letter = _in(data | 32, bytes(range(97, 123)))
    digit = (data >= 48) & (data <= 57)
    next_solid, next_other, next_nondigit = next_index(solid), next_index(~letter), next_index(~digit)
    prev_other, prev_nondigit = last_index(~letter), last_index(~digit)
    separator = free & _in(data, SEPARATORS)

    comma = at[free & (data == 44)]
    inner = comma[(comma > first[comma]) & (comma < last[comma])]
    inner = inner[digit[inner - 1] & digit[inner + 1]]
    run_end = np.minimum(next_nondigit[inner + 1], last[inner] + 1)
    unit_at = np.minimum(next_solid[np.minimum(run_end, size - 1)], size - 1)
    has_unit = (run_end <= last[inner]) & (unit_at <= last[inner]) & letter[unit_at]
    run_start = prev_nondigit[inner - 1]
    plain = (run_start < first[inner]) | ~_in(data[np.maximum(run_start, 0)], b",.")
    decimal = inner[has_unit & plain]
    separator[comma] = True
    separator[decimal] = False

    slash = at[free & (data == 47)]
    if len(slash):
        left_end = prev_solid[slash]
        left_start = np.maximum(prev_other[np.maximum(left_end, 0)] + 1, first[slash])
        right = next_solid[np.minimum(slash + 1, size - 1)]
        right_end = np.minimum(next_other[np.minimum(right, size - 1)], last[slash] + 1)
        lower = data | 32
        a = codes(lower, left_start, np.where(left_end >= 0, left_end + 1, left_start))
        b = codes(lower, np.minimum(right, right_end), right_end)
        unit = np.isin(a, np.array([code(w) for w in UNIT_BEFORE])) & np.isin(b, np.array([code(w) for w in UNIT_AFTER]))
        separator[slash[~unit]] = True

    closing = quote & ~inside
    reopened = at[quote & inside & (prev_solid >= 0) & (prev_solid < at - 1)]
    reopened = reopened[closing[prev_solid[reopened]]]
    between = prev_solid[reopened] + 1
    between = between[~separator[between]]
    separator[between] = True

    lo, hi = off[:-1].copy(), off[1:].copy()
    _trim(lo, hi, solid)
    # A bracket around the whole entry: the depth falls to nothing only at its last byte.
    step = np.where(_in(data, b"[({") & ~inside, 1, np.where(_in(data, b"])}") & ~inside, -1, 0))
    depth = np.concatenate([[0], np.cumsum(step)])
    level = depth[1:] - depth[off[:-1]][row]
    flat = np.concatenate([[0], np.cumsum(level == 0)])
    whole = np.flatnonzero((hi - lo >= 2) & (flat[np.maximum(hi - 1, lo)] == flat[lo]))
    a, b = lo[whole], hi[whole]
    _unwrap(a, b, data, PAIRS, None)
    lo[whole], hi[whole] = a, b
    cut = at[separator]
    cut = cut[(cut >= lo[row[cut]]) & (cut < hi[row[cut]])]
    many = np.bincount(row[cut], minlength=n)
    child = np.zeros(n + 1, np.int64)
    np.cumsum(many + 1, out=child[1:])
    start, stop = np.empty(child[-1], np.int64), np.empty(child[-1], np.int64)
    rank = np.arange(len(cut)) - (np.cumsum(many) - many)[row[cut]]
    start[child[:-1]], stop[child[1:] - 1] = lo, hi
    start[child[row[cut]] + rank + 1], stop[child[row[cut]] + rank] = cut + 1, cut
    close_at = {c: np.flatnonzero(data == c) for c in PAIRS.values()}
    for _ in range(2):
        _trim(start, stop, solid)
        _unwrap(start, stop, data, {34: 34, 39: 39}, None)
        _trim(start, stop, solid)
        _unwrap(start, stop, data, PAIRS, close_at)
    _trim(start, stop, solid)
    return pa.ListArray.from_arrays(pa.array(child, pa.int32()), slices(data, start, np.maximum(stop, start)))


def _trim(start: np.ndarray, stop: np.ndarray, solid: np.ndarray) -> None:
    """Move the ends of the slices over blanks, in place."""
    after, before = np.append(next_index(solid), len(solid)), np.append(-1, last_index(solid))
    np.minimum(after[start], stop, out=start)
    np.maximum(before[stop] + 1, start, out=stop)


def _unwrap(start: np.ndarray, stop: np.ndarray, data: np.ndarray, pairs: dict[int, int], close_at: dict | None) -> None:
    """Take a matching pair off slices, in place; with ``close_at`` only if the first closer is the last byte."""
    has = np.flatnonzero(stop - start >= 2)
    for a, b in pairs.items():
        i = has[(data[start[has]] == a) & (data[stop[has] - 1] == b)]
        if close_at is not None and len(i):
            i = i[close_at[b][np.searchsorted(close_at[b], start[i])] == stop[i] - 1]
        start[i] += 1
        stop[i] -= 1
        has = np.setdiff1d(has, i, assume_unique=True)


def split_values(df: DataFrame, id_col: str, fields: list[str], min_values: int = 2) -> DataFrame:
    """(id, field_name, pos, item) for the fields of ``df`` with at least ``min_values`` values.

    ``pos`` counts places from 1, empty ones included; an empty place gives no row. A narrow scan of ``id_col`` and
    the fields, without a shuffle. Null and empty fields give no row, repeated rows give repeated results, texts of
    any length are taken whole, and other columns of ``df`` are not read.
    """
    packed = [F.when(F.col(f).cast("string").rlike(_ANY), F.col(f).cast("string")).alias(f) if min_values > 1 else F.col(f).cast("string").alias(f) for f in fields]
    narrow = df.select(F.col(id_col), *packed).where(F.coalesce(*[F.col(f) for f in fields]).isNotNull())
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for k, name in enumerate(fields, 1):
                column = batch.column(k)
                keep = column.is_valid()
                column, own = column.filter(keep), ids.filter(keep)
                for lo, hi in passes(column):
                    lists = split_lists(column.slice(lo, hi - lo))
                    offsets = lists.offsets.to_numpy()
                    items = lists.flatten()
                    parent = np.repeat(np.arange(hi - lo), np.diff(offsets))
                    pos = np.arange(len(items)) - offsets[:-1][parent] + 1
                    filled = pa.compute.binary_length(items).to_numpy(zero_copy_only=False) > 0
                    several = np.bincount(parent[filled], minlength=hi - lo) >= min_values
                    take = np.flatnonzero(filled & several[parent])
                    if len(take):
                        yield pa.RecordBatch.from_arrays(
                            [own.slice(lo, hi - lo).take(pa.array(parent[take])), pa.array([name] * len(take), pa.string()), pa.array(pos[take], pa.int32()), items.take(pa.array(take)).cast(pa.string())],
                            names=[id_col, "field_name", "pos", "item"],
                        )

    return narrow.mapInArrow(kernel, f"`{id_col}` {kind}, field_name string, pos int, item string")
