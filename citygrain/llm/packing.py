"""Texts packed into containers of fixed capacity, every window filled to target token proportions per source.

Deficit round-robin: each source is a queue that earns its share of a window's tokens; what it does not spend is
carried to the next window, and from one partition to the next. A window's texts are packed best-fit, largest first.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citygrain.session import durable

#: Tokens that one task packs (for one capacity), and containers' worth of tokens in a window.
PART_TOKENS = 16_000_000
WINDOW_CONTAINERS = 256


def schedule(tokens: np.ndarray, source: np.ndarray, share: np.ndarray, deficit: np.ndarray, window_tokens: float) -> np.ndarray:
    """Window in which deficit round-robin serves each text, the texts of a source in the given order.

    A source earns ``share * window_tokens`` a window on top of its ``deficit``; a text goes when the earnings
    cover all texts of its source up to it. The sum of earnings minus sizes is the deficit carried on.
    """
    window = np.zeros(len(tokens), np.int64)
    for s in np.unique(source):
        own = np.flatnonzero(source == s)
        quantum = max(share[s] * window_tokens, 1.0)
        window[own] = np.maximum(0, np.ceil((np.cumsum(tokens[own]) - deficit[s]) / quantum) - 1)
    return window


def best_fit(size: np.ndarray, window: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(container, offset, number of containers): each window's pieces, largest first, into the fullest container that takes them.

    Containers with room left stay open for later windows. Full pieces never enter the search. A piece costs a search
    in, and an insertion into, the sorted list of open containers: a few microseconds, for at most PART_TOKENS tokens a task.
    """
    container, offset = np.empty(len(size), np.int64), np.zeros(len(size), np.int64)
    full = np.flatnonzero(size >= capacity)
    container[full] = np.arange(len(full))
    made = len(full)
    rest = np.flatnonzero((size < capacity) & (size > 0))
    rest = rest[np.lexsort((rest, -size[rest], window[rest]))]
    gaps: list[tuple[int, int]] = []
    for i, need in zip(rest.tolist(), size[rest].tolist(), strict=True):
        k = bisect_left(gaps, (need, -1))
        if k < len(gaps):
            gap, where = gaps.pop(k)
        else:
            gap, where = capacity, made
            made += 1
        container[i], offset[i] = where, capacity - gap
        if gap > need:
            insort(gaps, (gap - need, where))
    empty = np.flatnonzero(size <= 0)
    container[empty] = 0
    return container, offset, max(made, 1 if len(empty) else 0)


def pack(docs: DataFrame, capacities: DataFrame, shares: DataFrame | None = None, part_tokens: int = PART_TOKENS, window_containers: int = WINDOW_CONTAINERS) -> DataFrame:
    """(size_id, capacity_tokens, container_id, offset, doc_id, piece, token_from, n_tokens, source, window) of every text in every capacity.

    ``docs`` is (doc_id, source, n_tokens), ``capacities`` (size_id, capacity_tokens), a small list; ``shares``
    (source, share) sets the target proportions, by default each source's share of all tokens. Only a text larger
    than the capacity is cut, into full pieces and a rest. Texts are dealt to parts of about ``part_tokens`` tokens by
    a hash of their id, so a large source is spread like any other. The deficit a source carries into a part is the
    target minus the actual tokens of the parts before it, a running sum over one small row per part and source.
    Null sources form one queue, null ids are kept, texts of 0 tokens take no room, equal ids are packed one by one.
    Capacities that are null or below 1 are left out; without texts there are no containers.
    """
    docs = durable(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_tokens"))
    sources = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, -(-total // part_tokens))
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(parts)).cast("int")
    docs = docs.withColumn("part", part)
    if shares is None:
        target = sources.select("source", (F.col("tokens") / F.lit(max(total, 1))).alias("share"))
    else:
        target = sources.select("source").join(shares.select("source", "share"), "source", "left").fillna(0.0)
    per_part = docs.groupBy("part", "source").agg(F.sum("n_tokens").alias("actual"))
    of_part = per_part.groupBy("part").agg(F.sum("actual").alias("part_total"))
    every = of_part.crossJoin(F.broadcast(sources.select("source")))
    every = every.join(target, "source").join(per_part, ["part", "source"], "left").fillna(0, ["actual"])
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum(F.col("share") * F.col("part_total") - F.col("actual")).over(before), F.lit(0.0))
    budget = every.select("part", "source", "share", carried.alias("deficit"))
    sizes = [(r["size_id"], r["capacity_tokens"]) for r in capacities.select("size_id", "capacity_tokens").where("capacity_tokens >= 1").distinct().collect()]
    kind = capacities.schema["size_id"].dataType.simpleString()
    each = F.explode(F.array(*[F.struct(F.lit(a).cast(kind).alias("size_id"), F.lit(b).cast("long").alias("capacity_tokens")) for a, b in sizes])) if sizes else F.explode(F.array().cast(f"array<struct<size_id:{kind},capacity_tokens:bigint>>"))
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["size_id", "capacity_tokens", "container_id", "offset", "doc_id", "piece", "token_from", "n_tokens", "source", "window"]

    def fill(own: pa.Table, budget: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(columns, types, strict=True)})
        own = own.sort_by([("order", "ascending"), ("doc_id", "ascending")])
        names = own.column("source").combine_chunks().dictionary_encode()
        source, labels = names.indices.to_numpy(), names.dictionary.to_pylist()
        known = {r["source"]: r for r in budget.to_pylist()}
        share = np.array([known[x]["share"] if x in known else 0.0 for x in labels])
        deficit = np.array([known[x]["deficit"] if x in known else 0.0 for x in labels])
        tokens = own.column("n_tokens").to_numpy().astype(np.int64)
        capacity = own.column("capacity_tokens")[0].as_py()
        window = schedule(tokens, source, share, deficit, float(capacity * window_containers))
        pieces = np.maximum(1, -(-tokens // capacity))
        doc = np.repeat(np.arange(len(tokens)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        size = np.minimum(tokens[doc] - start, capacity)
        container, offset, _ = best_fit(size, window[doc], capacity)
        container = container + (own.column("part")[0].as_py() << 32)
        take = pa.array(doc)
        values = [own.column("size_id").take(take), own.column("capacity_tokens").take(take), container, offset, own.column("doc_id").take(take), piece, start, size, own.column("source").take(take), window[doc]]
        return pa.table({c: (pa.array(v) if isinstance(v, np.ndarray) else v).cast(t) for c, v, t in zip(columns, values, types, strict=True)})

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(capacities.schema["size_id"].dataType), pa.int64(), pa.int64(), pa.int64(), to_arrow_type(docs.schema["doc_id"].dataType), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    schema = f"size_id {kind}, capacity_tokens long, container_id long, offset long, doc_id {id_kind}, piece int, token_from long, n_tokens long, source string, window long"
    left = docs.select("*", F.xxhash64("doc_id", F.lit(23)).alias("order"), each.alias("z")).select("part", "order", "doc_id", "source", "n_tokens", "z.size_id", "z.capacity_tokens")
    right = budget.select("*", each.alias("z")).select(F.col("part").alias("to_part"), F.col("z.size_id").alias("to_size"), "source", "share", "deficit")
    return left.groupBy("size_id", "part").cogroup(right.groupBy("to_size", "to_part")).applyInArrow(fill, schema)


def container_report(packed: DataFrame) -> DataFrame:
    """(size_id, capacity_tokens, n_containers, n_texts, n_cut, tokens, waste_share) per capacity."""
    filled = packed.groupBy("size_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("held"), F.sum((F.col("piece") == 0).cast("long")).alias("texts"), F.sum((F.col("piece") == 1).cast("long")).alias("cut"))
    return filled.groupBy("size_id", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("texts").alias("n_texts"), F.sum("cut").alias("n_cut"), F.sum("held").alias("tokens"), (1 - F.sum("held") / F.max("capacity_tokens") / F.count("*")).alias("waste_share"))


def window_report(packed: DataFrame, window_containers: int = WINDOW_CONTAINERS) -> DataFrame:
    """(size_id, capacity_tokens, source, n_windows, target_share, mean_share, largest_error): how full windows keep the shares.

    The target is the source's share of all tokens packed, as ``pack`` has it without ``shares``. A window is full
    if it holds nine tenths of its tokens or more; the last of a part, and those in which a source has run out, are not.
    """
    part = F.shiftright("container_id", 32)
    own = packed.groupBy("size_id", "capacity_tokens", part.alias("part"), "window", "source").agg(F.sum("n_tokens").alias("tokens"))
    whole = own.groupBy("size_id", "part", "window").agg(F.sum("tokens").alias("held"))
    full = whole.join(own.select("size_id", "capacity_tokens").distinct(), "size_id").where(F.col("held") >= 0.9 * window_containers * F.col("capacity_tokens"))
    total = own.groupBy("size_id").agg(F.sum("tokens").alias("all"))
    target = own.groupBy("size_id", "source").agg(F.sum("tokens").alias("tokens")).join(total, "size_id").select("size_id", "source", F.try_divide("tokens", "all").alias("target_share"))
    each = full.join(target, "size_id").join(own.select("size_id", "part", "window", "source", "tokens"), ["size_id", "part", "window", "source"], "left")
    share = F.coalesce(F.col("tokens"), F.lit(0)) / F.col("held")
    return each.groupBy("size_id", "capacity_tokens", "source").agg(F.count("*").alias("n_windows"), F.max("target_share").alias("target_share"), F.avg(share).alias("mean_share"), F.max(F.abs(share - F.col("target_share"))).alias("largest_error"))


def broken_rules(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """(size_id, capacity_tokens, n_texts, overfull, overlapping, wrongly_cut, incomplete) per capacity; the last four are 0.

    Containers above their capacity or with pieces over each other, texts cut that need not be or cut elsewhere than
    at the capacity, and texts whose pieces are not all of them. ``docs`` is (doc_id, source, n_tokens), its ids unique.
    """
    sides = ["size_id", "capacity_tokens"]
    held = packed.groupBy(*sides, "container_id").agg(F.sum("n_tokens").alias("held"), F.max(F.col("offset") + F.col("n_tokens")).alias("reach"), F.sum(F.col("offset") * F.col("n_tokens") + F.col("n_tokens") * (F.col("n_tokens") - 1) / 2).alias("places"))
    # Pieces side by side from 0 on take each place once: the sum of the places is that of 0 to held - 1.
    boxes = held.groupBy(*sides).agg(F.count_if(F.greatest("held", "reach") > F.col("capacity_tokens")).alias("overfull"), F.count_if((F.col("reach") != F.col("held")) | (F.col("places") != F.col("held") * (F.col("held") - 1) / 2)).alias("overlapping"))
    pieces = packed.groupBy(*sides, "doc_id").agg(F.sum("n_tokens").alias("sum"), F.count("*").alias("n"), F.max(F.when(F.col("token_from") != F.col("piece") * F.col("capacity_tokens"), 1).otherwise(0)).alias("elsewhere"))
    both = pieces.join(docs.select("doc_id", "n_tokens"), "doc_id")
    need = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
    texts = both.groupBy(*sides).agg(F.count("*").alias("n_texts"), F.count_if((F.col("n") != need) | (F.col("elsewhere") == 1)).alias("wrongly_cut"), F.count_if(F.col("sum") != F.col("n_tokens")).alias("incomplete"))
    return texts.join(boxes, sides).select(*sides, "n_texts", *[F.col(c).cast("int").alias(c) for c in ("overfull", "overlapping", "wrongly_cut", "incomplete")])
