"""Missing values filled from similar records, with the method of each fill marked.

Records are clustered by k-prototypes on their observed numeric and categorical features (column expressions and
aggregates only). A missing value is the median (or, for codes, the mode) of its cluster within its group, else of
the whole parent group, else of the same unit at other times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citygrain.operators.skew import hot_keys, salted_join
from citygrain.session import durable

#: Clusters, and rounds after which they are taken as they are if they have not settled before.
CLUSTERS, ROUNDS, GAMMA = 6, 6, 0.25
#: Blocks have some thousands of heads at most; codes such as 9999 or 999999 stand for "not given".
MAX_HEADS = 9_998
CODE = r"^(?:[0-9]{9})?[0-9]{3}[0-9A-Z]$"


def head_count(c: Column, most: int = MAX_HEADS) -> Column:
    """The value if it can be a head count (0 is one), else null."""
    return F.when(~F.isnan(c) & (c >= 0) & (c <= most) & (c == F.floor(c)), c)


def zone_code(c: Column) -> Column:
    """The code in capitals without blanks and dashes, in its long or short form, else null; zeros are no code."""
    bare = F.regexp_replace(F.upper(c), r"[\s-]", "")
    return F.when(bare.rlike(CODE) & ~bare.rlike("^0+$"), bare)


@dataclass(frozen=True)
class Prototypes:
    """Cluster centres over columns: per cluster the means of the numeric and the modes of the categorical ones."""

    numeric: list[str]
    categorical: list[str]
    centres: list[tuple[list[float], list]]
    gamma: float

    def cluster(self, spread: bool = False) -> Column:
        """Number of the nearest prototype: squared differences of observed numbers plus gamma per differing category.

        ``spread`` says that the table has the columns of the function of this name, which are quicker to read.
        """
        if not self.centres:
            return F.lit(0)
        # The squares of a row's own features are the same for all clusters and left out: what stays is short enough to be compiled.
        distances = []
        for means, modes in self.centres:
            x, known = ((lambda i: f"_x{i}"), (lambda i: f"_k{i}")) if spread else ((lambda i: f"coalesce(`{self.numeric[i]}`, 0D)"), (lambda i: f"if(`{self.numeric[i]}` is null, 0D, 1D)"))
            terms = [f"{known(i)} * {m * m!r}D - {x(i)} * {2 * m!r}D" for i, m in enumerate(means) if m is not None]
            terms += [f"if(`{x}` <=> {_literal(m)}, 0D, {self.gamma!r}D)" for x, m in zip(self.categorical, modes, strict=True) if m is not None]
            distances.append(" + ".join(terms) or "0D")
        # One evaluation of each distance; of equal ones the first counts.
        return F.expr(f"array_min(array({', '.join(f'struct({d} as d, {i} as i)' for i, d in enumerate(distances))})).i")


def spread(df: DataFrame, numeric: list[str]) -> DataFrame:
    """``df`` with ``_x0``... for the numeric columns, 0 where null, and ``_k0``..., 1 where known, in their place."""
    return df.select(*[c for c in df.columns if c not in numeric], *[F.expr(f"coalesce(double(`{c}`), 0D) as _x{i}") for i, c in enumerate(numeric)], *[F.expr(f"if(`{c}` is null, 0D, 1D) as _k{i}") for i, c in enumerate(numeric)])


def _literal(value) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


def fit_prototypes(df: DataFrame, numeric: list[str], categorical: list[str], k: int = CLUSTERS, rounds: int = ROUNDS, gamma: float = GAMMA) -> Prototypes:
    """K-prototypes over all rows: each round is one aggregate of k rows, whatever the size of ``df``; it ends when no centre moves.

    The first clusters are k equal ranges of the rows' mean over their observed features. Null features are
    left out of means, modes and distances. An empty table gives no centres, and then one cluster.
    """
    own = range(len(numeric))
    df = df if "_x0" in df.columns or not numeric else spread(df, numeric)
    mean = f"try_divide({' + '.join(f'_x{i}' for i in own)}, {' + '.join(f'_k{i}' for i in own)})"
    low, high = df.select(F.expr(f"min({mean})"), F.expr(f"max({mean})")).first()
    low, high = low or 0.0, high or 0.0
    assigned = F.expr(" + ".join(["0", *(f"int(coalesce({mean}, 0D) > {low + (high - low) * i / k!r}D)" for i in range(1, k))]))
    model = Prototypes(numeric, categorical, [], gamma)
    for _ in range(rounds):
        aggregates = [F.expr(f"try_divide(sum(_x{i}), sum(_k{i})) as n{i}") for i in own] + [F.mode(F.col(x), True).alias(f"c{i}") for i, x in enumerate(categorical)]
        rows = df.groupBy(assigned.alias("_cluster")).agg(*aggregates).orderBy("_cluster").collect()
        centres = [([r[f"n{i}"] for i in range(len(numeric))], [r[f"c{i}"] for i in range(len(categorical))]) for r in rows]
        if _settled(centres, model.centres):
            break
        model = Prototypes(numeric, categorical, centres, gamma)
        assigned = model.cluster(spread=True)
    return model


def _settled(new: list, old: list) -> bool:
    """No centre has moved, but for the last digits of a sum."""
    if len(new) != len(old):
        return False
    same = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) <= 1e-12 * max(1.0, abs(a)))
    return all(c == d and all(map(same, a, b)) for (a, c), (b, d) in zip(new, old, strict=True))


def fill_blocks(blocks: DataFrame, features: list[str], heads: tuple[str, ...] = ("pobtot", "pobfem", "pobmas"), zone_field: str = "cve_ageb", k: int = CLUSTERS) -> DataFrame:
    """(block_id, cvegeo, census_year, cluster, then per field ``f``, ``f_filled``, ``f_method``) for each row of ``blocks``.

    ``f`` holds the cleaned value, filled where it was missing; ``f_filled`` marks fills; ``f_method`` is
    ``observed``, ``cluster`` (median or mode of the cluster in the zone and census), ``zone`` (of the whole zone and
    census), ``block`` (of the same block's other censuses) or ``unfillable``. A head count is missing if null,
    NaN, negative, fractional or impossibly large; a zone code if it is no code in any form. Only other records can
    be donors, since the record itself lacks the value. Ties of a mode go to the smaller code. Rows without
    ``cvegeo`` have no zone and are not filled from it. Repeated rows stay; other columns are ignored.

    The cleaned rows are written to the checkpoint folder once for the clustering, and once with their clusters. Only rows that lack something are
    joined with the statistics, salted where a zone holds a large part of them; statistics combine before their shuffle.
    """
    zone = F.when(F.length(F.trim("cvegeo")) >= 13, F.upper(F.substring(F.trim("cvegeo"), 1, 13)))
    demographic = [c for c in features if c in blocks.columns]
    numeric = [f"_f_{c}" for c in [*[c for c in demographic if c not in heads], *heads]]
    rows = blocks.select("block_id", "cvegeo", zone.alias("_zone"), "census_year", *[head_count(F.col(h)).alias(h) for h in heads], zone_code(F.col(zone_field)).alias(zone_field), *[F.log1p(head_count(F.col(c))).alias(f"_f_{c}") for c in demographic if c not in heads])
    rows = rows.withColumns({f"_f_{h}": F.log1p(h) for h in heads} | {"_c_state": F.substring("_zone", 1, 2), "_c_suffix": F.substring("_zone", 13, 1)})
    rows = durable(spread(rows, numeric))
    model = fit_prototypes(rows, numeric, ["_c_state", "_c_suffix", "census_year"], k)
    rows = durable(rows.select("block_id", "cvegeo", "_zone", "census_year", *heads, zone_field, model.cluster(spread=True).alias("cluster")))
    lacks = F.expr(" or ".join(f"`{f}` is null" for f in (*heads, zone_field)))
    todo = rows.where(lacks)

    long_code = F.when(F.length(zone_field) == 13, F.col(zone_field)).otherwise(F.concat(F.substring("_zone", 1, 9), F.col(zone_field)))
    zoned = rows.where(F.col("_zone").isNotNull())
    clusters = range(max(1, len(model.centres)))
    # Exact medians of bounded whole numbers keep one counter per value, so they combine before the shuffle.
    by_census = zoned.groupBy("_zone", "census_year").agg(*[F.expr(f"percentile(if(cluster = {i}, {h}, null), 0.5) as _{h}_{i}") for h in heads for i in clusters], *[F.expr(f"percentile({h}, 0.5) as _{h}_zone") for h in heads])
    by_zone = zoned.groupBy("_zone").agg(*[F.mode(F.when(F.col("cluster") == i, long_code), True).alias(f"_code_{i}") for i in clusters], F.mode(long_code, True).alias("_code_zone"))
    missing = todo.count()
    hot = hot_keys(todo, "_zone", missing)
    out = salted_join(todo, by_census, ["_zone", "census_year"], "_zone", hot, F.col("block_id"))
    out = salted_join(out, by_zone, ["_zone"], "_zone", hot, F.col("block_id"))
    own = lambda stem: F.expr(f"element_at(array({', '.join(f'_{stem}_{i}' for i in clusters)}), cluster + 1)").alias(f"_{stem}_cluster")
    out = out.select(*todo.columns, *[own(h) for h in heads], own("code"), *[f"_{h}_zone" for h in heads], "_code_zone")
    # What no record of the zone and census has is looked for among the block's other censuses, for the few blocks that need it.
    out = durable(out)
    open_ = out.where(F.expr(" or ".join(f"coalesce(`{h}`, `_{h}_cluster`, `_{h}_zone`) is null" for h in heads))).select("cvegeo").where("cvegeo is not null").distinct()
    by_block = rows.join(open_, "cvegeo", "left_semi").groupBy("cvegeo").agg(*[F.percentile(F.col(h), 0.5).alias(f"_{h}_block") for h in heads])
    out = salted_join(out, by_block, ["cvegeo"], "cvegeo", hot_keys(out, "cvegeo", missing), F.col("block_id"))

    def filled(field: str, found: list[tuple[str, Column]]) -> list[Column]:
        method = F.when(F.col(field).isNotNull(), "observed")
        for name, value in found:
            method = method.when(value.isNotNull(), name)
        value = F.coalesce(F.col(field), *[v for _, v in found])
        return [value.alias(field), (F.col(field).isNull() & value.isNotNull()).alias(f"{field}_filled"), method.otherwise("unfillable").alias(f"{field}_method")]

    columns = [c for h in heads for c in filled(h, [(n, F.col(f"_{h}_{n}")) for n in ("cluster", "zone", "block")])]
    columns += filled(zone_field, [(n, F.col(f"_code_{n}")) for n in ("cluster", "zone")])
    whole = [c for f in (*heads, zone_field) for c in (F.col(f), F.lit(False).alias(f"{f}_filled"), F.lit("observed").alias(f"{f}_method"))]
    keys = ["block_id", "cvegeo", "census_year", "cluster"]
    return out.select(*keys, *columns).unionByName(rows.where(~lacks).select(*keys, *whole))


def filled_fields(filled: DataFrame, fields: list[str]) -> DataFrame:
    """(block_id, field_name) of the fills."""
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_filled").alias("hit")) for f in fields])
    return filled.select("block_id", F.explode(entries).alias("e")).where("e.hit").select("block_id", "e.field_name")
