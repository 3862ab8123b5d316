"""Imputation of census variables of blocks: accounting equations within a row, then the remainder of the zone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrain.functions.convert import known_values, require

# The demographic columns.
DEMOGRAPHIC = """
    POBFEM POBMAS P_0A2 P_0A2_F P_0A2_M P_3A5 P_3A5_F P_3A5_M P_6A11 P_6A11_F P_6A11_M P_12A14 P_12A14_F P_12A14_M P_15A17 P_15A17_F P_15A17_M
    P_18A24 P_18A24_F P_18A24_M P_60YMAS P_60YMAS_F P_60YMAS_M P_3YMAS P_3YMAS_F P_3YMAS_M P_12YMAS P_12YMAS_F P_12YMAS_M
    P_15YMAS P_15YMAS_F P_15YMAS_M P_18YMAS P_18YMAS_F P_18YMAS_M REL_H_M POB0_14 POB15_64 POB65_MAS PCON_DISC
""".split()
GROUPS = ["P_0A2", "P_3A5", "P_6A11", "P_12A14", "P_15A17"]
SPLIT_BY_SEX = [*GROUPS, "P_18A24", "P_60YMAS"]
ZONE, BLOCK, TOTAL = "CVE_AGEB", "CVEGEO", "POBTOT"


@dataclass(frozen=True)
class Columns:
    """Which columns are worked on, which of them are left as they are, and the names of the keys and the total."""

    demographic: tuple[str, ...] = tuple(DEMOGRAPHIC)
    excluded: tuple[str, ...] = ("REL_H_M",)
    zone: str = ZONE
    block: str = BLOCK
    total: str = TOTAL


YOUNG = ["P_0A2", "P_3A5", "P_6A11", "P_12A14"]


def _rules() -> list[tuple[str, str | None, list[str], bool]]:
    """The equations in order, as (target, whole or None, parts, known parts only).

    With a whole the target is the whole less its parts; without one it is their sum. ``known parts only`` sums the
    parts that have a value (null if none has), otherwise all must have one.
    """
    out: list[tuple[str, str | None, list[str], bool]] = []
    for total, women, men in [(TOTAL, "POBFEM", "POBMAS"), *[(g, g + "_F", g + "_M") for g in SPLIT_BY_SEX]]:
        out += [(total, None, [women, men], False), (women, total, [men], False), (men, total, [women], False)]
    for sex, total in (("", TOTAL), ("_F", "POBFEM"), ("_M", "POBMAS")):
        out += [("P_0A2" + sex, total, ["P_3YMAS" + sex], False), ("P_3YMAS" + sex, total, ["P_0A2" + sex], False)]

    def cohort(young: list[str], old: str, total: str) -> None:
        out.append((old, total, young, True))
        out.extend((y, total, [*[z for z in young if z != y], old], True) for y in young)

    for count, old in ((3, "P_12YMAS"), (4, "P_15YMAS"), (5, "P_18YMAS")):
        for sex, total in (("", TOTAL), ("_F", "POBFEM"), ("_M", "POBMAS")):
            cohort([g + sex for g in GROUPS[:count]], old + sex, total)
    cohort(["POB0_14", "POB15_64"], "POB65_MAS", TOTAL)
    out.append(("POB0_14", None, YOUNG, True))
    out += [(y, "POB0_14", [z for z in YOUNG if z != y], True) for y in YOUNG]
    return out


RULES = _rules()


def apply_equations(rows: pd.DataFrame, passes: int = 50) -> pd.DataFrame:
    """Fill nulls by the equations, in order, pass by pass until nothing changes. Rows do not see each other.

    An equation is worked out only for the rows that lack its target, over a matrix of the columns.
    """
    place = {c: k for k, c in enumerate(rows.columns)}
    values = rows.to_numpy(dtype=float, na_value=np.nan).T.copy()
    rules = [(place[t], None if w is None else place[w], [place[p] for p in parts], known) for t, w, parts, known in RULES if {t, *parts, *([w] if w else [])} <= set(place)]
    for _ in range(passes):
        changed = False
        for target, whole, parts, known in rules:
            open_ = np.flatnonzero(np.isnan(values[target]))
            if not len(open_):
                continue
            terms = values[parts][:, open_]
            total = terms.sum(0)
            if known:
                missing = np.isnan(terms)
                total = np.where(missing.all(0), np.nan, np.where(missing, 0.0, terms).sum(0))
            found = total if whole is None else values[whole][open_] - total
            values[target, open_] = found
            changed |= not np.isnan(found).all()
        if not changed:
            break
    return pd.DataFrame(values.T, index=rows.index, columns=rows.columns)


def impute_blocks(zones: DataFrame, blocks: DataFrame, most_passes: int = 50, columns: Columns | None = None) -> DataFrame:
    """``blocks`` with missing demographic values filled, names in lower case; excluded columns (REL_H_M) stay as they are.

    A row with any demographic value goes through the equations. Then, per zone of ``zones`` and column, a single missing
    value is the zone's total less the known ones, and several share that remainder by their POBTOT (if its sum is above
    0). Negative remainders stay. Empty tables: ValueError; missing columns: KeyError; a block of an unknown zone only
    goes through the equations. Zone sums are aggregated before the shuffle and joined back, so a large zone is no window.
    ``columns`` names other columns and keys; the equations are about the default names, further columns only share remainders.
    """
    if zones.isEmpty() or blocks.isEmpty():
        raise ValueError("zones and blocks must not be empty")
    setup = columns or Columns()
    upper = lambda df: df.toDF(*[c if c == "geometry" else c.upper() for c in df.columns])
    zone, block, total = setup.zone.upper(), setup.block.upper(), setup.total.upper()
    zones, blocks = upper(zones), upper(blocks)
    require(zones, [zone], KeyError)
    require(blocks, [zone, block, total, *[c for c in ("POBFEM", "POBMAS") if c in setup.demographic]], KeyError)
    known = [c.upper() for c in setup.demographic if c.upper() in blocks.columns]
    worked = [c for c in known if c not in {x.upper() for x in setup.excluded}]
    numbers = {c: F.expr(f"nanvl(double(`{c}`), null)") for c in [*known, total]}
    some = F.expr(f"coalesce({', '.join(f'`{c}`' for c in known)}) is not null") if known else F.lit(False)
    rows = blocks.withColumns(numbers).withColumn("_any", some)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            use = batch["_any"].to_numpy(bool)
            if use.any():
                fill = apply_equations(batch.loc[use, [*worked, total]].astype(float).rename(columns={total: TOTAL}), most_passes)
                batch.loc[use, [*worked, total]] = fill.rename(columns={TOTAL: total})
            yield batch

    rows = rows.mapInPandas(kernel, rows.schema)
    out = zone_remainder(zones, rows, zone, total, [c for c in worked if c in zones.columns])
    return out.select(*[F.col(c).alias(c if c == "geometry" else c.lower()) for c in blocks.columns])


def zone_remainder(zones: DataFrame, rows: DataFrame, zone: str, total: str, columns: list[str]) -> DataFrame:
    """``rows`` with each zone's remainder given to its missing values: whole to a single one, else by the rows' ``total``."""
    totals = zones.groupBy(zone).agg(*[F.expr(f"first(nanvl(double(`{c}`), null)) as `_z_{c}`") for c in columns])
    parts = [f"count_if(`{c}` is null) as `_n_{c}`, coalesce(sum(`{c}`), 0D) as `_s_{c}`, coalesce(sum(if(`{c}` is null, `{total}`, null)), 0D) as `_p_{c}`".split(", coalesce") for c in columns]
    sums = rows.groupBy(zone).agg(*[F.expr(("coalesce" if k else "") + part) for own in parts for k, part in enumerate(own)])
    out = rows.join(sums.join(totals, zone), zone, "left")
    share = lambda c: f"coalesce(`{c}`, case when `_n_{c}` = 1 then `_z_{c}` - `_s_{c}` when `_n_{c}` > 1 and `_p_{c}` > 0 then (`_z_{c}` - `_s_{c}`) * `{total}` / `_p_{c}` end) as `{c}`"
    return out.select(*[F.expr(share(c)) if c in columns else F.col(c) for c in rows.columns])


def unknown_zones(zones: DataFrame, blocks: DataFrame, column: str = "cve_ageb") -> DataFrame:
    """Zone ids of blocks that no zone has."""
    return blocks.select(column).distinct().join(zones.select(column), column, "left_anti")


def imputation_report(before: DataFrame, after: DataFrame, zone: str = "cve_ageb") -> DataFrame:
    """(zone, missing_before, missing_after, percent_filled) over the demographic columns."""
    columns = [c for c in before.columns if c.upper() in DEMOGRAPHIC and c.upper() != "REL_H_M"]
    count = lambda df, name: df.groupBy(zone).agg(F.sum(F.lit(len(columns)) - known_values(columns)).alias(name))
    both = count(before, "missing_before").join(count(after, "missing_after"), zone)
    return both.withColumn("percent_filled", F.coalesce(F.try_divide((F.col("missing_before") - F.col("missing_after")) * 100.0, F.col("missing_before")), F.lit(0.0)))
