"""Queries over the census tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygrain.operators import census
from citygrain.operators.imputation import MAX_HEADS, head_count
from citygrain.sources.tables import nan_to_null, table

COLUMNS = [c.lower() for c in census.DEMOGRAPHIC if c != "REL_H_M"]
#: All columns that zones and blocks share.
SHARED = COLUMNS
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _censuses(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of each census, newest row each, head counts cleaned, zone from the block code."""
    rows = table(spark, d, "blocks").withColumn("cve_ageb", F.substring("cvegeo", 1, 13))
    newest = rows.groupBy("cvegeo", "census_year").agg(F.max_by(F.struct("block_id", "cve_ageb", *["pobtot"], *COLUMNS), F.struct("loaded_at", "block_id")).alias("b")).select("cvegeo", "census_year", "b.*")
    return newest.select("cvegeo", "census_year", "block_id", "cve_ageb", *[head_count(F.col(c)).alias(c) for c in ["pobtot", *COLUMNS]])


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of the census of the zone totals."""
    return _censuses(spark, d).where("census_year = 2020").drop("census_year")


def _head(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) AND {c} >= 0 AND {c} <= {MAX_HEADS} AND {c} = floor({c}) THEN {c} END AS {c}"


def _share(c: str, b: str = "b") -> str:
    return f"""round(coalesce({b}.{c}, CASE WHEN count(*) FILTER (WHERE {b}.{c} IS NULL) OVER w = 1 THEN z.{c} - coalesce(sum({b}.{c}) OVER w, 0)
  WHEN coalesce(sum(CASE WHEN {b}.{c} IS NULL THEN {b}.pobtot END) OVER w, 0) > 0 THEN (z.{c} - coalesce(sum({b}.{c}) OVER w, 0)) * {b}.pobtot / sum(CASE WHEN {b}.{c} IS NULL THEN {b}.pobtot END) OVER w END), 4) AS {c}"""


_EVERY = f"""WITH every AS (SELECT cvegeo, census_year, block_id, left(cvegeo, 13) AS cve_ageb, {', '.join(_head(c) for c in ['pobtot', *COLUMNS])}
FROM (SELECT *, row_number() OVER (PARTITION BY cvegeo, census_year ORDER BY loaded_at DESC, block_id DESC) AS k FROM blocks) WHERE k = 1)"""
_SQL = f"{_EVERY}, b AS (SELECT * EXCLUDE (census_year) FROM every WHERE census_year = 2020)"


def _passes(table: str, n: int) -> str:
    """CTEs e0 to e{n}: passes of the equations, one CTE per run of equations whose targets do not feed each other."""
    out, last, k = [f"e0 AS MATERIALIZED (SELECT * FROM {table})"], "e0", 0
    for _ in range(n):
        group: dict[str, str] = {}
        rules = [(t.lower(), w and w.lower(), [p.lower() for p in parts], known) for t, w, parts, known in census.RULES]
        for target, whole, parts, known in [*rules, ("", None, [], False)]:
            if not target or target in group or {*parts, whole} & set(group):
                k += 1
                out.append(f"e{k} AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'coalesce({c}, {x}) AS {c}' for c, x in group.items())}) FROM {last})")
                last, group = f"e{k}", {}
            if target:
                total = f"CASE WHEN coalesce({', '.join(parts)}) IS NOT NULL THEN {' + '.join(f'coalesce({p}, 0)' for p in parts)} END" if known else " + ".join(parts)
                group[target] = f"{whole} - ({total})" if whole else f"({total})"
    return ", ".join(out) + f", done AS (SELECT * FROM {last})"


@query(f"""{_SQL}, partly AS (SELECT * FROM b WHERE coalesce({', '.join(COLUMNS)}) IS NOT NULL), {_passes('partly', 4)}, f AS (SELECT * FROM done UNION ALL SELECT * FROM b WHERE coalesce({', '.join(COLUMNS)}) IS NULL),
z AS (SELECT cve_ageb, {', '.join(f'CASE WHEN NOT isnan({c}) THEN {c} END AS {c}' for c in COLUMNS)} FROM zones)
SELECT f.cvegeo, f.block_id, f.cve_ageb, round(f.pobtot, 4) AS pobtot, {', '.join(_share(c, 'f') for c in COLUMNS)} FROM f LEFT JOIN z ON z.cve_ageb = f.cve_ageb WINDOW w AS (PARTITION BY f.cve_ageb)""")
def q40_census_imputation(spark: SparkSession, d: str) -> DataFrame:
    zones = nan_to_null(table(spark, d, "zones").select("cve_ageb", "pobtot", *COLUMNS))
    out = census.impute_blocks(zones, _blocks(spark, d))
    return out.select("cvegeo", "block_id", "cve_ageb", *[F.round(c, 4).alias(c) for c in ["pobtot", *COLUMNS]])


@query(f"""{_EVERY}, t AS (SELECT *, coalesce(pobtot, pobfem + pobmas) AS t FROM every), f AS (SELECT *, coalesce(pobfem, t - pobmas) AS f FROM t)
SELECT cvegeo, census_year, t AS pobtot, f AS pobfem, coalesce(pobmas, t - f) AS pobmas FROM f""")
def q40b_gender_equations(spark: SparkSession, d: str) -> DataFrame:
    """The equations of the sexes within the rows of all censuses."""
    rows = _censuses(spark, d).select("cvegeo", "census_year", F.col("pobtot").alias("POBTOT"), F.col("pobfem").alias("POBFEM"), F.col("pobmas").alias("POBMAS"))

    def kernel(batches):
        for batch in batches:
            batch[["POBTOT", "POBFEM", "POBMAS"]] = census.apply_equations(batch[["POBTOT", "POBFEM", "POBMAS"]].astype(float))
            yield batch

    return rows.mapInPandas(kernel, rows.schema).toDF("cvegeo", "census_year", "pobtot", "pobfem", "pobmas")


@query(f"{_SQL}, z AS (SELECT cve_ageb, {', '.join(f'CASE WHEN NOT isnan({c}) THEN {c} END AS {c}' for c in SHARED)} FROM zones) SELECT b.cvegeo, {', '.join(_share(c) for c in SHARED)} FROM b LEFT JOIN z ON z.cve_ageb = b.cve_ageb WINDOW w AS (PARTITION BY b.cve_ageb)")
def q41_zone_remainder(spark: SparkSession, d: str) -> DataFrame:
    zones = table(spark, d, "zones")
    out = census.zone_remainder(zones, _blocks(spark, d), "cve_ageb", "pobtot", SHARED)
    return out.select("cvegeo", *[F.round(c, 4).alias(c) for c in SHARED])


@query("SELECT DISTINCT left(cvegeo, 13) AS cve_ageb FROM blocks WHERE left(cvegeo, 13) NOT IN (SELECT cve_ageb FROM zones WHERE pobtot > 300)")
def q41b_unknown_zones(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks").select(F.substring("cvegeo", 1, 13).alias("cve_ageb"))
    return census.unknown_zones(table(spark, d, "zones").where("pobtot > 300"), blocks)
