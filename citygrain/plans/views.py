"""Views over the TPC-H-like tables that stand for points, areas, networks and rasters; the same arithmetic in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citygrain.functions import geom
from citygrain.sources.tables import table

LATTICE = 40


def _xy(key: str) -> list[Column]:
    return [((F.col(key) * 7919) % 4096 / F.lit(64.0)).alias("x"), ((F.col(key) * 104729) % 4096 / F.lit(64.0)).alias("y")]


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *_xy("c_custkey"), F.col("c_acctbal").alias("value"), (F.col("c_nationkey") + 1).alias("weight"))


def pois(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), *_xy("s_suppkey"))


def bins(spark: SparkSession) -> DataFrame:
    x, y = (F.col("id") % 8) * 8, F.floor(F.col("id") / 8) * 8
    return spark.range(64).select(F.col("id").alias("bin_id"), geom.rectangle(x, y, x + 8, y + 8).alias("geometry"))


def areas(spark: SparkSession, d: str) -> DataFrame:
    x, y = (F.col("n_nationkey") % 5) * 12, F.floor(F.col("n_nationkey") / 5) * 12
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("area_id"), (F.col("n_nationkey") * 10 + 1000.0).alias("people"), (F.col("n_nationkey") / 4.0).alias("rate"), geom.rectangle(x, y, x + 12, y + 12).alias("geometry"))


def net_nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("osmid"), (k % LATTICE).cast("double").alias("x"), F.floor(k / LATTICE).cast("double").alias("y"))


def net_edges(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("u"))
    right = ids.where(F.col("u") % LATTICE < LATTICE - 1).select("u", (F.col("u") + 1).alias("v"))
    below = ids.select("u", (F.col("u") + LATTICE).alias("v"))
    both = right.unionByName(below).join(ids.withColumnRenamed("u", "v"), "v", "left_semi")
    return both.select("u", "v", F.lit(0).alias("key"), (((F.col("u") * 31 + F.col("v") * 17) % 64) / F.lit(16.0) + 1).alias("length"))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the network that stand for points of interest, numbered."""
    n = table(spark, d, "part").count()
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("seed_pos"), ((F.col("s_suppkey") * 37 + 11) % n).alias("osmid"))


def items(spark: SparkSession, d: str) -> DataFrame:
    tile = F.concat(F.lit("31T"), (F.col("o_custkey") % 5).cast("string"))
    cloud = F.floor(F.col("o_totalprice") % 100).cast("long").cast("string")
    href = lambda b: F.struct(F.lit(b).alias("common_name"), F.concat(F.lit(f"{b}-"), F.col("o_orderkey").cast("string")).alias("href"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("datetime"), F.create_map(F.lit("s2:mgrs_tile"), tile, F.lit("s2:high_proba_clouds_percentage"), cloud, F.lit("eo:cloud_cover"), cloud).alias("properties"), F.array(href("nir"), href("red")).alias("assets"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_shipdate")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("feature"), F.year(at).alias("year"), F.month(at).alias("month")).agg(F.avg("l_discount").alias("value"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """One row per user, kind of event and day of January 2024, without a value on days without such events."""
    feature = F.concat_ws(":", "user_id", "event_type").alias("feature")
    events = table(spark, d, "events").select(feature, F.to_date("ts").alias("day"), "value")
    days = F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-30')")).alias("day")
    known = events.groupBy("feature", "day").agg(F.max("value").alias("value"))
    return events.select("feature").distinct().select("feature", days).join(known, ["feature", "day"], "left")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / LATTICE).alias("row"), (k % LATTICE).alias("col"), F.col("p_retailprice").alias("nir"), F.col("p_size").cast("double").alias("red"))


SQL = {
    "points": "SELECT c_custkey AS id, (c_custkey * 7919 % 4096) / 64e0 AS x, (c_custkey * 104729 % 4096) / 64e0 AS y, c_acctbal AS value, c_nationkey + 1 AS weight FROM customer",
    "pois": "SELECT s_suppkey AS id, (s_suppkey * 7919 % 4096) / 64e0 AS x, (s_suppkey * 104729 % 4096) / 64e0 AS y FROM supplier",
    "bins": "SELECT i AS bin_id, (i % 8) * 8e0 AS x0, (i // 8) * 8e0 AS y0 FROM range(64) AS r(i)",
    "areas": "SELECT CAST(n_nationkey AS BIGINT) AS area_id, n_nationkey * 10 + 1000e0 AS people, n_nationkey / 4e0 AS rate, (n_nationkey % 5) * 12e0 AS x0, (n_nationkey // 5) * 12e0 AS y0 FROM nation",
    "net_nodes": f"SELECT p_partkey AS osmid, CAST(p_partkey % {LATTICE} AS DOUBLE) AS x, CAST(p_partkey // {LATTICE} AS DOUBLE) AS y FROM part",
    "net_edges": f"""SELECT u, v, 0 AS key, ((u * 31 + v * 17) % 64) / 16e0 + 1 AS length FROM (SELECT p_partkey AS u, p_partkey + 1 AS v FROM part WHERE p_partkey % {LATTICE} < {LATTICE - 1}
      UNION ALL SELECT p_partkey, p_partkey + {LATTICE} FROM part) WHERE v IN (SELECT p_partkey FROM part)""",
    "seeds": "SELECT s_suppkey AS seed_pos, (s_suppkey * 37 + 11) % (SELECT count(*) FROM part) AS osmid FROM supplier",
    "items": "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderdate AS datetime, '31T' || (o_custkey % 5) AS tile, CAST(floor(o_totalprice % 100) AS DOUBLE) AS cloud FROM orders",
    "panel": "SELECT l_suppkey AS feature, year(l_shipdate) AS year, month(l_shipdate) AS month, avg(l_discount) AS value FROM lineitem GROUP BY ALL",
    "daily": """SELECT f.feature, d.day, k.value FROM (SELECT DISTINCT user_id || ':' || event_type AS feature FROM events) f CROSS JOIN (SELECT CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS DATE) AS day FROM range(30) AS r(i)) d
      LEFT JOIN (SELECT user_id || ':' || event_type AS feature, CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY ALL) k ON k.feature = f.feature AND k.day = d.day""",
    "pixels": f"SELECT p_partkey // {LATTICE} AS row, p_partkey % {LATTICE} AS col, p_retailprice AS nir, CAST(p_size AS DOUBLE) AS red FROM part",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """WITH clause of the named views."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
