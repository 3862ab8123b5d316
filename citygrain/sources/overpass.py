"""Street networks from Overpass JSON: nodes and edges with the columns the network operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citygrain.functions.convert import pad_schema
from citygrain.functions.scalar import haversine
from citygrain.operators.joins import spatial_join
from citygrain.session import durable

NODE_COLUMNS = {"osmid": "bigint", "x": "double", "y": "double", "street_count": "int"}
EDGE_COLUMNS = {
    "u": "bigint", "v": "bigint", "key": "int", "osmid": "string", "oneway": "boolean", "lanes": "string", "name": "string", "highway": "string", "maxspeed": "string", "length": "double",
    "geometry": "array<struct<x:double,y:double>>", "bridge": "string", "ref": "string", "junction": "string", "tunnel": "string", "access": "string", "width": "string", "service": "string",
}
TAG_COLUMNS = ("lanes", "name", "highway", "maxspeed", "bridge", "ref", "junction", "tunnel", "access", "width", "service")
RESPONSE = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"
NETWORK_TYPES = {"all": None, "all_public": None, "bike": ["motorway", "motorway_link", "steps"], "drive": ["footway", "path", "steps", "cycleway", "pedestrian", "track", "service"], "drive_service": ["footway", "path", "steps", "cycleway", "pedestrian", "track"], "walk": ["motorway", "motorway_link", "cycleway"]}


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """The elements (type, id, lat, lon, nodes, tags) of response files, one JSON document a file."""
    return spark.read.schema(RESPONSE).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")


def network_from_elements(
    elements: DataFrame, network_type: str = "all", box: tuple[float, float, float, float] | None = None, area: DataFrame | None = None, simplify: bool = False, largest_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): an edge each way per pair of neighbouring nodes of each road, one way where it is oneway; lengths in metres on the sphere.

    ``box`` (west, south, east, north) or ``area`` (polygons in ``geometry``) keep what lies within. Members without a
    known place are left out, and with them their edges. Reloaded elements count once: the record of the smallest
    ``elem_id`` if there is one, else any. ``oneway`` is yes, true, 1, or -1 for against the order of the nodes;
    roundabouts are oneway. With ``simplify`` chains of nodes that are no junctions become one edge, and rings without a
    junction are left out; ``largest_only`` keeps the largest connected part. Unknown network types raise ValueError.
    """
    if network_type not in NETWORK_TYPES:
        raise ValueError(f"unknown network type {network_type!r}; use one of {', '.join(NETWORK_TYPES)}")
    first = lambda df, *keep: df.groupBy("id").agg(F.min_by(F.struct(*keep), "elem_id").alias("e")).select("id", "e.*") if "elem_id" in df.columns else df.select("id", *keep).dropDuplicates(["id"])
    placed = elements.where((F.col("type") == "node") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    if box is not None:
        placed = placed.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    places = first(placed, "lon", "lat").select(F.col("id").alias("osmid"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    if area is not None:
        inside = spatial_join(places, area.select(F.lit(1).alias("_area"), "geometry"), "_area").select("osmid").distinct()
        places = places.join(inside, "osmid", "left_semi")
    ways = first(elements.where((F.col("type") == "way") & (F.coalesce(F.col("tags")["highway"], F.lit("")) != "")), "nodes", "tags")
    if NETWORK_TYPES[network_type]:
        ways = ways.where(~F.col("tags")["highway"].isin(*NETWORK_TYPES[network_type]))
    if network_type == "all_public":
        ways = ways.where(F.coalesce(F.col("tags")["access"], F.lit("")) != "private")
    said = F.lower(F.coalesce(F.col("tags")["oneway"], F.when(F.col("tags")["junction"] == "roundabout", "yes"), F.lit("no")))
    way = F.when(said.isin("yes", "true", "1"), 1).when(said.isin("-1", "reverse"), -1).otherwise(0)
    steps = ways.where(F.size("nodes") > 1).select("id", "tags", way.alias("way"), F.posexplode(F.arrays_zip(F.expr("slice(nodes, 1, size(nodes) - 1)").alias("u"), F.expr("slice(nodes, 2, size(nodes) - 1)").alias("v"))).alias("at", "s")).select("id", "tags", "way", "at", "s.u", "s.v")
    ends = steps.join(places.select(F.col("osmid").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u").join(places.select(F.col("osmid").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
    degree = ends.select(F.explode(F.array("u", "v")).alias("osmid")).groupBy("osmid").agg(F.count("*").cast("int").alias("street_count"))
    there = F.struct("u", "v", "ux", "uy", "vx", "vy", F.lit(0).alias("back"))
    back = F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy"), F.lit(1).alias("back"))
    both = ends.select("id", "tags", "way", "at", F.explode(F.when(F.col("way") == 1, F.array(there)).when(F.col("way") == -1, F.array(back)).otherwise(F.array(there, back))).alias("e")).select("id", "tags", "way", "at", "e.*")
    line = F.array(F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")), F.struct(F.col("vx").alias("x"), F.col("vy").alias("y")))
    key = (F.row_number().over(Window.partitionBy("u", "v").orderBy("id", "at", "back")) - 1).alias("key")
    tags = [F.col("tags")[k].alias(k) for k in TAG_COLUMNS]
    edges = both.select("u", "v", key, F.col("id").cast("string").alias("osmid"), (F.col("way") != 0).alias("oneway"), haversine(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")).alias("length"), line.alias("geometry"), *tags)
    nodes = places.join(degree, "osmid")
    if largest_only:
        edges = durable(edges)
        part = connected_parts(edges)
        # The largest part by its nodes, of equal ones that of the smallest node: one row.
        best = part.groupBy("part").agg(F.count("*").alias("n")).agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("part"))
        kept = part.join(F.broadcast(best), "part", "left_semi").select("osmid")
        nodes, edges = nodes.join(kept, "osmid", "left_semi"), edges.join(kept.withColumnRenamed("osmid", "u"), "u", "left_semi")
    if simplify:
        edges = simplify_edges(edges)
        nodes = nodes.join(edges.select(F.explode(F.array("u", "v")).alias("osmid")).distinct(), "osmid", "left_semi")
    return pad_schema(nodes, NODE_COLUMNS), pad_schema(edges, EDGE_COLUMNS)


def connected_parts(edges: DataFrame) -> DataFrame:
    """(osmid, part): the smallest node of the connected part of each end of an edge.

    Labels are lowered to the least among the neighbours and followed to the labels of their labels, so that the rounds grow
    with the logarithm of the longest path; each round is written to the checkpoint folder.
    """
    pairs = durable(edges.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    label = durable(pairs.groupBy(F.col("a").alias("osmid")).agg(F.least(F.first("a"), F.min("b")).alias("part")))
    while True:
        near = pairs.join(label.select(F.col("osmid").alias("b"), "part"), "b").groupBy(F.col("a").alias("osmid")).agg(F.min("part").alias("near"))
        lower = label.join(near, "osmid").select("osmid", F.least("part", "near").alias("part"), F.col("part").alias("was"))
        up = label.select(F.col("osmid").alias("_o"), F.col("part").alias("_p"))
        new = durable(lower.join(up, F.col("part") == F.col("_o")).select("osmid", F.least("part", "_p").alias("part"), "was"))
        label = new.drop("was")
        if new.where("part <> was").isEmpty():
            return label


def simplify_edges(edges: DataFrame) -> DataFrame:
    """Edges between junctions: chains over nodes of two neighbours, passed straight on each way, become one edge.

    A node is passed if it has no loop, an edge in and one out at least, and two neighbours by two or four edges. Each
    edge points to the one that follows it, and takes over where that one points to in each round (pointer doubling), so the
    rounds grow with the logarithm of the longest chain. The edge has the summed length, the joined line and osmid, and
    the tags of its first part, with other values of its parts behind them, all as ``a;b``. Rings without a junction are left out.
    """
    edges = durable(edges.withColumn("_id", F.concat_ws(":", "u", "v", "key")))
    sides = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("o"), F.lit(1).alias("out")), F.struct(F.col("v").alias("n"), F.col("u").alias("o"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    kind = sides.groupBy("n").agg(F.countDistinct("o").alias("near"), F.count("*").alias("d"), F.sum("out").alias("outs"), F.max((F.col("n") == F.col("o")).cast("int")).alias("loop"))
    passed = durable(kind.where("loop = 0 and outs > 0 and outs < d and near = 2 and d in (2, 4)").select("n"))
    names = ["osmid", *TAG_COLUMNS]
    own = edges.select("_id", "u", "v", "oneway", "length", "geometry", *[F.array_compact(F.array(c)).alias(c) for c in names])
    onward = edges.join(passed, F.col("u") == F.col("n"), "left_semi").select(F.col("u").alias("_n"), F.col("v").alias("_to"), F.col("_id").alias("next"))
    chain = durable(own.join(onward, (F.col("v") == F.col("_n")) & (F.col("u") != F.col("_to")), "left").drop("_n", "_to"))
    starts = durable(edges.join(passed, F.col("u") == F.col("n"), "left_anti").select("_id"))
    while True:
        if chain.join(starts, "_id", "left_semi").where("next is not null").isEmpty():
            break
        after = chain.select(F.col("_id").alias("next"), F.col("v").alias("_v"), F.col("length").alias("_length"), F.col("geometry").alias("_geometry"), F.col("next").alias("_next"), *[F.col(c).alias(f"_{c}") for c in names])
        joined = chain.join(after, "next", "left")
        more = F.col("_v").isNotNull()
        lists = [F.when(more, F.array_distinct(F.concat(c, f"_{c}"))).otherwise(F.col(c)).alias(c) for c in names]
        line = F.when(more, F.concat("geometry", F.expr("slice(_geometry, 2, size(_geometry))"))).otherwise(F.col("geometry"))
        chain = durable(joined.select("_id", "u", F.coalesce("_v", "v").alias("v"), "oneway", (F.col("length") + F.coalesce("_length", F.lit(0.0))).alias("length"), line.alias("geometry"), F.col("_next").alias("next"), *lists))
    out = chain.join(starts, "_id", "left_semi")
    key = (F.row_number().over(Window.partitionBy("u", "v").orderBy("_id")) - 1).alias("key")
    return out.select("u", "v", key, "oneway", "length", "geometry", *[F.when(F.size(c) > 0, F.array_join(c, ";")).alias(c) for c in names])
