"""Queries p1 to p6 over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygrain.operators import imputation, nested, packed, proximity, references, units
from citygrain.sources.tables import table

PACKED_FIELDS = ["maxspeed", "lanes", "osmid", "highway"]
HEADS = ("pobtot", "pobfem", "pobmas")
FEATURES = ["p_0a2", "p_6a11", "p_12a14", "p_18a24", "p_60ymas", "pob0_14", "pob15_64", "pob65_mas", *HEADS]


def p1_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantity of edges.maxspeed and edges.width in km/h or metres, with where its unit came from."""
    extracts = table(spark, sf_dir, "extracts")
    defaults = units.source_defaults(extracts, "city", "remarks")
    return units.quantities(table(spark, sf_dir, "edges"), "edge_id", "city", {"maxspeed": "speed", "width": "length"}, defaults, source_rows=extracts.count())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with at least one quantity in another unit than km/h or metre."""
    return units.in_foreign_units(p1_quantities(spark, sf_dir), "edge_id")


def _locations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    nodes, elements = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "overpass_elements")
    both = nodes.select(F.col("osmid").alias("id"), F.col("x").alias("lon"), F.col("y").alias("lat"))
    both = both.unionByName(elements.where(F.col("type") == "node").select("id", "lon", "lat"))
    return both, nodes.count() + elements.count()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different locations at most 20 m apart."""
    points, rows = _locations(spark, sf_dir)
    return proximity.near_pairs(points, 20.0, rows)


def p2_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone whose polygon holds each location."""
    points, rows = _locations(spark, sf_dir)
    return proximity.locate(points, table(spark, sf_dir, "zones"), "cve_ageb", "geometry", rows)


def p3_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks with missing head counts and zone codes filled, fills marked with their method."""
    return imputation.fill_blocks(table(spark, sf_dir, "blocks"), FEATURES, HEADS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that were filled."""
    return imputation.filled_fields(p3_filled(spark, sf_dir), [*HEADS, "cve_ageb"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of packed fields, one row per value with its place."""
    return packed.split_values(table(spark, sf_dir, "edges"), "edge_id", PACKED_FIELDS)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, elements = table(spark, sf_dir, "edges"), table(spark, sf_dir, "overpass_elements")
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("ref_id")) for c in "uv"]))
    refs = edges.select(F.lit("edges").alias("table_name"), ends.alias("e"), F.col("edge_id").alias("row_id"), "loaded_at").select("table_name", "e.field_name", "row_id", "e.ref_id", "loaded_at")
    members = elements.select(F.lit("overpass_elements").alias("table_name"), F.lit("nodes").alias("field_name"), F.col("elem_id").alias("row_id"), F.explode(F.array_distinct("nodes")).alias("ref_id"), "loaded_at")
    parents = table(spark, sf_dir, "nodes").select(F.lit("edges").alias("table_name"), F.col("osmid").alias("ref_id"), "loaded_at")
    parents = parents.unionByName(elements.where(F.col("type") == "node").select(F.lit("overpass_elements").alias("table_name"), F.col("id").alias("ref_id"), "loaded_at"))
    removed = table(spark, sf_dir, "removed_ids").select(F.when(F.col("table_name") == "nodes", "edges").otherwise(F.col("table_name")).alias("table_name"), "ref_id", "removed_at")
    return references.orphans(refs.unionByName(members), parents, removed, 2 * edges.count() + (elements.agg(F.sum(F.size("nodes"))).first()[0] or 0))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to nodes that did not exist when the referring row was loaded."""
    period = F.date_format("loaded_at", "yyyy-MM").alias("period")
    return _orphans(spark, sf_dir).select("table_name", "field_name", "row_id", "ref_id", period)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field, month and status."""
    return references.orphan_report(_orphans(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node references of ways with a road tag."""
    flat = nested.flatten_responses(table(spark, sf_dir, "overpass_responses"), "response_id", "body", "nodes")
    return flat.where(F.col("highway").isNotNull()).drop("highway").distinct()


def p6_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways of all responses."""
    return nested.flatten_responses(table(spark, sf_dir, "overpass_responses"), "response_id", "body", "ways")


def p6_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of the ways of all responses."""
    return nested.flatten_responses(table(spark, sf_dir, "overpass_responses"), "response_id", "body", "tags")


QUERIES = {f.__name__: f for f in (p1_found, p1_quantities, p2_found, p2_zones, p3_found, p3_filled, p4_found, p5_found, p5_report, p6_found, p6_ways, p6_tags)}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _units_sql(tail: str) -> str:
    plain = lambda c: f"translate(lower({c}), {_text(units.ACCENTED)}, {_text(units.PLAIN)})"
    aliases = ", ".join(f"({_text(d)}, {_text(a)}, {_text(u)}, {f!r}::DOUBLE)" for d, u, f, _, names in units.UNITS for a in names.split())
    clean = plain("raw")
    for pattern in (units.CONDITION, units.TIME_OF_DAY, units.COUNT):
        clean = f"regexp_replace({clean}, {_text(pattern)}, ' ', 'g')"
    unquoted = f"regexp_replace({clean}, {_text(chr(91) + chr(92) + '[' + chr(92) + '](){}' + chr(34) + chr(39) + chr(93))}, ' ', 'g')"
    said = {d: "|".join(s for dd, s in (("speed", r"kilometres per hour|miles per hour|milles a l'heure|metres per second|km por hora|km/h|mi/h|mph|knots"), ("length", r"centimetros|centimetres|dezimetern|metres|metros|pies|feet|ft|cm")) if dd == d) for d in ("speed", "length")}
    last = lambda d: f"list_last(regexp_extract_all({'' if d == 'speed' else 'replace('}{plain('remarks')}{'' if d == 'speed' else ', $$metres per second$$, $$$$)'}, {_text(chr(92) + 'b(' + said[d] + ')' + chr(92) + 'b')}))"
    return rf"""
WITH alias(dimension, alias, unit, factor) AS (VALUES {aliases}),
said AS (SELECT city, 'speed' AS dimension, {last('speed')} AS word FROM extracts UNION ALL
  SELECT city, 'length', {last('length')} FROM extracts WHERE remarks IS NOT NULL),
defaults AS (SELECT s.city, s.dimension, a.unit FROM said s JOIN alias a ON a.dimension = s.dimension AND a.alias = replace(s.word, ' ', '')),
entries AS (SELECT edge_id, city, 'maxspeed' AS field_name, 'speed' AS dimension, maxspeed AS raw FROM edges UNION ALL
  SELECT edge_id, city, 'width', 'length', width FROM edges),
texts AS (SELECT edge_id, city, field_name, dimension, CASE WHEN dimension <> 'length' OR regexp_matches(raw, {_text(chr(94) + chr(92) + 's*[' + chr(92) + '[({"' + chr(39) + ']')}) THEN {unquoted} ELSE {clean} END AS body
  FROM entries WHERE regexp_matches(raw, '\d')),
pieces AS (SELECT edge_id, city, field_name, dimension, seq, list_extract(found, seq) AS piece FROM (
  SELECT *, unnest(range(1, len(found) + 1)) AS seq FROM (SELECT *, regexp_extract_all(body, {_text(units.QUANTITY)}) AS found FROM texts))),
parts AS (SELECT *, TRY_CAST(replace(regexp_extract(piece, '(\d+(?:[.,]\d+)?)', 1), ',', '.') AS DOUBLE) AS number,
  TRY_CAST(regexp_extract(piece, {_text("(?:feet|foot|ft|')" + chr(92) + ".?" + chr(92) + "s*(" + chr(92) + "d+(?:" + chr(92) + "." + chr(92) + "d+)?)" + chr(92) + 's*(?:inches|inch|in|")$')}, 1) AS DOUBLE) AS inches,
  regexp_replace(regexp_extract(piece, {_text(chr(92) + "d" + chr(92) + "s*([a-z'" + chr(34) + "].*)$")}, 1), '[\s.]', '', 'g') AS suffix,
  regexp_replace(regexp_extract(piece, '^([a-z][a-z./]*)\s+\d', 1), '[\s.]', '', 'g') AS prefix FROM pieces),
named AS (SELECT p.edge_id, p.field_name, p.seq, p.number, p.inches, p.dimension,
  coalesce(CASE WHEN p.inches IS NOT NULL THEN 'ft' ELSE s.unit END, f.unit) AS text_unit, d.unit AS source_unit,
  CASE p.dimension WHEN 'speed' THEN 'km/h' ELSE 'm' END AS base_unit
  FROM parts p LEFT JOIN alias s ON s.dimension = p.dimension AND s.alias = p.suffix
  LEFT JOIN alias f ON f.dimension = p.dimension AND f.alias = p.prefix
  LEFT JOIN defaults d ON d.dimension = p.dimension AND d.city = p.city),
final AS (SELECT n.*, coalesce(text_unit, source_unit, base_unit) AS unit,
  CASE WHEN text_unit IS NOT NULL THEN 'text' WHEN source_unit IS NOT NULL THEN 'source' ELSE 'base' END AS unit_from FROM named n)
{tail}"""


_DISTANCE = "2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_PLACES = """place AS (SELECT DISTINCT id, lon, lat FROM (SELECT osmid AS id, x AS lon, y AS lat FROM nodes UNION ALL
  SELECT id, lon, lat FROM overpass_elements WHERE type = 'node') WHERE id IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL
  AND NOT isnan(lon) AND NOT isnan(lat) AND abs(lon) <= 180 AND abs(lat) <= 90 AND NOT (lon = 0 AND lat = 0))"""
_REFS = """
ref AS (SELECT 'edges' AS table_name, 'u' AS field_name, edge_id AS row_id, u AS ref_id, loaded_at FROM edges UNION ALL
  SELECT 'edges', 'v', edge_id, v, loaded_at FROM edges UNION ALL
  SELECT 'overpass_elements', 'nodes', elem_id, unnest(nodes), loaded_at FROM overpass_elements),
parent AS (SELECT 'edges' AS table_name, osmid AS ref_id, min(loaded_at) AS since FROM nodes GROUP BY osmid UNION ALL
  SELECT 'overpass_elements', id, min(loaded_at) FROM overpass_elements WHERE type = 'node' GROUP BY id),
gone AS (SELECT CASE table_name WHEN 'nodes' THEN 'edges' ELSE table_name END AS table_name, ref_id, min(removed_at) AS till FROM removed_ids GROUP BY 1, 2),
orphan AS (SELECT DISTINCT r.*, CASE WHEN p.ref_id IS NULL THEN 'missing' WHEN p.since > r.loaded_at THEN 'late' ELSE 'deleted' END AS status
  FROM ref r LEFT JOIN parent p ON p.table_name = r.table_name AND p.ref_id = r.ref_id
  LEFT JOIN gone g ON g.table_name = r.table_name AND g.ref_id = r.ref_id
  WHERE r.ref_id IS NOT NULL AND (p.ref_id IS NULL OR p.since > r.loaded_at OR g.till <= r.loaded_at))"""


def _p3_sql() -> str:
    head = lambda c: f"CASE WHEN NOT isnan({c}) AND {c} >= 0 AND {c} <= {imputation.MAX_HEADS} AND {c} = floor({c}) THEN {c} END"
    bare = r"regexp_replace(upper(cve_ageb), '[\s-]', '', 'g')"
    parts = [f"SELECT block_id, '{h}' AS field_name FROM w WHERE {h} IS NULL AND (z_{h} > 0 OR b_{h} > 0)" for h in HEADS]
    counts = ", ".join(f"count({h}) OVER (PARTITION BY zone, census_year) AS z_{h}, count({h}) OVER (PARTITION BY cvegeo) AS b_{h}" for h in HEADS)
    return f"""WITH c AS (SELECT block_id, cvegeo, left(trim(cvegeo), 13) AS zone, census_year, {", ".join(f"{head(h)} AS {h}" for h in HEADS)},
  CASE WHEN regexp_matches({bare}, '{imputation.CODE}') AND NOT regexp_matches({bare}, '^0+$') THEN {bare} END AS code FROM blocks),
w AS (SELECT *, {counts}, count(code) OVER (PARTITION BY zone) AS z_code FROM c)
{" UNION ALL ".join(parts)} UNION ALL SELECT block_id, 'cve_ageb' FROM w WHERE code IS NULL AND z_code > 0"""


def _p3_filled_sql() -> str:
    """K-prototypes round by round, then medians and modes of cluster, zone and block."""
    head = lambda c: f"CASE WHEN NOT isnan({c}) AND {c} >= 0 AND {c} <= {imputation.MAX_HEADS} AND {c} = floor({c}) THEN {c} END"
    bare = r"regexp_replace(upper(cve_ageb), '[\s-]', '', 'g')"
    names = [c for c in FEATURES if c not in HEADS] + list(HEADS)
    cats = ["substr(zone, 1, 2)", "substr(zone, 13, 1)", "census_year"]
    k, gamma = imputation.CLUSTERS, imputation.GAMMA
    fields = ", ".join(f"ln(1 + {head(c)}) AS f{i}" for i, c in enumerate(names))
    known = " + ".join(f"CAST(f{i} IS NOT NULL AS INTEGER)" for i in range(len(names)))
    steps = [f"""c AS (SELECT block_id, cvegeo, CASE WHEN length(trim(cvegeo)) >= 13 THEN upper(left(trim(cvegeo), 13)) END AS zone, census_year, {", ".join(f"{head(h)} AS {h}" for h in HEADS)},
  CASE WHEN regexp_matches({bare}, '{imputation.CODE}') AND NOT regexp_matches({bare}, '^0+$') THEN {bare} END AS code, {fields} FROM blocks)""",
        f"r AS (SELECT *, row_number() OVER () AS id, {', '.join(f'{c} AS c{i}' for i, c in enumerate(cats))}, ({' + '.join(f'coalesce(f{i}, 0)' for i in range(len(names)))}) / nullif({known}, 0) AS m FROM c)",
        "span AS (SELECT coalesce(min(m), 0) AS lo, coalesce(max(m), 0) AS hi FROM r)",
        f"a0 AS (SELECT r.id, {' + '.join(f'CAST(coalesce(m, 0) > lo + (hi - lo) * {i} / {k} AS INTEGER)' for i in range(1, k))} AS cluster FROM r, span)"]
    for n in range(imputation.ROUNDS):
        means = ", ".join(f"avg(f{i}) AS n{i}" for i in range(len(names)))
        modes = [f"(SELECT cluster, arg_min(v, (-n, v)) AS m{i} FROM (SELECT cluster, c{i} AS v, count(*) AS n FROM a{n} JOIN r USING (id) WHERE c{i} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)" for i in range(len(cats))]
        steps.append(f"z{n} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS place FROM (SELECT cluster, {means} FROM a{n} JOIN r USING (id) GROUP BY 1) {' '.join(f'LEFT JOIN {m} USING (cluster)' for m in modes)})")
        terms = [f"coalesce((f{i} - n{i}) * (f{i} - n{i}), 0)" for i in range(len(names))] + [f"CASE WHEN m{i} IS NULL OR c{i} IS NOT DISTINCT FROM m{i} THEN 0 ELSE {gamma} END" for i in range(len(cats))]
        steps.append(f"a{n + 1} AS MATERIALIZED (SELECT id, arg_min(place, (d, place)) AS cluster FROM (SELECT r.id, place, {' + '.join(terms)} AS d FROM r, z{n}) GROUP BY id)")
    steps.append(f"b AS (SELECT r.*, a.cluster, CASE WHEN length(code) = 13 THEN code ELSE left(zone, 9) || code END AS long FROM r JOIN a{imputation.ROUNDS} a USING (id))")
    for name, on in (("cluster", "zone, census_year, cluster"), ("zone", "zone, census_year"), ("block", "cvegeo")):
        steps.append(f"h_{name} AS (SELECT {on}, {', '.join(f'quantile_cont({h}, 0.5) AS {h}_{name}' for h in HEADS)} FROM b WHERE {on.split(',')[0]} IS NOT NULL GROUP BY ALL)")
    for name, on in (("cluster", "zone, cluster"), ("zone", "zone")):
        steps.append(f"k_{name} AS (SELECT {on}, arg_min(long, (-n, long)) AS code_{name} FROM (SELECT {on}, long, count(*) AS n FROM b WHERE zone IS NOT NULL AND long IS NOT NULL GROUP BY ALL) GROUP BY {on})")

    def field(name: str, found: list[str], alias: str) -> str:
        method = " ".join(f"WHEN {v} IS NOT NULL THEN '{v.rsplit('_', 1)[1]}'" for v in found)
        return f"coalesce(b.{name}, {', '.join(found)}) AS {alias}, b.{name} IS NULL AND coalesce({', '.join(found)}) IS NOT NULL AS {alias}_filled, CASE WHEN b.{name} IS NOT NULL THEN 'observed' {method} ELSE 'unfillable' END AS {alias}_method"

    columns = [field(h, [f"{h}_{n}" for n in ("cluster", "zone", "block")], h) for h in HEADS] + [field("code", ["code_cluster", "code_zone"], "cve_ageb")]
    return f"""WITH {", ".join(steps)} SELECT b.block_id, b.cvegeo, b.census_year, CAST(b.cluster AS INTEGER) AS cluster, {", ".join(columns)} FROM b
LEFT JOIN h_cluster hc ON hc.zone = b.zone AND hc.census_year = b.census_year AND hc.cluster = b.cluster LEFT JOIN h_zone hz ON hz.zone = b.zone AND hz.census_year = b.census_year
LEFT JOIN h_block hb ON hb.cvegeo = b.cvegeo LEFT JOIN k_cluster kc ON kc.zone = b.zone AND kc.cluster = b.cluster LEFT JOIN k_zone kz ON kz.zone = b.zone"""


def _p4_sql() -> str:
    """Separators that do not separate are masked, then the entry is split at the rest."""
    steps = [r"""regexp_replace(trim(raw), '^[\[({](.*)[\])}]$', '\1')""", r"""regexp_replace({}, '([0-9]),([0-9]+ *[A-Za-z])', '\1¤\2', 'g')"""]
    steps += [r"""regexp_replace({}, '(@ *\([^();]*);', '\1§', 'g')"""] * 4
    steps += [r"""regexp_replace({}, '([a-z] *)/( *(?:h|hr|s)\b)', '\1‡\2', 'gi')""", r"""regexp_replace({}, '([''"])[ \t]+([''"])', '\1;\2', 'g')"""]
    masked = steps[0]
    for step in steps[1:]:
        masked = step.replace("{}", masked, 1)
    item = r"""replace(replace(replace(trim(trim(trim(x, ' '), '"'''), ' '), '¤', ','), '§', ';'), '‡', '/')"""
    fields = " UNION ALL ".join(f"SELECT edge_id, '{f}' AS field_name, {f} AS raw FROM edges" for f in PACKED_FIELDS)
    return f"""WITH e AS ({fields}), s AS (SELECT edge_id, field_name, [{item} FOR x IN regexp_split_to_array({masked}, '[;|,/\\t]')] AS items FROM e WHERE raw IS NOT NULL),
p AS (SELECT edge_id, field_name, unnest(range(1, len(items) + 1)) AS pos, items FROM s WHERE len([x FOR x IN items IF x <> '']) > 1)
SELECT edge_id, field_name, CAST(pos AS INTEGER) AS pos, items[pos] AS item FROM p WHERE items[pos] <> ''"""


_P6_WAYS = r"""WITH RECURSIVE doc AS (SELECT response_id, CAST(body AS JSON) AS j FROM overpass_responses WHERE json_valid(body) UNION
  SELECT d.response_id, CAST(t.value ->> '$' AS JSON) FROM doc d, json_tree(d.j) t WHERE t.type = 'VARCHAR' AND regexp_matches(t.value ->> '$', '^[\s"]*[\[{]')
  AND json_valid(t.value ->> '$') AND NOT regexp_matches(t.fullkey, '[.]tags[.]|[.]tags\[[0-9]+\][.]')),
obj AS (SELECT d.response_id, t.value AS o, t.fullkey FROM doc d, json_tree(d.j) t WHERE t.type = 'OBJECT'),
way AS (SELECT DISTINCT response_id, way_id, nodes, tags, CASE WHEN json_type(tags) = 'OBJECT' THEN tags ->> '$.highway' ELSE
    list_last([coalesce(x ->> '$.v', x ->> '$.value') FOR x IN CAST(tags AS JSON[]) IF coalesce(x ->> '$.k', x ->> '$.key') = 'highway']) END AS road
  FROM (SELECT response_id, TRY_CAST(o ->> '$.id' AS BIGINT) AS way_id, o -> '$.nodes' AS nodes, o -> '$.tags' AS tags FROM obj
    WHERE lower(o ->> '$.type') = 'way' OR ((o -> '$.type') IS NULL AND regexp_matches(fullkey, '[.]way\[[0-9]+\]$'))) WHERE way_id IS NOT NULL)"""
_P6_SQL = _P6_WAYS + r""",
road AS (SELECT response_id, way_id, CASE WHEN json_type(nodes) = 'ARRAY' THEN CAST(nodes AS JSON[]) ELSE [nodes] END AS items FROM way WHERE nodes IS NOT NULL AND trim(coalesce(road, '')) <> ''),
item AS (SELECT response_id, way_id, unnest(range(1, len(items) + 1)) AS pos, items FROM road)
SELECT DISTINCT response_id, way_id, CAST(pos AS INTEGER) AS pos, TRY_CAST(coalesce(CASE WHEN json_type(items[pos]) = 'OBJECT' THEN items[pos] ->> '$.ref' END, items[pos] ->> '$') AS BIGINT) AS node_id FROM item
WHERE TRY_CAST(coalesce(CASE WHEN json_type(items[pos]) = 'OBJECT' THEN items[pos] ->> '$.ref' END, items[pos] ->> '$') AS BIGINT) IS NOT NULL"""
_P6_TAGS_SQL = _P6_WAYS + r""",
pair AS (SELECT response_id, way_id, k AS tag_key, json_extract(tags, '$."' || k || '"') AS v FROM (SELECT response_id, way_id, tags, unnest(json_keys(tags)) AS k FROM way WHERE json_type(tags) = 'OBJECT') UNION ALL
  SELECT response_id, way_id, coalesce(x ->> '$.k', x ->> '$.key'), coalesce(x -> '$.v', x -> '$.value') FROM (SELECT response_id, way_id, unnest(CAST(tags AS JSON[])) AS x FROM way WHERE json_type(tags) = 'ARRAY'))
SELECT DISTINCT response_id, way_id, tag_key, v ->> '$' AS tag_value FROM pair WHERE tag_key IS NOT NULL AND json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL')"""


ORACLES = {
    "p1_found": _units_sql("SELECT DISTINCT edge_id, field_name FROM final WHERE unit <> base_unit"),
    "p1_quantities": _units_sql("SELECT f.edge_id, f.field_name, CAST(f.seq AS INTEGER) AS seq, f.number, f.unit, f.unit_from, f.number * a.factor + 0.0 + coalesce(f.inches * 0.0254, 0.0) AS value, f.base_unit FROM final f JOIN (SELECT DISTINCT dimension, unit, factor FROM alias) a ON a.dimension = f.dimension AND a.unit = f.unit"),
    "p2_found": f"""WITH {_PLACES}, cell AS (SELECT *, CAST(floor(lat * 4000) AS BIGINT) AS row FROM place),
near AS (SELECT id, lon, lat, row + d AS row FROM cell, (VALUES (-1), (0), (1)) AS s(d))
SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM cell a JOIN near b ON a.row = b.row AND a.id < b.id WHERE {_DISTANCE} <= 20""",
    "p2_zones": f"""WITH {_PLACES}, seg AS (SELECT cve_ageb, r, i, shift, r[i].x + shift AS x1, r[i].y AS y1, r[i + 1].x + shift AS x2, r[i + 1].y AS y2 FROM (
  SELECT cve_ageb, r, unnest(range(1, len(r))) AS i FROM (SELECT cve_ageb, unnest(geometry) AS r FROM zones)), (VALUES (0.0), (-360.0), (360.0)) AS s(shift)),
box AS (SELECT cve_ageb, shift, min(x1) AS x0, max(x1) AS xm, min(y1) AS y0, max(y1) AS ym FROM seg GROUP BY 1, 2),
hit AS (SELECT p.id, p.lon, p.lat, b.cve_ageb, b.shift FROM place p JOIN box b ON p.lon BETWEEN b.x0 AND b.xm AND p.lat BETWEEN b.y0 AND b.ym),
test AS (SELECT h.id, h.lon, h.lat, h.cve_ageb, h.shift,
  sum(CASE WHEN (s.y1 > h.lat) <> (s.y2 > h.lat) AND ((s.x2 - s.x1) * (h.lat - s.y1) - (s.y2 - s.y1) * (h.lon - s.x1) > 0) = (s.y2 > s.y1) AND (s.x2 - s.x1) * (h.lat - s.y1) - (s.y2 - s.y1) * (h.lon - s.x1) <> 0 THEN 1 ELSE 0 END) AS crossed,
  max(CASE WHEN (s.x2 - s.x1) * (h.lat - s.y1) - (s.y2 - s.y1) * (h.lon - s.x1) = 0 AND h.lon BETWEEN least(s.x1, s.x2) AND greatest(s.x1, s.x2) AND h.lat BETWEEN least(s.y1, s.y2) AND greatest(s.y1, s.y2) THEN 1 ELSE 0 END) AS touched
  FROM hit h JOIN seg s ON s.cve_ageb = h.cve_ageb AND s.shift = h.shift GROUP BY ALL)
SELECT id, lon, lat, min(cve_ageb) AS cve_ageb FROM test WHERE crossed % 2 = 1 OR touched = 1 GROUP BY id, lon, lat""",
    "p3_found": _p3_sql(),
    "p3_filled": _p3_filled_sql(),
    "p4_found": _p4_sql(),
    "p6_found": _P6_SQL,
    "p6_ways": _P6_WAYS + " SELECT DISTINCT response_id, way_id, CAST(CASE json_type(nodes) WHEN 'ARRAY' THEN json_array_length(nodes) WHEN 'OBJECT' THEN 0 WHEN 'NULL' THEN 0 ELSE CASE WHEN nodes IS NULL THEN 0 ELSE 1 END END AS BIGINT) AS n_nodes, CASE WHEN trim(coalesce(road, '')) <> '' THEN road END AS highway FROM way",
    "p6_tags": _P6_TAGS_SQL,
    "p5_found": f"WITH {_REFS} SELECT table_name, field_name, row_id, ref_id, strftime(loaded_at, '%Y-%m') AS period FROM orphan",
    "p5_report": f"WITH {_REFS} SELECT table_name, field_name, strftime(loaded_at, '%Y-%m') AS period, status, count(*) AS n_refs, count(DISTINCT ref_id) AS n_targets FROM orphan GROUP BY ALL",
}
