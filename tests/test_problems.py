"""The operators behind p1 to p6 against brute force and on awkward input."""

import datetime as dt
import json
import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citygrain.operators import buffers, imputation, nested, packed, proximity, references, skew, units

T = dt.datetime


# ---------------------------------------------------------------- units

EDGES = "edge_id long, city string, maxspeed string, width string, lanes string"
CITIES = [("A", "Limits in miles per hour unless noted; widths in metres."), ("B", None), ("C", "Los anchos sin sufijo van en centímetros."), ("D", "A few crews work in miles per hour and then write the unit; plain figures are km/h.")]


UNIT_CASES = [
    ("B", "maxspeed", "50", [("km/h", "base", 50.0)]),
    ("A", "maxspeed", "50", [("mph", "source", 80.4672)]),
    ("D", "maxspeed", "50", [("km/h", "source", 50.0)]),
    ("A", "maxspeed", "50 km / h", [("km/h", "text", 50.0)]),
    ("B", "maxspeed", "mph 30", [("mph", "text", 48.28032)]),
    ("B", "maxspeed", "13,9 m/s", [("m/s", "text", 50.04)]),
    ("B", "maxspeed", "2.8 m s-1", [("m/s", "text", 10.08)]),
    ("B", "maxspeed", "10 m.p.h.", [("mph", "text", 16.09344)]),
    ("B", "maxspeed", "35 miles per hour", [("mph", "text", 56.32704)]),
    ("B", "maxspeed", "5 nudos", [("knot", "text", 9.26)]),
    ("B", "maxspeed", "30 @ (Mo-Fr 07:00-09:30)", [("km/h", "base", 30.0)]),
    ("B", "maxspeed", "['20 mph', '50']", [("mph", "text", 32.18688), ("km/h", "base", 50.0)]),
    ("B", "maxspeed", "signals", []),
    ("B", "maxspeed", "", []),
    ("B", "maxspeed", None, []),
    ("B", "width", "16'9\"", [("ft", "text", 16 * 0.3048 + 9 * 0.0254)]),
    ("B", "width", "20 ft 9 in", [("ft", "text", 20 * 0.3048 + 9 * 0.0254)]),
    ("B", "width", "28′ 6″", [("ft", "text", 28 * 0.3048 + 6 * 0.0254)]),
    ("B", "width", "290\"", [("in", "text", 290 * 0.0254)]),
    ("B", "width", "10,5 m", [("m", "text", 10.5)]),
    ("B", "width", "8 Ft.", [("ft", "text", 8 * 0.3048)]),
    ("B", "width", "9.0 M", [("m", "text", 9.0)]),
    ("C", "width", "350", [("cm", "source", 3.5)]),
    ("B", "width", "2 lanes", []),
    ("B", "width", "9.5 yd", [("yd", "text", 9.5 * 0.9144)]),
    ("B", "width", "3 furlongs", [("m", "base", 3.0)]),
    (None, "width", "3", [("m", "base", 3.0)]),
]


def test_units(spark):
    rows = [{"edge_id": i, "city": city, "maxspeed": None, "width": None, "lanes": "2"} | {field: raw} for i, (city, field, raw, _) in enumerate(UNIT_CASES)]
    sources = spark.createDataFrame(CITIES, "city string, remarks string")
    found = units.quantities(spark.createDataFrame(rows, EDGES), "edge_id", "city", {"maxspeed": "speed", "width": "length"}, units.source_defaults(sources, "city", "remarks")).orderBy("edge_id", "seq").collect()
    for i, (_, field, raw, expected) in enumerate(UNIT_CASES):
        got = [(r["unit"], r["unit_from"], round(r["value"], 6)) for r in found if r["edge_id"] == i]
        assert got == [(a, b, round(c, 6)) for a, b, c in expected], (field, raw)


def test_units_column_offset_and_empty(spark):
    table = spark.createDataFrame([(1, None, "20", "mph"), (1, None, "20", "mph")], "edge_id long, city string, v string, u string")
    none = spark.createDataFrame([], "city string, dimension string, default_unit string")
    got = units.quantities(table, "edge_id", "city", {"v": "speed"}, none, {"v": "u"}).collect()
    assert [(r["unit_from"], round(r["value"], 5)) for r in got] == [("column", 32.18688)] * 2
    assert units.in_foreign_units(units.quantities(table.limit(0), "edge_id", "city", {"v": "speed"}, none), "edge_id").count() == 0


# ---------------------------------------------------------------- packed


def split_plainly(text):
    """Character by character: the same rules as the kernel, one entry at a time."""
    import re

    if text is None or not text.strip():
        return [""]
    s = text.strip()
    quotes = [q for q in '"' + "'" if s.count(q) % 2 == 0 and s.count(q)]
    if "'" in quotes and not re.search(r"""(^|[\[({;,|/])\s*'""", s[: s.index("'") + 1]):
        quotes.remove("'")

    def outer(v):
        if len(v) > 1 and v[0] in "[({" and v[-1] == {"[": "]", "(": ")", "{": "}"}[v[0]]:
            depth, inside = 0, None
            for i, c in enumerate(v):
                inside = None if c == inside else (c if inside is None and c in quotes else inside)
                if inside is None:
                    depth += (c in "[({") - (c in "])}")
                    if depth == 0 and i < len(v) - 1:
                        return v
            return v[1:-1]
        return v

    s = outer(s)
    parts, now, inside, condition, closed = [], "", None, False, False
    for i, c in enumerate(s):
        if inside:
            inside = None if c == inside else inside
            closed = inside is None
            now += c
            continue
        if condition:
            condition = c != ")"
            now += c
            continue
        if c in quotes:
            if closed and now and now[-1].isspace() and now.rstrip() and now.rstrip()[-1] in quotes:
                parts.append(now)
                now = ""
            inside = c
            now += c
            continue
        if c == "(" and now.rstrip().endswith("@"):
            condition = True
        cut = c in ";|\t\n"
        if c == ",":
            cut = not (re.search(r"(^|[^\d,.])\d+$", s[:i]) and re.match(r"\d+\s*[A-Za-z]", s[i + 1 :]))
        if c == "/":
            a, b = re.search(r"([A-Za-z]+)\s*$", s[:i]), re.match(r"\s*([A-Za-z]+)", s[i + 1 :])
            cut = not (a and b and a[1].lower() in packed.UNIT_BEFORE and b[1].lower() in packed.UNIT_AFTER)
        if cut:
            parts.append(now)
            now = ""
        else:
            now += c
    parts.append(now)
    out = []
    for p in parts:
        p = p.strip()
        for _ in range(2):
            if len(p) > 1 and p[0] in "\"'" and p[0] == p[-1]:
                p = p[1:-1].strip()
            if len(p) > 1 and p[0] in "[({" and p.find({"[": "]", "(": ")", "{": "}"}[p[0]]) == len(p) - 1:
                p = p[1:-1].strip()
        out.append(p)
    return out


VALUES = st.sampled_from(["30", "50.0", "20 mph", "13,9 m/s", "60 km / h", "50 @ (Mo-Fr 07:00-09:00; Sa 08:00-12:00)", "signals", "track", "", "400014104"])


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=5), st.sampled_from([("[", "', '", "'", "]"), ("[", '", "', '"', "]"), ("", ";", "", ""), ("", "|", "", ""), ("", " / ", "", ""), ("", "\t", "", ""), ("('", "', '", "", "')"), ("{", '","', '"', "}"), ("", " ; ", "", ""), ("['", "' '", "", "']")]))
def test_split_lists_property(values, style):
    before, between, quote, after = style
    text = before + quote + between.join(values) + quote + after
    assert packed.split_lists(pa.array([text, None, text])).to_pylist() == [split_plainly(text), [""], split_plainly(text)]


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("9, 9 km/h", ["9", "9 km/h"]), ("2,4", ["2", "4"]), ("13,9 m/s, 40", ["13,9 m/s", "40"]), ("[3, 4]", ["3", "4"]), ('"a" ; b', ["a", "b"]), ("a||c", ["a", "", "c"]),
        ("(50);(60)", ["50", "60"]), ("path / steps", ["path", "steps"]), ("60 km / h", ["60 km / h"]), ("['1']", ["1"]), ("50 @ (a; b)", ["50 @ (a; b)"]), ("28' , 3", ["28'", "3"]),
        ('["a;b", "c"]', ["a;b", "c"]), ("it's", ["it's"]), ("[", ["["]), (";", ["", ""]), ("ü;ß", ["ü", "ß"]), ("", [""]),
    ],
)
def test_split_lists_cases(text, items):
    assert packed.split_lists(pa.array([text])).to_pylist() == [items]


def test_split_values(spark):
    rows = [(1, "30;50", "2|", 7), (1, "30;50", None, 7), (2, None, "", 7), (3, "x" * 2_000_000 + ";y", "1", 7)]
    table = spark.createDataFrame(rows, "edge_id long, maxspeed string, lanes string, pos int")
    got = {(r.edge_id, r.field_name, r.pos, r.item[:3], len(r.item)) for r in packed.split_values(table, "edge_id", ["maxspeed", "lanes"]).collect()}
    assert got == {(1, "maxspeed", 1, "30", 2), (1, "maxspeed", 2, "50", 2), (3, "maxspeed", 1, "xxx", 2_000_000), (3, "maxspeed", 2, "y", 1)}
    assert packed.split_values(table, "edge_id", ["maxspeed"]).count() == 6
    assert packed.split_values(table.limit(0), "edge_id", ["maxspeed"]).count() == 0


# ---------------------------------------------------------------- nested


def ways_plainly(body):
    try:
        top = json.loads(body)
    except (ValueError, TypeError):
        return set()
    out = set()

    def tags(o):
        t = o.get("tags")
        if isinstance(t, dict):
            return t
        return {i.get("k", i.get("key")): i.get("v", i.get("value")) for i in t or [] if isinstance(i, dict)} if isinstance(t, list) else {}

    def number(x):
        try:
            return int(x)
        except (TypeError, ValueError):
            return None

    def opened(x):
        """What a string of JSON holds; other values as they are."""
        try:
            inner = json.loads(x) if isinstance(x, str) and x.lstrip(' \t\r\n"')[:1] in ("[", "{") else x
            return opened(inner) if inner is not x else x
        except ValueError:
            return x

    def walk(o, key, in_list):
        o = opened(o)
        if isinstance(o, dict):
            o = {k: opened(v) for k, v in o.items()}
            kind = o.get("type")
            named = isinstance(kind, str) and kind.lower() == "way"
            if (named or ("type" not in o and key == "way")) and number(o.get("id")) is not None and not isinstance(o["id"], bool):
                road = tags(o).get("highway")
                nodes = o.get("nodes")
                nodes = nodes if isinstance(nodes, list) else [nodes]
                for pos, n in enumerate(nodes, 1):
                    n = n.get("ref", n.get("id")) if isinstance(n, dict) else n
                    if number(n) is not None and isinstance(road, str) and road.strip():
                        out.add((int(o["id"]), pos, int(n)))
            for k, v in o.items():
                if k != "tags":
                    walk(v, k, False)
        elif isinstance(o, list):
            for v in o:
                walk(v, key, True)

    walk(top, None, False)
    return out


def found_ways(texts):
    return found_ways_of(pa.array(texts, pa.string()))


def found_ways_of(texts):
    flat = nested.flatten_ways(texts)["nodes"]
    out = [set() for _ in range(len(texts))]
    for r, w, p, n, h in zip(flat["row"], flat["way_id"], flat["pos"], flat["node_id"], flat["highway"].to_pylist()):
        if h is not None:
            out[r].add((int(w), int(p), int(n)))
    return out


def test_flatten_ways_layouts():
    way = {"type": "way", "id": 5, "nodes": [1, "2", {"ref": 3, "lat": 0.5}, None, 4], "tags": {"highway": "a", "note": 'nodes: [1, 2] "x" \\ {'}}
    bodies = [
        json.dumps({"elements": [way]}), json.dumps({"elements": {"way": [{k: v for k, v in way.items() if k != "type"}], "node": [{"id": 9}]}}), json.dumps([{"x": {"y": [[way]]}}], indent=1),
        json.dumps({"elements": [way | {"type": "WAY", "tags": [{"k": "highway", "v": "b"}]}]}), json.dumps({"elements": [way | {"tags": {"highway": " "}}]}), json.dumps({"elements": [way | {"tags": None}]}),
        json.dumps({"elements": [{"type": "relation", "members": [{"type": "way", "ref": 5}, {"element": way}]}]}), json.dumps({"elements": [way]})[:-1], json.dumps({"elements": [way]}) + "x", '{"a": [1, 2,]}',
        '{"\\u0074ype": "way", "id": 8, "nodes": 7, "tags": {"high\\u0077ay": "\\u0061"}}', "", "<html>", None, "[]", "{}", "5", '{"type": "way" "id": 1}', '{"type": "way", "id": 01}', '["a" : 1]',
    ]
    assert found_ways(bodies) == [ways_plainly(b) for b in bodies]
    assert len(found_ways(bodies)[0]) == 4


def test_json_in_strings_is_flattened():
    way = {"type": "way", "id": 5, "nodes": [1, 2], "tags": {"highway": '["a"]', "name": "caf\u00e9 \\ \"x\""}}
    bare = {k: v for k, v in way.items() if k != "type"}
    inner = json.dumps([way])
    bodies = [
        json.dumps({"elements": inner}), json.dumps({"elements": [way | {"id": 6}, inner]}), json.dumps({"a": json.dumps({"b": json.dumps({"c": [way]})})}), json.dumps(inner), json.dumps(json.dumps(inner)),
        json.dumps({"elements": [way | {"nodes": "[1, 2]", "tags": json.dumps(way["tags"])}]}), json.dumps({"way": json.dumps([bare])}), json.dumps({"elements": inner[:-1]}), json.dumps({"elements": inner})[:-1],
        json.dumps({"x": "\n\t " + json.dumps([way], indent=2), "y": ["[1", "{}", "[]", inner.replace("5", "7")]}), json.dumps({"elements": [way | {"tags": {"highway": "x", "note": json.dumps([way | {"id": 9}])}}]}), '{"a": "\\q"}', '{"a": "\\u12g4"}', None, "",
    ]
    assert found_ways(bodies) == [ways_plainly(b) for b in bodies]
    assert [len(x) for x in found_ways(bodies)] == [2, 4, 2, 2, 2, 2, 2, 0, 0, 4, 2, 0, 0, 0, 0]
    flat = nested.flatten_ways(pa.array(bodies))
    assert flat["tags"]["tag_value"].to_pylist().count(way["tags"]["name"]) == 10 and set(flat["ways"]["row"]) == {0, 1, 2, 3, 4, 5, 6, 9, 10}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from('\\"/\n\t\u00e9\U0001f600'), max_size=8), min_size=1, max_size=5))
def test_unescape_is_that_of_json(words):
    raw = [json.dumps(w, ensure_ascii=k % 2 == 0)[1:-1] for k, w in enumerate(words)]
    assert nested.unescape(pa.array(raw)).to_pylist() == words
    assert nested.unescape(pa.array(["\\ud83d x", "\\udc00", "\\ud83d\\u0041", "\\/"])).to_pylist() == ["? x", "?", "?A", "/"]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_every_planted_reference_is_found(sf):
    path = Path(f"/root/testdata/{sf}/overpass_responses.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    bodies = pq.read_table(path).column("body").combine_chunks()
    want = [ways_plainly(b) for b in bodies.to_pylist()]
    got = [found for lo, hi in buffers.passes(bodies) for found in found_ways_of(bodies.slice(lo, hi - lo))]
    assert sum(map(len, want)) > 1000 and got == want


JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["type", "id", "nodes", "tags", "way", "k", "v", "highway", "a\"b"]), c | st.just("way") | st.integers(1, 9), max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(JSON, st.integers(0, 30)), min_size=1, max_size=4))
def test_tokenize_knows_complete_json(values):
    texts = [json.dumps(v)[: -cut or None] if cut < 3 else json.dumps(v) for v, cut in values]
    done = nested.tokenize(pa.array(texts)).complete

    def complete(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    assert done.tolist() == [complete(t) for t in texts]


def test_flatten_responses(spark):
    body = json.dumps({"elements": [{"type": "way", "id": 1, "nodes": [2, 3], "tags": {"highway": "x", "name": "n"}}]})
    table = spark.createDataFrame([("r", body, 1), ("r", body, 2), ("s", None, 3), ("t", body[:-2], 4), (None, body, 5)], "response_id string, body string, pos int")
    assert nested.flatten_responses(table, "response_id", "body", "nodes").count() == 4
    assert {(r.tag_key, r.tag_value) for r in nested.flatten_responses(table, "response_id", "body", "tags").collect()} == {("highway", "x"), ("name", "n")}
    assert nested.flatten_responses(table, "response_id", "body", "ways").where("response_id = 'r'").first()["n_nodes"] == 2
    assert nested.flatten_responses(table.limit(0), "response_id", "body", "ways").count() == 0


# ---------------------------------------------------------------- references

REFS = "table_name string, field_name string, row_id long, ref_id long, loaded_at timestamp"


def test_orphans(spark):
    day = lambda n: T(2024, 1, n)
    refs = [("e", "u", 1, 10, day(5)), ("e", "u", 2, 11, day(5)), ("e", "u", 3, 12, day(5)), ("e", "u", 4, 13, day(5)), ("e", "u", 5, None, day(5)), ("e", "u", 6, 11, None), ("e", "u", 7, 14, None), ("e", "u", 2, 11, day(5)), ("f", "u", 1, 10, day(5))]
    parents = [("e", 10, day(1)), ("e", 10, day(9)), ("e", 11, day(6)), ("e", 12, day(1)), ("e", 13, day(5)), ("e", None, day(1))]
    removed = [("e", 12, day(5)), ("e", 13, day(6)), ("e", 99, day(1))]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    parts = (make(refs, REFS), make(parents, "table_name string, ref_id long, loaded_at timestamp"), make(removed, "table_name string, ref_id long, removed_at timestamp"))
    got = {(r.table_name, r.row_id, r.status) for r in references.orphans(*parts).collect()}
    assert got == {("e", 2, "late"), ("e", 3, "deleted"), ("e", 7, "missing"), ("f", 1, "missing")}
    report = references.orphan_report(references.orphans(*parts)).collect()
    assert sum(r.n_refs for r in report) == 4
    assert references.orphans(*(p.limit(0) for p in parts)).count() == 0


def test_orphans_hot_key(spark):
    refs = spark.range(6000).selectExpr("'e' table_name", "'u' field_name", "id row_id", "if(id % 3 = 0, 7, id) ref_id", "timestamp'2024-01-02' loaded_at")
    parents = spark.range(6000).selectExpr("'e' table_name", "id ref_id", "timestamp'2024-01-01' loaded_at").where("ref_id % 5 > 0")
    removed = spark.createDataFrame([], "table_name string, ref_id long, removed_at timestamp")
    assert skew.hot_keys(refs, "ref_id") == [7]
    assert references.orphans(refs, parents, removed).count() == sum(1 for i in range(6000) if i % 3 and i % 5 == 0)


# ---------------------------------------------------------------- imputation


def test_fill_blocks(spark):
    schema = "block_id long, cvegeo string, cve_ageb string, census_year int, pobtot double, pobfem double, pobmas double, p_0a2 double, cluster string"
    z, y = "0101100010010", "0101100010027"
    rows = [
        (1, z + "001", z, 2020, 10.0, 5.0, 5.0, 1.0, "x"), (2, z + "002", "001-0", 2020, 20.0, -1.0, 999999.0, None, "x"), (3, z + "003", "N/A", 2020, math.nan, 7.0, 0.0, 1.0, "x"), (3, z + "003", "N/A", 2020, math.nan, 7.0, 0.0, 1.0, "x"),
        (4, y + "001", None, 2015, None, 3.0, 1.5, 2.0, None), (5, y + "001", "0000000000000", 2020, 8.0, None, None, None, None), (6, None, z, 2020, None, None, None, None, None), (7, "  ", "*", None, None, None, None, None, None),
    ]
    got = imputation.fill_blocks(spark.createDataFrame(rows, schema), ["p_0a2", "pobtot"], k=2)
    by = {r.block_id: r for r in got.collect()}
    assert got.count() == 8
    assert by[3].pobtot in (10.0, 15.0, 20.0) and by[3].pobtot_filled and by[3].pobtot_method in ("cluster", "zone")
    assert by[2].pobfem in (5.0, 6.0, 7.0) and by[2].cve_ageb == "0010" and by[3].cve_ageb == z
    assert by[4].pobtot == 8.0 and by[4].pobtot_method == "block" and by[5].pobfem == 3.0
    assert by[4].pobmas_method == "unfillable" and not by[4].cve_ageb_filled and by[5].cve_ageb is None and by[6].pobtot is None
    assert by[1].pobtot_method == "observed" and by[3].pobmas == 0.0
    fields = {(r.block_id, r.field_name) for r in imputation.filled_fields(got, ["pobtot", "pobfem", "pobmas", "cve_ageb"]).collect()}
    assert fields == {(2, "pobfem"), (2, "pobmas"), (3, "pobtot"), (3, "cve_ageb"), (4, "pobtot"), (5, "pobfem")}
    assert imputation.fill_blocks(spark.createDataFrame([], schema), ["p_0a2"]).count() == 0


def test_fill_blocks_of_a_hot_zone(spark, monkeypatch):
    table = spark.range(900).selectExpr("id block_id", "concat(if(id % 2 = 0, '0101100010010', lpad(cast(id % 40 as string), 13, '1')), lpad(cast(id % 7 as string), 3, '0')) cvegeo", "if(id % 3 = 0, null, '0010') cve_ageb", "cast(2000 + id % 3 as int) census_year", "if(id % 5 = 0, null, cast(id % 50 as double)) pobtot", "cast(id % 9 as double) pobfem", "if(id % 4 = 0, -1D, 3D) pobmas")
    assert skew.hot_keys(table.selectExpr("substring(cvegeo, 1, 13) z"), "z")
    salted = sorted(imputation.fill_blocks(table, ["pobfem"], k=2).collect(), key=lambda r: r.block_id)
    monkeypatch.setattr(imputation, "hot_keys", lambda *a, **k: [])
    assert salted == sorted(imputation.fill_blocks(table, ["pobfem"], k=2).collect(), key=lambda r: r.block_id) and len(salted) == 900


def test_prototypes_separate_sizes(spark):
    rows = spark.range(300).selectExpr("if(id < 150, 1.0, 5.0) + (id % 3) / 10 a", "if(id < 150, 'x', 'y') c", "id")
    from pyspark.sql import functions as F

    model = imputation.fit_prototypes(rows, ["a"], ["c"], k=2)
    groups = rows.groupBy((F.col("id") < 150).alias("low")).agg(F.collect_set(model.cluster()).alias("s")).collect()
    assert sorted(len(r.s) for r in groups) == [1, 1] and groups[0].s != groups[1].s


# ---------------------------------------------------------------- proximity


def near_plainly(points, radius):
    ids, lon, lat = (np.array(v) for v in zip(*points))
    out = set()
    for i in range(len(ids)):
        d = proximity.haversine_m(lon[i], lat[i], lon, lat)
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in np.flatnonzero(d <= radius) if ids[i] != ids[j]}
    return {(int(a), int(b)) for a, b in out}


@pytest.mark.parametrize("pieces", [100_000, 40])
def test_near_pairs(spark, pieces):
    rng = random.Random(4)
    centres = [(0.1, 0.0), (179.99995, 10.0), (-179.99995, 10.0), (20.0, 89.99995), (-100.0, 89.99995), (5.0, -89.9999), (45.0, 35.26), (45.00001, 35.2644), (-60.0, 45.0), (90.0, 0.0)]
    points = []
    for i in range(600):
        lon, lat = centres[i % len(centres)]
        points.append((i, max(-180.0, min(180.0, lon + rng.uniform(-3, 3) * 1e-4)), max(-90.0, min(90.0, lat + rng.uniform(-3, 3) * 1e-4))))
    points += [(3, points[3][1], points[3][2]), (1000, 0.0, 0.0), (1001, 200.0, 0.0)]
    table = spark.createDataFrame([*points, (1002, None, 1.0), (1003, math.nan, 1.0), (None, 0.1, 0.0)], "id long, lon double, lat double").selectExpr("*", "1 x", "2 task")
    got = [(r.id_a, r.id_b) for r in proximity.near_pairs(table, 20.0, leaf_points=30, piece_points=pieces).collect()]
    assert len(got) == len(set(got)) and set(got) == near_plainly([p for p in points if p[0] < 1000], 20.0)
    assert proximity.near_pairs(table.limit(0)).count() == 0


def test_locate(spark):
    square = lambda x, y, s: [[{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}, {"x": x, "y": y}]]
    hole = square(10.0, 10.0, 10.0) + square(12.0, 12.0, 2.0)
    zones = [("a", square(0.0, 0.0, 5.0)), ("b", square(4.0, 4.0, 5.0)), ("c", hole), ("d", square(179.0, 0.0, 2.0)), ("e", None), ("f", [])]
    points = [(1, 1.0, 1.0), (2, 4.5, 4.5), (3, 11.0, 11.0), (4, 13.0, 13.0), (5, -179.5, 1.0), (6, 5.0, 2.0), (7, 50.0, 50.0), (8, None, 1.0), (1, 1.0, 1.0)]
    regions = spark.createDataFrame(zones, "zone string, geometry array<array<struct<x:double,y:double>>>")
    table = spark.createDataFrame(points, "id long, lon double, lat double").selectExpr("*", "'q' zone")
    for leaf in (30_000, 1):
        got = {r.id: r.zone for r in proximity.locate(table, regions, "zone", leaf_points=leaf).collect()}
        assert got == {1: "a", 2: "a", 3: "c", 5: "d", 6: "a"}
    assert proximity.locate(table.limit(0), regions, "zone").count() == 0
    assert proximity.locate(table, regions.limit(0), "zone").count() == 0


@pytest.mark.parametrize("leaf", [30_000, 40])
def test_locate_in_large_polygons(spark, leaf):
    rng = np.random.default_rng(6)

    def star(x, y, r, n, wave=0.3):
        a = np.linspace(0, 2 * np.pi, n + 1)
        far = r * (1 + wave * np.sin(9 * a))
        ring = [{"x": float(p), "y": float(q)} for p, q in zip(x + far * np.cos(a), y + far * np.sin(a), strict=True)]
        ring[-1] = ring[0]
        return ring

    shapes = {"a": [star(0, 0, 30, 700), star(0, 0, 8, 200)], "b": [star(20, 10, 5, 100)], "c": [star(178, -20, 15, 300)], "d": [star(60, 40, 0.5, 5)]}
    xy = np.concatenate([rng.uniform(-45, 70, (1500, 2)) * [1, 0.8], rng.normal(3, 0.5, (800, 2)), np.column_stack([rng.uniform(160, 180, 200), rng.uniform(-40, 0, 200)]), np.column_stack([rng.uniform(-180, -160, 200), rng.uniform(-40, 0, 200)])])
    table = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, lon double, lat double")
    regions = spark.createDataFrame(list(shapes.items()), "zone string, geometry array<array<struct<x:double,y:double>>>")
    want = {}
    for zone in reversed(shapes):
        for shift in (0, 360, -360):
            odd = np.zeros(len(xy), int)
            for ring in shapes[zone]:
                p = np.array([(c["x"] + shift, c["y"]) for c in ring])
                for (x1, y1), (x2, y2) in zip(p[:-1], p[1:], strict=True):
                    odd += proximity._in_ring(xy[:, 0], xy[:, 1], x1, y1, x2, y2)[0]
            want.update({int(i): zone for i in np.flatnonzero(odd % 2)})
    assert {r.id: r.zone for r in proximity.locate(table, regions, "zone", leaf_points=leaf).collect()} == want and len(want) > 500


def test_rtree_and_quadtree():
    rng = np.random.default_rng(1)
    boxes = rng.random((500, 2))
    boxes = np.hstack([boxes, boxes + rng.random((500, 2)) / 20])
    a, b = proximity.RTree(boxes).probe(boxes[:50])
    want = {(i, j) for i in range(50) for j in range(500) if (boxes[i, :2] <= boxes[j, 2:]).all() and (boxes[i, 2:] >= boxes[j, :2]).all()}
    assert set(zip(a.tolist(), b.tolist())) == want
    tree = proximity.build_quadtree(boxes[:, 0], boxes[:, 1], (0.0, 0.0, 1.0), 500, 1e-3, leaf_points=20)
    leaf, area = tree.leaf(boxes[:, 0], boxes[:, 1]), tree.boxes()
    assert (area[leaf, 0] <= boxes[:, 0]).all() and (boxes[:, 0] <= area[leaf, 2]).all() and np.isclose(((area[:, 2] - area[:, 0]) * (area[:, 3] - area[:, 1])).sum(), 1)
    assert np.bincount(leaf).max() <= 20


def test_salted_join_is_a_join(spark):
    left = spark.range(1000).selectExpr("if(id % 2 = 0, 5, id) k", "id")
    right = spark.range(500).selectExpr("id k", "id * 2 v")
    plain = left.join(right, ["k"], "left").groupBy().sum("v", "id").first()
    assert skew.salted_join(left, right, ["k"], "k", [5], left["id"]).groupBy().sum("v", "id").first() == plain
    assert skew.hot_keys(left.limit(0), "k") == []


def test_passes_cut_no_text(monkeypatch):
    monkeypatch.setattr(buffers, "PASS_BYTES", 10)
    texts = pa.array(["abc", None, "x" * 50, "", "de", "f" * 9])
    ranges = list(buffers.passes(texts))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(6))
    assert list(buffers.passes(pa.array([], pa.string()))) == []


def test_numbers_of_19_digits_are_known():
    import numpy as np
    import pyarrow as pa

    from citygrain.operators import nested

    texts = ["9223372036854775807", "9223372036854775808", "-9223372036854775808", "1000000000000000001", "12.0", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    stop = np.cumsum([len(t) for t in texts])
    tokens = type("T", (), dict(data=data, start=stop - [len(t) for t in texts], stop=stop, kind=np.full(len(texts), nested.LITERAL)))
    values, known = nested._integers(tokens, np.arange(len(texts)))
    assert known.tolist() == [True, False, True, True, True, False]
    assert values[known].tolist() == [2**63 - 1, -(2**63), 10**18 + 1, 12]
