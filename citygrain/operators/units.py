"""Quantities recorded in different units, brought to one unit per dimension.

Pure SQL: quantities are taken from the text with ``regexp_extract``, their unit alias is normalised by a join
with an alias table, the unit is the first of unit column, unit in the text, default of the source and base
unit, and the value is ``number * factor + offset``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dimension, unit, factor to the base unit, offset, spellings (lower case, no accents, blanks or full
# stops). Base units: km/h and metre.
UNITS = [
    ("speed", "km/h", 1.0, 0.0, "km/h kmh kph kmph km/hr km/hour kmhr kilometresperhour kilometersperhour kilometreperhour kilometerperhour kmporhora kilometrosporhora kilometresparheure km/std"),
    ("speed", "mph", 1.609344, 0.0, "mph mi/h mi/hr milesperhour mileperhour millas/h millasporhora millesal'heure milesal'heure miles/h meilen/h"),
    ("speed", "knot", 1.852, 0.0, "knots knot kn kt kts nudos nudo noeuds noeud knoten"),
    ("speed", "m/s", 3.6, 0.0, "m/s mps ms-1 m/sec m/seg metrespersecond meterspersecond metrospersegundo metresparseconde"),
    ("speed", "ft/s", 1.09728, 0.0, "ft/s fps feetpersecond"),
    ("length", "m", 1.0, 0.0, "m metre metres meter meters metro metros metern"),
    ("length", "cm", 0.01, 0.0, "cm centimetre centimetres centimeter centimeters centimetro centimetros zentimeter zentimetern"),
    ("length", "mm", 0.001, 0.0, "mm millimetre millimetres millimeter millimeters milimetro milimetros millimetern"),
    ("length", "dm", 0.1, 0.0, "dm decimetre decimetres decimeter decimeters decimetro decimetros dezimeter dezimetern"),
    ("length", "km", 1000.0, 0.0, "km kilometre kilometres kilometer kilometers kilometro kilometros"),
    ("length", "ft", 0.3048, 0.0, "ft foot feet pie pies pieds pied fuss '"),
    ("length", "in", 0.0254, 0.0, 'in inch inches pulgada pulgadas pouces zoll "'),
    ("length", "yd", 0.9144, 0.0, "yd yds yard yards yarda yardas"),
    ("length", "mi", 1609.344, 0.0, "mi mile miles milla millas"),
]
# Spellings that are common words or single signs, hence no units when met in running text.
NOT_IN_PROSE = "in m ' \" mi kt kn pie mile miles foot".split()
#: Rows of source defaults up to which they are sent to every task.
MOST_SOURCES = 100_000
BASE = {"speed": "km/h", "length": "m"}

ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüçñ’′″", "aaaaaaeeeeiiiiooooouuuucn''\""
UNIT = r"""(?:[a-z]+(?:\s*/\s*[a-z]+|(?:\.[a-z]+)+|\s+p(?:er|or|ar)\s+[a-z]+|\s+a\s+l'heure|\s*s-1)?\.?|['"])"""
COMPOUND = r"""\d+(?:\.\d+)?\s*(?:feet|foot|ft|')\.?\s*\d+(?:\.\d+)?\s*(?:inches|inch|in|")"""
QUANTITY = rf"(?:[a-z][a-z./]*\s+)?(?:{COMPOUND}|\d+(?:[.,]\d+)?\s*{UNIT}|\d+(?:\.\d+)?)"
CONDITION, TIME_OF_DAY = r"@\s*\([^)]*\)|@[^;|]*", r"\d{1,2}:\d{2}"
COUNT = r"\d+\s*(?:lanes?|carril(?:es)?|voies?|spur(?:en)?|faixas?)\b"


def alias_table(spark: SparkSession, units: list[tuple] = UNITS) -> DataFrame:
    """(dimension, alias, unit, factor, shift): one row per spelling; a fixed inline table of under 200 rows."""
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({text(d)}, {text(a)}, {text(u)}, {f!r}D, {o!r}D)" for d, u, f, o, names in units for a in names.split())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(dimension, alias, unit, factor, shift)")


def plain_text(text: Column) -> Column:
    """Lower case without accents; prime signs become quotes."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def source_defaults(sources: DataFrame, key: str, remarks: str) -> DataFrame:
    """(key, dimension, default_unit): the unit that a source's remarks give for numbers without one.

    The unit of a dimension that the remarks name last counts, since exceptions are told before the rule
    ("some write miles per hour; plain figures are km/h"). Null or empty remarks give no row.
    """
    spark = sources.sparkSession
    aliases = alias_table(spark)
    names = [a for _, _, _, _, names in UNITS for a in names.split() if a not in NOT_IN_PROSE]
    spaced = {"kmporhora": "km por hora", "millesal'heure": "milles a l'heure", "milesal'heure": "miles a l'heure"}
    for word in ("per", "por", "par"):
        spaced |= {a: a.replace(word, f" {word} ", 1) for a in names if a not in spaced and word in a[2:] and len(a) > 9}
    found = "|".join(spaced.get(a, a) for a in sorted(names, key=len, reverse=True))
    text = plain_text(F.col(remarks))
    hits = sources.select(F.col(key), F.posexplode(F.regexp_extract_all(text, F.lit(rf"\b({found})\b"), F.lit(1))).alias("at", "hit"))
    hits = hits.withColumn("alias", F.regexp_replace("hit", r"[\s.]", ""))
    return hits.join(F.broadcast(aliases), "alias").groupBy(key, "dimension").agg(F.max_by("unit", "at").alias("default_unit"))


def quantities(df: DataFrame, id_col: str, source_col: str, fields: dict[str, str], defaults: DataFrame, unit_cols: dict[str, str] | None = None, source_rows: int | None = None) -> DataFrame:
    """One row per quantity: (id, field_name, seq, number, unit, unit_from, value, base_unit).

    ``source_rows`` is the number of sources if known. ``fields`` maps text columns to dimensions, ``defaults`` is the result of ``source_defaults`` with the key
    named as ``source_col``, ``unit_cols`` names columns that hold the unit of a field, if there are any.
    Conditions after ``@``, times of day and counts of lanes are no quantities. Null, empty and wordy entries
    give no row; a unit that is not known for the dimension counts as none. A repeated input row gives repeated
    result rows. Only ``id_col``, ``source_col`` and the fields are read, so further columns do not matter.
    """
    unit_cols = unit_cols or {}
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(d).alias("dimension"), F.col(f).cast("string").alias("raw"), (F.col(unit_cols[f]) if f in unit_cols else F.lit(None)).cast("string").alias("given")) for f, d in fields.items()])
    long = df.select(F.col(id_col), F.col(source_col).alias("_source"), F.explode(entries).alias("e")).select(id_col, "_source", "e.*").where(F.col("raw").rlike(r"\d"))
    text = plain_text(F.col("raw"))
    for pattern in (CONDITION, TIME_OF_DAY, COUNT):
        text = F.regexp_replace(text, pattern, " ")
    unquoted = F.regexp_replace(text, r"""[\[\](){}"']""", " ")
    text = F.when((F.col("dimension") != "length") | F.col("raw").rlike(r"""^\s*[\[({"']"""), unquoted).otherwise(text)
    pieces = F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(0))
    long = long.select(id_col, "_source", "field_name", "dimension", "given", F.posexplode(pieces).alias("seq", "piece"))
    clean = lambda c: F.regexp_replace(c, r"[\s.]", "")
    suffix = F.regexp_extract("piece", r"""\d\s*([a-z'"].*)$""", 1)
    inches = F.regexp_extract("piece", rf"(?:feet|foot|ft|')\.?\s*(\d+(?:\.\d+)?)\s*(?:inches|inch|in|\")$", 1)
    feet = F.col("_inches") != ""
    long = long.withColumn("_inches", inches).select(
        id_col, "_source", "field_name", "dimension", (F.col("seq") + 1).alias("seq"),
        F.expr(r"try_cast(replace(regexp_extract(piece, '(\\d+(?:[.,]\\d+)?)', 1), ',', '.') as double)").alias("number"),
        F.when(feet, F.col("_inches").try_cast("double") * 0.0254).otherwise(0.0).alias("_extra"),
        clean(plain_text(F.col("given"))).alias("_given"), F.when(feet, F.lit("ft")).otherwise(clean(suffix)).alias("_suffix"),
        clean(F.regexp_extract("piece", r"^([a-z][a-z./]*)\s+\d", 1)).alias("_prefix"),
    )
    aliases = alias_table(df.sparkSession).select("dimension", "alias", F.struct("unit", "factor", "shift").alias("u"))
    for name in ["suffix", "prefix"] + ["given"] * bool(unit_cols):
        known = aliases.withColumnsRenamed({"alias": f"_{name}", "u": f"_unit_{name}"})
        long = long.join(F.broadcast(known), ["dimension", f"_{name}"], "left")
    # A row per source and dimension: broadcast only if there are at most MOST_SOURCES, else joined by a shuffle.
    units = alias_table(df.sparkSession).groupBy("dimension", "unit").agg(F.first(F.struct("unit", "factor", "shift")).alias("_unit_default"))
    of_source = defaults.select(F.col(source_col).alias("_source"), "dimension", F.col("default_unit").alias("unit")).join(F.broadcast(units), ["dimension", "unit"]).drop("unit")
    rows = len(BASE) * source_rows if source_rows is not None else defaults.limit(MOST_SOURCES + 1).count()
    long = long.join(F.broadcast(of_source) if rows <= MOST_SOURCES else of_source, ["_source", "dimension"], "left")
    base = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])[F.col("dimension")]
    given = F.col("_unit_given") if unit_cols else F.lit(None).cast("struct<unit:string,factor:double,shift:double>")
    text_unit = F.coalesce("_unit_suffix", "_unit_prefix")
    origin = F.when(given.isNotNull(), "column").when(text_unit.isNotNull(), "text").when(F.col("_unit_default").isNotNull(), "source").otherwise("base")
    unit = F.coalesce(given, text_unit, F.col("_unit_default"), F.struct(base.alias("unit"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("shift")))
    out = long.select(id_col, "field_name", "seq", "number", unit.alias("_u"), origin.alias("unit_from"), base.alias("base_unit"), "_extra")
    value = (F.col("number") * F.col("_u.factor") + F.col("_u.shift") + F.col("_extra")).alias("value")
    return out.select(id_col, "field_name", "seq", "number", F.col("_u.unit").alias("unit"), "unit_from", value, "base_unit")


def in_foreign_units(found: DataFrame, id_col: str) -> DataFrame:
    """(id, field_name) of the fields with at least one quantity in another unit than the base unit."""
    return found.where(F.col("unit") != F.col("base_unit")).select(id_col, "field_name").distinct()
