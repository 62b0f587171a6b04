"""Type functions: SQL type name -> field type (T5), geometry type
normalisation (G7), and the field-type -> Spark type table (1.2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's: substring rules, tested in order.
SQL_TYPE_RULES = (
    ("integer", ("int",)),
    ("number", ("double", "float", "real", "numeric")),
    ("boolean", ("bool", "boolean")),
    ("date-time", ("timestamp", "datetime")),
    ("date", ("date", "time")),
)
GEOMETRY_TYPE_WORDS = ("geom", "point", "line", "poly", "shape")

# Geometry type names, tested in this order (multi before single).
GEOMETRY_TYPE_RULES = (
    ("multipolygon", "MultiPolygon"),
    ("multilinestring", "MultiLineString"),
    ("multipoint", "MultiPoint"),
    ("polygon", "Polygon"),
    ("linestring", "LineString"),
    ("point", "Point"),
    ("collection", "GeometryCollection"),
)
GEOMETRY_TYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString",
                  "MultiPolygon", "GeometryCollection", "None")

# Field base type -> Spark type. Integers are folded into LongType.
SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "date-time": T.TimestampType(),
    "json": T.StringType(),
    "codelist": T.StringType(),
    "geometry": T.StringType(),  # WKT / GeoJSON text when stored flat
}


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def sql_type_to_field_type(c: Column | str, parity: bool = False) -> Column:
    """T5: returns the field kind/base type as a string: one of the primitive
    base types or ``geometry``.

    ``parity=True`` keeps the reference order, where the ``int`` rule runs
    first so ``POINT`` becomes ``integer``; the default tests the geometry
    words first, which is the fix recorded in SURVEY 1.2.
    """
    t = F.lower(_c(c))
    geom = None
    for w in GEOMETRY_TYPE_WORDS:
        p = t.contains(w)
        geom = p if geom is None else (geom | p)
    expr = None
    if not parity:
        expr = F.when(geom, F.lit("geometry"))
    for base, words in SQL_TYPE_RULES:
        cond = None
        for w in words:
            p = t.contains(w)
            cond = p if cond is None else (cond | p)
        expr = F.when(cond, F.lit(base)) if expr is None else expr.when(cond, F.lit(base))
    if parity:
        expr = expr.when(geom, F.lit("geometry"))
    return expr.otherwise(F.lit("string"))


def normalize_geometry_type(c: Column | str) -> Column:
    """Substring rules on the lower-cased name; ``none`` stays ``None``;
    anything unknown becomes ``Polygon``."""
    t = F.lower(_c(c))
    expr = F.when(t == "none", F.lit("None"))
    for word, name in GEOMETRY_TYPE_RULES:
        expr = expr.when(t.contains(word), F.lit(name))
    return expr.otherwise(F.lit("Polygon"))


def spark_type_to_base_type(dt: T.DataType) -> str:
    """Driver-side: the field base type a Spark column maps to (catalog import)."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "date-time"
    return "string"
