"""Well-known text of geometry columns, both ways, as Column expressions.

Geometries are the structs of ``functions.geometry``: type, srid, and parts of
rings of points. Text in, text out: no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let

# The geometry types that have a text form, by their tag.
TYPES = {t.upper(): t for t in ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")}
_XY = "struct<x:string,y:string>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _list(items: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(items, ", "), F.lit(")"))


def _number(n: Column) -> Column:
    return F.regexp_replace(n.cast("string"), r"\.0$", "")


def to_wkt(geometry: Column | str, srid: bool = False) -> Column:
    """The text of a geometry: ``POINT (4 57.5)``, ``POLYGON ((...), (...))``.

    A geometry without parts is ``<TYPE> EMPTY``, a null one or one of another
    type is null. ``srid`` puts ``SRID=<n>;`` before it, where it is known."""
    pair = lambda p: F.concat_ws(" ", _number(p["x"]), _number(p["y"]))
    ring = lambda r: _list(F.transform(r, pair))
    rings = lambda part: _list(F.transform(part, ring))

    def text(g):
        kind, parts = g["type"], g["parts"]
        body = (F.when(kind == "Point", ring(parts[0][0]))
                .when(kind == "MultiPoint", _list(F.transform(parts, lambda p: ring(p[0]))))
                .when(kind == "LineString", ring(parts[0][0]))
                .when(kind == "MultiLineString", _list(F.transform(parts, lambda p: ring(p[0]))))
                .when(kind == "Polygon", rings(parts[0]))
                .when(kind == "MultiPolygon", _list(F.transform(parts, rings))))
        out = F.concat(F.upper(kind), F.lit(" "), F.when(F.size(parts) > 0, body).otherwise(F.lit("EMPTY")))
        if srid:
            out = F.concat(F.coalesce(F.concat(F.lit("SRID="), g["srid"].cast("string"), F.lit(";")), F.lit("")), out)
        return F.when(g.isNotNull() & kind.isin(*TYPES.values()), out)
    # a geometry may be a long expression: built once, not for each mention
    return let(_c(geometry), text)


def from_wkt(text: Column | str, srid: int = 4326) -> Column:
    """The geometry of a text; null where it cannot be read.

    Tags may have any case, further ordinates (Z, M) are left out, multi-points may
    stand with or without brackets around each point, and ``SRID=<n>;`` before
    the tag goes before ``srid``. ``EMPTY`` has no parts."""
    # each step is bound once (``let``): mentioned several times, it would be computed as often, and so would all before it
    return let(F.trim(_c(text)), lambda t: let(_read(t), lambda r: let(_parts(r), lambda parts: _geometry(r, parts, int(srid)))))


def _read(t: Column) -> Column:
    """Of a text its ``tag``, whether it is ``empty``, the srid ``given`` in it, and its points as ``json``."""
    given = F.regexp_extract(t, r"(?i)^SRID\s*=\s*(\d+)\s*;", 1)
    plain = F.regexp_replace(t, r"(?i)^SRID\s*=\s*\d+\s*;\s*", "")
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"

    def of(p):
        tag = F.upper(F.regexp_extract(p, r"(?i)^([A-Z]+?)\s*(?:ZM|Z|M)?\s*(?:\(|\sEMPTY$)", 1))
        body = F.regexp_extract(p, r"^[^(]*(\(.*\))$", 1)
        pairs = F.regexp_replace(body, rf"({number})\s+({number})(?:\s+{number})*", r'{"x":"$1","y":"$2"}')
        return F.struct(tag.alias("tag"), F.regexp_like(p, F.lit(r"(?i)\sEMPTY$")).alias("empty"), given.alias("given"),
                        F.translate(pairs, "()", "[]").alias("json"))
    return let(plain, of)


def _parts(r: Column) -> Column:
    tag, json = r["tag"], r["json"]
    # a point of a multi-point without brackets of its own
    flat = F.regexp_replace(json, r"\[\s*(\{[^}]*\})\s*\]", "$1")
    levels = [F.from_json(json, f"{'array<' * n}{_XY}{'>' * n}") for n in (1, 2, 3)]
    points = F.from_json(F.when(tag == "MULTIPOINT", F.concat(F.lit("["), F.regexp_replace(flat, r"^\[|\]$", ""), F.lit("]"))),
                         f"array<{_XY}>")
    point = lambda p: F.struct(p["x"].try_cast("double").alias("x"), p["y"].try_cast("double").alias("y"))
    ring = lambda x: F.transform(x, point)
    part = lambda p: F.transform(p, ring)
    parts = (F.when(tag.isin("POINT", "LINESTRING"), F.array(F.array(ring(levels[0]))))
             .when(tag == "MULTIPOINT", F.transform(points, lambda p: F.array(F.array(point(p)))))
             .when(tag == "MULTILINESTRING", F.transform(levels[1], lambda line: F.array(ring(line))))
             .when(tag == "POLYGON", F.array(part(levels[1])))
             .when(tag == "MULTIPOLYGON", F.transform(levels[2], part)))
    none = F.array().cast("array<array<array<struct<x:double,y:double>>>>")
    return F.when(r["empty"], none).otherwise(parts)


def _geometry(r: Column, parts: Column, srid: int) -> Column:
    tag, given = r["tag"], r["given"]

    # a text that is not read whole has a null somewhere: a point, a list of points, or all of it
    def read_whole(points):
        whole = ~F.exists(points, lambda p: p["x"].isNull() | p["y"].isNull()) & (r["empty"] | (F.size(points) > 0))
        return whole & F.when(tag == "POINT", F.size(points) <= 1).otherwise(F.lit(True))
    whole = let(F.flatten(F.flatten(parts)), read_whole)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), tag)
    number = F.when(given != "", given.cast("int")).otherwise(F.lit(srid))
    return F.when(kind.isNotNull() & parts.isNotNull() & F.coalesce(whole, F.lit(False)),
                  F.struct(kind.alias("type"), number.alias("srid"), parts.alias("parts")))
