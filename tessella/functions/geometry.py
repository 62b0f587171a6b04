"""Geometry as plain Spark columns (G1-G9 and the predicates behind J5-J9).

Internal form (SURVEY 1.3)::

    struct<type string, srid int,
           parts array<array<array<struct<x double, y double>>>>>

part -> ring -> point. A point is one part with one ring of one point; a
line is one ring per part; a polygon part is an outer ring plus holes.
Everything below is built from higher-order functions (``transform``,
``exists``, ``aggregate``, ``zip_with``) so it runs inside the JVM with no
Python per row.

Tolerance: predicates are exact in IEEE doubles by default (``eps=0``);
callers may pass an absolute tolerance in CRS units.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_T = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY_T = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("srid", T.IntegerType()),
    T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(POINT_T)))),
])
EDGE_FIELDS = ("ax", "ay", "bx", "by")


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _lit(v):
    return v if isinstance(v, Column) else F.lit(v)


# --------------------------------------------------------------- helpers

def let(expr: Column, body) -> Column:
    """Evaluate ``expr`` once and pass it to ``body`` as a lambda variable
    (``transform`` over a one-element array): keeps a value that ``body``
    uses several times from being recomputed for each use."""
    return F.transform(F.array(expr), body)[0]


# --------------------------------------------------------------- builders

def xy(x, y) -> Column:
    return F.struct(_lit(x).cast("double").alias("x"), _lit(y).cast("double").alias("y"))


def point(x, y, srid=4326) -> Column:
    return F.struct(F.lit("Point").alias("type"), _lit(srid).cast("int").alias("srid"),
                    F.array(F.array(F.array(xy(x, y)))).alias("parts"))


def rectangle(x0, y0, x1, y1, srid=4326) -> Column:
    """Closed counter-clockwise ring of five points."""
    ring = F.array(xy(x0, y0), xy(x1, y0), xy(x1, y1), xy(x0, y1), xy(x0, y0))
    return F.struct(F.lit("Polygon").alias("type"), _lit(srid).cast("int").alias("srid"),
                    F.array(F.array(ring)).alias("parts"))


def linestring(points: Column, srid=4326) -> Column:
    """``points`` is an array<struct<x,y>> column."""
    return F.struct(F.lit("LineString").alias("type"), _lit(srid).cast("int").alias("srid"),
                    F.array(F.array(points)).alias("parts"))


# --------------------------------------------------------------- accessors

def coords(g) -> Column:
    """All vertices, flattened."""
    return F.flatten(F.flatten(_c(g)["parts"]))


def bbox(g) -> dict[str, Column]:
    pts = coords(g)
    return {
        "min_x": F.array_min(F.transform(pts, lambda p: p["x"])),
        "min_y": F.array_min(F.transform(pts, lambda p: p["y"])),
        "max_x": F.array_max(F.transform(pts, lambda p: p["x"])),
        "max_y": F.array_max(F.transform(pts, lambda p: p["y"])),
    }


def with_bbox(df, geom_col: str = "geometry"):
    """Adds ``min_x, min_y, max_x, max_y`` next to the geometry; written to
    Parquet these give row-group min/max skipping for bbox filters."""
    return df.withColumns(bbox(geom_col))


def ring_edges(ring: Column) -> Column:
    """array<struct<ax,ay,bx,by>> of consecutive vertex pairs."""
    n = F.size(ring) - 1
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n),
                      lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"),
                                            b["x"].alias("bx"), b["y"].alias("by")))


def edges(g) -> Column:
    """Every edge of every ring of every part."""
    return F.flatten(F.flatten(F.transform(
        _c(g)["parts"], lambda part: F.transform(part, ring_edges))))


# --------------------------------------------------------------- primitives

def _cross(ax, ay, bx, by, px, py):
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _sign(v, eps=0.0):
    return F.when(v > eps, F.lit(1)).when(v < -eps, F.lit(-1)).otherwise(F.lit(0))


def _between(v, a, b, eps=0.0):
    return (v >= F.least(a, b) - eps) & (v <= F.greatest(a, b) + eps)


def point_on_edge(px, py, e, eps=0.0) -> Column:
    cr = _cross(e["ax"], e["ay"], e["bx"], e["by"], px, py)
    return (F.abs(cr) <= eps) & _between(px, e["ax"], e["bx"], eps) & _between(py, e["ay"], e["by"], eps)


def point_on_boundary(px, py, edge_arr: Column, eps=0.0) -> Column:
    return F.exists(edge_arr, lambda e: point_on_edge(px, py, e, eps))


def point_in_rings(px, py, edge_arr: Column) -> Column:
    """Even-odd ray crossing over all ring edges (holes and multi-parts
    included). Points on the boundary are undefined here; test them first."""
    crossings = F.aggregate(
        edge_arr, F.lit(0),
        lambda acc, e: acc + F.when(
            ((e["ay"] > py) != (e["by"] > py))
            & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]),
            1).otherwise(0))
    return (crossings % 2) == 1


def point_location(px, py, edge_arr: Column, eps=0.0) -> Column:
    """'boundary', 'interior' or 'exterior' of a point against polygon edges."""
    return (F.when(point_on_boundary(px, py, edge_arr, eps), F.lit("boundary"))
            .when(point_in_rings(px, py, edge_arr), F.lit("interior"))
            .otherwise(F.lit("exterior")))


def _boxes_meet(e, f, eps=0.0) -> Column:
    """Bounding boxes of two segments overlap: a cheap test that settles most
    pairs before any orientation arithmetic (segments that meet always pass)."""
    return ((F.greatest(e["ax"], e["bx"]) >= F.least(f["ax"], f["bx"]) - eps)
            & (F.greatest(f["ax"], f["bx"]) >= F.least(e["ax"], e["bx"]) - eps)
            & (F.greatest(e["ay"], e["by"]) >= F.least(f["ay"], f["by"]) - eps)
            & (F.greatest(f["ay"], f["by"]) >= F.least(e["ay"], e["by"]) - eps))


def segments_intersect(e, f, eps=0.0) -> Column:
    """Closed segments share at least one point."""
    return F.when(_boxes_meet(e, f, eps), _segments_intersect(e, f, eps)).otherwise(F.lit(False))


def _segments_intersect(e, f, eps=0.0) -> Column:
    o1 = _sign(_cross(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"]), eps)
    o2 = _sign(_cross(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"]), eps)
    o3 = _sign(_cross(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"]), eps)
    o4 = _sign(_cross(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"]), eps)
    on = lambda o, s, px, py: (o == 0) & _between(px, s["ax"], s["bx"], eps) & _between(py, s["ay"], s["by"], eps)
    return (((o1 * o2) < 0) & ((o3 * o4) < 0)) | on(o1, e, f["ax"], f["ay"]) | on(o2, e, f["bx"], f["by"]) \
        | on(o3, f, e["ax"], e["ay"]) | on(o4, f, e["bx"], e["by"])


def segments_cross_properly(e, f, eps=0.0) -> Column:
    """Segments cross at one point interior to both."""
    return F.when(_boxes_meet(e, f, eps), _segments_cross_properly(e, f, eps)).otherwise(F.lit(False))


def _segments_cross_properly(e, f, eps=0.0) -> Column:
    o1 = _sign(_cross(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"]), eps)
    o2 = _sign(_cross(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"]), eps)
    o3 = _sign(_cross(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"]), eps)
    o4 = _sign(_cross(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"]), eps)
    return ((o1 * o2) < 0) & ((o3 * o4) < 0)


# --------------------------------------------------------------- predicates
# Point/polygon predicates take the polygon's precomputed edge array so the
# edges are built once per polygon, not once per candidate pair.

def pt_poly_intersects(px, py, poly_edges, eps=0.0) -> Column:
    return point_on_boundary(px, py, poly_edges, eps) | point_in_rings(px, py, poly_edges)


def pt_poly_contains(px, py, poly_edges, eps=0.0) -> Column:
    """Polygon contains point: point in the interior (OGC: boundary excluded)."""
    return ~point_on_boundary(px, py, poly_edges, eps) & point_in_rings(px, py, poly_edges)


def pt_poly_touches(px, py, poly_edges, eps=0.0) -> Column:
    return point_on_boundary(px, py, poly_edges, eps)


# Polygons and lines are compared by pieces: each edge of one is cut wherever it
# meets an edge of the other, so that a piece lies wholly inside, outside or on the
# boundary of the other, and the place of its midpoint tells which.

def _cuts(e, f) -> Column:
    """Places (0 to 1 along edge e) where e meets edge f; for parallel edges, the
    places beside f's ends (a cut too many does no harm)."""
    rx, ry = e["bx"] - e["ax"], e["by"] - e["ay"]
    sx, sy = f["bx"] - f["ax"], f["by"] - f["ay"]
    d = rx * sy - ry * sx
    ox, oy = f["ax"] - e["ax"], f["ay"] - e["ay"]
    px, py = f["bx"] - e["ax"], f["by"] - e["ay"]
    t, u = F.try_divide(ox * sy - oy * sx, d), F.try_divide(ox * ry - oy * rx, d)
    square = rx * rx + ry * ry
    beside = F.array(F.try_divide(ox * rx + oy * ry, square), F.try_divide(px * rx + py * ry, square))
    at = F.when(d == 0, beside).when((u >= 0) & (u <= 1), F.array(t)).otherwise(F.array().cast("array<double>"))
    return F.filter(at, lambda x: (x > 0) & (x < 1))


def piece_midpoints(ea: Column, eb: Column) -> Column:
    """Midpoints of the pieces of edges ``ea``, cut by edges ``eb``."""
    def of_edge(e):
        met = F.flatten(F.transform(F.filter(eb, lambda f: _boxes_meet(e, f)), lambda f: _cuts(e, f)))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), met)))

        def middles(c):
            return F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: let(
                (F.element_at(c, i) + F.element_at(c, i + 1)) / 2,
                lambda t: F.struct((e["ax"] + t * (e["bx"] - e["ax"])).alias("x"),
                                   (e["ay"] + t * (e["by"] - e["ay"])).alias("y"))))
        return let(cuts, middles)
    real = F.filter(ea, lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))
    return F.flatten(F.transform(real, of_edge))


#: Rounding of a computed point, as a share of its coordinates.
ROUNDING = 1e-12


def _near_edge(p, e, eps) -> Column:
    """Point within ``eps`` (a length) and rounding of edge e."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    tol = F.lit(eps) + F.lit(ROUNDING) * (F.lit(1.0) + F.greatest(F.abs(p["x"]), F.abs(p["y"]), F.abs(e["ax"]), F.abs(e["ay"])))
    off = F.abs(_cross(e["ax"], e["ay"], e["bx"], e["by"], p["x"], p["y"]))
    return ((off <= tol * F.sqrt(dx * dx + dy * dy))
            & (p["x"] >= F.least(e["ax"], e["bx"]) - tol) & (p["x"] <= F.greatest(e["ax"], e["bx"]) + tol)
            & (p["y"] >= F.least(e["ay"], e["by"]) - tol) & (p["y"] <= F.greatest(e["ay"], e["by"]) + tol))


def _on(p, edges, eps) -> Column:
    return F.exists(edges, lambda e: _near_edge(p, e, eps))


def strictly_inside(p, poly_edges, eps=0.0) -> Column:
    return ~_on(p, poly_edges, eps) & point_in_rings(p["x"], p["y"], poly_edges)


def strictly_outside(p, poly_edges, eps=0.0) -> Column:
    return ~_on(p, poly_edges, eps) & ~point_in_rings(p["x"], p["y"], poly_edges)


def interior_points(g) -> Column:
    """A point in the interior of each part of a polygon: the middle of the first
    stretch of a level line, halfway between the part's two lowest vertex levels."""
    def of_part(part):
        es = F.flatten(F.transform(part, ring_edges))
        levels = F.array_sort(F.array_distinct(F.transform(F.flatten(part), lambda q: q["y"])))

        def on_level(y):
            crossing = F.filter(es, lambda e: (e["ay"] > y) != (e["by"] > y))
            xs = F.array_sort(F.transform(crossing, lambda e: e["ax"] + F.try_divide((y - e["ay"]) * (e["bx"] - e["ax"]), e["by"] - e["ay"])))
            return let(xs, lambda x: F.when(F.size(x) >= 2, F.struct(((x[0] + x[1]) / 2).alias("x"), y.alias("y"))))
        return let(levels, lambda v: F.when(F.size(v) >= 2, let((v[0] + v[1]) / 2, on_level)))
    return F.filter(F.transform(_c(g)["parts"], of_part), lambda q: q.isNotNull())


def poly_poly_relations(ga, ea, gb, eb, eps=0.0) -> dict[str, Column]:
    """intersects / touches / within (A in B) of two polygons.

    Interiors meet if a piece of one boundary, or an interior point of a part of
    one, lies strictly inside the other. A is within B if no piece of A's boundary is
    outside B, no piece of B's boundary (its holes') is inside A, and interiors meet.
    """
    meet = F.exists(ea, lambda e: F.exists(eb, lambda f: segments_intersect(e, f, eps)))
    pa, pb = piece_midpoints(ea, eb), piece_midpoints(eb, ea)
    b_in_a = F.exists(pb, lambda p: strictly_inside(p, ea, eps))
    interiors = (F.exists(pa, lambda p: strictly_inside(p, eb, eps)) | b_in_a
                 | F.exists(interior_points(ga), lambda p: strictly_inside(p, eb, eps))
                 | F.exists(interior_points(gb), lambda p: strictly_inside(p, ea, eps)))
    outside = F.exists(pa, lambda p: strictly_outside(p, eb, eps))
    return {"intersects": meet | interiors, "touches": meet & ~interiors, "within": interiors & ~outside & ~b_in_a}


def line_boundary(edges) -> Column:
    """Boundary of a (multi-)line by the mod-2 rule: the points in which an odd number of its
    stretches end. A closed line has none, nor has a point that two stretches share."""
    ends = F.flatten(F.transform(edges, lambda e: F.array(
        F.struct(e["ax"].alias("x"), e["ay"].alias("y")), F.struct(e["bx"].alias("x"), e["by"].alias("y")))))
    kind = "struct<p:struct<x:double,y:double>,odd:boolean,out:array<struct<x:double,y:double>>>"
    none = F.struct(F.lit(None).alias("p"), F.lit(False).alias("odd"), F.array().alias("out")).cast(kind)

    def done(acc):
        return F.when(acc["odd"], F.concat(acc["out"], F.array(acc["p"]))).otherwise(acc["out"])

    def step(acc, q):
        same = F.coalesce(acc["p"] == q, F.lit(False))
        return F.struct(q.alias("p"), F.when(same, ~acc["odd"]).otherwise(F.lit(True)).alias("odd"),
                        F.when(same, acc["out"]).otherwise(done(acc)).alias("out")).cast(kind)
    # equal points stand together in order: an odd run is a boundary point
    return F.aggregate(F.sort_array(ends), none, step, done)


def line_line_relations(ea, eb, eps=0.0) -> dict[str, Column]:
    """intersects / crosses / touches / within (A in B) of two lines. They cross if
    their interiors meet in points only, touch if only ends meet the other line."""
    meet = F.exists(ea, lambda e: F.exists(eb, lambda f: segments_intersect(e, f, eps)))
    pieces = piece_midpoints(ea, eb)
    shared = F.exists(pieces, lambda p: _on(p, eb, eps))

    def points(e):
        near = F.filter(eb, lambda f: segments_intersect(e, f, eps))
        at = F.flatten(F.transform(near, lambda f: F.concat(_cuts(e, f), F.array(F.lit(0.0), F.lit(1.0)))))
        return F.transform(at, lambda t: F.struct((e["ax"] + t * (e["bx"] - e["ax"])).alias("x"),
                                                  (e["ay"] + t * (e["by"] - e["ay"])).alias("y")))
    met = F.filter(F.flatten(F.transform(ea, points)), lambda p: _on(p, eb, eps))
    same = lambda p, q: (F.abs(p["x"] - q["x"]) <= eps + ROUNDING * 10) & (F.abs(p["y"] - q["y"]) <= eps + ROUNDING * 10)
    inner = let(F.concat(line_boundary(ea), line_boundary(eb)),
                lambda ends: F.exists(met, lambda p: ~F.exists(ends, lambda q: same(p, q))))
    away = F.exists(pieces, lambda p: ~_on(p, eb, eps))
    return {"intersects": meet, "crosses": meet & ~shared & inner, "touches": meet & ~shared & ~inner,
            "within": meet & ~away}


def line_poly_relations(le, pe, eps=0.0) -> dict[str, Column]:
    """intersects / crosses / touches / within of a line and a polygon."""
    meet = F.exists(le, lambda e: F.exists(pe, lambda f: segments_intersect(e, f, eps)))
    pieces = piece_midpoints(le, pe)
    inside = F.exists(pieces, lambda p: strictly_inside(p, pe, eps))
    outside = F.exists(pieces, lambda p: strictly_outside(p, pe, eps))
    return {"intersects": meet | inside, "crosses": inside & outside, "touches": meet & ~inside, "within": inside & ~outside}


# --------------------------------------------------------------- validity

def ring_is_closed(ring: Column) -> Column:
    return (ring[0]["x"] == F.element_at(ring, -1)["x"]) & (ring[0]["y"] == F.element_at(ring, -1)["y"])


def ring_self_crosses(ring: Column) -> Column:
    """Non-adjacent edges of one ring that intersect (pairwise, quadratic).
    The indexed edge array is built once (``let``), not once per outer edge."""
    def pairs(es):
        m = F.size(es)
        return F.exists(es, lambda a: F.exists(es, lambda b: (b["i"] > a["i"] + 1)
                                               & ~((a["i"] == 0) & (b["i"] == m - 1))
                                               & segments_intersect(a["e"], b["e"])))
    return let(F.transform(ring_edges(ring), lambda e, i: F.struct(e.alias("e"), i.alias("i"))), pairs)


def _ring_has_spike(ring: Column) -> Column:
    """An edge that runs back along the one before it."""
    def turns(es):
        return F.exists(F.sequence(F.lit(1), F.size(es)), lambda i: let(
            F.struct(F.element_at(es, i).alias("e"), F.element_at(es, i % F.size(es) + 1).alias("f")), back))

    def back(pair):
        e, f = pair["e"], pair["f"]
        rx, ry, sx, sy = e["bx"] - e["ax"], e["by"] - e["ay"], f["bx"] - f["ax"], f["by"] - f["ay"]
        return (rx * sy - ry * sx == 0) & (rx * sx + ry * sy < 0)
    real = F.filter(ring_edges(ring), lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))
    return let(real, lambda es: F.when(F.size(es) > 1, turns(es)).otherwise(F.lit(False)))


def _part_ok(part: Column) -> Column:
    """Holes lie in their shell and not in one another."""
    def check(shell):
        holes = F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))

        def hole_ok(h, i):
            he = ring_edges(h)
            in_shell = ~F.exists(piece_midpoints(he, shell), lambda p: strictly_outside(p, shell))
            inner = F.exists(piece_midpoints(he, shell), lambda p: strictly_inside(p, shell))
            others = F.filter(holes, lambda o, j: j != i)
            apart = ~F.exists(others, lambda o: let(ring_edges(o), lambda oe: F.exists(
                piece_midpoints(he, oe), lambda p: strictly_inside(p, oe)) | F.forall(
                piece_midpoints(he, oe), lambda p: _on(p, oe, 0.0))))
            return in_shell & inner & apart
        return F.forall(F.transform(holes, hole_ok), lambda ok: ok)
    return F.when(F.size(part) < 2, F.lit(True)).otherwise(let(ring_edges(part[0]), check))


def _parts_apart(parts: Column) -> Column:
    """Interiors of the parts do not meet."""
    def clash(a, i):
        ea = F.flatten(F.transform(a, ring_edges))
        later = F.filter(parts, lambda b, j: j > i)
        own = interior_points(F.struct(F.array(a).alias("parts")))

        def meets(b):
            eb = F.flatten(F.transform(b, ring_edges))
            return (F.exists(piece_midpoints(ea, eb), lambda p: strictly_inside(p, eb))
                    | F.exists(piece_midpoints(eb, ea), lambda p: strictly_inside(p, ea))
                    | F.exists(own, lambda p: strictly_inside(p, eb)))
        return F.exists(later, meets)
    return F.when(F.size(parts) < 2, F.lit(True)).otherwise(~F.exists(F.transform(parts, clash), lambda x: x))


def is_valid(g) -> Column:
    """Polygon rings closed with >= 4 points, without self-crossing and
    spikes, holes inside their shell and outside one another, parts that do not
    overlap; lines need >= 2 points; points one coordinate; NaN is invalid."""
    gc = _c(g)
    t = F.lower(gc["type"])
    rings = F.flatten(gc["parts"])
    finite = F.forall(coords(gc), lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"])
                      & p["x"].isNotNull() & p["y"].isNotNull())
    poly_ok = F.forall(rings, lambda r: (F.size(r) >= 4) & ring_is_closed(r) & ~ring_self_crosses(r) & ~_ring_has_spike(r))
    # how rings stand to each other matters only where there are several
    poly_ok = F.when(poly_ok, F.forall(gc["parts"], _part_ok) & _parts_apart(gc["parts"])).otherwise(F.lit(False))
    line_ok = F.forall(rings, lambda r: F.size(r) >= 2)
    pt_ok = F.forall(rings, lambda r: F.size(r) == 1)
    return (F.when(gc.isNull(), F.lit(False))
            .when(F.size(gc["parts"]) == 0, F.lit(False))
            .when(t.contains("polygon"), finite & poly_ok)
            .when(t.contains("line"), finite & line_ok)
            .otherwise(finite & pt_ok))


def _signed_area(ring: Column) -> Column:
    return F.aggregate(ring_edges(ring), F.lit(0.0),
                       lambda a, e: a + (e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def _split_once(ring: Column) -> Column:
    """A closed ring with exactly one proper self-crossing (edges i < j)
    split at the crossing point X into ``[r0..ri, X, r(j+1)..r(n-1)]`` and
    ``[X, r(i+1)..rj, X]``; any other ring is returned alone. Returns an
    array of rings."""
    def with_edges(es):
        m = F.size(es)

        def pair_ok(a, b):
            return (b["i"] > a["i"] + 1) & ~((a["i"] == 0) & (b["i"] == m - 1)) & segments_intersect(a["e"], b["e"])
        # simple rings (most) stop at this short-circuiting test; only crossing
        # rings build the (few) intersecting pairs
        crossing = F.exists(es, lambda a: F.exists(es, lambda b: pair_ok(a, b)))
        hits = F.flatten(F.transform(es, lambda a: F.transform(
            F.filter(es, lambda b: pair_ok(a, b)),
            lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), a["e"].alias("e"), b["e"].alias("f")))))
        split = let(hits, lambda hs: F.when(
            (F.size(hs) == 1) & segments_cross_properly(hs[0]["e"], hs[0]["f"]), _split_at(ring, hs[0]))
            .otherwise(F.array(ring)))
        return F.when(crossing, split).otherwise(F.array(ring))
    return let(F.transform(ring_edges(ring), lambda e, i: F.struct(e.alias("e"), i.alias("i"))), with_edges)


def _split_at(ring: Column, hit: Column) -> Column:
    e, f, i, j = hit["e"], hit["f"], hit["i"], hit["j"]
    # X = A + t (B - A), t = ((C - A) x (D - C)) / ((B - A) x (D - C))
    rx, ry = e["bx"] - e["ax"], e["by"] - e["ay"]
    sx, sy = f["bx"] - f["ax"], f["by"] - f["ay"]
    t = ((f["ax"] - e["ax"]) * sy - (f["ay"] - e["ay"]) * sx) / (rx * sy - ry * sx)
    x = F.struct((e["ax"] + t * rx).alias("x"), (e["ay"] + t * ry).alias("y"))
    n = F.size(ring)
    first = F.concat(F.slice(ring, 1, i + 1), F.array(x), F.slice(ring, j + 2, n - j - 1))
    second = F.concat(F.array(x), F.slice(ring, i + 2, j - i), F.array(x))
    return F.array(first, second)


def make_valid(g) -> Column:
    """Drop consecutive repeated vertices, close polygon rings, split a
    single-ring polygon part whose ring crosses itself exactly once (the
    bow-tie) into two parts at the crossing point (the geometry becomes a
    MultiPolygon), orient outer rings counter-clockwise and holes clockwise.
    Rings with several self-crossings, or touching ones, are left as they are
    and ``is_valid`` still reports them. Each stage is bound once (``let``),
    so no stage is re-evaluated."""
    gc = _c(g)
    is_poly = F.lower(gc["type"]).contains("polygon")

    def dedupe(ring):
        return F.filter(ring, lambda p, i: (i == 0) | (p["x"] != ring[i - 1]["x"]) | (p["y"] != ring[i - 1]["y"]))

    def close(ring):
        return F.when(ring_is_closed(ring), ring).otherwise(F.concat(ring, F.array(ring[0])))

    def orient(ring, i):
        def by_area(a):
            want_ccw = i == 0
            flip = (want_ccw & (a < 0)) | (~want_ccw & (a > 0))
            return F.when(flip, F.reverse(ring)).otherwise(ring)
        return let(_signed_area(ring), by_area)

    def fix(ring, i):
        return let(dedupe(ring), lambda d: F.when(is_poly, let(close(d), lambda c: orient(c, i))).otherwise(d))

    fixed = F.transform(gc["parts"], lambda part: F.transform(part, fix))

    def split_part(part):
        # only single-ring parts are split; each piece is a new outer ring
        return F.when(is_poly & (F.size(part) == 1),
                      F.transform(_split_once(part[0]), lambda r: F.array(orient(r, F.lit(0)))))\
            .otherwise(F.array(part))
    parts = let(fixed, lambda fp: F.flatten(F.transform(fp, split_part)))
    return let(parts, lambda ps: F.struct(
        F.when(is_poly & (F.size(ps) > 1), F.lit("MultiPolygon")).otherwise(gc["type"]).alias("type"),
        gc["srid"].alias("srid"), ps.alias("parts")))


# --------------------------------------------------------------- extent

def round_half_up(c, digits: int = 4) -> Column:
    """JavaScript ``Math.round(v*10^d)/10^d``: halves go up (towards +inf)."""
    k = float(10 ** digits)
    return F.floor(_c(c) * k + 0.5) / k


def clamp_lon(c) -> Column:
    return F.greatest(F.lit(-180.0), F.least(F.lit(180.0), _c(c)))


def clamp_lat(c) -> Column:
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), _c(c)))


def extent_checks(w, s, e, n) -> dict[str, Column]:
    """Width, height, degenerate drawn box (<= 1e-5) and invalid order."""
    w, s, e, n = map(_c, (w, s, e, n))
    width, height = F.abs(e - w), F.abs(n - s)
    return {"width": width, "height": height,
            "degenerate": ~((width > 0.00001) & (height > 0.00001)),
            "invalid_order": (w >= e) | (s >= n)}


# --------------------------------------------------------------- CRS

EPSG_URI_PREFIX = "http://www.opengis.net/def/crs/EPSG/0/"
CRS84_URI = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"
# URIs advertised next to a non-WGS84 native CRS, in order.
COMMON_CRS_URIS = (
    "http://www.opengis.net/def/crs/EPSG/0/4326",
    "http://www.opengis.net/def/crs/EPSG/0/4258",
    "http://www.opengis.net/def/crs/EPSG/0/3857",
)


def epsg_from_wkt(wkt) -> Column:
    """EPSG code from WKT1 ``AUTHORITY["EPSG","n"]`` else WKT2 ``ID["EPSG",n]``."""
    w = _c(wkt)
    a = F.regexp_extract(w, r'AUTHORITY\["EPSG","(\d+)"\]', 1)
    b = F.regexp_extract(w, r'ID\["EPSG",\s*(\d+)\]', 1)
    return F.when(a != "", a.cast("int")).when(b != "", b.cast("int"))


def epsg_from_name(crs) -> Column:
    """Trailing 4-5 digit code of a CRS name such as ``EPSG:25833``."""
    m = F.regexp_extract(_c(crs), r"(\d{4,5})$", 1)
    return F.when(m != "", m.cast("int"))


def crs_uri(crs) -> Column:
    """Pass URIs through; ``EPSG:n`` -> OGC URI."""
    c = _c(crs)
    return (F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
            .when(c.startswith("http"), c)
            .otherwise(F.concat(F.lit(EPSG_URI_PREFIX), F.split(c, ":").getItem(1))))


def is_wgs84(crs) -> Column:
    c = _c(crs)
    return (c.isNull() | (c == "") | c.isin("EPSG:4326", "4326", "CRS84")
            | c.contains("CRS84") | c.contains("EPSG/0/4326"))


def crs_list(crs) -> Column:
    """CRS84, native, then the common ones; duplicates dropped, order kept;
    empty when the native CRS is WGS84 or unknown."""
    u = crs_uri(crs)
    full = F.array_distinct(F.array(F.lit(CRS84_URI), u, *[F.lit(x) for x in COMMON_CRS_URIS]))
    return F.when(~is_wgs84(crs) & u.isNotNull(), full).otherwise(F.array().cast("array<string>"))


# --------------------------------------------------------------- reprojection
# Ellipsoids and projections of the six supported CRS.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
UTM_K0, UTM_E0 = 0.9996, 500000.0
UTM_ZONES = {25832: 32, 25833: 33, 25835: 35}   # ETRS89 / UTM zone nN, GRS80
GEOGRAPHIC = (4326, 4258)                        # 4258 taken equal to 4326 (null shift)
MERCATOR = 3857
SUPPORTED_SRIDS = (4326, 3857, 25832, 25833, 25835, 4258)


def _kruger(a: float, f: float):
    """Coefficients of the Krüger series to n^4 (transverse Mercator)."""
    n = f / (2 - f)
    A = a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180,
             13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440,
             61 * n ** 3 / 240 - 103 * n ** 4 / 140,
             49561 * n ** 4 / 161280)
    beta = (n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360,
            n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440,
            17 * n ** 3 / 480 - 37 * n ** 4 / 840,
            4397 * n ** 4 / 161280)
    delta = (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 + 116 * n ** 4 / 45,
             7 * n ** 2 / 3 - 8 * n ** 3 / 5 - 227 * n ** 4 / 45,
             56 * n ** 3 / 15 - 136 * n ** 4 / 35,
             4279 * n ** 4 / 630)
    return n, A, alpha, beta, delta


def _utm_forward(lon, lat, zone: int, a=GRS80_A, f=GRS80_F):
    n, A, alpha, _, _ = _kruger(a, f)
    lam0 = math.radians(zone * 6 - 183)
    phi = F.radians(_c(lat))
    dl = F.radians(_c(lon)) - F.lit(lam0)
    k = 2 * math.sqrt(n) / (1 + n)
    sphi = F.sin(phi)
    t = F.sinh(F.atanh(sphi) - F.lit(k) * F.atanh(F.lit(k) * sphi))
    xi = F.atan(t / F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    e_sum, n_sum = eta, xi
    for j, al in enumerate(alpha, start=1):
        e_sum = e_sum + F.lit(al) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n_sum = n_sum + F.lit(al) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(UTM_E0) + F.lit(UTM_K0 * A) * e_sum, F.lit(UTM_K0 * A) * n_sum


def _utm_inverse(x, y, zone: int, a=GRS80_A, f=GRS80_F):
    n, A, _, beta, delta = _kruger(a, f)
    lam0 = math.radians(zone * 6 - 183)
    xi = _c(y) / F.lit(UTM_K0 * A)
    eta = (_c(x) - F.lit(UTM_E0)) / F.lit(UTM_K0 * A)
    xp, ep = xi, eta
    for j, b in enumerate(beta, start=1):
        xp = xp - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    phi = chi
    for j, d in enumerate(delta, start=1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    lam = F.lit(lam0) + F.atan(F.sinh(ep) / F.cos(xp))
    return F.degrees(lam), F.degrees(phi)


def _merc_forward(lon, lat):
    R = WGS84_A
    return (F.lit(R) * F.radians(_c(lon)),
            F.lit(R) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2)))


def _merc_inverse(x, y):
    R = WGS84_A
    return (F.degrees(_c(x) / F.lit(R)),
            F.degrees(2 * F.atan(F.exp(_c(y) / F.lit(R))) - F.lit(math.pi / 2)))


def to_wgs84(x, y, srid: int):
    if srid in GEOGRAPHIC:
        return _c(x), _c(y)
    if srid == MERCATOR:
        return _merc_inverse(x, y)
    if srid in UTM_ZONES:
        return _utm_inverse(x, y, UTM_ZONES[srid])
    raise ValueError(f"unsupported CRS EPSG:{srid}; supported: {SUPPORTED_SRIDS}")


def from_wgs84(lon, lat, srid: int):
    if srid in GEOGRAPHIC:
        return _c(lon), _c(lat)
    if srid == MERCATOR:
        return _merc_forward(lon, lat)
    if srid in UTM_ZONES:
        return _utm_forward(lon, lat, UTM_ZONES[srid])
    raise ValueError(f"unsupported CRS EPSG:{srid}; supported: {SUPPORTED_SRIDS}")


def reproject_xy(x, y, src: int, dst: int) -> tuple[Column, Column]:
    """G1: (x, y) columns from ``src`` to ``dst`` EPSG code via WGS84."""
    if src == dst or (src in GEOGRAPHIC and dst in GEOGRAPHIC):
        return _c(x), _c(y)
    lon, lat = to_wgs84(x, y, src)
    return from_wgs84(lon, lat, dst)


def reproject_geometry(g, src: int, dst: int) -> Column:
    """G1 on every vertex of a geometry column."""
    gc = _c(g)

    def move(p):
        nx, ny = reproject_xy(p["x"], p["y"], src, dst)
        return F.struct(nx.alias("x"), ny.alias("y"))

    parts = F.transform(gc["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, move)))
    return F.struct(gc["type"].alias("type"), F.lit(dst).alias("srid"), parts.alias("parts"))


def bbox_to_wgs84(min_x, min_y, max_x, max_y, src: int, densify: int = 0) -> dict[str, Column]:
    """G2. ``densify=0``: the two corners only (parity with the reference);
    ``densify=k``: k points per edge plus the four corners, which bounds a
    projected box correctly when its edges curve in WGS84."""
    if src in GEOGRAPHIC:
        return {"west": _c(min_x), "south": _c(min_y), "east": _c(max_x), "north": _c(max_y)}
    if densify <= 0:
        w, s = to_wgs84(min_x, min_y, src)
        e, n = to_wgs84(max_x, max_y, src)
        return {"west": w, "south": s, "east": e, "north": n}
    xs, ys = [], []
    steps = [i / (densify + 1) for i in range(densify + 2)]
    x0, y0, x1, y1 = map(_c, (min_x, min_y, max_x, max_y))
    samples = []
    for t in steps:
        samples += [(x0 + (x1 - x0) * t, y0), (x0 + (x1 - x0) * t, y1),
                    (x0, y0 + (y1 - y0) * t), (x1, y0 + (y1 - y0) * t)]
    for sx, sy in samples:
        lon, lat = to_wgs84(sx, sy, src)
        xs.append(lon)
        ys.append(lat)
    return {"west": F.least(*xs), "south": F.least(*ys), "east": F.greatest(*xs), "north": F.greatest(*ys)}
