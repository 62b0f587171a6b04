"""Validity and repair of polygons of any shape (G3, G4, A9), as jobs over edges.

Polygons of up to ``FEW`` points are judged and rebuilt whole, many at a time, by the task that has their
row (``rings``). A larger polygon is taken apart into its edges, which meet in cells: each feature has a grid
of its own, as fine as its edges are many, and edges are paired by an equi-join
on (feature, cell). So a ring of 100,000 points is spread over many tasks, and its cost
grows with its edges, not with their square.

``polygon_faults`` tells why polygons are invalid: crossing, touching or
overlapping edges, spikes, rings outside or inside one another, and interiors that
touching rings cut in pieces. ``repair`` rebuilds invalid ones by the even-odd
rule: edges are cut wherever they meet, pieces that lie on one another in even
number vanish, each other piece learns from the number of pieces below its middle
on which side the interior is, pieces are linked at nodes in order of their
angle, and walking the links gives shells and holes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import ensure_checkpoint_dir
from . import rings as R
from .rings import SHEAR, SNAP, _within, closes_circle, walk  # noqa: F401

#: Polygons of at most so many points are one task's work, pairs of their edges included.
FEW = 512
_PARTS = "array<array<array<struct<x:double,y:double>>>>"
#: Features of at most so many points are one cell.
ONE_CELL = 32


def _settled(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the checkpoint folder: later steps start from it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _is_polygon(geom: str) -> Column:
    return F.lower(F.col(f"{geom}.type")).contains("polygon")


def _distinct_points(ring: Column) -> Column:
    return F.filter(ring, lambda p, i: (i == 0) | (p["x"] != ring[i - 1]["x"]) | (p["y"] != ring[i - 1]["y"]))


def _finite(geom: str) -> Column:
    return _all_finite(G.coords(geom))


def _all_finite(pts: Column) -> Column:
    big = float("inf")
    return F.forall(pts, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"])
                    & (F.abs(p["x"]) < big) & (F.abs(p["y"]) < big))


def ring_table(df: DataFrame, key: str, geom: str = "geometry") -> DataFrame:
    """(fid, part, ring, pts, and the feature's grid) of polygons with finite coordinates; points that
    repeat the one before are left out, open rings are closed."""
    # bound once each (``let``): a geometry may be a long expression, which every mention of its points would compute anew
    side = lambda e: F.sqrt(F.pow(e["bx"] - e["ax"], 2) + F.pow(e["by"] - e["ay"], 2))

    def frame(g):
        length = F.aggregate(F.flatten(F.transform(F.flatten(g["parts"]), G.ring_edges)), F.lit(0.0), lambda acc, e: acc + side(e))

        def of(pts):
            ends = [f(F.transform(pts, lambda p: p[c])).alias(n) for n, f, c in (  # noqa: B023
                ("x0", F.array_min, "x"), ("y0", F.array_min, "y"), ("x1", F.array_max, "x"), ("y1", F.array_max, "y"))]
            row = F.struct(g["parts"].alias("parts"), F.size(pts).alias("n"), *ends, length.alias("length"))
            return F.when(F.lower(g["type"]).contains("polygon") & _all_finite(pts) & (F.size(pts) > 0), F.array(row))
        return G.let(G.coords(g), of)
    g = df.select(F.col(key).alias("fid"), F.inline(G.let(F.col(geom), frame)))
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    g = g.withColumn("extent", F.when(extent > 0, extent).otherwise(1.0))
    # as fine as lets its edges pass through some two cells each: short edges, as of a long coast, make many
    # cells (only those passed through have rows), edges across the whole feature make few
    g = g.withColumn("around", F.col("length") / F.col("extent"))
    fine = F.least(F.floor(F.col("n") / 4), F.floor(F.col("n") * 2 / F.greatest(F.col("around"), F.lit(1.0)))).cast("int")
    g = g.withColumn("grid", F.when(F.col("n") <= ONE_CELL, 1).otherwise(F.greatest(F.lit(1), fine)))
    rings = g.select("fid", "n", "x0", "y0", "extent", "grid", F.posexplode("parts").alias("part", "rings")).select(
        "fid", "n", "x0", "y0", "extent", "grid", "part", F.posexplode("rings").alias("ring", "raw")).filter(F.size("raw") > 0)

    def closing(pts):
        first, last = pts[0], F.element_at(pts, -1)
        closed = (first["x"] == last["x"]) & (first["y"] == last["y"]) & (F.size(pts) > 1)
        return F.array(F.struct(closed.alias("closed"), F.when(closed, pts).otherwise(F.concat(pts, F.array(first))).alias("pts")))
    return rings.select("fid", "part", "ring", "n", "x0", "y0", "extent", "grid",
                        F.inline(G.let(_distinct_points(F.col("raw")), closing)).alias("closed", "pts"))


def edge_table(rings: DataFrame) -> DataFrame:
    """A row per edge: ``e`` of the ``n_ring`` edges of its ring, ``id`` unique in its feature."""
    out = rings.select("fid", "part", "ring", "n", "x0", "y0", "extent", "grid", (F.size("pts") - 1).alias("n_ring"),
                       F.posexplode(G.ring_edges(F.col("pts"))).alias("e", "s")).select("*", "s.*").drop("s")
    out = out.filter((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))
    return out.withColumn("id", F.struct("part", "ring", "e"))


def in_cells(edges: DataFrame) -> DataFrame:
    """Edges once per cell that they pass through: for each column of cells, the rows
    that the edge covers in it."""
    w = F.col("extent") / F.col("grid")
    col = lambda v: F.least(F.greatest(F.floor((v - F.col("x0")) / w), F.lit(0)), F.col("grid") - 1).cast("int")
    row = lambda v: F.least(F.greatest(F.floor((v - F.col("y0")) / w), F.lit(0)), F.col("grid") - 1).cast("int")
    lo, hi = F.least("ax", "bx"), F.greatest("ax", "bx")
    out = edges.withColumn("cx", F.explode(F.sequence(col(lo), col(hi))))
    dx = F.col("bx") - F.col("ax")
    at = lambda x: F.col("ay") + (x - F.col("ax")) / dx * (F.col("by") - F.col("ay"))
    # a hair wider than the column, so that rounding loses no cell
    hair = w * 1e-9
    left = F.greatest(lo, F.col("x0") + F.col("cx") * w - hair)
    right = F.least(hi, F.col("x0") + (F.col("cx") + 1) * w + hair)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    steep = F.abs(dx) <= hair
    y0 = F.when(steep, low).otherwise(F.greatest(low, F.least(at(left), at(right)) - hair))
    y1 = F.when(steep, high).otherwise(F.least(high, F.greatest(at(left), at(right)) + hair))
    out = out.withColumn("cy", F.explode(F.sequence(row(F.least(y0, y1)), row(F.greatest(y0, y1)))))
    return out.withColumn("cell", F.col("cx").cast("long") * F.col("grid") + F.col("cy")).drop("cx", "cy")


_FRAME = ("grid", "x0", "y0", "extent")
_SIDE = ("part", "ring", "e", "n_ring", "id", "ax", "ay", "bx", "by")


def _boxes_meet(extent: Column, one, two) -> Column:
    """Boxes of two edges overlap; ``one`` and ``two`` give an edge's field by name."""
    meet = F.lit(True)
    for c in "xy":
        lo, hi = (lambda g, c=c: F.least(g(f"a{c}"), g(f"b{c}"))), (lambda g, c=c: F.greatest(g(f"a{c}"), g(f"b{c}")))
        meet = meet & (lo(one) <= hi(two) + extent * SNAP) & (lo(two) <= hi(one) + extent * SNAP)
    return meet


def edge_pairs(edges: DataFrame) -> DataFrame:
    """Pairs of edges of one feature whose boxes meet (columns ``*1`` and ``*2``, ``id1 < id2``).

    Features of one cell pair their few edges in a row of their own, after one shuffle by feature; in the
    others edges that share a cell are joined, and a pair comes once per shared cell.
    """
    names = [f"{c}{k}" for k in (1, 2) for c in _SIDE]
    few = edges.filter("grid = 1").groupBy("fid").agg(
        *[F.first(c).alias(c) for c in _FRAME], F.collect_list(F.struct("id", *[c for c in _SIDE if c != "id"])).alias("es"))
    few = few.select("fid", *_FRAME, F.explode("es").alias("one"), "es").select("fid", *_FRAME, "one", F.explode("es").alias("two"))
    few = few.filter((F.col("two.id") > F.col("one.id")) & _boxes_meet(F.col("extent"), lambda c: F.col(f"one.{c}"), lambda c: F.col(f"two.{c}")))
    few = few.select("fid", *_FRAME, *[F.col(f"{o}.{c}").alias(f"{c}{k}") for o, k in (("one", 1), ("two", 2)) for c in _SIDE])
    cells = in_cells(edges.filter("grid > 1"))
    a = cells.select("fid", "cell", *_FRAME, *[F.col(c).alias(f"{c}1") for c in _SIDE])
    b = cells.select("fid", "cell", *[F.col(c).alias(f"{c}2") for c in _SIDE])
    meet = _boxes_meet(F.col("extent"), lambda c: F.col(f"{c}1"), lambda c: F.col(f"{c}2"))
    many = a.join(b, ["fid", "cell"]).filter((F.col("id1") < F.col("id2")) & meet)
    return few.unionByName(many.select("fid", *_FRAME, *names))


def _cross(k: int, x: Column, y: Column) -> Column:
    """Twice the area of edge k and a point: positive to its left."""
    return ((F.col(f"bx{k}") - F.col(f"ax{k}")) * (y - F.col(f"ay{k}")) - (F.col(f"by{k}") - F.col(f"ay{k}")) * (x - F.col(f"ax{k}")))


def _with_sides(pairs: DataFrame, snap: float) -> DataFrame:
    """For each end of either edge of a pair: which side of the other edge (0: in line with
    it), and whether it lies on it (``on_a1``: the start of edge 1 lies on edge 2)."""
    for k, o in ((1, 2), (2, 1)):
        length = F.sqrt(F.pow(F.col(f"bx{o}") - F.col(f"ax{o}"), 2) + F.pow(F.col(f"by{o}") - F.col(f"ay{o}"), 2))
        tol = F.col("extent") * snap
        for end in "ab":
            x, y = F.col(f"{end}x{k}"), F.col(f"{end}y{k}")
            c = _cross(o, x, y)
            side = F.when(F.abs(c) <= tol * length, 0).otherwise(F.signum(c)).cast("int")
            inside = ((x >= F.least(f"ax{o}", f"bx{o}") - tol) & (x <= F.greatest(f"ax{o}", f"bx{o}") + tol)
                      & (y >= F.least(f"ay{o}", f"by{o}") - tol) & (y <= F.greatest(f"ay{o}", f"by{o}") + tol))
            pairs = pairs.withColumn(f"side_{end}{k}", side).withColumn(f"on_{end}{k}", (F.col(f"side_{end}{k}") == 0) & inside)
    crossing = (F.col("side_a1") * F.col("side_b1") < 0) & (F.col("side_a2") * F.col("side_b2") < 0)
    return pairs.withColumn("crossing", crossing)


# ------------------------------------------------------------ numbers below

def in_strips(edges: DataFrame) -> DataFrame:
    """Adds sheared ends ``ux, vx`` and the strips of a feature: ``s0..s1`` that an edge covers, ``sm`` of its middle."""
    u, v = F.col("ax") + F.col("ay") * SHEAR, F.col("bx") + F.col("by") * SHEAR
    # sheared coordinates span at most (1 + SHEAR) extents
    strips = F.col("grid")
    w = F.col("extent") * (1 + SHEAR) / strips
    at = lambda x: F.least(F.greatest(F.floor((x - F.col("x0") - F.col("y0") * SHEAR) / w), F.lit(0)), strips - 1).cast("int")
    out = edges.withColumns({"ux": u, "vx": v}).withColumns({"mx": (F.col("ux") + F.col("vx")) / 2, "my": (F.col("ay") + F.col("by")) / 2})
    return out.withColumns({"s0": at(F.least("ux", "vx")), "s1": at(F.greatest("ux", "vx")), "sm": at(F.col("mx"))})


def below(points: DataFrame, edges: DataFrame, extra: list[str]) -> DataFrame:
    """Edges of the same feature (``extra`` names of theirs with a 2 behind) that pass below or through the middle of each row of
    ``points``: columns of ``points`` and ``under``: 1 below, 0 through it."""
    spans = edges.select("fid", F.explode(F.sequence("s0", "s1")).alias("sm"), *[F.col(c).alias(f"{c}2") for c in (*extra, "ux", "vx", "ay", "by")])
    j = points.join(spans, ["fid", "sm"])
    j = j.filter((F.least("ux2", "vx2") <= F.col("mx")) & (F.col("mx") < F.greatest("ux2", "vx2")))
    y = F.col("ay2") + (F.col("mx") - F.col("ux2")) / (F.col("vx2") - F.col("ux2")) * (F.col("by2") - F.col("ay2"))
    return j.withColumn("rise", F.col("my") - y)


# ------------------------------------------------------------ few points, many points

def _dealt(df: DataFrame, key: str, geom: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows that are a feature of their own of up to ``FEW`` points, and the others (None: there are none):
    larger ones, and those whose key is null or comes again, which are told apart by key alone."""
    points = F.aggregate(F.flatten(F.col(f"{geom}.parts")), F.lit(0), lambda n, ring: n + F.size(ring))
    many = _is_polygon(geom) & (points > FEW)
    other = df.select(F.col(key).alias("_other"), F.coalesce(many, F.lit(False)).alias("many")).groupBy("_other").agg(
        F.count(F.lit(1)).alias("rows"), F.max("many").alias("many"))
    other = _settled(other.filter(F.col("_other").isNull() | (F.col("rows") > 1) | F.col("many")).select("_other"))
    if other.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("_other"))
    return df.join(other, same, "left_anti"), df.join(other, same, "left_semi")


def _of_parts(f, kind: str, geom: str) -> Column:
    """``f`` of each polygon's parts, run once per row: a filter on a deterministic one would be moved below and run it there, too."""
    return F.arrow_udf(f, kind).asNondeterministic()(F.when(_is_polygon(geom), F.col(f"{geom}.parts")))


def _fault(geom: str) -> Column:
    return _of_parts(R.faults, "string", geom)


# ------------------------------------------------------------ validity

def polygon_faults(df: DataFrame, key: str, geom: str = "geometry") -> DataFrame:
    """``key, fault``: of the faults of each invalid polygon the first by name; how its rings lie in one
    another is asked only where its edges have none. Valid polygons have no row.

    ``key`` is unique and not null. Faults: ``coordinate`` (null, NaN, infinite), ``empty``, ``open ring``, ``few points``,
    ``spike``, ``self-intersection`` (edges of one ring cross, overlap or touch), ``rings cross`` (or overlap),
    ``hole outside shell``, ``nested holes``, ``parts overlap``, ``interior cut``. Other geometry types have none here.
    """
    few, others = _dealt(df, key, geom)
    found = few.select(key, _fault(geom).alias("fault")).filter(F.col("fault").isNotNull())
    return found if others is None else found.unionByName(_faults_by_edges(others, key, geom))


def _faults_by_edges(df: DataFrame, key: str, geom: str) -> DataFrame:
    """``polygon_faults`` as jobs over edges, for polygons of any number of points; rows of one key are one polygon."""
    poly = df.filter(F.col(geom).isNotNull() & _is_polygon(geom))
    bare = poly.select(F.col(key).alias("fid"), F.when(F.size(f"{geom}.parts") == 0, "empty").when(~_finite(geom), "coordinate").alias("fault"))
    rings = _settled(ring_table(df, key, geom))
    shape = rings.select("fid", F.when(~F.col("closed"), "open ring").when(F.size("pts") < 4, "few points").alias("fault"))
    edges = edge_table(rings)
    pairs = _with_sides(edge_pairs(edges), 0.0)
    one_ring = (F.col("part1") == F.col("part2")) & (F.col("ring1") == F.col("ring2"))
    gap = F.col("e2") - F.col("e1")
    near = (gap == 1) | ((gap == F.col("n_ring1") - 1) & (F.col("n_ring1") > 2))
    on = F.col("on_a1") | F.col("on_b1") | F.col("on_a2") | F.col("on_b2")
    in_line = (F.col("side_a1") == 0) & (F.col("side_b1") == 0)
    forth = ((F.col("bx1") - F.col("ax1")) * (F.col("bx2") - F.col("ax2")) + (F.col("by1") - F.col("ay1")) * (F.col("by2") - F.col("ay2")))
    # two edges in line share a stretch if an end of one lies on the other beyond a common end
    ends = [F.when(F.col(f"on_{e}{k}"), F.struct(F.col(f"{e}x{k}").alias("x"), F.col(f"{e}y{k}").alias("y"))) for k in (1, 2) for e in "ab"]
    met = F.array_distinct(F.filter(F.array(*ends), lambda p: p.isNotNull()))
    pairs = pairs.withColumn("met", met).filter(F.col("crossing") | on).withColumn("overlap", in_line & (F.size("met") > 1))
    fault = (F.when(one_ring & near, F.when(in_line & (forth < 0), "spike"))
             .when(one_ring, "self-intersection").when(F.col("crossing") | F.col("overlap"), "rings cross"))
    pairs = _settled(pairs.select("fid", "part1", "part2", "ring1", "ring2", "met", fault.alias("fault"), one_ring.alias("one_ring")))
    edge_faults = pairs.select("fid", "fault")
    early = bare.unionByName(shape).unionByName(edge_faults).filter(F.col("fault").isNotNull())
    early = _settled(early.groupBy("fid").agg(F.min("fault").alias("fault")))

    # how rings lie in one another matters only where there are several, and none cross
    several = rings.groupBy("fid").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("fid").join(early, "fid", "left_anti")
    strips = in_strips(edges).join(several, "fid", "left_semi")
    mids = strips.select("fid", "part", "ring", "e", "mx", "my", "sm")
    under = below(mids, strips, ["part", "ring"]).filter((F.col("part") != F.col("part2")) | (F.col("ring") != F.col("ring2")))
    # a middle on another ring says nothing; others: inside if an odd number of its edges are below
    inside = under.groupBy("fid", "part", "ring", "e", "part2", "ring2").agg(
        F.min(F.abs("rise")).alias("gap"), (F.sum(F.when(F.col("rise") > 0, 1).otherwise(0)) % 2 == 1).alias("inside"))
    inside = inside.filter((F.col("gap") > 0) & F.col("inside"))
    of_edge = _settled(inside.groupBy("fid", "part", "ring", "e", "part2").agg(
        F.sum(F.when(F.col("ring2") == 0, 1).otherwise(0)).alias("in_shell"),
        F.sum(F.when(F.col("ring2") > 0, 1).otherwise(0)).alias("in_holes")))
    clash = (F.when((F.col("part") != F.col("part2")) & (F.col("in_shell") > 0) & (F.col("in_holes") == 0), "parts overlap")
             .when((F.col("part") == F.col("part2")) & (F.col("ring") > 0) & (F.col("in_holes") > 0), "nested holes"))
    clashes = of_edge.select("fid", clash.alias("fault")).filter(F.col("fault").isNotNull())
    holes = rings.filter("ring > 0").select("fid", "part", "ring").join(several, "fid", "left_semi")
    in_shell = of_edge.filter("part = part2 AND ring > 0 AND in_shell > 0").select("fid", "part", "ring").distinct()
    outside = holes.join(in_shell, ["fid", "part", "ring"], "left_anti").select("fid", F.lit("hole outside shell").alias("fault"))

    touches = pairs.filter(~F.col("one_ring") & F.col("fault").isNull() & (F.col("part1") == F.col("part2"))).select(
        "fid", F.col("part1").alias("part"), "ring1", "ring2", F.explode("met").alias("p"))
    links = touches.select("fid", "part", F.explode(F.array("ring1", "ring2")).alias("ring"), "p").distinct()
    cut = links.groupBy("fid", "part").agg(F.collect_list(F.struct("ring", F.col("p.x").alias("x"), F.col("p.y").alias("y"))).alias("links"))
    # fewer than four links close no circle
    cut = cut.filter(F.size("links") > 3).select("fid", "links").mapInArrow(_cut_interiors, f"fid {_kind(df, key)}, fault string")
    late = clashes.unionByName(outside).unionByName(cut).join(early, "fid", "left_anti")
    found = early.unionByName(late)
    return found.groupBy("fid").agg(F.min("fault").alias("fault")).withColumnRenamed("fid", key)


def _kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def _cut_interiors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        cut = [closes_circle([(t["ring"], (t["x"], t["y"])) for t in links]) for links in rb.column(1).to_pylist()]
        fid = rb.column(0).filter(pa.array(cut, pa.bool_()))
        yield pa.RecordBatch.from_arrays([fid, pa.array(["interior cut"] * len(fid))], names=["fid", "fault"])


def with_validity(df: DataFrame, key: str, geom: str = "geometry", name: str = "valid") -> DataFrame:
    """``df`` with ``name``: whether the geometry is valid; polygons by ``polygon_faults``, others by ``geometry.is_valid``."""
    few, others = _dealt(df, key, geom)
    out = few.select(key, *[c for c in df.columns if c != key], _fault(geom).alias(f"_{name}"))
    if others is not None:
        faults = _faults_by_edges(others, key, geom).withColumnRenamed("fault", f"_{name}")
        out = out.unionByName(others.join(faults, key, "left"))
    ok = F.when(F.col(geom).isNull(), False).when(_is_polygon(geom), F.col(f"_{name}").isNull()).otherwise(G.is_valid(geom))
    return out.withColumn(name, ok).drop(f"_{name}")


# ------------------------------------------------------------ repair

def _point(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def noded(edges: DataFrame) -> DataFrame:
    """Pieces ``(fid, ax, ay, bx, by)`` of edges, cut wherever they meet, that an odd number of
    edges cover; ends in order."""
    pairs = _with_sides(edge_pairs(edges), SNAP)
    on_any = F.col("on_a1") | F.col("on_b1") | F.col("on_a2") | F.col("on_b2")
    pairs = _settled(pairs.filter(F.col("crossing") | on_any))
    rx, ry = F.col("bx1") - F.col("ax1"), F.col("by1") - F.col("ay1")
    sx, sy = F.col("bx2") - F.col("ax2"), F.col("by2") - F.col("ay2")
    t = F.try_divide((F.col("ax2") - F.col("ax1")) * sy - (F.col("ay2") - F.col("ay1")) * sx, rx * sy - ry * sx)
    grid = F.col("extent") * SNAP
    snap = lambda v: F.rint(v / grid) * grid
    x = F.when(F.col("crossing") & ~on_any, _point(snap(F.col("ax1") + t * rx), snap(F.col("ay1") + t * ry)))
    end = lambda e, k: F.when(F.col(f"on_{e}{k}"), _point(F.col(f"{e}x{k}"), F.col(f"{e}y{k}")))
    def along(p, k):
        return (p["x"] - F.col(f"ax{k}")) * (F.col(f"bx{k}") - F.col(f"ax{k}")) + (p["y"] - F.col(f"ay{k}")) * (F.col(f"by{k}") - F.col(f"ay{k}"))

    def cuts_of(k, o):
        at = F.filter(F.array(x, end("a", o), end("b", o)), lambda p: p.isNotNull())
        return F.transform(at, lambda p: F.struct(F.col(f"id{k}").alias("id"), along(p, k).alias("t"), p["x"].alias("x"), p["y"].alias("y")))

    cuts = pairs.select("fid", *_FRAME, F.explode(F.concat(cuts_of(1, 2), cuts_of(2, 1))).alias("c"))
    cuts = cuts.select("fid", *_FRAME, "c.*")
    whole = F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2)
    both = edges.select("fid", *_FRAME, "id", F.explode(F.array(
        F.struct(F.lit(0.0).alias("t"), F.col("ax").alias("x"), F.col("ay").alias("y")),
        F.struct(whole.alias("t"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("c")).select("fid", *_FRAME, "id", "c.*")
    # the points of an edge in order: each and the next bound a piece
    order = Window.partitionBy("fid", "id").orderBy("t", "x", "y")
    p = F.struct("x", "y")
    pieces = both.unionByName(cuts).withColumn("next", F.lead(p).over(order)).filter(F.col("next").isNotNull()).select(
        "fid", *_FRAME, F.least(p, F.col("next")).alias("p"), F.greatest(p, F.col("next")).alias("q")).filter("p < q")
    odd = pieces.groupBy("fid", "p", "q").agg(F.count(F.lit(1)).alias("k"), *[F.first(c).alias(c) for c in _FRAME])
    return odd.filter("k % 2 = 1").select("fid", *_FRAME, F.col("p.x").alias("ax"), F.col("p.y").alias("ay"),
                                          F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def directed(pieces: DataFrame) -> DataFrame:
    """Pieces as ``(fid, ax, ay, bx, by)`` from a to b with the interior on their left."""
    s = in_strips(pieces).withColumn("piece", F.struct("ax", "ay", "bx", "by"))
    under = below(s, s, ["piece"])
    # its own row counts nothing, and is there for each piece
    count = F.sum(F.when((F.col("piece") != F.col("piece2")) & (F.col("rise") > 0), 1).otherwise(0))
    n = under.groupBy("fid", "piece").agg(count.alias("k"), F.first(F.col("vx") > F.col("ux")).alias("right"))
    # an even number below: the interior is above, to the left of the way to the right
    keep = (F.col("k") % 2 == 0) == F.col("right")
    e = F.col("piece")
    turned = F.when(keep, e).otherwise(F.struct(e["bx"].alias("ax"), e["by"].alias("ay"), e["ax"].alias("bx"), e["ay"].alias("by")))
    return n.select("fid", turned.alias("d")).select("fid", "d.*")


def linked(pieces: DataFrame) -> DataFrame:
    """Each directed piece with the end ``cx, cy`` of the one that follows it around
    the interior: at their node, the next in clockwise order from the way back."""
    into = pieces.withColumn("back", F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx")))
    out = pieces.select("fid", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("cx"), F.col("by").alias("cy"),
                        F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("forth"))
    j = into.join(out, ["fid", "bx", "by"])
    turn = F.col("back") - F.col("forth")
    turn = F.when(turn > 0, turn).otherwise(turn + 6.283185307179586)
    return j.groupBy("fid", "ax", "ay", "bx", "by").agg(F.min_by(F.struct("cx", "cy"), turn).alias("c")).select("fid", "ax", "ay", "bx", "by", "c.*")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        parts = [[[[{"x": x, "y": y} for x, y in ring] for ring in part]
                  for part in walk([((t["ax"], t["ay"]), (t["bx"], t["by"]), (t["cx"], t["cy"])) for t in links])]
                 for links in rb.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(parts, R.PARTS)], names=["fid", "fixed"])


def rebuild(df: DataFrame, key: str, geom: str = "geometry") -> DataFrame:
    """``fid, fixed``: the parts of each polygon by the even-odd rule over all its rings; none without area."""
    pieces = _settled(noded(_settled(edge_table(ring_table(df, key, geom)))))
    links = linked(_settled(directed(pieces)))
    rows = links.groupBy("fid").agg(F.collect_list(F.struct("ax", "ay", "bx", "by", "cx", "cy")).alias("links"))
    return rows.mapInArrow(_rebuilt, f"fid {_kind(df, key)}, fixed {_PARTS}")


def repair(df: DataFrame, key: str, geom: str = "geometry") -> DataFrame:
    """``df`` with invalid polygons rebuilt, and ``fault``: what was wrong (null: nothing, kept as it was).

    ``key`` is unique and not null. The interior is what an odd number of rings
    surrounds: of overlapping parts the overlap goes, a hole's share outside its shell
    becomes a part, spikes and doubled edges vanish. A polygon becomes a
    MultiPolygon where several parts result, and has no parts where no area does (so
    too with null, NaN or infinite coordinates). Other types, nulls and other columns are kept. Crossings are
    computed to 2**-42 of a feature's extent.
    """
    few, others = _dealt(df, key, geom)
    done = few.withColumn("_done", _of_parts(R.repaired, f"fault string, fixed {_PARTS}", geom))
    out = done.select(key, *[c for c in df.columns if c != key], F.col("_done.fault").alias("fault"), F.col("_done.fixed").alias("fixed"))
    if others is not None:
        faults = _settled(_faults_by_edges(others, key, geom))
        fixed = _settled(rebuild(others.join(faults, key, "left_semi"), key, geom)).withColumnRenamed("fid", key)
        out = out.unionByName(others.join(faults, key, "left").join(fixed, key, "left"))
    parts = F.coalesce("fixed", F.array().cast(_PARTS))
    new = F.struct(F.when(F.size(parts) > 1, "MultiPolygon").otherwise(F.col(f"{geom}.type")).alias("type"),
                   F.col(f"{geom}.srid").alias("srid"), parts.alias("parts"))
    out = out.withColumn(geom, F.when(F.col("fault").isNotNull(), new).otherwise(F.col(geom))).drop("fixed")
    # written down: what is asked of it next would repair anew
    return _settled(out)


def area(geom: str | Column) -> Column:
    """Area of a valid polygon: shells less holes."""
    g = F.col(geom) if isinstance(geom, str) else geom
    ring_area = lambda r: F.abs(G._signed_area(r))
    total = lambda rings: F.aggregate(rings, F.lit(0.0), lambda acc, r: acc + ring_area(r))
    return F.aggregate(g["parts"], F.lit(0.0), lambda acc, p: acc + 2 * ring_area(p[0]) - total(p))
