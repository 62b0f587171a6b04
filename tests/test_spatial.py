"""Spatial joins: the cell join must equal a brute-force cross join, and
hand-made cases must give the OGC answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import spatial as SP


def brute_force_join(left, right, predicate, left_geom="geometry", right_geom="geometry",
                     left_cols=None, right_cols=None, kinds=None, eps=0.0):
    """Every pair tested (cross join): the reference answer on small inputs."""
    left_cols = left_cols or [c for c in left.columns if c != left_geom]
    right_cols = right_cols or [c for c in right.columns if c != right_geom]
    a = SP._prepare(left.select(*left_cols, F.col(left_geom).alias("a_geom")), "a_geom", "a_", eps)
    b = SP._prepare(right.select(*right_cols, F.col(right_geom).alias("b_geom")), "b_geom", "b_", eps)
    return a.crossJoin(b).filter(SP.relation(predicate, "a_", "b_", eps, kinds)).select(*left_cols, *right_cols)


def _poly(spark, rows):
    """rows: (id, [ring, ring...]) with rings as [(x, y), ...]."""
    data = [(i, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]]) for i, rings in rows]
    df = spark.createDataFrame(data, "pid long, parts array<array<array<struct<x:double,y:double>>>>")
    return df.select("pid", F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"),
                                     F.col("parts")).alias("geometry"))


def _pts(spark, rows):
    df = spark.createDataFrame(rows, "qid long, x double, y double")
    return df.select("qid", G.point(F.col("x"), F.col("y")).alias("geometry"))


def _lines(spark, rows):
    data = [(i, [{"x": float(x), "y": float(y)} for x, y in pts]) for i, pts in rows]
    df = spark.createDataFrame(data, "lid long, pts array<struct<x:double,y:double>>")
    return df.select("lid", G.linestring(F.col("pts")).alias("geometry"))


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]


@pytest.fixture(scope="module")
def layers(spark):
    polys = _poly(spark, [(1, [SQUARE, HOLE]), (2, [[(4, 0), (8, 0), (8, 4), (4, 4), (4, 0)]]),
                          (3, [[(1, 5), (3, 5), (3, 7), (1, 7), (1, 5)]]),
                          (4, [[(-50, -50), (60, -50), (60, 60), (-50, 60), (-50, -50)]])])
    pts = _pts(spark, [(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 4.0, 2.0), (4, 0.0, 0.0), (5, 2.0, 6.0),
                       (6, 9.0, 9.0), (7, 1.0, 1.5), (8, 3.0, 3.0)])
    lines = _lines(spark, [(1, [(-1, 2), (5, 2)]), (2, [(2, 5), (2, 8)]), (3, [(0, 4), (4, 4)]),
                           (4, [(10, 10), (11, 11)]), (5, [(2, 3), (2, 3.5)]), (6, [(3, 0), (3, -2)])])
    return polys, pts, lines


def _pairs(df):
    return sorted(tuple(r) for r in df.collect())


CASES = ([(p, c, 4096, True) for p in SP.PREDICATES
          for c in ["pt_poly", "poly_pt", "poly_poly", "line_poly", "line_line", "pt_line"]]
         # two-level cells (huge polygon 4 goes coarse) and the untyped predicate switch
         + [(p, c, 2, False) for p in ("intersects", "within", "touches") for c in ("pt_poly", "poly_poly")])


@pytest.mark.parametrize("pred,combo,max_cells,typed", CASES)
def test_cell_join_equals_brute_force(layers, pred, combo, max_cells, typed):
    polys, pts, lines = layers
    sides = {"pt_poly": (pts, polys, ("point", "polygon")), "poly_pt": (polys, pts, ("polygon", "point")),
             "poly_poly": (polys, polys.withColumnRenamed("pid", "pid2"), ("polygon", "polygon")),
             "line_poly": (lines, polys, ("line", "polygon")),
             "line_line": (lines, lines.withColumnRenamed("lid", "lid2"), ("line", "line")),
             "pt_line": (pts, lines, ("point", "line"))}
    a, b, kinds = sides[combo]
    got = _pairs(SP.spatial_join(a, b, pred, 1.0, kinds=kinds if typed else None, max_cells=max_cells))
    want = _pairs(brute_force_join(a, b, pred, kinds=kinds))
    assert got == want


def test_known_answers(layers):
    polys, pts, lines = layers
    within = _pairs(SP.spatial_join(pts, polys, "within", 1.0, kinds=("point", "polygon")))
    # point 2 sits in the hole of polygon 1; point 3 is on the shared edge of 1 and 2;
    # point 4 is a corner; point 7 is on the hole's boundary
    assert (1, 1) in within and (2, 1) not in within and (3, 1) not in within and (3, 2) not in within
    touches = _pairs(SP.spatial_join(pts, polys, "touches", 1.0, kinds=("point", "polygon")))
    assert {(3, 1), (3, 2), (4, 1), (7, 1)} <= set(touches)
    assert (1, 1) not in touches
    ptouch = _pairs(SP.spatial_join(polys, polys.withColumnRenamed("pid", "pid2"), "touches", 1.0,
                                    kinds=("polygon", "polygon")))
    assert (1, 2) in ptouch and (2, 1) in ptouch and (1, 3) not in ptouch
    pwithin = _pairs(SP.spatial_join(polys, polys.withColumnRenamed("pid", "pid2"), "within", 1.0,
                                     kinds=("polygon", "polygon")))
    assert (1, 4) in pwithin and (3, 4) in pwithin and (4, 1) not in pwithin
    crosses = _pairs(SP.spatial_join(lines, polys, "crosses", 1.0, kinds=("line", "polygon")))
    assert (1, 1) in crosses and (2, 3) in crosses and (3, 1) not in crosses
    ltouch = _pairs(SP.spatial_join(lines, polys, "touches", 1.0, kinds=("line", "polygon")))
    assert (3, 1) in ltouch and (6, 1) in ltouch
    llcross = _pairs(SP.spatial_join(lines, lines.withColumnRenamed("lid", "lid2"), "crosses", 1.0,
                                     kinds=("line", "line")))
    assert llcross == []


def test_salted_join_equals_unsalted(layers):
    polys, pts, _ = layers
    plain = _pairs(SP.spatial_join(pts, polys, "intersects", 1.0, kinds=("point", "polygon")))
    salted = _pairs(SP.spatial_join(pts, polys, "intersects", 1.0, kinds=("point", "polygon"), salt_buckets=4))
    assert salted == plain and plain


def test_broadcast_guard(spark):
    from tessella.operators import _util as U
    small = spark.range(10)
    assert U.estimated_bytes(small) is not None
    assert "broadcast" in small.hint("broadcast")._jdf.queryExecution().logical().toString().lower()
    wide = spark.range(100).selectExpr("id", "repeat('x', 100000) AS pad")
    # few rows but an estimate over the byte cap: no hint
    assert U.broadcast_if_small(wide, max_rows=1000, max_bytes=1024) is wide


@pytest.mark.parametrize("seed", [1, 2])
def test_random_layers_cell_join_equals_brute_force(spark, seed):
    import random
    rnd = random.Random(seed)
    snap = lambda v: round(v * 2) / 2  # noqa: E731 - half-unit grid: shared edges and vertices happen
    polys = []
    for i in range(25):
        x, y = snap(rnd.uniform(-20, 20)), snap(rnd.uniform(-20, 20))
        w, h = snap(rnd.uniform(0.5, 12)), snap(rnd.uniform(0.5, 12))
        if i % 3 == 0:   # triangle
            ring = [(x, y), (x + w, y), (x, y + h), (x, y)]
        elif i == 4:     # one very large polygon (goes up the cell levels)
            ring = [(-200, -200), (200, -200), (200, 200), (-200, 200), (-200, -200)]
        else:
            ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        polys.append((i, [ring]))
    pts = [(i, snap(rnd.uniform(-25, 25)), snap(rnd.uniform(-25, 25))) for i in range(300)]
    segs = [(i, [(snap(rnd.uniform(-25, 25)), snap(rnd.uniform(-25, 25))),
                 (snap(rnd.uniform(-25, 25)), snap(rnd.uniform(-25, 25)))]) for i in range(60)]
    P, Q, Ls = _poly(spark, polys), _pts(spark, pts), _lines(spark, segs)
    cases = [(Q, P, ("point", "polygon"), "intersects"), (Q, P, ("point", "polygon"), "touches"),
             (P, Q, ("polygon", "point"), "contains"), (Ls, P, ("line", "polygon"), "crosses"),
             (P, P.withColumnRenamed("pid", "pid2"), ("polygon", "polygon"), "touches"),
             (P, P.withColumnRenamed("pid", "pid2"), ("polygon", "polygon"), "within")]
    for a, b, kinds, pred in cases:
        want = _pairs(brute_force_join(a, b, pred, kinds=kinds))
        got = _pairs(SP.spatial_join(a, b, pred, 2.0, kinds=kinds, max_cells=16))
        assert got == want, (pred, kinds)


@pytest.mark.parametrize("seed,max_cells,eps", [(3, 4096, 0.0), (4, 8, 0.0), (5, 64, 0.25)])
def test_random_long_lines_supercover_equals_brute_force(spark, seed, max_cells, eps):
    import random
    rnd = random.Random(seed)
    snap = lambda v: round(v * 2) / 2
    polys = []
    for i in range(20):
        x, y = snap(rnd.uniform(-30, 30)), snap(rnd.uniform(-30, 30))
        w, h = snap(rnd.uniform(0.5, 8)), snap(rnd.uniform(0.5, 8))
        polys.append((i, [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]))
    pts = [(i, snap(rnd.uniform(-30, 30)), snap(rnd.uniform(-30, 30))) for i in range(150)]
    lines = []
    for i in range(40):   # long polylines of 2-4 vertices, some axis-parallel
        n = rnd.randint(2, 4)
        pl = [(snap(rnd.uniform(-40, 40)), snap(rnd.uniform(-40, 40))) for _ in range(n)]
        if i % 5 == 0:
            pl = [(pl[0][0], pl[0][1]), (pl[0][0], pl[-1][1])]
        lines.append((i, pl))
    # lines through polygon corners and along edges
    lines += [(100 + i, [(p[1][0][0][0] - 5, p[1][0][0][1] - 5), (p[1][0][0][0] + 5, p[1][0][0][1] + 5)])
              for i, p in enumerate(polys[:5])]
    lines += [(200 + i, [(p[1][0][0][0] - 3, p[1][0][0][1]), (p[1][0][1][0] + 3, p[1][0][1][1])])
              for i, p in enumerate(polys[5:10])]
    lines += [(300 + i, [(x, y), (x + 7, y - 3)]) for i, x, y in pts[:10]]  # lines starting on points
    P, Q, Ls = _poly(spark, polys), _pts(spark, pts), _lines(spark, lines)
    cases = [(Ls, P, ("line", "polygon"), pr) for pr in ("intersects", "crosses", "touches", "within")]
    cases += [(P, Ls, ("polygon", "line"), pr) for pr in ("intersects", "contains")]
    cases += [(Ls, Q, ("line", "point"), pr) for pr in ("intersects", "contains", "touches")]
    cases += [(Q, Ls, ("point", "line"), "intersects")]
    for a, b, kinds, pred in cases:
        want = _pairs(brute_force_join(a, b, pred, kinds=kinds, eps=eps))
        got = _pairs(SP.spatial_join(a, b, pred, 1.5, kinds=kinds, max_cells=max_cells, eps=eps))
        assert got == want, (pred, kinds, len(got), len(want))


def test_supercover_is_chosen_for_long_diagonal_lines_only(spark):
    lines = _lines(spark, [(1, [(-40, -40), (40, 40)]), (2, [(0, 0), (1, 1)]), (3, [(0, -40), (0, 40)])])
    p = SP._prepare(lines.select("lid", F.col("geometry").alias("a_geom")), "a_geom", "a_")
    flags = {r.lid: r.sc for r in p.select("lid", SP._use_supercover("a_", 1.5).alias("sc")).collect()}
    assert flags == {1: True, 2: False, 3: False}
    cells = {r.lid: r.n for r in p.withColumn("a_sc", F.lit(True))
             .select("lid", F.size(SP._cells("a_", 1.5, line=True)).alias("n")).collect()}
    assert cells[1] < 250  # vs 54 x 54 = 2916 box cells


# ---------------------------------------------------------------- written-down OGC answers

def _related(a, b, kind_a, kind_b):
    """For each pair of rows with one id: the predicates that hold."""
    x = SP._prepare(a.toDF("i", "geometry").select("i", F.col("geometry").alias("a_geom")), "a_geom", "a_", 0.0)
    y = SP._prepare(b.toDF("j", "geometry").select("j", F.col("geometry").alias("b_geom")), "b_geom", "b_", 0.0)
    holds = [F.when(SP.relation(p, "a_", "b_", 0.0, (kind_a, kind_b)), F.lit(p)) for p in SP.PREDICATES]
    rows = x.join(y, F.col("i") == F.col("j")).select("i", F.array_compact(F.array(*holds)).alias("p")).collect()
    return {r["i"]: set(r["p"]) for r in rows}


def _multi(spark, rows):
    df = spark.createDataFrame([(i, [[[{"x": float(x), "y": float(y)}]] for x, y in pts]) for i, pts in rows],
                               "qid long, parts array<array<array<struct<x:double,y:double>>>>")
    return df.select("qid", F.struct(F.lit("MultiPoint").alias("type"), F.lit(4326).alias("srid"), "parts").alias("geometry"))


def _box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


U = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0)]


LINE_SQUARE = [
    ([(-1, -1), (3, 3)], {"intersects", "crosses"}),                  # through two corners
    ([(0, 0), (2, 2)], {"intersects", "within"}),                     # corner to corner
    ([(-1, 0), (3, 0)], {"intersects", "touches"}),                   # along an edge and on
    ([(1, 1), (1, 1.5)], {"intersects", "within"}),
    ([(-1, 1), (0, 1)], {"intersects", "touches"}),
    ([(3, 3), (4, 4)], set()),
]
LINES = [
    ([(0, 0), (1, 1), (2, 2)], [(0, 2), (1, 1), (2, 0)], {"intersects", "crosses"}),   # through a vertex of both
    ([(0, 0), (2, 2)], [(0, 2), (2, 0)], {"intersects", "crosses"}),
    ([(0, 0), (2, 0)], [(1, 0), (1, 2)], {"intersects", "touches"}),
    ([(0, 0), (2, 0)], [(1, 0), (3, 0)], {"intersects"}),                              # a shared stretch
    ([(1, 0), (2, 0)], [(0, 0), (3, 0)], {"intersects", "within"}),
    ([(0, 0), (1, 0)], [(2, 0), (3, 0)], set()),
]
POLYGONS = [
    ([_box(2, 2, 8, 8)], [_box(0, 0, 10, 10), _box(4, 4, 6, 6)], {"intersects"}),             # covers the hole
    ([_box(1, 1, 3, 3)], [_box(0, 0, 10, 10), _box(4, 4, 6, 6)], {"intersects", "within"}),
    ([_box(4, 4, 6, 6)], [_box(0, 0, 10, 10), _box(4, 4, 6, 6)], {"intersects", "touches"}),  # fills the hole
    ([U], [U], {"intersects", "within", "contains"}),
    ([U], [_box(2, 2, 4, 6)], {"intersects", "touches"}),                                     # the gap of the U
    ([_box(0, 0, 6, 6)], [U], {"intersects", "contains"}),
    ([_box(0, 0, 2, 2)], [_box(2, 0, 4, 2)], {"intersects", "touches"}),
    ([_box(0, 0, 2, 2)], [_box(1, 0, 3, 2)], {"intersects"}),                                 # edges run together
    ([_box(0, 0, 2, 2)], [_box(5, 5, 6, 6)], set()),
    ([_box(0, 0, 4, 1)], [_box(1, -1, 2, 3)], {"intersects"}),                                # a cross of two bars
]
MULTI = [
    ([(50, 50), (1, 1)], {"intersects", "crosses"}),
    ([(1, 1), (0, 1)], {"intersects", "within"}),
    ([(0, 0), (9, 9)], {"intersects", "touches"}),
    ([(9, 9), (8, 8)], set()),
]
RINGS = [
    ([_box(0, 0, 4, 4), _box(1, 1, 2, 2)], True),
    ([_box(0, 0, 4, 4), _box(6, 6, 7, 7)], False),                    # hole outside the shell
    ([_box(0, 0, 4, 4), _box(3, 3, 5, 5)], False),                    # hole across the shell
    ([_box(0, 0, 9, 9), _box(1, 1, 5, 5), _box(2, 2, 3, 3)], False),  # hole in a hole
    ([_box(0, 0, 9, 9), _box(1, 1, 3, 3), _box(5, 5, 7, 7)], True),
    ([[(0, 0), (4, 0), (6, 0), (4, 0), (4, 4), (0, 0)]], False),      # spike
    ([U], True),
]


def _numbered(cases, k):
    return [(i, c[k]) for i, c in enumerate(cases)]


def _wanted(cases):
    return {i: c[-1] for i, c in enumerate(cases)}


def test_lines_and_a_square(spark):
    squares = _poly(spark, [(i, [_box(0, 0, 2, 2)]) for i in range(len(LINE_SQUARE))])
    assert _related(_lines(spark, _numbered(LINE_SQUARE, 0)), squares, "line", "polygon") == _wanted(LINE_SQUARE)


def test_two_lines(spark):
    assert _related(_lines(spark, _numbered(LINES, 0)), _lines(spark, _numbered(LINES, 1)), "line", "line") == _wanted(LINES)


def test_two_polygons(spark):
    got = _related(_poly(spark, _numbered(POLYGONS, 0)), _poly(spark, _numbered(POLYGONS, 1)), "polygon", "polygon")
    assert got == _wanted(POLYGONS)


def test_all_points_of_a_multi_point_count(spark):
    squares = _poly(spark, [(i, [_box(0, 0, 2, 2)]) for i in range(len(MULTI))])
    points = _multi(spark, _numbered(MULTI, 0))
    assert _related(points, squares, "point", "polygon") == _wanted(MULTI)
    got = SP.spatial_join(points, squares.limit(1), "intersects", 1.0, kinds=("point", "polygon")).collect()
    assert {r["qid"] for r in got} == {i for i, (_, w) in enumerate(MULTI) if "intersects" in w}


def test_validity_of_rings(spark):
    got = _poly(spark, _numbered(RINGS, 0)).select("pid", G.is_valid("geometry").alias("ok")).collect()
    assert {r["pid"]: r["ok"] for r in got} == _wanted(RINGS)


def test_validity_of_parts(spark):
    sets = [[_box(0, 0, 1, 1), _box(2, 2, 3, 3)], [_box(0, 0, 1, 1), _box(1, 1, 2, 2)],
            [_box(0, 0, 3, 3), _box(1, 1, 2, 2)], [_box(0, 0, 1, 1), _box(0, 0, 1, 1)]]
    data = [(i, [[[{"x": float(x), "y": float(y)} for x, y in r]] for r in boxes]) for i, boxes in enumerate(sets)]
    df = spark.createDataFrame(data, "pid long, parts array<array<array<struct<x:double,y:double>>>>")
    g = F.struct(F.lit("MultiPolygon").alias("type"), F.lit(4326).alias("srid"), F.col("parts"))
    got = df.select("pid", g.alias("geometry")).select("pid", G.is_valid("geometry").alias("ok")).collect()
    assert {r["pid"]: r["ok"] for r in got} == {0: True, 1: True, 2: False, 3: False}


MOD_2 = [
    ([[(0, 0), (2, 0), (2, 2), (0, 0)]], (0, 0), "within"),            # a closed line has no boundary
    ([[(0, 0), (2, 0), (2, 2)]], (0, 0), "touches"),
    ([[(0, 0), (2, 0), (2, 2)]], (2, 0), "within"),
    ([[(0, 0), (2, 0)], [(2, 0), (4, 1)]], (2, 0), "within"),             # two stretches end there
    ([[(0, 0), (2, 0)], [(2, 0), (4, 1)], [(2, 0), (2, 5)]], (2, 0), "touches"),  # three do
    ([[(0, 0), (2, 0)], [(5, 5), (6, 6)]], (5, 5), "touches"),            # an end of a later stretch
    ([[(2, 0), (0, 0)], [(2, 0), (4, 1)]], (2, 0), "within"),             # both start there
]


def test_boundary_of_lines_by_the_mod_2_rule(spark):
    kind = "geometry struct<type:string,srid:int,parts:array<array<array<struct<x:double,y:double>>>>>"
    xy = lambda p: {"x": float(p[0]), "y": float(p[1])}
    lines = [(i, {"type": "MultiLineString", "srid": 4326, "parts": [[[xy(p) for p in stretch]] for stretch in line]})
             for i, (line, _, _) in enumerate(MOD_2)]
    points = [(i, {"type": "Point", "srid": 4326, "parts": [[[xy(at)]]]}) for i, (_, at, _) in enumerate(MOD_2)]
    lines, points = spark.createDataFrame(lines, f"l long, {kind}"), spark.createDataFrame(points, f"p long, {kind}")
    for pred in ("within", "touches", "intersects"):
        j = SP.spatial_join(points, lines, pred, 1.0, kinds=("point", "line")).filter("l = p")
        assert sorted(r["p"] for r in j.collect()) == [i for i, c in enumerate(MOD_2) if pred in ("intersects", c[2])], pred
