"""Validity and repair of polygons of any shape, as jobs over edges."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import planar as P

SCHEMA = "k long, geometry struct<type:string,srid:int,parts:array<array<array<struct<x:double,y:double>>>>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def geom(*parts, kind=None):
    pts = [[[{"x": None if x is None else float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts]
    return {"type": kind or ("Polygon" if len(parts) == 1 else "MultiPolygon"), "srid": 4326, "parts": pts}


def frame(spark, shapes):
    return spark.createDataFrame([(i, g) for i, g in enumerate(shapes)], SCHEMA)


def star(n, r=1.0):
    pts = [(r * math.cos(2 * math.pi * 2 * i / n + 0.1), r * math.sin(2 * math.pi * 2 * i / n + 0.1)) for i in range(n)]
    return [*pts, pts[0]]


def star_area(n, r=1.0):
    """Even-odd area of the star that joins every second of n points."""
    inner = r * math.cos(2 * math.pi / n) / math.cos(math.pi / n)
    return n * r * inner * math.sin(math.pi / n) - n / 2 * inner * inner * math.sin(2 * math.pi / n)


def circle(n, r=1.0, cx=0.0, cy=0.0):
    pts = [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*pts, pts[0]]


BIG = box(0, 0, 10, 10)
#: shape, fault, area and number of parts after repair
CASES = [
    (geom([BIG]), None, 100, 1),
    (geom([BIG, box(2, 2, 4, 4)]), None, 96, 1),
    (geom([BIG, box(2, 2, 4, 4), box(5, 5, 6, 6)]), None, 95, 1),
    (geom([BIG], [box(20, 0, 21, 1)]), None, 101, 2),
    (geom([BIG], [box(10, 10, 11, 11)]), None, 101, 2),                         # parts touch at a point
    (geom([BIG, box(2, 2, 8, 8)], [box(3, 3, 4, 4)]), None, 65, 2),            # an island in a hole
    (geom([BIG, [(0, 5), (2, 4), (2, 6), (0, 5)]]), None, 98, 1),              # hole touches the shell once
    (geom([star(5)]), "self-intersection", star_area(5), 5),
    (geom([star(9)]), "self-intersection", star_area(9), 9),
    (geom([box(0, 0, 2, 2)], [box(1, 1, 3, 3)]), "rings cross", 6, 2),         # overlapping parts
    (geom([[(0, 0), (4, 0), (4, 2), (6, 2), (4, 2), (4, 4), (0, 4), (0, 0)]]), "self-intersection", 16, 1),  # a spike, too
    (geom([box(0, 0, 4, 4), box(6, 6, 7, 7)]), "hole outside shell", 17, 2),
    (geom([box(0, 0, 4, 4), box(3, 1, 5, 2)]), "rings cross", 16, 2),          # a hole partly outside
    (geom([box(0, 0, 9, 9), box(1, 1, 8, 8), box(2, 2, 3, 3)]), "nested holes", 33, 2),
    (geom([BIG, [(0, 5), (5, 0), (10, 5), (5, 10), (0, 5)]]), "interior cut", 50, 4),
    (geom([BIG, [(0, 0), (10, 10), (5, 8), (0, 0)]]), "interior cut", 85, 2),   # touches at two corners
    (geom([BIG], [box(2, 2, 3, 3)]), "parts overlap", 99, 1),
    (geom([box(0, 0, 2, 2)], [box(2, 0, 4, 2)]), "rings cross", 8, 1),         # parts share an edge
    (geom([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]), "self-intersection", 2, 2),
    (geom([[(0, 0), (4, 0), (4, 4), (0, 4)]]), "open ring", 16, 1),
    (geom([[(0, 0), (4, 0), (0, 0)]]), "few points", 0, 0),
    (geom([[(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4), (0, 0)]]), None, 16, 1),
    (geom([[(0, 0), (4, 0), (float("nan"), 4), (0, 0)]]), "coordinate", 0, 0),
    (geom([[(0, 0), (4, 0), (None, 4), (0, 0)]]), "coordinate", 0, 0),
    (geom(kind="Polygon"), "empty", 0, 0),
    # two rings of one part that touch in a chain with the shell: the chain of three closes a circle
    (geom([BIG, [(0, 5), (5, 4), (5, 6), (0, 5)], [(10, 5), (5, 4), (6, 7), (10, 5)]]), "interior cut", None, None),
]


def test_faults_and_repaired_areas(spark):
    df = frame(spark, [c[0] for c in CASES])
    faults = {r["k"]: r["fault"] for r in P.polygon_faults(df, "k").collect()}
    wrong = {i: (faults.get(i), c[1]) for i, c in enumerate(CASES) if faults.get(i) != c[1]}
    assert not wrong
    fixed = P.repair(df, "k")
    rows = {r["k"]: r for r in fixed.select("k", P.area("geometry").alias("area"), F.size("geometry.parts").alias("parts")).collect()}
    for i, (_, _, want, parts) in enumerate(CASES):
        if want is not None:
            assert rows[i]["area"] == pytest.approx(want, abs=1e-9), i
            assert rows[i]["parts"] == parts, i
    again = {r["k"]: r["fault"] for r in P.polygon_faults(fixed.drop("fault"), "k").collect()}
    assert set(again.values()) <= {"empty"}


def test_valid_geometries_and_other_types_stay_as_they_are(spark):
    shapes = [geom([BIG]), geom([[(1, 2)]], kind="Point"), geom([[(0, 0), (1, 1)]], kind="LineString"), None]
    got = {r["k"]: r for r in P.repair(frame(spark, shapes), "k").collect()}
    assert [got[i]["geometry"].asDict(recursive=True) if got[i]["geometry"] else None for i in range(4)] == shapes
    valid = {r["k"]: r["valid"] for r in P.with_validity(frame(spark, shapes), "k").collect()}
    assert valid == {0: True, 1: True, 2: True, 3: False}
    assert P.repair(frame(spark, []), "k").count() == 0


def test_random_rings_agree_with_the_row_test_and_become_valid(spark):
    rng = random.Random(7)
    shapes = []
    for _ in range(80):
        ring = [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(3, 9))]
        shapes.append(geom([[*ring, ring[0]]]))
    df = frame(spark, shapes)
    both = P.with_validity(df, "k").select("valid", G.is_valid("geometry").alias("row")).collect()
    assert all(r["valid"] == r["row"] for r in both)
    fixed = P.repair(df, "k").drop("fault").filter(F.size("geometry.parts") > 0)
    assert P.polygon_faults(fixed, "k").count() == 0
    # the even-odd rule, point by point: a point's parity is the same before and after
    pts = [(x + 0.37, y + 0.41) for x in range(-1, 9) for y in range(-1, 9)]
    fixed_parts = {r["k"]: r["geometry"]["parts"] for r in fixed.collect()}
    for i, g in enumerate(shapes):
        before = [[(p["x"], p["y"]) for p in r] for part in g["parts"] for r in part]
        after = [[(p["x"], p["y"]) for p in r] for part in fixed_parts.get(i, []) for r in part]
        for p in pts:
            assert sum(P._within(p, r) for r in before) % 2 == sum(P._within(p, r) for r in after) % 2, (i, p)


def test_a_ring_of_many_points_is_spread_and_quick(spark):
    n = 100_000
    ring, bad = circle(n), circle(5_000, 2.0, 5.0, 5.0)
    bad[100], bad[101] = bad[101], bad[100]
    df = frame(spark, [geom([ring]), geom([bad]), geom([circle(4_000, 3.0), circle(4_000, 1.0)])])
    t = time.time()
    faults = {r["k"]: r["fault"] for r in P.polygon_faults(df, "k").collect()}
    assert faults == {1: "self-intersection"}
    assert time.time() - t < 60
    fixed = P.repair(df, "k").filter("k = 1").select(P.area("geometry").alias("a")).first()
    assert fixed["a"] == pytest.approx(4 * math.pi, rel=1e-3)


def test_edges_meet_in_cells_of_their_feature(spark):
    plan = P.edge_pairs(P.edge_table(P.ring_table(frame(spark, [geom([BIG])]), "k")))._jdf.queryExecution().toString()
    assert "Join Inner" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_geometry_is_made_once_for_its_rings(spark):
    ring = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: G.xy(F.cos(i % 5 + F.col("k")), F.sin(i % 5 + F.col("k"))))
    df = spark.range(2).withColumnRenamed("id", "k").withColumn("geometry", F.struct(
        F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"), F.array(F.array(ring)).alias("parts")))
    rings = P.ring_table(df, "k")
    assert rings._jdf.queryExecution().optimizedPlan().toString().count("COS(") <= 2
    assert {(r["fid"], r["n"], len(r["pts"]), r["closed"]) for r in rings.collect()} == {(0, 6, 6, True), (1, 6, 6, True)}


def _mixed(n):
    """Polygons of one to three parts, of rings over one another, beside and in one another."""
    rng = random.Random(11)

    def ring():
        x, y, w = rng.randrange(8), rng.randrange(8), rng.randrange(1, 4)
        kind = rng.randrange(4)
        if kind == 0:
            return box(x, y, x + w, y + rng.randrange(1, 4))
        if kind == 1:
            return [(x - w, y), (x, y - w), (x + w, y), (x, y + w), (x - w, y)]
        if kind == 2:
            pts = [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(2, 7))]
            return pts if rng.random() < 0.2 else [*pts, pts[0]]
        return star(rng.choice([5, 7]), float(w))
    shapes = [geom([BIG, *[ring() for _ in range(rng.randrange(3))]], *[[ring() for _ in range(rng.randrange(1, 3))]
              for _ in range(rng.randrange(3))]) for _ in range(n)]
    return [*shapes, *[c[0] for c in CASES], geom([circle(P.FEW * 2, 5.0)]), geom([circle(P.FEW * 2, 5.0)], [circle(P.FEW * 2, 2.0)])]


def _by_key(df, value):
    return {r["k"]: r[value] for r in df.collect()}


def test_polygons_of_few_points_are_repaired_without_jobs_over_their_edges(spark, monkeypatch):
    shapes = _mixed(60)
    df = frame(spark, shapes)
    broken = P._faults_by_edges(df, "k", "geometry")
    by_edges = {r["fid"]: r["fixed"] for r in P.rebuild(df.join(broken, "k", "left_semi"), "k").collect()}
    fixed = P.repair(df, "k")
    assert fixed.columns == ["k", "geometry", "fault"]
    got = {r["k"]: r for r in fixed.collect()}
    assert {k: r["fault"] for k, r in got.items() if r["fault"]} == _by_key(broken, "fault")

    def area(parts):
        return sum(P.R._area([(p["x"], p["y"]) for p in ring[:-1]]) for part in parts for ring in part)
    for k, r in got.items():
        if r["fault"]:
            assert area(r["geometry"]["parts"]) == pytest.approx(area(by_edges.get(k, [])), abs=1e-9), k
            assert r["geometry"]["type"] == ("MultiPolygon" if len(r["geometry"]["parts"]) > 1 else shapes[k]["type"])

    def over_edges(*args, **kwargs):
        raise AssertionError("edges of few points were dealt out")
    for name in ("edge_table", "edge_pairs", "noded", "directed", "linked"):
        monkeypatch.setattr(P, name, over_edges)
    few = frame(spark, [c[0] for c in CASES])
    assert _by_key(P.repair(few, "k"), "fault") == {i: c[1] for i, c in enumerate(CASES)}
    assert _by_key(P.with_validity(few, "k"), "valid") == {i: c[1] is None for i, c in enumerate(CASES)}


def test_rows_of_one_key_are_one_polygon_of_few_points_or_many(spark):
    rows = [(1, geom([box(0, 0, 2, 2)])), (1, geom([star(7)])), (2, geom([box(0, 0, 2, 2)])), (None, geom([star(5)]))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _by_key(P.polygon_faults(df, "k"), "fault") == _by_key(P._faults_by_edges(df, "k", "geometry"), "fault") == {
        1: "self-intersection", None: "self-intersection"}
    assert sorted((r["k"] or 0, r["valid"]) for r in P.with_validity(df, "k").collect()) == [(0, True), (1, False), (1, False), (2, True)]
    assert sorted((r["k"] or 0, r["fault"]) for r in P.repair(df, "k").collect()) == [
        (0, None), (1, "self-intersection"), (1, "self-intersection"), (2, None)]


def test_null_parts_and_rings_tell_nothing(spark):
    shapes = [None, [None], [[None]], [[[]]], [[[None, None, None, None]]]]
    df = spark.createDataFrame([(i, {"type": "Polygon", "srid": 4326, "parts": p}) for i, p in enumerate(shapes)], SCHEMA)
    assert _by_key(P.polygon_faults(df, "k"), "fault") == {4: "coordinate"}
    got = {r["k"]: r for r in P.repair(df, "k").collect()}
    assert [got[i]["geometry"]["parts"] for i in range(5)] == [None, [None], [[None]], [[[]]], []]


def test_faults_of_few_points_are_told_in_their_rows_task(spark):
    df = frame(spark, _mixed(60)[:-2])
    faults = P.polygon_faults(df, "k")
    plan = faults._jdf.queryExecution().executedPlan().toString()
    # the rows' task tells them, once
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "Join" not in plan
    assert _by_key(faults, "fault") == _by_key(P._faults_by_edges(df, "k", "geometry"), "fault")
