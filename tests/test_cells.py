"""Cells taken from the data: the tree finds the pairs that a nested loop finds."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import cells as CL
from tessella.operators import spatial as SP


def _points(spark, rows):
    df = spark.createDataFrame(rows, "pid int, x double, y double")
    return df.select("pid", G.point(F.col("x"), F.col("y"), 4326).alias("geometry"))


def _boxes(spark, rows, key="bid"):
    df = spark.createDataFrame(rows, f"{key} int, x0 double, y0 double, x1 double, y1 double")
    return df.select(key, G.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], 4326).alias("geometry"))


def _layers(seed=3):
    """A third of the points in one town, some at one place; boxes from tiny to the whole plane."""
    rnd = random.Random(seed)
    pts = [(i, rnd.uniform(0, 100), rnd.uniform(0, 60)) for i in range(200)]
    pts += [(200 + i, 40 + rnd.uniform(0, 0.01), 30 + rnd.uniform(0, 0.01)) for i in range(100)]
    pts += [(300 + i, 40.004, 30.004) for i in range(60)]
    boxes = []
    for i, wide in enumerate([0.002, 0.5, 3, 20, 90] * 12):
        x, y = (40.0, 30.0) if i % 4 == 0 else (rnd.uniform(-5, 100), rnd.uniform(-5, 60))
        boxes.append((i, x, y, x + wide, y + wide * rnd.uniform(0.2, 1)))
    return pts, boxes


@pytest.mark.parametrize("max_cells", [9, 64, 4096])
@pytest.mark.parametrize("salt_cells", [1, 64])
def test_points_in_boxes(spark, monkeypatch, max_cells, salt_cells):
    monkeypatch.setattr(CL, "SALT_CELLS", salt_cells)
    pts, boxes = _layers()
    j = SP.spatial_join(_points(spark, pts), _boxes(spark, boxes), "within", kinds=("point", "polygon"),
                        max_cells=max_cells, rows_per_cell=8)
    got = [(r.pid, r.bid) for r in j.collect()]
    want = {(p, b) for p, x, y in pts for b, x0, y0, x1, y1 in boxes if x0 < x < x1 and y0 < y < y1}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("max_cells", [9, 256])
def test_boxes_meet_boxes_once(spark, max_cells):
    _, boxes = _layers()
    a, b = _boxes(spark, boxes, "a"), _boxes(spark, boxes, "b")
    j = SP.spatial_join(a, b, "intersects", kinds=("polygon", "polygon"), max_cells=max_cells, rows_per_cell=4)
    got = [(r.a, r.b) for r in j.collect()]
    want = {(p[0], q[0]) for p in boxes for q in boxes
            if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_sampled_tree_changes_no_pair(spark, monkeypatch):
    monkeypatch.setattr(CL, "SAMPLE_ALL", 50)
    monkeypatch.setattr(CL, "SAMPLES_PER_CELL", 2)
    pts, boxes = _layers(5)
    j = SP.spatial_join(_boxes(spark, boxes), _points(spark, pts), "contains", kinds=("polygon", "point"), rows_per_cell=16)
    want = {(b, p) for p, x, y in pts for b, x0, y0, x1, y1 in boxes if x0 < x < x1 and y0 < y < y1}
    got = [(r.bid, r.pid) for r in j.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cells_grow_with_rows_and_split_the_town(spark):
    def leaves(n):
        rows = spark.range(n).select(F.col("id").cast("int").alias("pid"), F.when(F.col("id") % 3 == 0, 40 + F.rand(1) / 100)
                                     .otherwise(F.rand(2) * 100).alias("x"), (30 + F.rand(3) / 100).alias("y"))
        a = SP._prepare(rows.select("pid", G.point(F.col("x"), F.col("y"), 4326).alias("a_geom")), "a_geom", "a_")
        b = SP._prepare(_boxes(spark, [(0, 0.0, 0.0, 100.0, 100.0)]).withColumnRenamed("geometry", "b_geom"), "b_geom", "b_")
        a, b, cond, once = CL.meet(a, b, 100, 4096)
        own = a.filter("a_leaf").groupBy("a_node").count()
        return own.agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).first()
    small, large = leaves(2000), leaves(10000)
    assert large.n > 3 * small.n and small.most <= 150 and large.most <= 150


def test_boxes_larger_than_the_cells_of_a_town_take_few_cells(spark):
    def cells_per_row(n):
        boxes = spark.range(n).select(F.col("id").cast("int").alias("k"), (50 + F.rand(1)).alias("x"), (10 + F.rand(2)).alias("y"))
        far = spark.range(20).select((F.col("id") + n).cast("int").alias("k"), (F.col("id") * 10.0).alias("x"), (F.col("id") * 10.0).alias("y"))
        g = boxes.unionByName(far).select("k", G.rectangle(F.col("x"), F.col("y"), F.col("x") + 0.5, F.col("y") + 0.75, 4326).alias("g"))
        a = SP._prepare(g.withColumnRenamed("g", "a_geom"), "a_geom", "a_")
        b = SP._prepare(_boxes(spark, [(i, 49.0 + i % 3, 9.0 + i // 3, 50.5 + i % 3, 10.5 + i // 3) for i in range(9)])
                        .withColumnRenamed("geometry", "b_geom"), "b_geom", "b_")
        return CL.meet(a, b, 50, 4096)[0].count() / n
    small, large = cells_per_row(1000), cells_per_row(8000)
    assert small < 12 and large < 12


def test_empty_null_and_single_place(spark):
    some = _points(spark, [(1, 5.0, 5.0), (2, None, None)]).unionByName(
        _points(spark, [(3, 5.0, 5.0)]).withColumn("geometry", F.lit(None).cast(_points(spark, [(1, 1.0, 1.0)]).schema[1].dataType)))
    box = _boxes(spark, [(7, 5.0, 5.0, 5.0, 5.0)])
    assert SP.spatial_join(some, box.limit(0), "within").count() == 0
    assert SP.spatial_join(some.limit(0), box.limit(0), "within").count() == 0
    same = _points(spark, [(9, 5.0, 5.0), (8, 5.5, 5.0)]).withColumnRenamed("pid", "qid")
    j = SP.spatial_join(some, same, "intersects", kinds=("point", "point"), rows_per_cell=1)
    assert [(r.pid, r.qid) for r in j.collect()] == [(1, 9)]


def test_lines_take_a_measured_grid(spark):
    rnd = random.Random(2)
    ends = [(i, rnd.uniform(0, 50), rnd.uniform(0, 50), rnd.uniform(0, 50), rnd.uniform(0, 50)) for i in range(40)]
    lines = spark.createDataFrame(ends, "lid int, x0 double, y0 double, x1 double, y1 double").select(
        "lid", G.linestring(F.array(G.xy(F.col("x0"), F.col("y0")), G.xy(F.col("x1"), F.col("y1"))), 4326).alias("geometry"))
    _, boxes = _layers()
    for pred in ("crosses", "intersects"):
        got = {(r.lid, r.bid) for r in SP.spatial_join(lines, _boxes(spark, boxes), pred, kinds=("line", "polygon")).collect()}
        want = {(r.lid, r.bid) for r in SP.spatial_join(lines, _boxes(spark, boxes), pred, 7.0, kinds=("line", "polygon")).collect()}
        assert got == want and got
