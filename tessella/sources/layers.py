"""Feature layers derived from the driver tables (FIXTURES.md).

``events`` becomes a point layer (coordinates derived from the id) and
``nation`` a polygon layer (a 5 x 5 grid of rectangles). Both are plain
projections of the scanned tables: their size grows with the tables and
Catalyst prunes unused columns down to the Parquet scan.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import table

# Fixed values of the fixture rule (FIXTURES.md): degrees, EPSG:4326.
POINT_X0, POINT_X_MOD, POINT_X_MUL = 4.0, 28000, 7919
POINT_Y0, POINT_Y_MOD, POINT_Y_MUL = 57.0, 15000, 104729
CELL_W, CELL_H, GRID_N = 5.6, 3.0, 5


def point_x(id_col="event_id"):
    return F.lit(POINT_X0) + (F.col(id_col) * POINT_X_MUL % POINT_X_MOD) / F.lit(1000.0)


def point_y(id_col="event_id"):
    return F.lit(POINT_Y0) + (F.col(id_col) * POINT_Y_MUL % POINT_Y_MOD) / F.lit(1000.0)


def narrow(spark: SparkSession, sf_dir: str, name: str, *cols: str, spread: bool = False) -> DataFrame:
    """Some columns of a table. ``spread`` deals them over all tasks by the first: a file of few narrow columns
    is one task's input, and what is made of its rows may be many times larger."""
    df = table(spark, sf_dir, name).select(*cols)
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), cols[0]) if spread else df


def event_points(spark: SparkSession, sf_dir: str, with_geometry: bool = False) -> DataFrame:
    """Point layer: every event with ``x``, ``y`` (and bbox = the point)."""
    df = table(spark, sf_dir, "events").withColumns({"x": point_x(), "y": point_y()})
    if with_geometry:
        df = df.withColumn("geometry", G.point(F.col("x"), F.col("y"), 4326))
    return df


def nation_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon layer: one rectangle per nation, with bbox columns."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    x0 = F.lit(POINT_X0) + F.lit(CELL_W) * (k % GRID_N)
    y0 = F.lit(POINT_Y0) + F.lit(CELL_H) * F.floor(k / GRID_N)
    return (n.withColumns({"min_x": x0, "min_y": y0})
            .withColumns({"max_x": F.col("min_x") + F.lit(CELL_W), "max_y": F.col("min_y") + F.lit(CELL_H)})
            .withColumn("geometry", G.rectangle(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), 4326)))


# SQL spellings of the same rule, for DuckDB oracles.
SQL_POINT_X = "(CAST(4.0 AS DOUBLE) + CAST(event_id * 7919 % 28000 AS DOUBLE) / CAST(1000.0 AS DOUBLE))"
SQL_POINT_Y = "(CAST(57.0 AS DOUBLE) + CAST(event_id * 104729 % 15000 AS DOUBLE) / CAST(1000.0 AS DOUBLE))"
SQL_RECT_X0 = "(CAST(4.0 AS DOUBLE) + CAST(5.6 AS DOUBLE) * (n_nationkey % 5))"
SQL_RECT_Y0 = "(CAST(57.0 AS DOUBLE) + CAST(3.0 AS DOUBLE) * floor(n_nationkey / 5))"
SQL_RECT_W, SQL_RECT_H = "CAST(5.6 AS DOUBLE)", "CAST(3.0 AS DOUBLE)"


def event_segments(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Line layer: each event's movement segment, from its point to the point
    of ``event_id + 1`` (both computed from ids, so no join is needed)."""
    ev = narrow(spark, sf_dir, "events", "event_id", "user_id", spread=spread)
    nxt = F.col("event_id") + 1
    x1 = F.lit(POINT_X0) + (nxt * POINT_X_MUL % POINT_X_MOD) / F.lit(1000.0)
    y1 = F.lit(POINT_Y0) + (nxt * POINT_Y_MUL % POINT_Y_MOD) / F.lit(1000.0)
    return ev.withColumn("geometry", G.linestring(F.array(G.xy(point_x(), point_y()), G.xy(x1, y1)), 4326))


def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon layer: per region, the bounding rectangle of its nations'
    rectangles (an aggregate over the nation layer)."""
    n = nation_polygons(spark, sf_dir)
    b = n.groupBy("n_regionkey").agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"),
                                     F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
    return (b.withColumnRenamed("n_regionkey", "r_regionkey")
            .withColumn("geometry", G.rectangle(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), 4326)))


SQL_NEXT_X = "(CAST(4.0 AS DOUBLE) + CAST((event_id + 1) * 7919 % 28000 AS DOUBLE) / CAST(1000.0 AS DOUBLE))"
SQL_NEXT_Y = "(CAST(57.0 AS DOUBLE) + CAST((event_id + 1) * 104729 % 15000 AS DOUBLE) / CAST(1000.0 AS DOUBLE))"
SQL_NATION_RECTS = f"""(SELECT n_nationkey, n_regionkey, {SQL_RECT_X0} AS x0, {SQL_RECT_Y0} AS y0,
  {SQL_RECT_X0} + {SQL_RECT_W} AS x1, {SQL_RECT_Y0} + {SQL_RECT_H} AS y1 FROM nation)"""


def order_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon layer with invalid members: per order a quad
    A(x0,0) B(x0+1,0) C(x0+u,1) D(x0+v,1) with ``x0 = 2*(o_orderkey % 1000)``,
    ``u = (o_custkey % 3)/2``, ``v = (o_orderkey % 3)/2``. ``u < v`` gives a
    bow-tie, ``u = v`` a repeated vertex; pending orders (status ``P``) leave
    the ring unclosed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    x0 = (F.col("o_orderkey") % 1000).cast("double") * 2.0
    u = (F.col("o_custkey") % 3).cast("double") / 2.0
    v = (F.col("o_orderkey") % 3).cast("double") / 2.0
    a, b = G.xy(x0, F.lit(0.0)), G.xy(x0 + 1.0, F.lit(0.0))
    c, d = G.xy(x0 + u, F.lit(1.0)), G.xy(x0 + v, F.lit(1.0))
    ring = F.when(F.col("o_orderstatus") == "P", F.array(a, b, c, d)).otherwise(F.array(a, b, c, d, a))
    return o.select("o_orderkey", F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"),
                                           F.array(F.array(ring)).alias("parts")).alias("geometry"))


SQL_QUADS = """(SELECT o_orderkey, o_orderstatus, CAST(o_orderkey % 1000 AS DOUBLE) * 2.0 AS x0,
  CAST(o_custkey % 3 AS DOUBLE) / 2.0 AS u, CAST(o_orderkey % 3 AS DOUBLE) / 2.0 AS v FROM orders)"""


def order_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon layer of larger faults, a kind per ``o_orderkey % 5``: stars of 5, 7 or 9 points, rings that cross
    their base line 3 to 9 times, two overlapping parts, a hole partly outside its shell beside one
    inside, and a valid polygon with a hole. Sizes come from the customer key."""
    o = narrow(spark, sf_dir, "orders", "o_orderkey", "o_custkey", spread=True)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x0 = (k % 1000).cast("double") * 32.0
    at = lambda x, y: G.xy(x0 + x, y)
    n, r = (c % 3).cast("int") * 2 + 5, (k % 7 + 1).cast("double")
    angle = lambda i: i.cast("double") * (4.0 * math.pi) / n
    star = F.transform(F.sequence(F.lit(0), n), lambda i: at(r * F.cos(angle(i % n)), r * F.sin(angle(i % n))))
    m, h = (c % 7).cast("int") + 4, (k % 3 + 1).cast("double")
    teeth = F.transform(F.sequence(F.lit(0), m - 1), lambda i: at(
        m.cast("double") - i.cast("double") - 0.5, F.when(i % 2 == 0, h).otherwise(-h)))
    saw = F.concat(F.array(at(F.lit(0.0), F.lit(0.0)), at(m.cast("double"), F.lit(0.0))), teeth, F.array(at(F.lit(0.0), F.lit(0.0))))
    zero = F.lit(0.0)

    def box(ax, ay, bx, by):
        ax, ay, bx, by = (v.cast("double") if hasattr(v, "cast") else F.lit(float(v)) for v in (ax, ay, bx, by))
        return F.array(at(ax, ay), at(bx, ay), at(bx, by), at(ax, by), at(ax, ay))
    a, d = c % 4 + 2, c % 3 + 1
    parts = (F.when(k % 5 == 0, F.array(F.array(star))).when(k % 5 == 1, F.array(F.array(saw)))
             .when(k % 5 == 2, F.array(F.array(box(zero, zero, a, a)), F.array(box(a - 1, a - 1, a * 2 - 1, a * 2 - 1))))
             .when(k % 5 == 3, F.array(F.array(box(0, 0, 6, 6), box(F.lit(5), 1, d + 6, 3), box(1, 1, 2, 2))))
             .otherwise(F.array(F.array(box(0, 0, 6, 6), box(1, 1, 2, 2)))))
    kind = F.when(k % 5 == 2, "MultiPolygon").otherwise("Polygon")
    return o.select("o_orderkey", "o_custkey", F.struct(kind.alias("type"), F.lit(4326).alias("srid"), parts.alias("parts")).alias("geometry"))


#: What the even-odd rule leaves of ``order_shapes``, by formula: the inner polygon of a star has
#: radius r * cos(2 pi / n) / cos(pi / n).
SQL_SHAPES = """(SELECT o_orderkey, k, n, CASE k WHEN 0 THEN n * r * q * sin(pi() / n) - n / 2.0 * q * q * sin(2 * pi() / n)
  WHEN 1 THEN m * h / 2.0 WHEN 2 THEN 2 * a * a - 2 WHEN 3 THEN 33 + 2 * d ELSE 35 END AS area,
  CASE k WHEN 0 THEN n WHEN 1 THEN m WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS n_parts,
  CASE k WHEN 0 THEN n WHEN 1 THEN m WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 2 END AS n_rings,
  CASE k WHEN 0 THEN 'self-intersection' WHEN 1 THEN 'self-intersection' WHEN 4 THEN NULL ELSE 'rings cross' END AS fault
  FROM (SELECT *, r * cos(2 * pi() / n) / cos(pi() / n) AS q FROM (SELECT o_orderkey, o_orderkey % 5 AS k,
    o_custkey % 3 * 2 + 5 AS n, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS r, o_custkey % 7 + 4 AS m,
    o_orderkey % 3 + 1 AS h, o_custkey % 4 + 2 AS a, o_custkey % 3 + 1 AS d FROM orders)))"""


def order_parcels(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Polygon layer that grows with the orders: per order a square of 1.5 with a hole of 0.75,
    200 to a row of the plane, so neighbours overlap and the plane gets higher with the orders."""
    o = narrow(spark, sf_dir, "orders", "o_orderkey", spread=spread)
    x0, y0 = (F.col("o_orderkey") % 200).cast("double"), F.floor(F.col("o_orderkey") / 200).cast("double")

    def ring(a, b):
        return F.array(G.xy(x0 + a, y0 + a), G.xy(x0 + b, y0 + a), G.xy(x0 + b, y0 + b), G.xy(x0 + a, y0 + b), G.xy(x0 + a, y0 + a))
    return o.select("o_orderkey", F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"),
                                           F.array(F.array(ring(0.0, 1.5), ring(0.25, 1.0))).alias("parts")).alias("geometry"))


def town_visits(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Point and multi-point layer over the plane of ``order_parcels``: a third of all events lie in one town
    of one square unit, the others along the rows. ``geometry`` is the event's place, ``trail`` a multi-point
    of three places."""
    e = narrow(spark, sf_dir, "events", "event_id", "user_id", spread=spread)
    k = F.col("event_id")
    town = k % 3 == 0
    x = F.when(town, 50.0 + (k * 7919 % 10000) / F.lit(10000.0)).otherwise((k * 7919 % 200000) / F.lit(1000.0))
    y = F.when(town, 10.0 + (k * 104729 % 10000) / F.lit(10000.0)).otherwise(F.floor(k / 200) + (k * 31 % 1000) / F.lit(1000.0))
    e = e.withColumns({"x": x, "y": y})
    places = F.array(*[F.array(F.array(G.xy(F.col("x") + dx, F.col("y") + dy))) for dx, dy in TRAIL])
    return e.select("event_id", "user_id", G.point(F.col("x"), F.col("y"), 4326).alias("geometry"),
                    F.struct(F.lit("MultiPoint").alias("type"), F.lit(4326).alias("srid"), places.alias("parts")).alias("trail"))


TRAIL = [(0.0, 0.0), (0.25, 0.125), (0.5, 0.75)]
SQL_PARCELS = """(SELECT o_orderkey, CAST(o_orderkey % 200 AS DOUBLE) AS x0, CAST(o_orderkey // 200 AS DOUBLE) AS y0 FROM orders)"""
SQL_VISITS = """(SELECT event_id, user_id,
  CASE WHEN event_id % 3 = 0 THEN CAST(50 AS DOUBLE) + CAST(event_id * 7919 % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE)
    ELSE CAST(event_id * 7919 % 200000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS x,
  CASE WHEN event_id % 3 = 0 THEN CAST(10 AS DOUBLE) + CAST(event_id * 104729 % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE)
    ELSE CAST(event_id // 200 AS DOUBLE) + CAST(event_id * 31 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS y FROM events)"""
