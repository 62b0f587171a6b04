"""Cells for spatial joins, taken from the data: a quad-tree over both sides.

The tree is a table of nodes that Spark counts, never a structure on the
driver. Centres of the rows' boxes are sampled (``SAMPLES_PER_CELL`` of
``rows_per_cell`` rows, all rows of small inputs), counted at every depth at
once, and a node with more than ``rows_per_cell`` rows is split. So the number
of cells grows with the rows, and a town holding a third of all points has many
small cells while an empty region is one.

A geometry is registered

- on every leaf its box touches, unless that would be more than ``max_cells``
  cells: then it stops higher, at its own depth ``s``;
- on the inner nodes of those depths at which geometries of the other side stop.

A pair meets on one node only: the one holding the lower-left corner of the
boxes' intersection at depth ``min(leaf, s of a, s of b)``.

Where many rows have an extent, ``max_cells`` is lowered so that the cells of all boxes
stay some ``CELLS_PER_ROW`` a row (in a dense place leaves are far smaller than the
boxes), and no box is registered deeper than any geometry of the other side: no pair
meets there.

A leaf at the greatest depth that still holds very many rows (points at one
place) is salted: the rows of its larger side are dealt over several keys and
those of the other side repeated. So is an inner node, as far as that repeats fewer rows than it holds. Sampling decides only how work is cut; which
pairs meet never depends on it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

ROWS_PER_CELL = 1000
CELLS_PER_ROW = 8            # on average over both sides' rows, where boxes are larger than cells
SAMPLES_PER_CELL = 32
SAMPLE_ALL = 200_000         # inputs up to this many rows are counted whole
DEEPEST = 24                 # node ids: 5 bits of depth, 24 of column, 24 of row
DEPTH_FOR_SKEW = 16          # depths beyond those an even spread would need
SALT_CELLS = 64              # a deepest leaf of more rows than so many cells is salted
MAX_SALTS = 1024             # spreads work only: rows are never left out; 10 bits beside the node in a cell
MAX_NODES = 4_000_000        # broadcast bound of the node table (32 bytes each); beyond it the planner joins


def node_id(d: Column, ix: Column, iy: Column) -> Column:
    return (F.shiftleft(d.cast("long"), 48).bitwiseOR(F.shiftleft(ix.cast("long"), 24))).bitwiseOR(iy.cast("long"))


class Frame:
    """The square around both sides, their number of rows and the depth of the tree."""

    def __init__(self, a: DataFrame, b: DataFrame, rows_per_cell: int):
        box = lambda df, p: df.select(*[F.col(f"{p}{c}").alias(c) for c in ("cx0", "cy0", "cx1", "cy1")])
        wide = (F.col("cx1") > F.col("cx0")) | (F.col("cy1") > F.col("cy0"))
        r = box(a, "a_").unionByName(box(b, "b_")).agg(
            F.min("cx0").alias("x0"), F.min("cy0").alias("y0"), F.max("cx1").alias("x1"), F.max("cy1").alias("y1"),
            F.count("cx0").alias("n"), F.count(F.when(wide, 1)).alias("wide")).first()
        self.n, self.wide = r["n"], r["wide"]
        self.x0, self.y0 = (r["x0"], r["y0"]) if self.n else (0.0, 0.0)
        side = max(r["x1"] - r["x0"], r["y1"] - r["y0"]) if self.n else 0.0
        self.side = side if side > 0 else 1.0
        even = math.ceil(math.log(max(1.0, self.n / rows_per_cell), 4))
        self.depth = min(DEEPEST, even + DEPTH_FOR_SKEW) if self.n > rows_per_cell else 0
        self.fraction = min(1.0, max(SAMPLES_PER_CELL / rows_per_cell, SAMPLE_ALL / self.n)) if self.n else 1.0

    def cells_each(self, max_cells: int) -> int:
        """Cells that one box may touch: fewer than ``max_cells`` where boxes are many."""
        return max(4, min(max_cells, CELLS_PER_ROW * self.n // max(self.wide, 1)))

    def index(self, v: Column, axis: str, d: Column) -> Column:
        """Column or row at depth ``d``. Scaling by a power of two is exact, so the index
        at a depth is the index at a greater depth with its last bits cut off."""
        unit = (v - F.lit(self.x0 if axis == "x" else self.y0)) / F.lit(self.side)
        cells = F.call_function("shiftleft", F.lit(1).cast("long"), d.cast("int"))
        return F.greatest(F.lit(0).cast("long"), F.least(cells - 1, F.floor(unit * cells.cast("double"))))

    def stop_depth(self, p: str, max_cells: int) -> Column:
        """Greatest depth at which the box surely touches at most ``max_cells`` cells."""
        across = max(1.0, math.sqrt(max_cells) - 2)
        wide = F.greatest(F.col(f"{p}cx1") - F.col(f"{p}cx0"), F.col(f"{p}cy1") - F.col(f"{p}cy0")) / F.lit(self.side)
        fits = F.floor(F.log2(F.lit(across) / wide)).cast("int")
        return F.when(wide <= 0, F.lit(self.depth)).otherwise(
            F.greatest(F.lit(0), F.least(F.lit(self.depth), F.coalesce(fits, F.lit(self.depth)))))


def tree(a: DataFrame, b: DataFrame, frame: Frame, rows_per_cell: int) -> DataFrame:
    """Nodes (id, leaf, a_salts, b_salts, d), written down once: the root and
    the children of every split node."""
    deep = frame.depth

    def centres(df, p, is_a):
        x = (F.col(f"{p}cx0") + F.col(f"{p}cx1")) / 2
        y = (F.col(f"{p}cy0") + F.col(f"{p}cy1")) / 2
        at = F.lit(deep)
        rows = df if frame.fraction >= 1.0 else df.sample(frame.fraction, seed=7)
        return rows.filter(x.isNotNull()).select(frame.index(x, "x", at).alias("x"), frame.index(y, "y", at).alias("y"),
                                                 F.lit(is_a).alias("is_a"))
    seen = centres(a, "a_", 1).unionByName(centres(b, "b_", 0))
    cells = seen.groupBy("x", "y").agg(F.sum("is_a").alias("na"), F.count(F.lit(1)).alias("n"))
    counts = (cells.select(F.explode(F.sequence(F.lit(0), F.lit(deep))).alias("d"), "x", "y", "na", "n")
              .groupBy("d", F.expr(f"shiftright(x, {deep} - d)").alias("x"), F.expr(f"shiftright(y, {deep} - d)").alias("y"))
              .agg((F.sum("na") / frame.fraction).alias("na"), (F.sum("n") / frame.fraction).alias("n"))
              .filter(F.col("n") > rows_per_cell))
    ensure_checkpoint_dir(a.sparkSession)
    heavy = counts.withColumn("id", node_id(F.col("d"), F.col("x"), F.col("y"))).checkpoint(eager=True)
    split = heavy.filter(F.col("d") < deep)
    two = F.array(F.lit(0), F.lit(1))
    children = (split.select((F.col("d") + 1).alias("d"), F.explode(two).alias("dx"), "x", "y")
                .select("d", (F.col("x") * 2 + F.col("dx")).alias("x"), "y", F.explode(two).alias("dy"))
                .select("d", node_id(F.col("d"), F.col("x"), F.col("y") * 2 + F.col("dy")).alias("id")))
    root = a.sparkSession.range(1).select(F.lit(0).alias("d"), node_id(F.lit(0), F.lit(0), F.lit(0)).alias("id"))
    found = root.unionByName(children).join(heavy.select("id", "na", "n"), "id", "left")
    inner = F.col("n").isNotNull() & (F.col("d") < deep)
    nb = F.col("n") - F.col("na")
    few = lambda mine, other: F.when(inner, F.greatest(F.lit(1), F.floor(mine / F.greatest(other, F.lit(1.0))))).otherwise(F.lit(MAX_SALTS))
    salts = lambda mine, other: F.when(F.col("n").isNotNull() & (mine >= other), F.least(
        F.lit(MAX_SALTS), F.ceil(mine / (SALT_CELLS * rows_per_cell)), few(mine, other)).cast("int")).otherwise(F.lit(1))
    a_salts = salts(F.col("na"), nb)
    return found.select("id", "d", (~inner).alias("leaf"), a_salts.alias("a_salts"),
                        F.when(a_salts > 1, F.lit(1)).otherwise(salts(nb, F.col("na"))).alias("b_salts")
                        ).checkpoint(eager=True)


def register(df: DataFrame, p: str, frame: Frame, nodes: DataFrame, small: bool, leaf_depths: list[int],
             other_stops: list[int], other_top: int) -> DataFrame:
    """Rows of one side, one for each node they are registered on (columns
    ``{p}s``, ``{p}node``, ``{p}d``, ``{p}leaf``, ``{p}salt``). The other side's
    geometries stop at ``other_top`` at the deepest: no pair meets below."""
    s = F.col(f"{p}s")
    row = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    # no node is deeper than the deepest leaf
    tried = F.array(*[F.lit(d) for d in range(max(leaf_depths) + 1)])
    wide = (F.col(f"{p}cx1") > F.col(f"{p}cx0")) | (F.col(f"{p}cy1") > F.col(f"{p}cy0"))
    # a point has one node a depth; the leaves below are spared to boxes, which have many
    lowest = F.when(wide, F.least(s, F.lit(other_top))).otherwise(s)
    known = F.array(*[F.lit(d) for d in sorted(set(leaf_depths) | set(other_stops))])
    d = F.col(f"{p}d")
    out = df.filter(F.col(f"{p}cx0").isNotNull()).select("*", F.explode(
        F.filter(tried, lambda t: (t <= lowest) & ((t == s) | F.array_contains(known, t)))).alias(f"{p}d"))
    out = out.select("*", F.explode(F.sequence(frame.index(F.col(f"{p}cx0"), "x", d),
                                               frame.index(F.col(f"{p}cx1"), "x", d))).alias(f"{p}ix"))
    out = out.select("*", F.explode(F.sequence(frame.index(F.col(f"{p}cy0"), "y", d),
                                               frame.index(F.col(f"{p}cy1"), "y", d))).alias(f"{p}iy"))
    out = out.withColumn(f"{p}node", node_id(d, F.col(f"{p}ix"), F.col(f"{p}iy"))).drop(f"{p}ix", f"{p}iy")
    mine, theirs = ("a_salts", "b_salts") if p == "a_" else ("b_salts", "a_salts")
    at = nodes.select(F.col("id").alias(f"{p}node"), F.col("leaf").alias(f"{p}leaf"),
                      F.col(mine).alias(f"{p}mine"), F.col(theirs).alias(f"{p}theirs"))
    # small: counted rows of fixed size; an estimate of a written table's size says little
    out = out.join(F.broadcast(at) if small else at.hint("merge"), f"{p}node")
    stops = F.array(*[F.lit(x) for x in other_stops]) if other_stops else F.array().cast("array<int>")
    out = out.filter(F.col(f"{p}leaf") | (d == s) | F.array_contains(stops, d))
    # the larger side of a salted leaf takes one salt per row, the other side all of them; the salt
    # is a hash of the row itself, so a stage run again deals its rows alike
    own = F.pmod(F.xxhash64(*row), F.col(f"{p}mine")).cast("int")
    dealt = F.when(F.col(f"{p}theirs") > 1, F.sequence(F.lit(0), F.col(f"{p}theirs") - 1)).otherwise(F.array(own))
    return out.select("*", F.explode(dealt).alias(f"{p}salt")).drop(f"{p}mine", f"{p}theirs")


def meet(a: DataFrame, b: DataFrame, rows_per_cell: int, max_cells: int) -> tuple[DataFrame, DataFrame, Column, Column]:
    """Both sides registered on the tree, the join condition, and the rule that
    keeps a pair on one of the nodes it meets on."""
    frame = Frame(a, b, rows_per_cell)
    max_cells = frame.cells_each(max_cells)
    a = a.withColumn("a_s", frame.stop_depth("a_", max_cells))
    b = b.withColumn("b_s", frame.stop_depth("b_", max_cells))
    stops, top = {"a": [], "b": []}, {"a": 0, "b": 0}
    for r in (a.select(F.lit("a").alias("side"), F.col("a_s").alias("s"))
              .unionByName(b.select(F.lit("b").alias("side"), F.col("b_s").alias("s"))).distinct().collect()):
        if r["s"] is not None:      # at most 2 x 25 rows
            top[r["side"]] = max(top[r["side"]], r["s"])
            if r["s"] < frame.depth:
                stops[r["side"]].append(r["s"])
    nodes = tree(a, b, frame, rows_per_cell)
    kinds = nodes.groupBy("leaf", "d").count().collect()      # at most 2 x 25 rows
    leaf_depths = sorted(r["d"] for r in kinds if r["leaf"])
    small = sum(r["count"] for r in kinds) <= MAX_NODES
    a = register(a, "a_", frame, nodes, small, leaf_depths, sorted(stops["b"]), top["b"])
    b = register(b, "b_", frame, nodes, small, leaf_depths, sorted(stops["a"]), top["a"])
    # node and salt as one key
    cell = lambda p: F.shiftleft(F.col(f"{p}node"), 10).bitwiseOR(F.col(f"{p}salt").cast("long"))
    a, b = a.withColumn("a_cell", cell("a_")), b.withColumn("b_cell", cell("b_"))
    cond = F.col("a_cell") == F.col("b_cell")
    d = F.col("a_d")
    corner = node_id(d, frame.index(F.greatest("a_cx0", "b_cx0"), "x", d),
                     frame.index(F.greatest("a_cy0", "b_cy0"), "y", d))
    once = (F.col("a_leaf") | (d == F.least("a_s", "b_s"))) & (corner == F.col("a_node"))
    return a, b, cond, once


def measured_size(a: DataFrame, b: DataFrame, rows_per_cell: int, line_side: str) -> float:
    """Edge of an even grid for lines, which are registered on the cells they
    pass through: as wide as the other side's mean box, and wide enough that a
    cell holds ``rows_per_cell`` rows if they were spread evenly."""
    other = "b_" if line_side == "a_" else "a_"
    cols = lambda df, p: df.select(*[F.col(f"{p}{c}").alias(c) for c in ("cx0", "cy0", "cx1", "cy1")],
                                   F.lit(p == other).alias("o"))
    wide = F.when(F.col("o"), F.greatest(F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")))
    r = cols(a, "a_").unionByName(cols(b, "b_")).agg(
        F.count("cx0").alias("n"), F.avg(wide).alias("mean"), F.min("cx0").alias("x0"), F.min("cy0").alias("y0"),
        F.max("cx1").alias("x1"), F.max("cy1").alias("y1")).first()
    if not r["n"]:
        return 1.0
    w, h = r["x1"] - r["x0"], r["y1"] - r["y0"]
    size = max(r["mean"] or 0.0, math.sqrt(max(w, 0) * max(h, 0) * rows_per_cell / r["n"]) / 8, max(w, h) / (1 << 28))
    return size if size > 0 else 1.0
