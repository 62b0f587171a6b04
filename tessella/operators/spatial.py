"""Spatial relation joins (J5-J9): intersects, contains, within, touches,
crosses between two feature layers.

Plan (no geometry library, no Python per row):

Cells come from the data unless the caller names a size: a quad-tree whose
nodes hold at most ``rows_per_cell`` rows (``cells.py``), or, where one side is
lines, an even grid of a measured size.

1. Each geometry gets its bbox and the cells the bbox covers: leaves of the
   tree, or integer pairs ``floor(x/size), floor(y/size)`` packed into one
   long. Points cover one cell; a polygon covers its bbox's cells.
2. Both sides are exploded to ``(cell, geometry)`` rows and equi-joined on
   ``cell``: an ordinary shuffle join that AQE can convert to a broadcast
   join when one side turns out small, and split when a cell is hot (skew
   join). A side may also be broadcast explicitly, but only behind a proven
   row bound (``broadcast_rows``).
3. A pair met in several cells is kept only in the cell holding the
   lower-left corner of the intersection of the two bboxes (reference-point
   rule), so no ``distinct`` shuffle is needed to deduplicate.
4. The exact predicate runs on the joined pair; edge arrays are built once
   per geometry before the explode, not once per pair.

A given cell size should be near the typical polygon extent (a few cells per
polygon). Of such a grid ``max_cells`` bounds the explode of one geometry: levels of cells
64 x 64 times coarser each are stacked, every geometry sits on the finest
level where its bbox covers at most ``max_cells`` cells, the other side is
also placed on the levels in use, and a pair meets on the coarser of its two
levels. One huge polygon therefore never produces millions of rows, and no
candidate is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import cells as CL
from ._util import broadcast_if_small

PREDICATES = ("intersects", "contains", "within", "touches", "crosses")
KINDS = ("point", "line", "polygon")
_SHIFT = 1 << 30   # cell indices must satisfy |i| < 2^30


def _kind(g: Column) -> Column:
    t = F.lower(g["type"])
    return (F.when(t.contains("polygon"), F.lit("polygon"))
            .when(t.contains("line"), F.lit("line"))
            .otherwise(F.lit("point")))


def _prepare(df: DataFrame, geom_col: str, prefix: str, eps: float = 0.0) -> DataFrame:
    """Geometry + bbox + edges, computed once per feature. The cell box
    (``c*`` columns) is the bbox widened by ``eps``, so geometries within the
    tolerance of each other always share a cell."""
    g = F.col(geom_col)
    b = G.bbox(geom_col)
    df = df.withColumns({
        f"{prefix}minx": b["min_x"], f"{prefix}miny": b["min_y"],
        f"{prefix}maxx": b["max_x"], f"{prefix}maxy": b["max_y"],
        f"{prefix}edges": G.edges(g),
        f"{prefix}kind": _kind(g),
    })
    return df.withColumns({f"{prefix}cx0": F.col(f"{prefix}minx") - eps, f"{prefix}cy0": F.col(f"{prefix}miny") - eps,
                           f"{prefix}cx1": F.col(f"{prefix}maxx") + eps, f"{prefix}cy1": F.col(f"{prefix}maxy") + eps})


def _cell_id(ix: Column, iy: Column) -> Column:
    return F.shiftleft(ix.cast("long") + F.lit(_SHIFT), 31) + (iy.cast("long") + F.lit(_SHIFT))


SUPERCOVER_GAIN = 4   # a line uses its supercover when that is 4x smaller than its box cover


def _use_supercover(prefix: str, size: float) -> Column:
    """Per line: the supercover pays (its entry-point dedupe costs more than
    the box rule) only when it is much smaller than the bbox cover, as for
    long diagonal or many-vertex lines, whose box cover grows quadratically."""
    return _n_cells(prefix, size) > SUPERCOVER_GAIN * _n_cells(prefix, size, line=True)


def _cells(prefix: str, size: float, line: bool = False, eps: float = 0.0) -> Column:
    """Array of cell ids covered by the cell box, or for a line flagged
    ``{prefix}sc`` the cells its edges pass through (supercover)."""
    if line:
        return F.when(F.col(f"{prefix}sc"), _line_cells(prefix, size, eps)).otherwise(_cells(prefix, size))
    s = F.lit(float(size))
    ix0 = F.floor(F.col(f"{prefix}cx0") / s)
    ix1 = F.floor(F.col(f"{prefix}cx1") / s)
    iy0 = F.floor(F.col(f"{prefix}cy0") / s)
    iy1 = F.floor(F.col(f"{prefix}cy1") / s)
    return F.flatten(F.transform(F.sequence(ix0, ix1),
                                 lambda ix: F.transform(F.sequence(iy0, iy1), lambda iy: _cell_id(ix, iy))))


def _n_cells(prefix: str, size: float, line: bool = False, flagged: bool = False) -> Column:
    s = F.lit(float(size))
    if flagged:
        return F.when(F.col(f"{prefix}sc"), _n_cells(prefix, size, line=True)).otherwise(_n_cells(prefix, size))
    if line:
        # supercover bound: per edge, columns + rows crossed, with tolerance cells
        return F.aggregate(F.col(f"{prefix}edges"), F.lit(0).cast("long"), lambda acc, e: acc + 3 * (
            F.abs(F.floor(e["bx"] / s) - F.floor(e["ax"] / s)) + F.abs(F.floor(e["by"] / s) - F.floor(e["ay"] / s)) + 2))
    return ((F.floor(F.col(f"{prefix}cx1") / s) - F.floor(F.col(f"{prefix}cx0") / s) + 1)
            * (F.floor(F.col(f"{prefix}cy1") / s) - F.floor(F.col(f"{prefix}cy0") / s) + 1))


def _line_cells(prefix: str, size: float, eps: float) -> Column:
    """Supercover of a line: for every edge and every cell column it crosses,
    the rows its y-range spans within that column. Widened by a tolerance
    (``eps`` plus a millionth of a cell) so float rounding can never leave out
    a cell holding a point of the line."""
    s = float(size)
    t = float(eps) + s * 1e-6

    def edge_cells(e):
        x0, x1 = F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])
        vertical = e["bx"] == e["ax"]

        def column(ix):
            xl = F.greatest(x0, ix * s - t)
            xh = F.least(x1, (ix + 1) * s + t)
            yl_at = e["ay"] + (xl - e["ax"]) * (e["by"] - e["ay"]) / (e["bx"] - e["ax"])
            yh_at = e["ay"] + (xh - e["ax"]) * (e["by"] - e["ay"]) / (e["bx"] - e["ax"])
            ylo = F.when(vertical, F.least(e["ay"], e["by"])).otherwise(F.least(yl_at, yh_at))
            yhi = F.when(vertical, F.greatest(e["ay"], e["by"])).otherwise(F.greatest(yl_at, yh_at))
            return F.transform(F.sequence(F.floor((ylo - t) / s), F.floor((yhi + t) / s)),
                               lambda iy: _cell_id(ix, iy))
        return F.flatten(F.transform(F.sequence(F.floor((x0 - t) / s), F.floor((x1 + t) / s)), column))
    return F.array_distinct(F.flatten(F.transform(F.col(f"{prefix}edges"), edge_cells)))


def _entry_point(line: str, other: str) -> Column:
    """First point along the line's edges inside the other geometry's cell
    box (Liang-Barsky clip per edge), clamped to that box; NULL when the
    line never enters it. Its cell is on the line's supercover and inside the
    other's box cells, so it names one cell both sides are registered on."""
    bx0, by0 = F.col(f"{other}cx0"), F.col(f"{other}cy0")
    bx1, by1 = F.col(f"{other}cx1"), F.col(f"{other}cy1")
    inf = F.lit(float("inf"))

    def clip(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        bounds = [(-dx, e["ax"] - bx0), (dx, bx1 - e["ax"]), (-dy, e["ay"] - by0), (dy, by1 - e["ay"])]
        lo = F.greatest(F.lit(0.0), *[F.when(p < 0, q / p).otherwise(-inf) for p, q in bounds])
        hi = F.least(F.lit(1.0), *[F.when(p > 0, q / p).otherwise(inf) for p, q in bounds])
        rejected = None
        for p, q in bounds:
            r = (p == 0) & (q < 0)
            rejected = r if rejected is None else (rejected | r)
        ok = ~rejected & (lo <= hi)
        px = F.least(bx1, F.greatest(bx0, e["ax"] + lo * dx))
        py = F.least(by1, F.greatest(by0, e["ay"] + lo * dy))
        return ok, px, py

    init = F.struct(F.lit(False).alias("found"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc, e):
        ok, px, py = clip(e)
        return F.when(acc["found"], acc).when(ok, F.struct(F.lit(True).alias("found"), px.alias("x"), py.alias("y"))) \
            .otherwise(acc)
    r = F.aggregate(F.col(f"{line}edges"), init, step)
    return F.when(r["found"], F.struct(r["x"].alias("x"), r["y"].alias("y")))


def relation(pred: str, a: str = "a_", b: str = "b_", eps: float = 0.0,
             kinds: tuple[str, str] | None = None) -> Column:
    """Exact predicate ``A pred B`` on a joined pair of prepared rows.

    Kinds are point, line, polygon; ``contains``/``within`` follow OGC
    (boundary excluded: a polygon does not contain a point on its edge).
    """
    ga, gb = F.col(f"{a}geom"), F.col(f"{b}geom")
    ea, eb = F.col(f"{a}edges"), F.col(f"{b}edges")
    ka, kb = F.col(f"{a}kind"), F.col(f"{b}kind")
    if pred not in PREDICATES:
        raise ValueError(f"predicate {pred!r} not in {PREDICATES}")
    no = F.lit(False)

    def pt_pt():
        same = F.exists(G.coords(ga), lambda p: F.exists(G.coords(gb), lambda q: (F.abs(p["x"] - q["x"]) <= eps)
                                                         & (F.abs(p["y"] - q["y"]) <= eps)))
        return {"intersects": same, "contains": same, "within": same}.get(pred, no)

    def pt_poly(g, poly_edges, point_first: bool):
        # all points of a multi-point count: within needs one in the interior and none outside
        place = F.transform(G.coords(g), lambda p: G.point_location(p["x"], p["y"], poly_edges, eps))
        has = lambda where: F.exists(place, lambda x: x == where)
        inner = "within" if point_first else "contains"
        return {"intersects": has("interior") | has("boundary"), inner: has("interior") & ~has("exterior"),
                "touches": has("boundary") & ~has("interior"),
                "crosses": has("interior") & has("exterior")}.get(pred, no)

    def poly_poly():
        if pred == "contains":
            return G.poly_poly_relations(gb, eb, ga, ea, eps)["within"]
        return G.poly_poly_relations(ga, ea, gb, eb, eps).get(pred, no)

    def line_line():
        if pred == "contains":
            return G.line_line_relations(eb, ea, eps)["within"]
        return G.line_line_relations(ea, eb, eps)[pred]

    def line_poly(le, pe, line_first: bool):
        name = {"within": "within" if line_first else "", "contains": "" if line_first else "within"}.get(pred, pred)
        return G.line_poly_relations(le, pe, eps).get(name, no)

    def pt_line(g, le, point_first: bool):
        pts = G.coords(g)
        on = lambda p: G.point_on_boundary(p["x"], p["y"], le, eps)
        mid = G.let(G.line_boundary(le), lambda ends: F.exists(pts, lambda p: on(p) & ~_among(p, ends, eps)))
        inner = "within" if point_first else "contains"
        return {"intersects": F.exists(pts, on), inner: mid & F.forall(pts, on),
                "touches": F.exists(pts, on) & ~mid, "crosses": mid & ~F.forall(pts, on)}.get(pred, no)

    table = {
        ("point", "point"): pt_pt,
        ("point", "polygon"): lambda: pt_poly(ga, eb, True),
        ("polygon", "point"): lambda: pt_poly(gb, ea, False),
        ("polygon", "polygon"): poly_poly,
        ("line", "line"): line_line,
        ("line", "polygon"): lambda: line_poly(ea, eb, True),
        ("polygon", "line"): lambda: line_poly(eb, ea, False),
        ("point", "line"): lambda: pt_line(ga, eb, True),
        ("line", "point"): lambda: pt_line(gb, ea, False),
    }
    if kinds and kinds[0] and kinds[1]:
        return table[tuple(kinds)]()
    out = no
    for (x, y), build in reversed(list(table.items())):
        out = F.when((ka == x) & (kb == y), build()).otherwise(out)
    return out


def _among(p, points: Column, eps) -> Column:
    return F.exists(points, lambda q: (F.abs(q["x"] - p["x"]) <= eps) & (F.abs(q["y"] - p["y"]) <= eps))


LEVEL_FACTOR = 64     # each coarser level has cells 64 x 64 times larger
MAX_LEVEL = 6         # 64^6 ~ 7e10: any extent fits


def _level(p: str, cell_size: float, max_cells: int, line: bool = False) -> Column:
    """Finest level on which the geometry covers at most ``max_cells`` cells."""
    out = F.lit(MAX_LEVEL)
    for lv in range(MAX_LEVEL - 1, -1, -1):
        out = F.when(_n_cells(p, cell_size * LEVEL_FACTOR ** lv, flagged=line) <= max_cells, F.lit(lv)).otherwise(out)
    return out


def _levels(df: DataFrame, p: str, cell_size: float, max_cells: int, line: bool = False) -> list[int]:
    """Levels used on one side (a multi-point may be large too): one early-exit pass
    finds whether any geometry is oversized, and only then the distinct
    levels (at most MAX_LEVEL + 1 values) are collected."""
    if df.filter(_n_cells(p, cell_size, flagged=line) > max_cells).limit(1).count() == 0:
        return [0]
    return sorted(r[0] for r in df.select(_level(p, cell_size, max_cells, line).alias("l")).distinct().collect())


def _tag(lv: int):
    # a one-argument lambda (PySpark picks the transform arity from it)
    return lambda x: F.struct(F.lit(lv).alias("lvl"), x.alias("cell"))


def spatial_join(left: DataFrame, right: DataFrame, predicate: str, cell_size: float | None = None,
                 left_geom: str = "geometry", right_geom: str = "geometry",
                 left_cols: list[str] | None = None, right_cols: list[str] | None = None,
                 kinds: tuple[str, str] | None = None, eps: float = 0.0,
                 broadcast_rows: int | None = None, max_cells: int = 4096, salt_buckets: int = 0,
                 rows_per_cell: int = CL.ROWS_PER_CELL) -> DataFrame:
    """Pairs ``(left, right)`` with ``left <predicate> right``.

    ``cell_size = None`` takes the cells from the data: a tree whose cells hold
    about ``rows_per_cell`` rows of both sides, hot places salted.

    Returns ``left_cols + right_cols`` (names must not clash). ``kinds`` =
    (left kind, right kind) among point/line/polygon, when known, compiles
    only that predicate. ``broadcast_rows`` broadcasts the right side if it is proven to have at
    most that many rows; otherwise the planner (and AQE) picks the join.
    ``salt_buckets = n`` splits every cell of the left side over ``n`` tasks
    and replicates right rows ``n`` times: for hot cells (one cell holding a
    large share of the left rows) when both sides are too big to broadcast.
    """
    if predicate not in PREDICATES:
        raise ValueError(f"predicate {predicate!r} not in {PREDICATES}")
    left_cols = left_cols or [c for c in left.columns if c != left_geom]
    right_cols = right_cols or [c for c in right.columns if c != right_geom]
    a = _prepare(left.select(*left_cols, F.col(left_geom).alias("a_geom")), "a_geom", "a_", eps)
    b = _prepare(right.select(*right_cols, F.col(right_geom).alias("b_geom")), "b_geom", "b_", eps)
    ka, kb = kinds or (None, None)
    # a line against a non-line is registered on the cells it passes through
    # (supercover) instead of its whole bbox; the pair then meets in the cell
    # of the line's entry point into the other's box (see _entry_point)
    a_line = ka == "line" and kb in ("point", "polygon")
    b_line = kb == "line" and ka in ("point", "polygon")
    overlap = ((F.col("a_cx1") >= F.col("b_cx0")) & (F.col("b_cx1") >= F.col("a_cx0"))
               & (F.col("a_cy1") >= F.col("b_cy0")) & (F.col("b_cy1") >= F.col("a_cy0")))
    if cell_size is None and not (a_line or b_line):
        # rows are exploded to cells without their edges, which are several times larger
        a, b, cond, once = CL.meet(a.drop("a_edges"), b.drop("b_edges"), rows_per_cell, max_cells)
        a = a.withColumn("a_edges", G.edges(F.col("a_geom")))
        b = b.withColumn("b_edges", G.edges(F.col("b_geom")))
        # the planner's estimate knows nothing of cells and edges: it may not broadcast by it
        b = broadcast_if_small(b, broadcast_rows) if broadcast_rows else b.hint("merge")
        exact = F.when(overlap & once, relation(predicate, "a_", "b_", eps, kinds)).otherwise(F.lit(False))
        return a.join(b, cond).filter(exact).select(*left_cols, *right_cols)
    if cell_size is None:
        cell_size = CL.measured_size(a, b, rows_per_cell, "a_" if a_line else "b_")
    if a_line:
        a = a.withColumn("a_sc", _use_supercover("a_", cell_size))
    if b_line:
        b = b.withColumn("b_sc", _use_supercover("b_", cell_size))
    la = _levels(a, "a_", cell_size, max_cells, a_line)
    lb = _levels(b, "b_", cell_size, max_cells, b_line)
    if la == [0] and lb == [0]:
        a = a.select("*", F.explode(_cells("a_", cell_size, a_line, eps)).alias("a_cell"))
        b = b.select("*", F.explode(_cells("b_", cell_size, b_line, eps)).alias("b_cell"))
        cond = F.col("a_cell") == F.col("b_cell")
        size = F.lit(float(cell_size))
    else:
        # a geometry sits on its own level and is also placed on every coarser
        # level the other side uses; a pair meets on the coarser of its two levels
        def explode(df, p, other_levels, line):
            own = _level(p, cell_size, max_cells, line)
            df = df.withColumn(f"{p}lvl", own)
            parts = []
            for lv in sorted(set(la) | set(lb)):
                keep = (F.col(f"{p}lvl") == lv)
                if lv in other_levels:
                    keep = keep | (F.col(f"{p}lvl") < lv)
                cells = F.transform(_cells(p, cell_size * LEVEL_FACTOR ** lv, line, eps), _tag(lv))
                parts.append(F.when(keep, cells).otherwise(F.array().cast("array<struct<lvl:int,cell:bigint>>")))
            return df.select("*", F.inline(F.concat(*parts)).alias(f"{p}cl", f"{p}cell"))

        a = explode(a, "a_", lb, a_line)
        b = explode(b, "b_", la, b_line)
        cond = ((F.col("a_cell") == F.col("b_cell")) & (F.col("a_cl") == F.col("b_cl"))
                & (F.col("a_cl") == F.greatest(F.col("a_lvl"), F.col("b_lvl"))))
        size = F.lit(float(cell_size)) * F.pow(F.lit(float(LEVEL_FACTOR)), F.col("a_cl"))
    if salt_buckets and salt_buckets > 1:
        a = a.withColumn("a_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left_cols], F.col("a_cell")),
                                          F.lit(salt_buckets)).cast("int"))
        b = b.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
        cond = cond & (F.col("a_salt") == F.col("b_salt"))
    if broadcast_rows:
        b = broadcast_if_small(b, broadcast_rows)
    j = a.join(b, cond)
    # cheap tests first: bbox overlap, and the reference point (lower-left
    # corner of the bbox intersection) must fall in this row's cell, so a pair
    # met in several cells is kept once with no distinct. The exact predicate
    # sits behind a CASE so the optimizer cannot move it ahead of them.
    rx = F.floor(F.greatest(F.col("a_cx0"), F.col("b_cx0")) / size)
    ry = F.floor(F.greatest(F.col("a_cy0"), F.col("b_cy0")) / size)
    box_rule = _cell_id(rx, ry) == F.col("a_cell")
    if a_line or b_line:
        entry = _entry_point("a_", "b_") if a_line else _entry_point("b_", "a_")
        # the entry point is computed once (let), only for overlapping boxes of
        # lines registered by supercover; box-registered lines keep the box rule
        ref = G.let(entry, lambda e: F.when(e.isNotNull(), _cell_id(F.floor(e["x"] / size), F.floor(e["y"] / size))))
        entry_rule = F.coalesce(ref == F.col("a_cell"), F.lit(False))
        sc = F.col("a_sc") if a_line else F.col("b_sc")
        cheap = F.when(overlap, F.when(sc, entry_rule).otherwise(box_rule)).otherwise(F.lit(False))
    else:
        cheap = overlap & box_rule
    j = j.filter(F.when(cheap, relation(predicate, "a_", "b_", eps, kinds)).otherwise(F.lit(False)))
    return j.select(*left_cols, *right_cols)
