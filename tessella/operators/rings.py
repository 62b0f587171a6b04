"""Validity and repair of polygons of few points, many polygons at a time, as array work.

The same rules as the jobs over edges in ``planar``, for polygons that one task holds whole: a batch
of geometries is taken apart into arrays of edges, edges of a polygon whose boxes meet are paired by a sort
of their left ends, and what lies below a middle is found by a sort of the middles. No
row leaves its task. Comparisons and arithmetic are those of ``planar``, step by step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Slope of the shear after which edges are told apart as above or below: no edge
#: of coordinates with few digits is upright then.
SHEAR = 0.6180339887498949
#: A point within this share of a feature's extent of an edge lies on it.
SNAP = 2.0 ** -42
#: Pairs of points that one step works on; a polygon of more is one step.
PAIRS = 1 << 18
#: Pairs of a middle and an edge that are looked at together.
BLOCK = 1 << 20
#: By name: of several the first is told.
FAULTS = sorted(["coordinate", "empty", "open ring", "few points", "spike", "self-intersection", "rings cross",
                 "hole outside shell", "nested holes", "parts overlap", "interior cut"])
_CODE = {name: i for i, name in enumerate(FAULTS)}
_NONE = len(FAULTS)
PARTS = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


# ------------------------------------------------------------ one polygon

def closes_circle(links: list[tuple]) -> bool:
    """Whether rings and the points where they touch, linked, hold a circle: then the interior is cut."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for ring, point in links:
        a, b = root(("ring", ring)), root(("point", point))
        if a == b:
            return True
        up[a] = b
    return False


def _area(ring: list[tuple]) -> float:
    ox, oy = ring[0]
    return sum((a[0] - ox) * (b[1] - oy) - (b[0] - ox) * (a[1] - oy) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def _within(p: tuple, ring: list[tuple]) -> bool:
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def walk(links: list[tuple]) -> list[list[list[tuple]]]:
    """Parts (shell, holes; closed rings) from ``(a, b, c)``: piece a-b is followed by b-c.

    A walk that comes back to a node has closed a ring there: to the left a shell,
    to the right a hole of the walk's shell or, if it has none, of the smallest around it.
    """
    follow = {(a, b): (b, c) for a, b, c in links}
    shells: list[list] = []
    loose: list[list[tuple]] = []
    while follow:
        at = next(iter(follow))
        path, seen, rings = [], {}, []
        while at in follow:
            a, b = at
            seen[a] = len(path)
            path.append(a)
            at = follow.pop(at)
            if b in seen:
                k = seen[b]
                rings.append(path[k:])
                for node in path[k:]:
                    del seen[node]
                del path[k:]
        rings = [r for r in rings if len(r) > 2]
        own = [r for r in rings if _area(r) > 0]
        holes = [r for r in rings if _area(r) < 0]
        shells += [[r] for r in own]
        if len(own) == 1:
            shells[-1] += holes
        else:
            loose += holes
    boxes = [(min(x for x, _ in s[0]), max(x for x, _ in s[0]), _area(s[0])) for s in shells]
    for h in loose:
        m = ((h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2)
        around = [(boxes[i][2], i) for i, s in enumerate(shells) if boxes[i][0] <= m[0] <= boxes[i][1] and _within(m, s[0])]
        if around:
            shells[min(around)[1]].append(h)

    def start_lowest(ring):
        k = ring.index(min(ring))
        return ring[k:] + ring[:k + 1]
    return sorted([start_lowest(s[0]), *sorted(map(start_lowest, s[1:]))] for s in shells)


# ------------------------------------------------------------ arrays

def _upto(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, start[i] + 0 .. count[i] - 1) for each i."""
    count = np.maximum(count, 0)
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(_upto(count)[:-1] - start, count)


def _rank(f: np.ndarray, v: np.ndarray, qf: np.ndarray, q: np.ndarray, equal: bool) -> np.ndarray:
    """For each ``(qf, q)`` how many of the sorted ``(f, v)`` come before it (``equal``: or are it)."""
    kind = np.concatenate([np.full(len(f), 0 if equal else 1), np.full(len(qf), 1 if equal else 0)])
    order = np.lexsort((kind, np.concatenate([v, q]), np.concatenate([f, qf])))
    key = order < len(f)
    out = np.empty(len(qf), np.int64)
    out[order[~key] - len(f)] = np.cumsum(key)[~key]
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


@dataclass
class Edges:
    """Edges in order of feature, part, ring and place; ``ring`` and ``part`` count over all features."""
    feat: np.ndarray
    part: np.ndarray
    ring: np.ndarray
    nth: np.ndarray         # place of the ring in its part: 0 is the shell
    e: np.ndarray
    n_ring: np.ndarray
    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray
    tol: np.ndarray         # SNAP of the feature's extent

    def at(self, keep: np.ndarray) -> Edges:
        return Edges(*[getattr(self, c)[keep] for c in self.__dataclass_fields__])


@dataclass
class Rings:
    feat: np.ndarray
    part: np.ndarray
    nth: np.ndarray
    closed: np.ndarray
    size: np.ndarray        # points, the closing one too


class Batch:
    """The points of a column of parts, ring by ring."""

    def __init__(self, parts: pa.ListArray):
        n = len(parts)
        in_parts = parts.values
        in_rings = in_parts.values
        points = in_rings.values
        # a column of no lists may come without its one offset
        self.f, self.p, self.r = (c.offsets.to_numpy().astype(np.int64) if len(c) else np.zeros(1, np.int64) for c in (parts, in_parts, in_rings))
        self.x, self.y = (c.to_numpy(zero_copy_only=False) for c in points.flatten())
        self.given = parts.is_valid().to_numpy(zero_copy_only=False)
        # a part or ring that is null leaves nothing to judge
        ends = self.p[self.f]
        for column, at in ((in_parts, self.f), (in_rings, ends)):
            if column.null_count:
                nulls = _upto(column.is_null().to_numpy(zero_copy_only=False))
                self.given = self.given & (nulls[at[1:]] == nulls[at[:-1]])
        self.ends = self.r[ends]
        bad = _upto(~(np.isfinite(self.x) & np.isfinite(self.y)))
        self.fault = np.full(n, _NONE)
        self.fault[self.given & (bad[self.ends[1:]] > bad[self.ends[:-1]])] = _CODE["coordinate"]
        self.fault[self.given & (np.diff(self.f) == 0)] = _CODE["empty"]
        self.rings = self.given & (self.fault == _NONE) & (np.diff(self.ends) > 0)

    def steps(self) -> Iterator[tuple[int, int]]:
        """Features from and to, of some ``PAIRS`` pairs of points together."""
        n = len(self.fault)
        upto = _upto(np.square(np.diff(self.ends)))
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
            yield at, end
            at = end

    def taken_apart(self, lo: int, hi: int) -> tuple[Rings, Edges]:
        """Rings without points that repeat the one before, and their edges; features count from ``lo``."""
        p0, p1 = self.f[lo], self.f[hi]
        r0, r1 = self.p[p0], self.p[p1]
        part = np.repeat(np.arange(p0, p1), np.diff(self.p[p0:p1 + 1]))
        feat = np.repeat(np.arange(hi - lo), np.diff(self.f[lo:hi + 1]))[part - p0]
        nth = np.arange(r0, r1) - self.p[part]
        count = np.diff(self.r[r0:r1 + 1])
        take = self.rings[lo:hi][feat] & (count > 0)
        feat, part, nth, start, count = feat[take], part[take] - p0, nth[take], self.r[r0:r1][take], count[take]
        ring, i = _ranges(start, count)
        x, y = self.x[i], self.y[i]
        has = np.flatnonzero(np.bincount(feat, minlength=hi - lo)) if len(feat) else np.zeros(0, np.int64)
        at = np.searchsorted(feat[ring], has)
        extent = np.ones(hi - lo)
        if len(at):
            wide = np.maximum(*(np.maximum.reduceat(v, at) - np.minimum.reduceat(v, at) for v in (x, y)))
            extent[has] = np.where(wide > 0, wide, 1.0)
        fresh = _changes(ring, x, y)
        ring, x, y = ring[fresh], x[fresh], y[fresh]
        size = np.bincount(ring, minlength=len(feat))
        first = _upto(size)[:-1]
        last = first + size - 1
        closed = (size > 1) & (x[first] == x[last]) & (y[first] == y[last])
        n_ring = np.where(closed, size - 1, size)
        ring, a = _ranges(first, n_ring)
        e = a - first[ring]
        b = np.where(e + 1 < size[ring], a + 1, first[ring])
        f = feat[ring]
        edges = Edges(f, part[ring], ring, nth[ring], e, n_ring[ring], x[a], y[a], x[np.minimum(b, len(x) - 1)], y[np.minimum(b, len(y) - 1)], extent[f] * SNAP)
        return Rings(feat, part, nth, closed, n_ring + 1), edges.at((edges.ax != edges.bx) | (edges.ay != edges.by))


def box_pairs(s: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of edges of one feature whose boxes meet, the earlier one first."""
    lo, hi = np.minimum(s.ax, s.bx), np.maximum(s.ax, s.bx) + s.tol
    order = np.lexsort((lo, s.feat))
    f = s.feat[order]
    upto = _rank(f, lo[order], f, hi[order], True)
    i, j = _ranges(np.arange(len(f)) + 1, upto - np.arange(len(f)) - 1)
    i, j = order[i], order[j]
    low, high = np.minimum(s.ay, s.by), np.maximum(s.ay, s.by) + s.tol
    meet = (low[i] <= high[j]) & (low[j] <= high[i])
    i, j = i[meet], j[meet]
    return np.minimum(i, j), np.maximum(i, j)


@dataclass
class Sides:
    """Pairs of edges that cross or have an end on the other: as ``planar._with_sides``."""
    one: np.ndarray
    two: np.ndarray
    crossing: np.ndarray
    in_line: np.ndarray     # edge 1 with edge 2
    on: dict                # by end: "a1" is the start of edge 1, on edge 2


def sides(s: Edges, one: np.ndarray, two: np.ndarray, snap: bool) -> Sides:
    side, on = {}, {}
    tol = s.tol[one] if snap else 0.0
    for k, (own, other) in enumerate(((one, two), (two, one)), 1):
        ax, ay, bx, by = s.ax[other], s.ay[other], s.bx[other], s.by[other]
        dx, dy = bx - ax, by - ay
        near = tol * np.sqrt(dx * dx + dy * dy) if snap else 0.0
        x0, x1, y0, y1 = np.minimum(ax, bx) - tol, np.maximum(ax, bx) + tol, np.minimum(ay, by) - tol, np.maximum(ay, by) + tol
        for end, x, y in (("a", s.ax[own], s.ay[own]), ("b", s.bx[own], s.by[own])):
            c = dx * (y - ay) - dy * (x - ax)
            side[f"{end}{k}"] = np.where(np.abs(c) <= near, 0.0, np.sign(c))
            on[f"{end}{k}"] = (side[f"{end}{k}"] == 0) & (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
    crossing = (side["a1"] * side["b1"] < 0) & (side["a2"] * side["b2"] < 0)
    met = crossing | on["a1"] | on["b1"] | on["a2"] | on["b2"]
    return Sides(one[met], two[met], crossing[met], ((side["a1"] == 0) & (side["b1"] == 0))[met], {k: v[met] for k, v in on.items()})


def below(feat: np.ndarray, ax, ay, bx, by) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, rise): edge j of the same feature has the middle of edge i in its sheared span, ``rise`` above it; in blocks."""
    ux, vx = ax + ay * SHEAR, bx + by * SHEAR
    mx, my = (ux + vx) / 2, (ay + by) / 2
    order = np.lexsort((mx, feat))
    f, m = feat[order], mx[order]
    start = _rank(f, m, feat, np.minimum(ux, vx), False)
    count = np.maximum(_rank(f, m, feat, np.maximum(ux, vx), False) - start, 0)
    upto = _upto(count)
    at = 0
    while at < len(feat):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, "right")) - 1)
        j, i = _ranges(start[at:end], count[at:end])
        i, j = order[i], j + at
        yield i, j, my[i] - (ay[j] + (mx[i] - ux[j]) / (vx[j] - ux[j]) * (by[j] - ay[j]))
        at = end


# ------------------------------------------------------------ validity

def _tell(fault: np.ndarray, feat: np.ndarray, name: str) -> None:
    fault[feat] = np.minimum(fault[feat], _CODE[name])


def faults_of(rings: Rings, s: Edges, one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """The first fault by name of each of ``n`` features, ``_NONE`` of valid ones: the rules of ``planar.polygon_faults``."""
    fault = np.full(n, _NONE)
    _tell(fault, rings.feat[~rings.closed], "open ring")
    _tell(fault, rings.feat[rings.closed & (rings.size < 4)], "few points")
    m = sides(s, one, two, False)
    i, j = m.one, m.two
    same = s.ring[i] == s.ring[j]
    gap, n_ring = s.e[j] - s.e[i], s.n_ring[i]
    near = (gap == 1) | ((gap == n_ring - 1) & (n_ring > 2))
    forth = (s.bx[i] - s.ax[i]) * (s.bx[j] - s.ax[j]) + (s.by[i] - s.ay[i]) * (s.by[j] - s.ay[j])
    _tell(fault, s.feat[i[same & near & m.in_line & (forth < 0)]], "spike")
    _tell(fault, s.feat[i[same & ~near]], "self-intersection")
    # two edges in line share a stretch if an end of one lies on the other beyond a common end
    x = {"a1": s.ax[i], "b1": s.bx[i], "a2": s.ax[j], "b2": s.bx[j]}
    y = {"a1": s.ay[i], "b1": s.by[i], "a2": s.ay[j], "b2": s.by[j]}
    ends = list(m.on)
    several = np.zeros(len(i), bool)
    for k, p in enumerate(ends):
        for q in ends[k + 1:]:
            several |= m.on[p] & m.on[q] & ((x[p] != x[q]) | (y[p] != y[q]))
    cross = m.crossing | (m.in_line & several)
    _tell(fault, s.feat[i[~same & cross]], "rings cross")

    # how rings lie in one another matters only where there are several, and none cross
    open_ = (fault == _NONE) & (np.bincount(rings.feat, minlength=n) > 1)
    if not open_.any():
        return fault
    late = np.full(n, _NONE)
    t = s.at(open_[s.feat])
    a, b, rise = (np.concatenate(c) for c in zip(*below(t.feat, t.ax, t.ay, t.bx, t.by), strict=True))
    other = t.ring[a] != t.ring[b]
    a, b, rise = a[other], b[other], rise[other]
    # a middle on another ring says nothing; others: inside if an odd number of its edges are below
    order = np.lexsort((t.ring[b], a))
    a, ring2, part2, nth2, rise = a[order], t.ring[b][order], t.part[b][order], t.nth[b][order], rise[order]
    at = np.flatnonzero(_changes(a, ring2))
    if len(at):
        inside = (np.minimum.reduceat(np.abs(rise), at) > 0) & (np.add.reduceat((rise > 0).astype(np.int64), at) % 2 == 1)
        a, part2, nth2 = (c[at][inside] for c in (a, part2, nth2))
        at = np.flatnonzero(_changes(a, part2))
    else:
        a, part2, nth2 = a[:0], part2[:0], nth2[:0]
    if len(at) and len(a):
        in_shell, in_holes = (np.add.reduceat(c.astype(np.int64), at) for c in (nth2 == 0, nth2 > 0))
        a, part2 = a[at], part2[at]
        own, hole = t.part[a] == part2, t.nth[a] > 0
        _tell(late, t.feat[a[~own & (in_shell > 0) & (in_holes == 0)]], "parts overlap")
        _tell(late, t.feat[a[own & hole & (in_holes > 0)]], "nested holes")
        held = t.ring[a[own & hole & (in_shell > 0)]]
    else:
        held = a[:0]
    loose = open_[rings.feat] & (rings.nth > 0)
    loose[held] = False
    _tell(late, rings.feat[loose], "hole outside shell")

    touch = np.flatnonzero(~same & ~cross & (s.part[i] == s.part[j]) & open_[s.feat[i]])
    links: dict[tuple, dict] = {}
    for k in touch.tolist():
        seen = links.setdefault((int(s.feat[i[k]]), int(s.part[i[k]])), {})
        for p in ends:
            if m.on[p][k]:
                point = (float(x[p][k]), float(y[p][k]))
                seen[int(s.ring[i[k]]), point] = seen[int(s.ring[j[k]]), point] = None
    # fewer than four links close no circle
    cut = [f for (f, _), seen in links.items() if len(seen) > 3 and closes_circle(list(seen))]
    _tell(late, np.array(cut, np.int64), "interior cut")
    return np.where(open_, late, fault)


# ------------------------------------------------------------ repair

@dataclass
class Links:
    """Directed pieces with the interior on their left, and the piece that follows each."""
    feat: np.ndarray
    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray
    follow: np.ndarray


def linked(s: Edges, one: np.ndarray, two: np.ndarray) -> Links:
    """Pieces of the edges by the even-odd rule: the steps of ``planar.noded``, ``directed`` and ``linked``."""
    m = sides(s, one, two, True)
    i, j = m.one, m.two
    rx, ry, sx, sy = s.bx[i] - s.ax[i], s.by[i] - s.ay[i], s.bx[j] - s.ax[j], s.by[j] - s.ay[j]
    free = m.crossing & ~(m.on["a1"] | m.on["b1"] | m.on["a2"] | m.on["b2"]) & (rx * sy - ry * sx != 0)
    k = np.flatnonzero(free)
    t = ((s.ax[j] - s.ax[i]) * sy - (s.ay[j] - s.ay[i]) * sx)[k] / (rx * sy - ry * sx)[k]
    snap = lambda v: np.rint(v / s.tol[i[k]]) * s.tol[i[k]]
    x, y = snap(s.ax[i[k]] + t * rx[k]), snap(s.ay[i[k]] + t * ry[k])
    cut = [(i[k], x, y), (j[k], x, y)]
    for end, (own, other) in {"a1": (i, j), "b1": (i, j), "a2": (j, i), "b2": (j, i)}.items():
        k = np.flatnonzero(m.on[end])
        cut.append((other[k], (s.ax if end[0] == "a" else s.bx)[own[k]], (s.ay if end[0] == "a" else s.by)[own[k]]))
    edge, x, y = (np.concatenate(c) for c in zip(*cut, strict=True))
    dx, dy = s.bx - s.ax, s.by - s.ay
    along = (x - s.ax[edge]) * dx[edge] + (y - s.ay[edge]) * dy[edge]
    every = np.arange(len(s.feat))
    edge = np.concatenate([every, every, edge])
    t = np.concatenate([np.zeros(len(every)), dx * dx + dy * dy, along])
    # zeros of one sign: they are grouped by value
    x, y = np.concatenate([s.ax, s.bx, x]) + 0.0, np.concatenate([s.ay, s.by, y]) + 0.0
    # the points of an edge in order: each and the next bound a piece
    order = np.lexsort((y, x, t, edge))
    edge, x, y = edge[order], x[order], y[order]
    k = np.flatnonzero((edge[1:] == edge[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    turned = (x[k] > x[k + 1]) | ((x[k] == x[k + 1]) & (y[k] > y[k + 1]))
    p, q = np.where(turned, k + 1, k), np.where(turned, k, k + 1)
    feat, ax, ay, bx, by = s.feat[edge[k]], x[p], y[p], x[q], y[q]
    order = np.lexsort((by, bx, ay, ax, feat))
    feat, ax, ay, bx, by = (c[order] for c in (feat, ax, ay, bx, by))
    at = np.flatnonzero(_changes(feat, ax, ay, bx, by))
    at = at[np.diff(np.append(at, len(feat))) % 2 == 1]
    feat, ax, ay, bx, by = (c[at] for c in (feat, ax, ay, bx, by))

    under, seen = np.zeros(len(feat), np.int64), np.zeros(len(feat), bool)
    for i, j, rise in below(feat, ax, ay, bx, by):
        under += np.bincount(i[(i != j) & (rise > 0)], minlength=len(feat))
        seen[i] = True
    # an even number below: the interior is above, to the left of the way to the right
    keep = (under % 2 == 0) == (bx + by * SHEAR > ax + ay * SHEAR)
    ax, ay, bx, by = np.where(keep, ax, bx), np.where(keep, ay, by), np.where(keep, bx, ax), np.where(keep, by, ay)
    feat, ax, ay, bx, by = (c[seen] for c in (feat, ax, ay, bx, by))

    # at their node, the next in clockwise order from the way back
    n = len(feat)
    order = np.lexsort((np.concatenate([ay, by]), np.concatenate([ax, bx]), np.concatenate([feat, feat])))
    node = np.empty(2 * n, np.int64)
    node[order] = np.cumsum(_changes(np.concatenate([feat, feat])[order], np.concatenate([ax, bx])[order], np.concatenate([ay, by])[order])) - 1
    out = np.argsort(node[:n], kind="stable")
    upto = _upto(np.bincount(node[:n], minlength=node.max(initial=-1) + 1))
    into, k = _ranges(upto[node[n:]], upto[node[n:] + 1] - upto[node[n:]])
    k = out[k]
    back = np.arctan2((ay - by) + 0.0, (ax - bx) + 0.0)
    forth = np.arctan2((by - ay) + 0.0, (bx - ax) + 0.0)
    turn = back[into] - forth[k]
    turn = np.where(turn > 0, turn, turn + 6.283185307179586)
    order = np.lexsort((turn, into))
    first = order[_changes(into[order])]
    follow = np.full(n, -1)
    follow[into[first]] = k[first]
    return Links(feat, ax, ay, bx, by, follow)


class Found:
    """Rings of repaired polygons, in any order: feature, part, place in the part, points."""

    def __init__(self):
        self.rings: list[tuple] = []

    def add(self, feat, part, nth, size, x, y) -> None:
        self.rings.append(tuple(np.asarray(c) for c in (feat, part, nth, size, x, y)))

    def column(self, broken: np.ndarray) -> pa.ListArray:
        """Parts of each feature, null where it is not ``broken``."""
        if self.rings:
            feat, part, nth, size, x, y = (np.concatenate(c) for c in zip(*self.rings, strict=True))
        else:
            feat = part = nth = size = np.zeros(0, np.int64)
            x = y = np.zeros(0)
        order = np.lexsort((nth, part, feat))
        _, at = _ranges(_upto(size)[:-1][order], size[order])
        feat, part = feat[order], part[order]
        points = pa.StructArray.from_arrays([pa.array(x[at]), pa.array(y[at])], names=["x", "y"])
        lists = lambda offsets, values, **k: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, **k)
        in_rings = lists(_upto(size[order]), points)
        new = np.flatnonzero(_changes(feat, part))
        in_parts = lists(np.append(new, len(feat)), in_rings)
        return lists(_upto(np.bincount(feat[new], minlength=len(broken))), in_parts, mask=pa.array(~broken))


def rebuilt(links: Links, found: Found, lo: int) -> None:
    """What ``walk`` makes of the links of each feature. Rings that no node is twice on and that all lie to the
    left of their pieces are parts of their own; features with others are walked one by one."""
    n = len(links.feat)
    follow = links.follow
    ids = np.arange(n)
    whole = np.bincount(follow[follow >= 0], minlength=n) == 1
    # pieces of a ring have the lowest of them as label
    label, ahead = ids.copy(), np.where(follow >= 0, follow, ids)
    longest = int(np.bincount(links.feat).max(initial=0))
    for _ in range(max(1, longest).bit_length()):
        label = np.minimum(label, label[ahead])
        ahead = ahead[ahead]
    size = np.bincount(label, minlength=n)
    order = np.lexsort((links.ay, links.ax, label))
    starts = order[_changes(label[order])]
    twice = order[~_changes(label[order], links.ax[order], links.ay[order])]
    ox, oy = np.zeros(n), np.zeros(n)
    ox[label[starts]], oy[label[starts]] = links.ax[starts], links.ay[starts]
    x, y, u, v = links.ax - ox[label], links.ay - oy[label], links.bx - ox[label], links.by - oy[label]
    area = np.bincount(label, x * v - u * y, minlength=n)
    about = np.bincount(label, np.abs(x * v) + np.abs(u * y), minlength=n)
    # an area that rounding might turn is left to the walk
    odd = ~whole | (size[label] < 3) | ~(area[label] > 1e-9 * about[label])
    odd[twice] = True
    odd_feat = np.bincount(links.feat, odd, minlength=links.feat.max(initial=-1) + 1) > 0
    starts = starts[~odd_feat[links.feat[starts]]]
    if len(starts):
        nth = np.zeros(n, np.int64)
        at, step = starts, 0
        of = np.arange(len(starts))
        rows, steps, rings = [], [], []
        while len(at):
            rows.append(at)
            steps.append(np.full(len(at), step))
            rings.append(of)
            at, step = follow[at], step + 1
            more = at != starts[of]
            at, of = at[more], of[more]
        rows, steps, rings = (np.concatenate(c) for c in (rows, steps, rings))
        rows = rows[np.lexsort((steps, rings))]
        # closed: the first point comes again
        size = np.bincount(rings)
        end = _upto(size)[1:]
        rows = np.insert(rows, end, starts)
        feat = links.feat[starts]
        nth = np.lexsort((links.by[starts], links.bx[starts], links.ay[starts], links.ax[starts], feat))
        part = np.empty(len(starts), np.int64)
        part[nth] = np.arange(len(starts))
        found.add(feat + lo, part, np.zeros(len(starts), np.int64), size + 1, links.ax[rows], links.ay[rows])
    rest = np.flatnonzero(odd_feat[links.feat] & (follow >= 0)) if n else ids
    if len(rest):
        to = follow[rest]
        a, b, c = (list(zip(u.tolist(), v.tolist(), strict=True)) for u, v in (
            (links.ax[rest], links.ay[rest]), (links.bx[rest], links.by[rest]), (links.bx[to], links.by[to])))
        at = np.flatnonzero(_changes(links.feat[rest]))
        out: list[tuple] = []
        points: list[tuple] = []
        for f, i, j in zip(links.feat[rest][at].tolist(), at.tolist(), [*at[1:].tolist(), len(rest)], strict=True):
            for p, part in enumerate(walk(list(zip(a[i:j], b[i:j], c[i:j], strict=True)))):
                for r, ring in enumerate(part):
                    out.append((f + lo, p, r, len(ring)))
                    points += ring
        if out:
            found.add(*np.array(out, np.int64).T, *np.array(points, np.float64).T)


# ------------------------------------------------------------ columns

def _names(fault: np.ndarray) -> pa.Array:
    return pa.array(FAULTS, pa.string()).take(pa.array(np.minimum(fault, _NONE - 1), mask=fault == _NONE))


def faults(parts: pa.Array) -> pa.Array:
    """The fault of each polygon, by its parts."""
    batch = Batch(parts)
    with np.errstate(all="ignore"):
        for lo, hi in batch.steps():
            rings, s = batch.taken_apart(lo, hi)
            batch.fault[lo:hi] = np.minimum(batch.fault[lo:hi], faults_of(rings, s, *box_pairs(s), hi - lo))
    return _names(batch.fault)


def repaired(parts: pa.Array) -> pa.Array:
    """The fault of each polygon and the parts that it has after repair: structs ``fault, fixed``, both null for valid ones."""
    batch, found = Batch(parts), Found()
    with np.errstate(all="ignore"):
        for lo, hi in batch.steps():
            rings, s = batch.taken_apart(lo, hi)
            one, two = box_pairs(s)
            fault = faults_of(rings, s, one, two, hi - lo)
            batch.fault[lo:hi] = np.minimum(batch.fault[lo:hi], fault)
            broken = (fault < _NONE)[s.feat]
            place = np.cumsum(broken) - 1
            meet = broken[one]
            rebuilt(linked(s.at(broken), place[one[meet]], place[two[meet]]), found, lo)
    return pa.StructArray.from_arrays([_names(batch.fault), found.column(batch.fault < _NONE)], names=["fault", "fixed"])
