"""Hard negatives by Kronecker-packed integer products (operator 12).

Vectors become integers (``floor(256 * x)``). Biased to be non-negative, the
same component of several candidates goes into separated fields of one 64-bit
integer. One multiplication by an anchor's component then multiplies them all,
the products of all components are summed in the word, and the fields, wide
enough that none runs over, hold the exact scores. Components too large for two
fields in 64 bits take fields of a wide Python integer instead, to the same scores.

Anchors, a stated query set, are taken in blocks of bounded size. For a block
Spark reads all rows twice: once for the best rows of the anchor's own label,
once for the rows of other labels whose score lies in a window below each
positive. A task keeps a bounded list per anchor and sends on only that; a window
per anchor merges the tasks' lists.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import work_dir

#: Fixed values of the contract: scale of a component, and the window of a negative's score in hundredths of the positive's.
SCALE = 256
LOW, HIGH = 50, 95
#: Anchors of one block hold at most so many components.
BLOCK_COMPONENTS = 1 << 21
#: Scores that a task holds at once.
HELD_SCORES = 1 << 20
WORD = 64
_INT64 = 1 << 63


# ------------------------------------------------------------ exact scores

def quantize(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64, or as Python integers where 64 bits are too few."""
    x = np.floor(np.asarray(flat, np.float64) * SCALE)
    if not len(x) or np.abs(x).max() < 2.0**62:
        return x.astype(np.int64)
    # SCALE * x can leave the doubles: exact, by integers
    return np.array([int(v) if np.isfinite(v) else int(f) * SCALE for v, f in zip(x.tolist(), np.asarray(flat, np.float64).tolist(), strict=True)], object)


def field_bits(dim: int, anchor_top: int, cand_top: int) -> int:
    """Bits that hold the sum of ``dim`` products of components up to these tops."""
    return max(1, (max(1, dim) * anchor_top * cand_top).bit_length())


def packed_scores(anchors: np.ndarray, cands: np.ndarray) -> np.ndarray:
    """Inner products of each row of ``anchors`` with each of ``cands`` (integers): exact."""
    (n_a, dim), n_c = anchors.shape, len(cands)
    if not (n_a and n_c and dim):
        return np.zeros((n_a, n_c), np.int64)
    a_low, c_low = int(anchors.min()), int(cands.min())
    width = field_bits(dim, int(anchors.max()) - a_low, int(cands.max()) - c_low)
    a = anchors - a_low
    c = cands - c_low
    if width * 2 <= WORD and anchors.dtype != object and cands.dtype != object:
        per = WORD // width
        words = -(-n_c // per)
        c = np.concatenate([c, np.zeros((words * per - n_c, dim), np.int64)]).astype(np.uint64)
        shift = (np.arange(per) * width).astype(np.uint64)
        # the same component of ``per`` candidates in one word
        packed = np.zeros((words, dim), np.uint64)
        for f in range(per):
            packed |= c[f * words:(f + 1) * words] << shift[f]
        total = np.zeros((n_a, words), np.uint64)
        held = np.empty_like(total)
        for d in range(dim):
            np.multiply(a[:, d, None].astype(np.uint64), packed[:, d], out=held)
            total += held
        mask = np.uint64((1 << width) - 1)
        out = np.concatenate([((total >> s) & mask).astype(np.int64) for s in shift], axis=1)[:, :n_c]
    else:
        # one wide Python integer for all candidates
        rows = [sum(int(v) << (width * j) for j, v in enumerate(c[:, d].tolist())) for d in range(dim)]
        mask = (1 << width) - 1
        out = np.empty((n_a, n_c), object)
        for i in range(n_a):
            word = sum(int(x) * w for x, w in zip(a[i].tolist(), rows, strict=True))
            out[i] = [(word >> (width * j)) & mask for j in range(n_c)]
    # biased: sum (x - la)(y - lc) = sum xy - lc sum x - la sum y + dim la lc
    if out.dtype != object and dim * max(abs(a_low), abs(c_low), 1) * max(int(anchors.max()), int(cands.max()), -a_low, -c_low, 1) < 1 << 61:
        return out + c_low * anchors.sum(1)[:, None] + a_low * cands.sum(1)[None, :] - dim * a_low * c_low
    wide_a, wide_c = anchors.astype(object).sum(1), cands.astype(object).sum(1)
    return out.astype(object) + c_low * wide_a[:, None] + a_low * wide_c[None, :] - dim * a_low * c_low


#: Components from which a row is scored apart, so that it does not widen the fields of the others.
LARGE = 1 << 12


def scores(anchors: np.ndarray, cands: np.ndarray) -> np.ndarray:
    """As ``packed_scores``; rows with large components are packed apart."""
    big_a, big_c = (np.abs(x).max(axis=1, initial=0) >= LARGE if x.size else np.zeros(len(x), bool) for x in (anchors, cands))
    big_a, big_c = big_a.astype(bool), big_c.astype(bool)
    if not big_a.any() and not big_c.any():
        return packed_scores(anchors, cands)
    out = np.zeros((len(anchors), len(cands)), object)
    for i in (np.flatnonzero(big_a), np.flatnonzero(~big_a)):
        for j in (np.flatnonzero(big_c), np.flatnonzero(~big_c)):
            if len(i) and len(j):
                out[np.ix_(i, j)] = packed_scores(_narrow(anchors[i]), _narrow(cands[j]))
    return _narrow(out)


def _narrow(x: np.ndarray) -> np.ndarray:
    if x.dtype == object and (not x.size or max(abs(int(x.max())), abs(int(x.min()))) < 1 << 55):
        return x.astype(np.int64)
    return x


# ------------------------------------------------------------ lists per anchor

@dataclass
class Block:
    """Anchors of one vector length: ids, labels and components; ``slot``: number in the block."""
    slot: np.ndarray
    id: np.ndarray
    label: np.ndarray
    q: np.ndarray
    #: Bounds of the wanted scores for each list of an anchor; None: positives are wanted.
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def vectors(column) -> tuple[np.ndarray, np.ndarray]:
    """(length of each vector, flat components)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_value_length(column).to_numpy(zero_copy_only=False), pc.list_flatten(column).to_numpy(zero_copy_only=False)


def best(lists: np.ndarray, ids: np.ndarray, points: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best entries of each list: higher points, then smaller ids."""
    if points.dtype == object:
        order = np.array(sorted(range(len(lists)), key=lambda i: (lists[i], -points[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -points, lists))
    if not len(order):
        return order
    s = lists[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return order[rank < top]


class Lists:
    """The best ``top`` rows found so far, for ``per`` lists of each anchor."""

    def __init__(self, n_anchors: int, per: int, top: int):
        self.per, self.top = per, top
        self.list, self.id, self.points = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Points of a full list's last entry: less cannot enter it.
        self.least = np.full((n_anchors, per), -(_INT64 - 1), np.int64)

    def add(self, lists: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        if not len(lists):
            return
        lists, ids = np.concatenate([self.list, lists]), np.concatenate([self.id, ids])
        points = np.concatenate([self.points, points])
        at = best(lists, ids, points, self.top)
        self.list, self.id, self.points = lists[at], ids[at], _narrow(points[at])
        full = np.flatnonzero(np.bincount(self.list, minlength=self.least.size) == self.top)
        if len(full) and self.points.dtype != object:
            # entries stand list by list, best first
            last = np.searchsorted(self.list, full, side="right") - 1
            self.least.flat[full] = self.points[last]

    def offer(self, block: Block, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        step = max(1, HELD_SCORES // max(1, len(block.id)))
        for lo in range(0, len(ids), step):
            part_ids, part_labels = ids[lo:lo + step], labels[lo:lo + step]
            s = scores(block.q, q[lo:lo + step])
            same = block.label[:, None] == part_labels[None, :]
            if block.low is None:
                fits = same & (block.id[:, None] != part_ids[None, :])
                self._take(block, 0, s, fits, part_ids)
            else:
                for k in range(self.per):
                    inside = (s >= block.low[:, k, None]) & (s <= block.high[:, k, None])
                    self._take(block, k, s, inside & ~same, part_ids)

    def _take(self, block: Block, k: int, s: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        fits &= s >= self.least[block.slot, k][:, None]
        a, c = np.nonzero(fits)
        self.add(block.slot[a] * self.per + k, ids[c], s[a, c])


def _scan(batches: Iterator[pa.RecordBatch], blocks, n_anchors: int, per: int, top: int) -> Iterator[pa.RecordBatch]:
    held = Lists(n_anchors, per, top)
    for rb in batches:
        ids, labels = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        size, flat = vectors(rb.column(2))
        start = np.cumsum(size) - size
        for block in blocks.value:
            dim = block.q.shape[1]
            at = np.flatnonzero(size == dim)
            q = quantize(flat[(start[at, None] + np.arange(dim)).ravel()]).reshape(len(at), dim)
            held.offer(block, ids[at], labels[at], q)
    yield pa.RecordBatch.from_arrays(
        [pa.array((held.list // per).astype(np.int32)), pa.array((held.list % per).astype(np.int32)), pa.array(held.id),
         pa.array([str(x) for x in held.points.tolist()])], names=["anchor", "slot", "id", "points"])


#: Scores travel as text only between tasks: a decimal holds any of them.
_SCAN = "anchor int, slot int, id long, points string"
_POINTS = "decimal(38,0)"


def _merged(rows: DataFrame, blocks: list[Block], n_anchors: int, per: int, top: int) -> DataFrame:
    """(anchor, slot, id, points, rank) of the best ``top`` rows of each list."""
    shared = rows.sparkSession.sparkContext.broadcast(blocks)
    found = rows.mapInArrow(lambda it: _scan(it, shared, n_anchors, per, top), _SCAN)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("points"), "id")
    return (found.withColumn("points", F.col("points").cast(_POINTS)).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= top))


def _blocks(pdf) -> list[Block]:
    """Anchors as blocks of equal vector length."""
    size = np.array([len(v) for v in pdf["v"]], np.int64)
    out = []
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        flat = np.concatenate([np.asarray(pdf["v"][i], np.float64) for i in at]) if dim else np.zeros(0)
        out.append(Block(at, pdf["id"].to_numpy(np.int64)[at], pdf["label"].to_numpy(np.int64)[at], quantize(flat).reshape(len(at), dim)))
    return out


def hard_negatives(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 50,
                   positives: int = 5, negatives: int = 3, low: int = LOW, high: int = HIGH,
                   block_components: int = BLOCK_COMPONENTS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row whose id is divisible by
    ``every`` and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``. Ties go to the smaller id.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths have
    no score. A repeated row counts as often as it occurs, as a positive or negative too, but one anchor; rows with the
    anchor's own id are not its positives. Without rows, or without anchors, the result is empty. Other columns are not read. Scores
    are exact at any size; one beyond 64 bits is returned as the nearest 64-bit number.
    """
    spark = vecs.sparkSession
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vecs.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                       F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)
    anchors = rows.filter(F.col("id") % every == 0).distinct()
    total = anchors.agg(F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()[0]
    n_blocks = -(-total // block_components)
    path = f"{work_dir(spark)}/tessella-{uuid.uuid4().hex}/negatives"
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for b in range(n_blocks):
        # a bounded part of the query set, by a hash of the whole row
        part = anchors.filter(F.pmod(F.xxhash64("id", "label", "v"), F.lit(n_blocks)) == b).toPandas()
        blocks, n = _blocks(part), len(part)
        if not n:
            continue
        pos = _merged(rows, blocks, n, 1, positives).select("anchor", "rank", "id", "points").toPandas()
        bound = np.zeros((n, positives), object), np.full((n, positives), -1, object)
        for a, k, p in zip(pos["anchor"], pos["rank"], pos["points"], strict=True):
            bound[0][a, k - 1], bound[1][a, k - 1] = -(-low * int(p) // 100), high * int(p) // 100
        windows = [replace(x, low=_narrow(bound[0][x.slot]), high=_narrow(bound[1][x.slot])) for x in blocks]
        neg = _merged(rows, windows, n, positives, negatives)
        wanted = spark.createDataFrame(
            [(int(a), int(k) - 1, int(part["id"][a]), int(i), p) for a, k, i, p in
             zip(pos["anchor"], pos["rank"], pos["id"], pos["points"], strict=True)],
            f"anchor int, slot int, anchor_id long, positive_id long, positive {_POINTS}")
        limit = F.lit(_INT64 - 1).cast(_POINTS)
        as_long = lambda c: F.greatest(F.least(F.col(c), limit), -limit).cast("long")
        # one block's positives: bounded as the block is
        out = neg.join(F.broadcast(wanted), ["anchor", "slot"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            as_long("positive").alias("positive_score"), as_long("points").alias("negative_score"))
        out.write.mode("append").option("compression", "zstd").parquet(path)
    if not n_blocks:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
