"""Connected components of a graph of links, as Spark joins.

Each task first contracts the links it holds to a spanning forest; then
large-star and small-star rounds (joins of the links with the smallest
neighbour of each node) run until nothing changes. No node list, component or
union-find table of all rows ever reaches the driver or one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

EDGE = "a long, b long"
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Links that a task contracts at once.
CONTRACT = 1 << 20


def min_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Label of each of ``n`` nodes: the smallest node it is linked with over
    the links (u, v), by hooking and pointer jumping."""
    lab = np.arange(n)
    while len(u):
        a, b = lab[u], lab[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
    return lab


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (smallest node, node) with the components of links (a, b)."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    lab = min_labels(len(ids), inv[:len(a)], inv[len(a):])
    other = lab != np.arange(len(ids))
    return ids[lab[other]], ids[other]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        a, b = forest(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_EDGE)

    for rb in batches:
        held.append((rb.column(0).to_numpy(), rb.column(1).to_numpy()))
        size += rb.num_rows
        if size >= CONTRACT:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that occurs in ``edges`` (a, b), of
    64-bit node ids; component is the smallest node reachable. Self links and
    repeated links change nothing; links with a null end are left out."""
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    e = materialize(e.where("a <> b").mapInArrow(_contract, EDGE).distinct(), "links")

    def mark(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = mark(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").where("a <> b")
        large = large.distinct()  # each row: smaller node, larger node
        low = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        small = large.join(low, F.col("b") == F.col("u"))
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b")
        e = materialize(small.distinct(), "links")
        was, now = now, mark(e)
        if now == was:
            break
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
