"""Embedding near-duplicates by a pivot-permutation index (operator 2).

1. Equal vectors of a label are one class, aggregated before the shuffle.
2. Pivots are ``4 * sqrt(classes)`` vectors, chosen by a hash, at most
   ``MAX_PIVOTS``: the bounded sample that the index is fitted on. One that is
   nearer to another than twice the search angle is left out: pivots inside a
   dense group would order its members by chance. Every class is described by
   its ``PREFIX`` nearest pivots, in order, and stands in the inverted lists (of
   its label) of the first ``LISTS`` of them.
3. Within a list, pairs are candidates if they share ``SHARED`` pivots or more;
   a pair that meets in several lists is looked at in one of them. Candidates
   are verified by their cosine in double precision.
4. A list above ``CHUNK`` rows is dealt out as pairs of chunks. Tasks return
   sums of links per vector and spanning links, never all pairs.

The number of pivots grows with the input, so that lists stay short. At
cosine 0.93 the chance to miss a pair of 64 numbers is below 0.5 %, and smaller
for closer pairs; links found are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, materialize
from .components import connected, forest

THRESHOLD = 0.93
LISTS, PREFIX, SHARED = 6, 12, 2
MAX_PIVOTS = 4096
CHUNK = 1024
#: Rows whose similarities to all pivots are held at once.
ROWS = 2048


def _vectors(rows: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length from their bytes, as a matrix of doubles."""
    return np.frombuffer(b"".join(rows.to_pylist()), kind).reshape(len(rows), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    # the largest component is taken out first: squares neither overflow nor vanish
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _encode(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) with the vector as bytes: null unless it can link."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("v", pa.binary())])
    for rb in batches:
        out: list[bytes | None] = []
        for lab, vec in zip(rb.column(1), rb.column(2), strict=True):
            if not (lab.is_valid and vec.is_valid) or vec.values.null_count or not len(vec.values):
                out.append(None)
                continue
            x = vec.values.to_numpy(zero_copy_only=False)
            out.append(x.astype(kind).tobytes() if np.isfinite(x).all() and x.any() else None)
        yield batch(schema, id=rb.column(0), label=rb.column(1), v=pa.array(out, pa.binary()))


def _describe(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], kind: str) -> Iterator[pa.RecordBatch]:
    """Adds to (key, label, v, rep, n) the nearest pivots of each vector. One
    without pivots of its length goes to a list of its own length, -1."""
    schema = pa.schema([("key", pa.binary()), ("label", pa.string()), ("v", pa.binary()), ("rep", pa.int64()),
                        ("n", pa.int64()), ("near", pa.list_(pa.int32()))])
    for whole in batches:
        size = np.array([len(x) for x in whole.column(2).to_pylist()], np.int64)
        for s in np.unique(size):
            part = whole.take(pa.array(np.flatnonzero(size == s)))
            p = pivots.get(int(s))
            for lo in range(0, part.num_rows, ROWS):
                rb = part.slice(lo, ROWS)
                if p is None:
                    near = [[-1]] * rb.num_rows
                else:
                    sim = np.round(_unit(_vectors(rb.column(2), kind)) @ p.T, 12)
                    near = np.argsort(-sim, axis=1, kind="stable")[:, :PREFIX].astype(np.int32).tolist()
                yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(near, pa.list_(pa.int32()))], schema=schema)


def spread(x: np.ndarray, most: float) -> np.ndarray:
    """The rows of ``x``, in order, whose cosine with every row taken before is
    below ``most``."""
    taken = np.zeros((0, x.shape[1]))
    for row in x:
        if not len(taken) or (taken @ row).max() < most:
            taken = np.vstack([taken, row])
    return taken


def _incidence(near: list[list[int]], upto: int, below: int | None, slot: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(near), len(slot)), np.float32)
    for i, p in enumerate(near):
        out[i, [slot[x] for x in p[:upto] if below is None or x < below]] = 1
    return out


def list_links(x: np.ndarray, near: list[list[int]], pivot: int, side: np.ndarray, n: np.ndarray, threshold: float):
    """(links of each row counted with ``n``, spanning links) among the rows of
    a list; with rows of side 1, between side 0 and side 1 only."""
    a = np.flatnonzero(side == 0) if side.any() else np.arange(len(x))
    b = np.flatnonzero(side == 1) if side.any() else a
    links = np.zeros(len(x), np.int64)
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(a) or not len(b):
        return links, u, v
    slot = {p: i for i, p in enumerate(sorted({p for row in near for p in row}))}
    have = _incidence(near, PREFIX, None, slot)
    earlier = _incidence(near, LISTS, pivot, slot)
    for lo in range(0, len(a), 256):
        r = a[lo:lo + 256]
        shared = have[r] @ have[b].T
        ok = (shared >= min(SHARED, min(map(len, near)))) & (earlier[r] @ earlier[b].T == 0)
        ok &= x[r] @ x[b].T >= threshold
        if not side.any():
            ok &= r[:, None] != b[None, :]
        links[r] += ok @ n[b]
        if side.any():
            links[b] += n[r] @ ok
        i, j = np.nonzero(ok)
        u, v = forest(np.concatenate([u, r[i]]), np.concatenate([v, b[j]]))
    return links, u, v


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (label, size, pivot, lo, hi) to links: rows (key, links)
    and rows (a, b)."""
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    group = ["label", "size", "pivot", "lo", "hi"]

    def run(t: pa.Table):
        x = _unit(_vectors(t.column("v").combine_chunks(), kind))
        rep, key = t.column("rep").to_numpy(), t.column("key")
        links, u, v = list_links(x, t.column("near").to_pylist(), t.column("pivot")[0].as_py(),
                                 t.column("side").to_numpy(), t.column("n").to_numpy(), threshold)
        at = np.flatnonzero(links)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([key.take(pa.array(at)).combine_chunks(), pa.array(links[at]), none, none], schema=schema)
        none = pa.nulls(len(u), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(u), pa.binary()), none, pa.array(rep[u], pa.int64(), mask=None), pa.array(rep[v], pa.int64())], schema=schema)

    kept: pa.Table | None = None
    for rb in batches:
        t = pa.Table.from_batches([rb])
        t = t if kept is None else pa.concat_tables([kept, t])
        code = np.zeros(t.num_rows, bool)
        for c in group:
            col = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
            code[1:] |= col[1:] != col[:-1]
        cut = np.concatenate([[0], np.flatnonzero(code)])
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if hi - lo > 1:
                yield from run(t.slice(lo, hi - lo))
        kept = t.slice(int(cut[-1])) if t.num_rows else None
    if kept is not None and kept.num_rows > 1:
        yield from run(kept)


def embedding_dedup(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, pivots: int | None = None) -> DataFrame:
    """One row (id, n_links, component_id, kept) for each row of ``vecs``.

    ``n_links``: other rows of the same label with a cosine of ``threshold`` or
    more, each verified in double precision; ``component_id``: the smallest id
    reachable over links, the row's own included; ``kept``: id = component_id.
    ``pivots``: their number, instead of 4 * sqrt(classes).

    A null label, and a vector that is null, empty, all zero or holds null or
    non-finite numbers, links with nothing: n_links 0, its own component.
    Vectors of different lengths do not link. Repeated rows link with each
    other. Rows with one id are one node. A null id counts as a link of others
    but names no component. An empty table gives no rows. Other columns are not
    read.
    """
    kind = "<f4" if vecs.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    cast = T.ArrayType(T.FloatType() if kind == "<f4" else T.DoubleType())
    rows = vecs.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                       F.col(vec_col).cast(cast).alias("v"))
    rows = rows.mapInArrow(lambda it: _encode(it, kind), "id long, label string, v binary")
    key = F.unhex(F.substring(F.sha2(F.concat("v", F.encode(F.concat(F.lit("|"), "label"), "utf-8")), 256), 1, 32))
    rows = materialize(rows.withColumn("key", key), "vectors")
    classes = materialize(rows.where("v is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.min("id").alias("rep"),
        F.count(F.lit(1)).alias("n")), "classes")
    count = classes.count()
    size = min(MAX_PIVOTS, pivots or max(16, int(4 * count**0.5)))
    by_size: dict[int, list[bytes]] = {}
    for r in classes.select("v", F.xxhash64("key").alias("h")).orderBy("h", "v").limit(size).collect():
        by_size.setdefault(len(r["v"]), []).append(bytes(r["v"]))
    model = {s: spread(_unit(_vectors(pa.array(v), kind)), 2 * threshold**2 - 1) for s, v in by_size.items()}
    held = vecs.sparkSession.sparkContext.broadcast(model)
    desc = classes.mapInArrow(lambda it: _describe(it, held.value, kind),
                              "key binary, label string, v binary, rep long, n long, near array<int>")
    entries = desc.withColumn("size", F.octet_length("v")).withColumn("pivot", F.explode(F.slice("near", 1, LISTS)))
    entries = materialize(entries, "entries")
    many = entries.groupBy("label", "size", "pivot").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    e = entries.join(many, ["label", "size", "pivot"]).withColumn("k", F.ceil(F.col("rows") / F.lit(CHUNK)).cast("int"))
    e = e.withColumn("c", F.pmod(F.xxhash64("key"), F.col("k")).cast("int"))
    e = e.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    e = e.select("label", "size", "pivot", F.least("c", "j").alias("lo"), F.greatest("c", "j").alias("hi"),
                 (F.col("c") > F.col("j")).cast("int").alias("side"), "key", "v", "rep", "n", "near")
    group = ["label", "size", "pivot", "lo", "hi"]
    e = e.repartition(*group).sortWithinPartitions(*group)
    found = materialize(e.mapInArrow(lambda it: _compare(it, threshold, kind), "key binary, links long, a long, b long"), "found")
    links = found.where("links is not null").groupBy("key").agg(F.sum("links").alias("links"))
    twice = rows.where("id is not null and v is not null").groupBy("id").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    same = rows.where("v is not null").join(twice.select("id"), "id").join(classes.select("key", "rep"), "key").select(
        F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = connected(found.where("a is not null").select("a", "b").unionByName(same))
    info = classes.select("key", "rep", "n").join(links, "key", "left").join(comp, F.col("rep") == F.col("node"), "left")
    info = info.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                       F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "key").join(info, "key", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("component", "id").alias("component_id"))
    same_id = F.col(id_col).eqNullSafe(F.col("component_id"))
    return out.withColumn("kept", same_id)
