"""Best-fit packing improved by swap-based local search (operator 10).

Pieces of one length are interchangeable, so packing only needs the number
of pieces of each length: at most ``capacity`` numbers, whatever the corpus.
Spark counts them; the driver lays out *kinds* of bins (the lengths in a bin,
and how many such bins), which is bounded in the same way; Spark then deals
ranked pieces of each length to the slots of that layout.

The layout starts from best fit decreasing. Local search then works on pairs
of underfull kinds: it moves a document, exchanges one for one or two for one
(either way round), whenever that raises the sum of squared fills, for as
many bins at a time as both kinds have, until bins become empty or the lower
bound ceil(tokens / capacity) is met.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch, materialize, text_blocks
from .tokens import encoder, split_long, with_end

CAPACITY = 4096
#: Groups that the pieces of one length are ranked in; spreads a hot length.
SALT = 256
#: Steps of local search (each handles all bins of two kinds).
STEPS = 2000
BLOCK = 1 << 19

Kind = tuple[tuple[int, int], ...]  # (length, number) pairs, longest first


def best_fit_kinds(hist: dict[int, int], capacity: int) -> Counter:
    """Kinds of bins by best fit decreasing: the longest piece left opens a
    bin, the longest that fits goes in next; repeated as often as pieces last."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in hist.items():
        left[length] = n
    kinds: Counter = Counter()
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return kinds
        used: Counter = Counter()
        gap, at = capacity, top
        while gap and at:
            at = min(at, gap)
            while at and left[at] <= used[at]:
                at -= 1
            if at:
                n = min(gap // at, int(left[at]) - used[at])
                used[at] += n
                gap -= n * at
                at -= 1
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
        kinds[tuple(sorted(used.items(), reverse=True))] += times


def fill(kind: Kind) -> int:
    return sum(x * n for x, n in kind)


def _changed(kind: Kind, out: tuple[int, ...], into: tuple[int, ...]) -> Kind:
    c = Counter(dict(kind))
    c.subtract(out)
    c.update(into)
    return tuple(sorted(((x, n) for x, n in c.items() if n), reverse=True))


def _options(kind: Kind) -> list[tuple[int, tuple[int, ...]]]:
    """(sum, lengths) of one or two pieces of a bin, sums distinct, and none."""
    out: dict[int, tuple[int, ...]] = {0: ()}
    for x, _ in kind:
        out.setdefault(x, (x,))
    have = dict(kind)
    for x, y in combinations_with_replacement([x for x, _ in kind], 2):
        if x != y or have[x] > 1:
            out.setdefault(x + y, (x, y))
    return sorted(out.items())


def best_swap(a: Kind, b: Kind, capacity: int):
    """The exchange that shifts most from ``a`` to the fuller ``b``: (pieces
    of a, pieces of b), one at least of the two being a single piece or none."""
    room = capacity - fill(b)
    best, found = 0, None
    theirs = _options(b)
    sums = np.array([s for s, _ in theirs])
    for s, mine in _options(a):
        if not mine:
            continue
        # the least of theirs with s - theirs <= room
        i = int(np.searchsorted(sums, s - room))
        while i < len(theirs):
            t, other = theirs[i]
            if s - t <= best:
                break
            if not (len(mine) == 2 and len(other) == 2):
                best, found = s - t, (mine, other)
                break
            i += 1
    return found


def local_search(kinds: Counter, capacity: int, steps: int = STEPS) -> Counter:
    """Fewer bins, or fuller ones: see the module's description."""
    kinds = Counter(kinds)
    tokens = sum(fill(k) * n for k, n in kinds.items())
    bound = -(-tokens // capacity)
    tired: set[tuple[Kind, Kind]] = set()
    while steps and sum(kinds.values()) > bound:
        under = sorted((k for k in kinds if fill(k) < capacity), key=lambda k: (fill(k), k))
        done = True
        for i, a in enumerate(under):  # empty the emptiest bins first, into the fullest
            for b in reversed(under[i:]):
                n = min(kinds[a], kinds[b]) if a != b else kinds[a] // 2
                if not n or (a, b) in tired:
                    continue
                swap = best_swap(a, b, capacity)
                if swap is None or fill(b) + sum(swap[0]) - sum(swap[1]) <= fill(a):
                    tired.add((a, b))
                    continue
                for old, out, into in ((a, *swap), (b, *swap[::-1])):
                    kinds[old] -= n
                    if new := _changed(old, out, into):
                        kinds[new] += n
                kinds = +kinds
                done = False
                break
            if not done:
                break
        steps -= 1
        if done:
            break
    return kinds


def layout(kinds: Counter) -> dict[str, np.ndarray]:
    """Slots by length: pieces ranked ``rank``, rank + 1, ... of a length go
    to bins ``bin``, bin + 1, ... at ``offset``; after ``bins`` of them the
    next ``uses`` follow at the next place in the same bins."""
    rows, base, given = [], 0, Counter()
    for kind, bins in sorted(kinds.items(), reverse=True):
        offset = 0
        for length, uses in kind:
            rows.append((length, given[length], base, bins, offset))
            given[length] += bins * uses
            offset += length * uses
        base += bins
    rows.sort()
    got = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "bins", "offset"), got.T, strict=True))


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    enc, schema = encoder(path), None
    for rb in batches:
        schema = schema or pa.schema([rb.schema.field(0), *(pa.field(f, pa.int64()) for f in ("piece", "start", "length", "crc"))])
        for lo, _, raw, offs in text_blocks(rb.column(1), BLOCK):
            ids, counts = with_end(*enc.encode(raw, offs), end)
            text, piece, start, length = split_long(counts, capacity)
            buf = memoryview(ids.astype("<u4").tobytes())
            at = (np.cumsum(counts) - counts)[text] + start
            crc = [zlib.crc32(buf[4 * s:4 * (s + n)]) for s, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield batch(schema, **{rb.schema.names[0]: rb.column(0).take(pa.array(text + lo))},
                        piece=piece, start=start, length=length, crc=np.array(crc, np.int64))


def _place(batches: Iterator[pa.RecordBatch], plan: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Adds sequence_id and offset to rows with a length and a rank in it."""
    # (length, first rank) as one sortable number; ranks stay below 2**48
    keys = (plan["length"] << 48) + plan["rank"]
    for rb in batches:
        length = rb.column("length").to_numpy()
        rank = rb.column("rank").to_numpy()
        at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
        turn, bin_ = np.divmod(rank - plan["rank"][at], plan["bins"][at])
        cols = dict(zip(rb.schema.names, rb.columns, strict=True))
        cols.pop("rank")
        cols["sequence_id"] = pa.array(plan["bin"][at] + bin_, pa.int64())
        cols["offset"] = pa.array(plan["offset"][at] + turn * length, pa.int64())
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = 1, steps: int = STEPS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then ``end_id``; only one longer than
    ``capacity`` is cut, into full pieces and a rest. Null and empty texts
    are the end id alone. Repeated rows are packed as often as they occur, ids
    may be null or repeated. No row is dropped; an empty table gives none.
    Columns of ``docs`` other than the two named are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    cols = f"id {kind}, piece long, start long, length long, crc long"
    p = materialize(src.mapInArrow(lambda it: _tokenise(it, tokenizer, capacity, end_id), cols), "pieces")
    hist = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(
        layout(local_search(best_fit_kinds(hist, capacity), capacity, steps)))
    p = p.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(SALT)))
    before = p.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("id", "piece", "crc")
    p = p.join(before, ["length", "salt"]).withColumn("rank", F.row_number().over(order) - 1 + F.col("before"))
    out = p.select("id", "piece", "start", "length", "crc", "rank").mapInArrow(
        lambda it: _place(it, plan.value), cols + ", sequence_id long, offset long")
    return out.select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "length",
                      F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
