"""SimHash near-duplicates by bit-sliced comparison (operator 1).

1. Fingerprints: a scan of the texts, no shuffle. Bit counts are added eight
   bits at a time in the lanes of 64-bit words.
2. Documents with one fingerprint are one class (aggregated before the
   shuffle), so a large group of copies is one row from here on.
3. Two fingerprints at most ``radius`` bits apart agree in all bits of some
   ``blocks - radius`` of ``blocks`` bit ranges: each choice of ranges is a
   band, equal bands meet in a bucket. This loses no pair.
4. Buckets hold bit planes: plane b has bit b of 64 fingerprints in a word.
   Distances to all of them grow together in carry-save counters; words whose
   counters have all passed the radius are dropped from the loop. A bucket
   above ``chunk`` rows is dealt out as pairs of chunks over many tasks.
5. Buckets emit spanning links only; ``components.connected`` joins them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch, materialize, ragged, runs_of, text_blocks
from .components import connected, forest, min_labels

BITS = 64
#: Rows of a bucket that one task compares with as many others.
CHUNK = 2048
#: (fingerprint, word of 64 others) comparisons that run together.
LANES = 1 << 16
ALL = U64(0xFFFFFFFFFFFFFFFF)

#: Fixed value: white space that separates words, 0x20 and 0x09-0x0D.
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(raw: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of all k-word shingles, number of shingles of each text)."""
    low = _LOWER[raw]
    starts, ends = runs_of(_IN_WORD[low], offs)
    lens = ends - starts
    # all words of the block, one space apart: a shingle is then one slice
    flat = np.full(int(lens.sum()) + len(lens), 0x20, np.uint8)
    to = np.cumsum(lens + 1) - lens - 1
    flat[ragged(to, lens)] = low[ragged(starts, lens)]
    first = np.searchsorted(starts, offs)
    words = np.diff(first)
    count = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    lo = ragged(first[:-1], count)
    hi = lo + np.repeat(np.minimum(words, k), count) - 1
    view, h = memoryview(flat.tobytes()), xxhash.xxh64_intdigest
    got = [h(view[s:e], 42) for s, e in zip(to[lo].tolist(), (to[hi] + lens[hi]).tolist(), strict=True)]
    return np.array(got, U64), count


def fold_bits(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Fingerprint of each text from its hashes: bits set in over half of them."""
    out = np.zeros(len(count), U64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    n = count[some]
    # pieces of at most 255 hashes: a byte lane cannot overflow
    pieces = (n + 254) // 255
    start = np.cumsum(n) - n
    at = np.repeat(start, pieces) + 255 * ragged(np.zeros(len(n), np.int64), pieces)
    owner = np.cumsum(pieces) - pieces
    sums = np.empty((len(n), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> U64(k)) & U64(0x0101010101010101), at)
        sums[:, :, k] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
    bits = (2 * sums.reshape(len(n), 64) > n[:, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) of every row: null and empty texts have fingerprint 0."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            got = [fold_bits(*shingle_hashes(raw, offs, shingle)) for _, _, raw, offs in text_blocks(rb.column(1))]
            if got:
                yield batch(schema, id=rb.column(0), fp=np.concatenate(got).view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, fp long")


# --------------------------------------------------------- bit-sliced search

def planes_of(fps: np.ndarray, word: np.ndarray, lane: np.ndarray, words: int) -> np.ndarray:
    """planes[b, w]: bit b of the up to 64 fingerprints that word w holds."""
    grid = np.zeros((words, 64, 8), np.uint8)
    grid[word, lane] = fps.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(grid, axis=2, bitorder="little")  # word, lane, bit
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")[:, :, 0]


def sliced_matches(planes: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int):
    """For comparisons of fingerprint q[i] with word w[i]: (indexes with a
    match, mask of the lanes within the radius)."""
    alive = np.arange(len(q))
    width = max(1, radius.bit_length())
    spare = (1 << width) - 1 - radius  # start value: the first overflow is at radius + 1
    count = [np.full(len(q), ALL if spare >> i & 1 else U64(0)) for i in range(width)]
    over = np.zeros(len(q), U64)
    for b in range(BITS):
        x = planes[b][w] ^ (U64(0) - ((q >> U64(b)) & U64(1)))
        for c in count:  # carry-save: add one bit to 64 counters at once
            carry = c & x
            np.bitwise_xor(c, x, out=c)
            x = carry
        over |= x
        if b % 8 == 7:
            go = over != ALL
            if not go.all():
                alive, q, w, over = alive[go], q[go], w[go], over[go]
                count = [c[go] for c in count]
                if not len(alive):
                    break
    return alive, ~over


def bucket_links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row, row) among the rows of each group that are within
    the radius. ``group`` is sorted. In a group with rows of side 1, side 0 is
    compared with side 1 only (two chunks of one bucket); else all with all."""
    n = len(fps)
    edge = np.flatnonzero(np.diff(group)) + 1
    first = np.concatenate([[0], edge])
    gid = np.zeros(n, np.int64)
    gid[edge] = 1
    gid = np.cumsum(gid)
    mixed = np.zeros(len(first), bool)
    mixed[gid[side == 1]] = True
    target = np.where(mixed[gid], side == 1, True)  # rows that sit in planes
    asks = np.where(mixed[gid], side == 0, True)
    t = np.flatnonzero(target)
    per = np.bincount(gid[t], minlength=len(first))
    rank = np.arange(len(t)) - np.repeat(np.cumsum(per) - per, per)
    words = (per + 63) // 64
    base = np.cumsum(words) - words
    word, lane = base[gid[t]] + rank // 64, rank % 64
    total = int(words.sum())
    planes = planes_of(fps[t], word, lane, total)
    holder = np.full((total, 64), -1, np.int64)
    holder[word, lane] = t
    asks = np.flatnonzero(asks)
    lab_u, lab_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    need = words[gid[asks]]
    lo = 0
    ends = np.cumsum(need)
    while lo < len(asks):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LANES, side="right")))
        rows = np.repeat(asks[lo:hi], need[lo:hi])
        w = ragged(base[gid[asks[lo:hi]]], need[lo:hi])
        hit, mask = sliced_matches(planes, fps[rows], w, radius)
        if len(hit):
            bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, at = np.nonzero(bits)
            u, v = rows[hit[i]], holder[w[hit[i]], at]
            ok = (v >= 0) & (mixed[gid[u]] | (u < v))
            if ok.any():
                # spanning links of what is known so far: memory stays at the number of rows
                lab_u, lab_v = forest(np.concatenate([lab_u, u[ok]]), np.concatenate([lab_v, v[ok]]))
        lo = hi
    return lab_u, lab_v


def _link_rows(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (band, key, lo, hi, side, fp, rep), sorted by the first four: links
    (a, b) of representatives."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    kept: list[np.ndarray] = []

    def links(x: np.ndarray):
        new = np.concatenate([[0], (np.diff(x[:, :4], axis=0) != 0).any(axis=1).astype(np.int64)])
        u, v = bucket_links(x[:, 5].copy().view(U64), np.cumsum(new), x[:, 4], radius)
        return batch(schema, a=x[u, 6], b=x[v, 6])

    size = 0
    for rb in batches:
        if not rb.num_rows:
            continue
        kept.append(np.stack([c.cast(pa.int64()).to_numpy() for c in rb.columns], axis=1))
        size += rb.num_rows
        if size < 4 * CHUNK:
            continue
        x = np.concatenate(kept)
        cut = np.flatnonzero((x[:, :4] != x[-1, :4]).any(axis=1))
        if len(cut):  # the last bucket may go on in the next batch
            yield links(x[:cut[-1] + 1])
            x = x[cut[-1] + 1:]
        kept, size = [x], len(x)
    if size:
        yield links(np.concatenate(kept))


def bands(radius: int, blocks: int) -> list[int]:
    """Bit masks: each leaves out ``radius`` of ``blocks`` ranges of the 64 bits."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    part = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(part[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]


def near_links(classes: DataFrame, radius: int, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that span the groups of fingerprints within ``radius`` bits.
    ``classes``: one row (fp, rep) per distinct fingerprint."""
    masks = [m - (1 << 64) if m >> 63 else m for m in bands(radius, blocks or radius + 2)]
    rows = classes.select(
        "fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("band", "key"))
    many = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(many, ["band", "key"])
    k = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    rows = rows.withColumn("k", k).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("band", "key", F.least("c", "j").alias("lo"), F.greatest("c", "j").alias("hi"),
                       (F.col("c") > F.col("j")).cast("int").alias("side"), "fp", "rep")
    rows = rows.repartition("band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi")
    return rows.mapInArrow(lambda it: _link_rows(it, radius), "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                  radius: int = 3) -> DataFrame:
    """One row (id, fingerprint, component_id, kept) for each row of ``docs``.

    ``fingerprint``: 16 hex digits; ``component_id``: the smallest id reachable
    over links of at most ``radius`` differing bits; ``kept``: whether the row's
    id is that smallest one.

    Null or empty texts and texts without words have fingerprint zero and link
    like any other. Rows with the same id are one node of the graph: each gets
    a row, and the id joins their groups. A null id takes no part in the choice
    of the smallest; its row gets the group's component (null if the group has
    no other id) and is not kept unless that is null. Other columns of ``docs``
    are not read, so their names cannot clash. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    links = near_links(classes.where("rep is not null"), radius)
    # one id with several texts: its rows' classes belong together
    twice = fps.where("id is not null").groupBy("id").agg(
        F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    same = fps.join(twice.select("id"), "id").join(classes, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = connected(links.unionByName(same))
    label = classes.join(comp, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(label, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.col("id").isNull() & F.col("component_id").isNull()).alias("kept"))
