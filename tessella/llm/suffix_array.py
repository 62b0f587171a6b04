"""Removal of repeated byte strings by suffix arrays (operator 5).

A byte goes if it lies in a string of ``length`` bytes that also starts
anywhere else, in the same text or another, in the texts as they came.

1. *Anchors.* Every string of ``length`` bytes holds ``length - SEED + 1`` seeds
   of ``SEED`` bytes; the leftmost one with the smallest hash is its anchor. Equal strings have
   equal anchors at equal places, so strings need to be compared only under
   the same anchor hash. Consecutive strings with one anchor occurrence are one
   *context*: all of them together are one stretch of bytes.
2. A context that occurs twice as a whole is repeated as a whole: counted by a
   hash of its bytes, aggregated before the shuffle. Copies, however many,
   cost one row per task here and move no text.
3. *Shards.* Where an anchor has several different contexts, one example of
   each goes, as bytes, to the anchor's shard. A shard sorts its suffixes by
   Larsson-Sadakane refinement in numpy; Kasai's common prefixes of neighbours
   show which strings of ``length`` bytes occur twice.
4. *Merging.* An anchor with more than ``GROUP`` different contexts is dealt
   over several shards. Each returns the sorted digests of its distinct
   strings, and these are merged by binary search in one another.
5. Marked strings go back to their texts as runs, and the texts that lose
   something are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U64, batch, leftmost_min, materialize, mix, ragged, span_hash, text_blocks, text_key

#: A longer seed means more contexts, but fewer that meet for a short phrase alone.
LENGTH, SEED = 400, 128
#: Different contexts of one anchor that a shard takes at once.
GROUP = 512
#: Bytes of contexts that one suffix array holds, beyond one group.
SHARD_BYTES = 1 << 20
BLOCK = 1 << 18


# ------------------------------------------------------------- 1. anchors

def seed_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive bytes (k a power of two)."""
    h, done, power = raw.astype(U64) + U64(1), 1, BASE
    while done < k:
        h = h[:-done] * U64(power) + h[done:]
        power = power * power % (1 << 64)
        done *= 2
    return mix(h)


def contexts(raw: np.ndarray, offs: np.ndarray, length: int, k: int):
    """Contexts of a block of texts: (text, anchor hash, first start, end of
    starts) of their strings, by place in the block."""
    n = len(raw) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, np.zeros(0, U64), none, none
    h = seed_hashes(raw, k)
    at = leftmost_min(h, length - k + 1)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    ok = np.arange(n) + length <= offs[1:][text]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    # strings must end in their text: a text's last length - 1 starts are none
    last = np.minimum(last, offs[1:][text[first]] - length + 1)
    keep = ok[first] & (last > first)
    first, last = first[keep], last[keep]
    return text[first], h[at[first]], first, last


_FOUND = pa.schema([("key", pa.binary()), ("anchor", pa.int64()), ("ctx", pa.int64()), ("start", pa.int32()),
                    ("starts", pa.int32())])


def _find(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for lo, _, raw, offs in text_blocks(rb.column(1), BLOCK):
            text, anchor, s, e = contexts(raw, offs, length, k)
            if not len(text):
                continue
            view = memoryview(raw.tobytes())
            digest = xxhash.xxh3_64_intdigest
            ctx = [digest(view[a:b]) for a, b in zip(s.tolist(), (e + length - 1).tolist(), strict=True)]
            yield batch(_FOUND, key=rb.column(0).take(pa.array(text + lo)), anchor=anchor.view(np.int64),
                        ctx=np.array(ctx, U64).view(np.int64), start=(s - offs[text]).astype(np.int32),
                        starts=(e - s).astype(np.int32))


# -------------------------------------------------- 3. suffix arrays of shards

def suffix_ranks(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of ``codes`` (16-bit, the end lowest), sorted by the
    first ``depth`` codes at least. Larsson-Sadakane: suffixes that agree in h
    codes are ordered by the rank of what follows; only groups that are not yet
    single are sorted again, with h doubled each time."""
    n = len(codes)
    h = 4
    padded = np.concatenate([codes.astype(U64), np.zeros(h, U64)])
    key = np.zeros(n, U64)
    for i in range(h):
        key = (key << U64(16)) | padded[i:i + n]
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[sa] = start[np.cumsum(new) - 1]  # a group's rank: its first place
    rank[n] = -1
    while h < depth:
        size = np.diff(np.append(start, n))
        open_ = size > 1
        if not open_.any():
            break
        at = ragged(start[open_], size[open_])  # places of the groups to refine
        suf = sa[at]
        follow = rank[np.minimum(suf + h, n)]
        group = np.repeat(start[open_], size[open_])
        o = np.lexsort((follow, group))
        sa[at] = suf[o]
        follow, group = follow[o], group[o]
        cut = np.ones(len(at), bool)
        cut[1:] = (follow[1:] != follow[:-1]) | (group[1:] != group[:-1])
        first = at[cut]
        rank[sa[at]] = first[np.cumsum(cut) - 1]
        new = np.ones(n, bool)
        new[at] = cut
        start = np.flatnonzero(new)
        h *= 2
    return sa, rank[:n]


def common_prefixes(codes: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, up to
    ``depth``. Kasai's property (in text order the value falls by one at most) gives
    a lower bound for a whole stretch at once; numpy verifies the rest in steps."""
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lcp = np.zeros(n, np.int64)
    text = np.concatenate([codes, np.zeros(1, codes.dtype)])
    # every 64th position is compared from the start, those after it from the bound
    for stride in (64, 8, 1):
        at = np.arange(0, n, stride)
        if stride < 64:
            at = at[at % (stride * 8) != 0]
            base = at - at % (stride * 8)
            lcp[at] = np.maximum(0, lcp[base] - (at - base))
        at = at[before[at] >= 0]
        while len(at):
            a, b = at + lcp[at], before[at] + lcp[at]
            same = (lcp[at] < depth) & (a < n) & (b < n)
            same &= text[np.minimum(a, n)] == text[np.minimum(b, n)]
            at = at[same]
            lcp[at] += 1
    return lcp[sa]


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of several byte strings: whether the ``length`` bytes from each
    of its places also start at another place, in any of them."""
    size = np.array([len(p) for p in parts], np.int64)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    codes = np.zeros(len(flat) + len(parts), np.uint16)
    base = np.cumsum(size + 1) - size - 1
    codes[ragged(base, size)] = flat.astype(np.uint16) + 2
    codes[base + size] = 1  # ends a part: lower than any byte
    sa, _ = suffix_ranks(codes, length)
    lcp = common_prefixes(codes, sa, length)
    inside = np.repeat(base + size, size + 1) - np.arange(len(codes))  # bytes left in the part
    long = (lcp >= length) & (inside[sa] >= length)
    long[1:] &= inside[sa[:-1]] >= length
    # suffixes equal beyond the sorting depth stand in any order, where Kasai's
    # bound may be too high: what it calls equal is compared once more
    at = np.flatnonzero(long)
    h = span_hash(codes, np.concatenate([sa[at], sa[at - 1]]), np.concatenate([sa[at], sa[at - 1]]) + length)
    long[at] = h[:len(at)] == h[len(at):]
    hit = np.zeros(len(codes), bool)
    hit[sa[long]] = True
    hit[sa[np.flatnonzero(long) - 1]] = True
    return [hit[b:b + max(0, s - length + 1)] for b, s in zip(base.tolist(), size.tolist(), strict=True)]


def runs(mask: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PARTS = pa.list_(pa.struct([("part", pa.int32()), ("places", pa.list_(pa.int32())), ("digests", pa.list_(pa.int64()))]))
_MARKED = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("runs", _RUNS), ("shard", pa.int32()), ("parts", _PARTS)])


def _sort_shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, shard, shards, ctx, bytes), sorted by the first two: which
    strings of each context are repeated in its shard. An anchor over several
    shards also gives the sorted digests of its strings, by part (of the digest)."""

    def shard(rows: list[tuple]):
        rows = list({(r[0], r[3]): r for r in rows}.values())  # repeated rows of the table
        hit = repeated_starts([r[4] for r in rows], length)
        parts: list[list[dict]] = []
        for r, h in zip(rows, hit, strict=True):
            parts.append([])
            if r[2] > 1:
                view, d = memoryview(r[4]), xxhash.xxh3_64_intdigest
                got = np.array([d(view[i:i + length]) for i in range(len(h))], U64)
                part = (got >> U64(32)) % U64(r[2])
                o = np.lexsort((got, part))
                for at in np.split(o, np.flatnonzero(np.diff(part[o])) + 1):
                    parts[-1].append({"part": int(part[at[0]]), "places": at.astype(np.int32), "digests": got[at].view(np.int64)})
        yield batch(_MARKED, anchor=[r[0] for r in rows], ctx=[r[3] for r in rows], runs=[runs(h) for h in hit],
                    shard=[r[1] for r in rows], parts=parts)

    held: list[tuple] = []
    size = 0
    for rb in batches:
        for r in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if held and size >= SHARD_BYTES and r[:2] != held[-1][:2]:
                yield from shard(held)
                held, size = [], 0
            held.append(r)
            size += len(r[4])
    if held:
        yield from shard(held)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, part, ctx, shard, places, digests) sorted by anchor and
    part: strings that several shards hold, found in the merged order of the
    shards' digests, and by binary search the contexts that have them."""
    schema = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("runs", _RUNS)])

    def merge(rows: list[tuple]):
        by_shard: dict[int, list[np.ndarray]] = {}
        for r in rows:
            by_shard.setdefault(r[3], []).append(np.array(r[5], np.int64))
        every = np.sort(np.concatenate([np.unique(np.concatenate(x)) for x in by_shard.values()]))
        shared = np.unique(every[1:][every[1:] == every[:-1]])  # in two shards at least
        out = []
        for r in rows if len(shared) else ():
            d = np.array(r[5], np.int64)
            seen = shared[np.minimum(np.searchsorted(shared, d), len(shared) - 1)] == d
            if seen.any():
                mark = np.zeros(max(r[4]) + 1, bool)
                mark[np.array(r[4])[seen]] = True
                out.append((r[0], r[2], runs(mark)))
        if out:
            a, c, x = zip(*out, strict=True)
            yield batch(schema, anchor=list(a), ctx=list(c), runs=list(x))

    held: list[tuple] = []
    for rb in batches:
        for r in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if held and r[:2] != held[-1][:2]:
                yield from merge(held)
                held = []
            held.append(r)
    if held:
        yield from merge(held)


# ------------------------------------------------------------- texts and cuts

def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(text, wanted contexts) to a row per context with its bytes."""
    schema = pa.schema([("anchor", pa.int64()), ("shards", pa.int32()), ("ctx", pa.int64()), ("bytes", pa.binary())])
    for rb in batches:
        rows: list[tuple] = []
        for text, want in zip(rb.column(0), rb.column(1).to_pylist(), strict=True):
            raw = text.as_py().encode()
            rows += [(w["anchor"], w["shards"], w["ctx"], raw[w["start"]:w["start"] + w["starts"] + length - 1]) for w in want]
            if len(rows) > 4096:
                yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))
                rows = []
        if rows:
            yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))


def _cut(batches: Iterator[pa.RecordBatch], length: int, all_kept: bool) -> Iterator[pa.RecordBatch]:
    """(id, text, runs of repeated starts or null) to (id, counts, spans, kept bytes, digest)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for rb in batches:
        schema = pa.schema([("id", rb.schema.field(0).type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span),
                            ("kept", pa.binary()), ("kept_sha256", pa.string())])
        out: list[tuple] = []
        for text, found in zip(rb.column(1), rb.column(2), strict=True):
            raw = text.as_py().encode()
            f = found.values
            if f is None or not len(f):
                out.append((len(raw), 0, [], raw if all_kept else None, hashlib.sha256(raw).hexdigest()))
                continue
            s, e = f.field("start").to_numpy(), f.field("end").to_numpy() + length - 1
            o = np.argsort(s, kind="stable")
            s, e = s[o], np.maximum.accumulate(e[o])
            new = np.concatenate([[True], s[1:] > e[:-1]])
            s, e = s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]
            edges = np.concatenate([[0], e]), np.concatenate([s, [len(raw)]])
            kept = b"".join(raw[a:b] for a, b in zip(*(x.tolist() for x in edges), strict=True))
            spans = [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)]
            out.append((len(raw), int((e - s).sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
        if out:
            cols = dict(zip(schema.names[1:], map(list, zip(*out, strict=True)), strict=True))
            yield batch(schema, id=rb.column(0), **cols)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   seed: int = SEED, group: int = GROUP, all_kept: bool = False) -> DataFrame:
    """One row (id, n_bytes, n_removed, n_spans, spans, kept, kept_sha256) for
    each row of ``docs``: ``spans`` are the maximal removed runs of bytes,
    ``kept`` the other bytes (null where nothing is removed: the text itself, which is
    given with ``all_kept``), ``kept_sha256`` their digest.

    ``seed`` is a power of two up to ``length``. A null text is an empty one;
    texts below ``length`` bytes keep all. Repeated rows are repeats of each
    other, whatever their ids. Contexts are told apart by two 64-bit hashes, strings
    of an anchor over several shards by one and the anchor's, texts by 128 bits of their SHA-256. An empty table gives no rows. Other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", text_key("text"))
    found = materialize(src.where(F.octet_length("text") >= length).select("key", "text").mapInArrow(
        lambda it: _find(it, length, seed), "key binary, anchor long, ctx long, start int, starts int"), "contexts")
    # an anchor that occurs once has nothing to be compared with
    # (the aggregates are written down: a join with one of the same shuffle could not split a hot anchor's rows)
    many = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "many")
    found = materialize(found.join(many, "anchor"), "shared")
    # 2. whole contexts: how often, and one example of each
    kinds = materialize(found.groupBy("anchor", "ctx").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "starts")).alias("ex")), "kinds")
    # 3. an example of each context of anchors that have several
    several = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "several")
    shards = F.ceil(F.col("kinds") / F.lit(group)).cast("int")
    want = kinds.join(several, "anchor").groupBy("ex.key").agg(F.collect_list(F.struct(
        "anchor", shards.alias("shards"), "ctx", F.col("ex.start").alias("start"), F.col("ex.starts").alias("starts"))).alias("want"))
    # one of the rows that have a text gives its examples
    i = F.coalesce(F.col("id").cast("string"), F.lit(""))
    one = src.groupBy("key").agg(F.min(i).alias("i"))
    texts = src.select("key", i.alias("i"), "text").join(want.join(one, "key"), ["key", "i"])
    pieces = texts.select("text", "want").mapInArrow(
        lambda it: _slices(it, length), "anchor long, shards int, ctx long, bytes binary")
    pieces = pieces.select("anchor", F.pmod(F.xxhash64("ctx"), F.col("shards")).cast("int").alias("shard"), "shards", "ctx", "bytes")
    pieces = pieces.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    runs_type = "array<struct<start:long,end:long>>"
    marked = materialize(pieces.mapInArrow(
        lambda it: _sort_shards(it, length),
        f"anchor long, ctx long, runs {runs_type}, shard int, "
        "parts array<struct<part:int,places:array<int>,digests:array<long>>>"), "marked")
    # 4. anchors over several shards: equal digests of all of them meet
    spread = marked.select("anchor", "ctx", "shard", F.explode("parts").alias("p"))
    spread = spread.select("anchor", "p.part", "ctx", "shard", "p.places", "p.digests")
    spread = spread.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    across = spread.mapInArrow(_merge, f"anchor long, ctx long, runs {runs_type}")
    # 5. runs of starts, back to the texts
    whole = kinds.where("n > 1").select("anchor", "ctx", F.array(F.struct(
        F.lit(0).cast("long").alias("start"), F.col("ex.starts").cast("long").alias("end"))).alias("runs"))
    # one row per context, so that a join with it makes no more rows than there are contexts; one that
    # occurs twice as a whole needs no other run
    rel = marked.select("anchor", "ctx", F.explode("runs").alias("run"), F.lit(False).alias("is_whole")).unionByName(
        across.select("anchor", "ctx", F.explode("runs").alias("run"), F.lit(False).alias("is_whole"))).unionByName(
        whole.select("anchor", "ctx", F.col("runs")[0].alias("run"), F.lit(True).alias("is_whole")))
    rel = materialize(rel.groupBy("anchor", "ctx").agg(
        F.collect_set("run").alias("runs"), F.max(F.when(F.col("is_whole"), F.col("run"))).alias("all")).select(
        "anchor", "ctx", F.when(F.col("all").isNotNull(), F.array("all")).otherwise(F.col("runs")).alias("runs")), "runs")
    shifted = F.transform("runs", lambda r: F.struct((F.col("start") + r["start"]).alias("start"), (F.col("start") + r["end"]).alias("end")))
    hits = found.join(rel, ["anchor", "ctx"]).select("key", shifted.alias("runs"))
    cuts = materialize(hits.distinct().groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs")), "cuts")
    kind = src.schema["id"].dataType.simpleString()
    out = src.join(cuts, "key", "left").select("id", "text", "runs").mapInArrow(
        lambda it: _cut(it, length, all_kept), f"id {kind}, n_bytes long, n_removed long, spans {runs_type}, kept binary, kept_sha256 string")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "spans",
                      "kept", "kept_sha256")
