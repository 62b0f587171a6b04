"""Benchmark decontamination by winnowing (operator 6).

A k-gram hash is kept where it is the smallest of ``window - k + 1``
consecutive ones, in benchmark and documents alike, so any shared span of
``window`` words has a kept k-gram in common. The kept k-grams of both sides
are joined on their hash and each hit is extended word by word to both sides;
it counts where the matching stretch reaches ``window`` words.

The benchmark is a stated query set: it is read in blocks of a measured size,
each block is broadcast and meets all documents in one scan without a shuffle.
An item of fewer than ``window`` words is one window of its own; documents
are probed for such items at every position (a window of one k-gram).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch, leftmost_min, lists, materialize, mix, ragged, text_blocks, text_key, utf8, with_text, word_table

WINDOW, KGRAM = 13, 5
#: Bytes of benchmark text that are broadcast at once.
BLOCK = 16 << 20
#: (hit, posting) pairs that are extended together.
STEP = 1 << 18

#: Fixed value: word bytes are 0-9, a-z (after lower-casing A-Z) and all of 0x80-0xFF.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = True
IS_WORD[0x61:0x7B] = True
IS_WORD[0x80:] = True


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = words[:n].copy()
    for i in range(1, k):
        acc = acc * U64(0xD6E8FEB86659FD93) + words[i:i + n]
    return mix(acc)


def winnowed(hashes: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the leftmost smallest of some ``w`` consecutive valid hashes."""
    n = len(hashes)
    if n < w:
        return np.zeros(0, np.int64)
    whole = np.concatenate([[0], np.cumsum(~valid)])
    ok = whole[w:] == whole[:-w]  # windows that lie in one text
    return np.unique(leftmost_min(hashes, w)[ok])


class Index:
    """Words of a block of items and the postings of their kept k-grams."""

    def __init__(self, ids: list, texts: pa.Array, window: int, k: int):
        raw, offs = utf8(texts)
        _, _, self.words, first = word_table(raw, offs, IS_WORD)
        self.ids, self.window, self.k = ids, window, k
        n = np.diff(first)
        self.item = np.repeat(np.arange(len(n)), n)
        self.start, self.end = first[:-1], first[1:]
        self.parts = []  # (k-gram length, words in a window, sampled?, sorted hashes, positions, bitmap)
        long = n >= window
        if long.any():
            h = grams(self.words, k)
            at = np.arange(len(h))
            inside = (at + k <= self.end[self.item[at]]) & long[self.item[at]]
            # a window of k-grams must not cross into the next item
            keep = winnowed(h, inside & (self.item[at] == self.item[at + k - 1]), window - k + 1)
            self.parts.append((k, window, True, *self._sorted(h, keep)))
        for m in np.unique(n[(n > 0) & ~long]):
            kk = min(k, int(m))
            h = grams(self.words, kk)
            self.parts.append((kk, int(m), False, *self._sorted(h, self.start[n == m])))

    @staticmethod
    def _sorted(h, at):
        order = np.argsort(h[at], kind="stable")
        seen = np.zeros(1 << 18, bool)
        seen[(h[at] & U64((1 << 18) - 1)).astype(np.int64)] = True
        return h[at][order], at[order], seen


def item_hits(ix: Index, words: np.ndarray, first: np.ndarray):
    """Stretches (word from, to) of the documents' words that lie in windows
    of items, and the item of each. ``first``: first word of each document."""
    n = len(words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lo_of, hi_of = first[:-1][doc], first[1:][doc]
    out = []
    cache: dict[int, np.ndarray] = {}
    for k, need, sampled, hashes, at, seen in ix.parts:
        if n < k or not len(at):
            continue
        h = cache.get(k)
        if h is None:
            h = cache[k] = grams(words, k)
        pos = np.arange(len(h))
        inside = pos + k <= hi_of[:len(h)]
        pos = winnowed(h, inside, need - k + 1) if sampled else pos[inside]
        pos = pos[seen[(h[pos] & U64((1 << 18) - 1)).astype(np.int64)]]
        lo = np.searchsorted(hashes, h[pos], "left")
        num = np.searchsorted(hashes, h[pos], "right") - lo
        pos, lo, num = pos[num > 0], lo[num > 0], num[num > 0]
        ends = np.cumsum(num)
        i = 0
        while i < len(pos):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, side="right")))
            p, q = np.repeat(pos[i:j], num[i:j]), at[ragged(lo[i:j], num[i:j])]
            i = j
            item = ix.item[q]
            left, right = np.zeros(len(p), np.int64), np.full(len(p), k)
            for step, size, sign in ((need - k, left, -1), (need - k, right, 1)):
                go = np.arange(len(p))
                for s in range(step):
                    a, b = (p[go] - s - 1, q[go] - s - 1) if sign < 0 else (p[go] + k + s, q[go] + k + s)
                    fits = (a >= lo_of[p[go]]) & (a < hi_of[p[go]]) & (b >= ix.start[item[go]]) & (b < ix.end[item[go]])
                    go, a, b = go[fits], a[fits], b[fits]
                    go = go[words[a] == ix.words[b]]
                    size[go] += 1
                    if not len(go):
                        break
            ok = (left + right >= need) & (words[p] == ix.words[q])
            out.append(np.stack([p[ok] - left[ok], p[ok] + right[ok], item[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    s, e = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]


_RUN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SCHEMA = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("items", pa.list_(pa.string()))])


def _scan(batches: Iterator[pa.RecordBatch], ix: Index) -> Iterator[pa.RecordBatch]:
    """The columns before the text stay; n_words, runs and items are added."""
    for rb in batches:
        n_words, run_s, run_e, run_n, items, item_n = [], [], [], [], [], []
        for _, _, raw, offs in text_blocks(rb.column(rb.num_columns - 1)):
            _, _, words, first = word_table(raw, offs, IS_WORD)
            num = np.diff(first)
            hits = item_hits(ix, words, first)
            runs, found = np.zeros(len(num), np.int64), np.zeros(len(num), np.int64)
            of = np.searchsorted(first, hits[:, 0], side="right") - 1
            for d in np.unique(of):
                own = hits[of == d]
                s, e = merged(own[:, 0], own[:, 1])
                run_s.append(s - first[d])
                run_e.append(e - first[d])
                names = sorted({str(ix.ids[i]) for i in np.unique(own[:, 2]) if ix.ids[i] is not None})
                items += names
                runs[d], found[d] = len(s), len(names)
            n_words.append(num)
            run_n.append(runs)
            item_n.append(found)
        if not n_words:
            continue
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        spans = pa.StructArray.from_arrays([pa.array(cat(run_s)), pa.array(cat(run_e))], ["start", "end"])
        new = batch(_SCHEMA, n_words=cat(n_words), runs=lists(spans, cat(run_n)),
                    items=lists(pa.array(items, pa.string()), cat(item_n)))
        yield pa.RecordBatch.from_arrays([*rb.columns[:-1], *new.columns], names=[*rb.schema.names[:-1], *new.schema.names])


def _blocks(bench: DataFrame, size: int) -> list[DataFrame]:
    """The benchmark's rows in blocks of at most about ``size`` bytes of text."""
    total = bench.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    k = max(1, -(-int(total) // size))
    if k == 1:
        return [bench]
    spread = F.pmod(F.xxhash64("item", "text"), F.lit(k))
    return [bench.where(spread == i) for i in range(k)]


def mark(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with n_words, n_hit, runs and items beside their own columns
    (columns of these names are replaced); options as for ``decontaminate``."""
    new = ("n_words", "n_hit", "runs", "items")
    own = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"))
    hit = decontaminate(rows, bench, id_col="doc", text_col=f"doc.`{text_col}`", **options)
    return hit.select(*[F.col(f"doc.`{c}`").alias(c) for c in own], *new)


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = KGRAM,
                  block_bytes: int = BLOCK) -> DataFrame:
    """One row (id, n_words, n_hit, runs, items) for each row of ``docs``.

    ``runs``: maximal stretches of words (from, to) that lie in an occurrence
    of a window of ``window`` words of an item (all words of a shorter item);
    ``n_hit``: words in them; ``items``: ids of those items as sorted strings.

    Null or empty texts have no words and no hits; an item without words has no
    window. Items with one id count once, an item with a null id hits words but
    is not listed. Repeated rows of ``docs`` each get a row. An empty benchmark
    hits nothing, empty documents give no rows. Other columns are not read.
    """
    k = min(k, window)
    spark = docs.sparkSession
    bench = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    bench = bench.where("text is not null")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    tail = "n_words long, runs array<struct<start:bigint,end:bigint>>, items array<string>"
    blocks = _blocks(bench, block_bytes)

    def scan(df: DataFrame, block: DataFrame, head: str) -> DataFrame:
        got = block.toArrow()
        index = spark.sparkContext.broadcast(Index(got.column("item").to_pylist(), got.column("text"), window, k))
        return df.mapInArrow(lambda it: _scan(it, index.value), f"{head}, {tail}")

    if len(blocks) == 1 and kind.startswith("struct<") and text_col.startswith(f"{id_col}.`"):
        got = blocks[0].toArrow()
        index = spark.sparkContext.broadcast(Index(got.column("item").to_pylist(), got.column("text"), window, k))
        field = text_col[len(id_col) + 2:-1]
        out = docs.select("id").mapInArrow(lambda it: _scan(with_text(it, field), index.value), f"id {kind}, {tail}")
    elif len(blocks) == 1:
        out = scan(docs, blocks[0], f"id {kind}")
    else:
        keyed = docs.select("id", text_key("text").alias("key"), "text")
        hits = None
        for i, b in enumerate(blocks):  # one scan of all documents for each block of the query set
            part = materialize(scan(keyed, b, f"id {kind}, key binary"), f"hits{i}")
            hits = part if hits is None else hits.unionByName(part)
        hit = hits.where(F.size("runs") > 0).distinct().groupBy("id", "key").agg(
            F.array_sort(F.flatten(F.collect_list("runs"))).alias("r"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
        one = scan(keyed, bench.limit(0), f"id {kind}, key binary").drop("runs", "items")
        join = (one["id"].eqNullSafe(hit["id"])) & (one["key"] == hit["key"])
        out = one.join(hit, join, "left").select(
            one["id"], "n_words", F.coalesce("r", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("runs"),
            F.coalesce("i", F.array().cast("array<string>")).alias("items"))
        out = out.withColumn("runs", F.expr("""
            aggregate(runs, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) ->
              if(size(acc) > 0 and element_at(acc, -1).end >= x.start,
                 concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start,
                        'end', greatest(element_at(acc, -1).end, x.end)))),
                 concat(acc, array(x))))"""))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "runs", "items")


def is_contaminated(n_words="n_words", n_hit="n_hit"):
    """The rule: some word is hit, and hits are a twentieth of the words or more."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))
