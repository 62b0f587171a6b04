"""Line de-duplication by overlapping three-line windows (operator 9).

Every run of ``window`` consecutive lines of a text is a window. A window
that occurs more than once in the corpus stays at its first place (smallest
document id, then smallest line number); lines covered by any later occurrence
are removed, overlapping windows merged into runs.

Window hashes are aggregated to one row each before they are shuffled (a very
common window is then one row of each task); only repeated windows meet the
occurrences again, in a join that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, ragged, span_hash, text_blocks, text_key

WINDOW = 3
_MAX = 2**63 - 1


def line_table(raw: np.ndarray, offs: np.ndarray):
    """(line starts, ends, index of each text's first line): lines end at \\n,
    a text of n breaks has n + 1 lines, an empty one has one."""
    n = len(offs) - 1
    breaks = np.flatnonzero(raw == 0x0A)
    owner = np.searchsorted(offs, breaks, side="right") - 1
    count = np.bincount(owner, minlength=n) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[first[:-1]] = offs[:-1]
    ends[first[1:] - 1] = offs[1:]
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[inner] = breaks + 1
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    ends[inner] = breaks
    return starts, ends, first


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(id, key, text) to a row per window: its two hashes and first line."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
    table2 = np.random.default_rng(9).permutation(256).astype(np.uint8)
    for rb in batches:
        for lo, hi, raw, offs in text_blocks(rb.column(2)):
            starts, ends, first = line_table(raw, offs)
            lines = np.diff(first)
            count = np.maximum(0, lines - window + 1)
            at = ragged(first[:-1], count)
            if not len(at):
                continue
            s, e = starts[at], ends[at + window - 1]
            # a window of nothing but white space is none
            ink = np.concatenate([[0], np.cumsum(raw > 0x20)])
            keep = ink[e] > ink[s]
            h1, h2 = span_hash(raw, s, e), span_hash(table2[raw], s, e)
            row = np.repeat(np.arange(lo, hi), count)
            line = at - np.repeat(first[:-1], count)
            if keep.any():
                take = pa.array(row[keep])
                yield batch(schema, id=rb.column(0).take(take), key=rb.column(1).take(take),
                            line=line[keep].astype(np.int32), h1=h1[keep].view(np.int64), h2=h2[keep].view(np.int64))


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Adds to each row (..., text, lines) its kept text and counts."""
    for rb in batches:
        text = rb.column("text").to_pylist()
        at = rb.column("lines").to_pylist()
        kept, n, gone, runs = [], [], [], []
        for t, cover in zip(text, at, strict=True):
            lines = (t or "").split("\n")
            drop = np.zeros(len(lines), bool)
            for w in cover or ():
                drop[w:w + window] = True
            n.append(len(lines) if t else 0)
            gone.append(int(drop.sum()))
            runs.append(int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum()))
            kept.append(t if not gone[-1] else "\n".join(x for x, d in zip(lines, drop.tolist(), strict=True) if not d))
        cols = [c for c, f in zip(rb.columns, rb.schema.names, strict=True) if f not in ("text", "lines")]
        names = [f for f in rb.schema.names if f not in ("text", "lines")]
        yield pa.RecordBatch.from_arrays(
            [*cols, pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())],
            names=[*names, "text", "n_lines", "n_removed", "n_spans"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the text column cut and three columns more: ``n_lines``,
    ``n_removed`` (lines) and ``n_spans`` (maximal removed runs); columns of
    these names in ``docs`` are replaced.

    Windows compare bytes of whole lines. Windows of white space alone are left
    alone, as are texts of fewer than ``window`` lines. A null text stays null
    and an empty one empty, with 0 lines. Rows with the same id and text are
    one document here: they keep and lose the same lines, and a window counts
    as repeated only if it also occurs elsewhere; rows with one id and other texts are ordered by a
    hash of the text. A null id comes last. An empty table gives no rows.
    """
    new = ["n_lines", "n_removed", "n_spans"]
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_MAX)).alias("id"), text_key(text_col).alias("key"),
                       F.col(text_col).cast("string").alias("text"))
    occ = base.where("text is not null").mapInArrow(
        lambda it: _windows(it, window), "id long, key binary, line int, h1 long, h2 long")
    place = F.struct("id", "key", "line")
    rep = occ.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    later = occ.join(rep.select("h1", "h2", "first"), ["h1", "h2"]).where(place > F.col("first"))
    cuts = later.groupBy(F.col("id").alias("cut_id"), F.col("key").alias("cut_key")).agg(
        F.array_sort(F.collect_set("line")).alias("lines"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                        F.coalesce(F.col(id_col).cast("long"), F.lit(_MAX)).alias("id"),
                        text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    both = keyed.join(cuts, (F.col("id") == F.col("cut_id")) & (F.col("key") == F.col("cut_key")), "left")
    others = [c for c in docs.columns if c != text_col]
    both = both.select(F.struct(F.lit(0).alias("_"), *[F.col(f"doc.`{c}`") for c in others]).alias("doc"), "text", "lines")
    kind = both.schema["doc"].dataType.simpleString()
    done = both.mapInArrow(lambda it: _cut(it, window), f"doc {kind}, text string, n_lines long, n_removed long, n_spans long")
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns],
                       *new)
