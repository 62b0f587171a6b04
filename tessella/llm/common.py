"""Helpers shared by the training-data operators.

* ``materialize`` cuts lineage with a written Parquet table in the folder
  named by ``spark.checkpoint.dir`` (never a local checkpoint).
* ``text_blocks`` hands the text column of an Arrow batch to numpy as UTF-8
  bytes, in blocks of bounded size.
* ``word_table`` finds and hashes all words of a block without a Python loop.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy step works on; a longer document is one step.
BLOCK_BYTES = 1 << 18
#: Odd multiplier of the polynomial hashes (any odd 64-bit number would do).
BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)


# ------------------------------------------------------------ written tables

def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of
    the session. Where it is unset, a private folder is made in local mode
    (tests, a laptop); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessella-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``work_dir`` and read back: lineage is
    cut, and a lost executor costs only the tasks that were running."""
    path = f"{work_dir(df.sparkSession)}/tessella-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str | Column) -> Column:
    """16 bytes of the SHA-256 of a text (null as empty): equal for equal texts."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 32))


# ------------------------------------------------------------ bytes in numpy

def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_blocks(column, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows, of about
    ``size`` bytes each; every row is in exactly one block."""
    raw, offs = utf8(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        yield lo, hi, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi
    # memory of finished batches goes back to the system: workers live long
    pa.default_memory_pool().release_unused()


_POWERS = np.ones(1, U64), np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below ``n`` (kept per process,
    up to a few blocks)."""
    global _POWERS
    if len(_POWERS[0]) < n:
        def run(b):
            x = np.full(n, b, U64)
            x[0] = 1
            return np.cumprod(x, dtype=U64)
        made = run(BASE), run(_INV)
        if n > 8 * BLOCK_BYTES:
            return made
        _POWERS = made
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a hash over all 64 bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``codes`` (uint8), a function of its bytes alone."""
    pw, inv = powers(len(codes) + 1)
    acc = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * pw[:-1], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * inv[starts] + (ends - starts).astype(U64))


def runs_of(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a text's end ends a run."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(mask))]
    first[cut] = mask[cut]
    last[cut - 1] = mask[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_table(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
    """(word starts, ends, hashes, index of each text's first word) with A-Z
    lower-cased. ``is_word``: for each byte, whether it belongs to words."""
    low = LOWER[raw]
    starts, ends = runs_of(is_word[low], offs)
    return starts, ends, span_hash(low, starts, ends), np.searchsorted(starts, offs)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values (len(x) - w + 1 of them)."""
    n, done = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x[:n]


#: Bits of the place that a hash is joined with: texts of up to 2**31 steps.
_PLACE = U64((1 << 31) - 1)


def leftmost_min(hashes: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of every ``w`` consecutive hashes, the leftmost of
    equal ones. Hashes are compared by their upper 33 bits, whatever the length
    of the array, so that equal stretches choose alike anywhere."""
    if len(hashes) > int(_PLACE):
        raise ValueError("a text of more than 2**31 steps")
    at = np.arange(len(hashes), dtype=U64)
    return (sliding_min((hashes & ~_PLACE) | at, w) & _PLACE).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indexes start, start + 1, ... of spans, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def with_text(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of one struct column, with its field ``column`` beside it: the text
    travels to Python once."""
    for rb in batches:
        yield pa.RecordBatch.from_arrays([rb.column(0), pc.struct_field(rb.column(0), [column])],
                                         names=[rb.schema.names[0], "text"])


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    """A record batch from arrays or lists, by the names in ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type)
         for f, c in ((f, cols[f.name]) for f in schema)], schema=schema)


def lists(flat: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), flat)
