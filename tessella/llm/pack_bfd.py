"""Token-id output by best-fit-decreasing packing (operator 3).

Every task packs the texts it reads, so nothing is shuffled: texts become token
ids, longer ones are split into pieces without loss, and each shard of at most
``shard_tokens`` ids is packed longest piece first into the open sequence with
the least room that still fits. A segment tree over the rooms finds it in
O(log capacity) steps. A shard leaves few underfull sequences however the
corpus is split, and a lost task packs its own texts again, to the same rows.

``packed`` gives a row per sequence; ``write_matrices`` writes id matrices with
cumulative segment lengths and position resets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks
from .tokens import encoder, split_long, with_end

CAPACITY = 4096
#: Token ids that a task packs together: its memory, and the width of choice.
SHARD_TOKENS = 2 << 20
#: Sequences in a written matrix.
MATRIX_ROWS = 512
BLOCK = 1 << 19


class RoomTree:
    """A segment tree over rooms 1..capacity: which have an open sequence."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(sequence, room) with the smallest room of at least ``least``, removed."""
        i = least + self.size
        if not self.count[i]:
            # up to the first ancestor with something to the right, then down to its left
            while i > 1 and not (i % 2 == 0 and self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.open[room].pop(), room


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each piece, and the number of sequences."""
    tree, sequences = RoomTree(capacity), 0
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        s, room = found or (sequences, capacity)
        if found is None:
            sequences += 1
        seq[i], offset[i] = s, capacity - room
        if room > n:
            tree.add(room - n, s)
    return seq, offset, sequences


_SEGMENT = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())])


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    wide = enc.vocab_size > 1 << 16
    kind = "<u4" if wide else "<u2"
    base = TaskContext.get().partitionId() << 40
    made = 0
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def shard():
        nonlocal made
        id_, ids = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
        counts = np.concatenate([h[2] for h in held])
        text, piece, start, length = split_long(counts, capacity)
        seq, offset, n = best_fit(length, capacity)
        source = (np.cumsum(counts) - counts)[text] + start
        order = np.lexsort((offset, seq))
        per = np.bincount(seq, minlength=n)
        upto = np.concatenate([[0], np.cumsum(per)])
        flat = np.concatenate([ids[source[i]:source[i] + length[i]] for i in order.tolist()]).astype(kind)
        tokens = np.bincount(seq, weights=length, minlength=n).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(tokens)])
        buf = flat.tobytes()
        width = flat.itemsize
        segments = pa.StructArray.from_arrays(
            [pa.array(piece[order].astype(np.int32)), pa.array(start[order]), pa.array(length[order].astype(np.int32))], fields=list(_SEGMENT))
        offs = pa.array(upto.astype(np.int32))
        # cumulative lengths: 0 first, so one more than segments
        cum = np.insert((offset + length)[order], upto[:-1], 0).astype(np.int32)
        cum_offs = pa.array((upto + np.arange(n + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(base + made + np.arange(n)), pa.array(tokens.astype(np.int32)),
             pa.ListArray.from_arrays(offs, id_.take(pa.array(text[order]))), pa.ListArray.from_arrays(offs, segments),
             pa.ListArray.from_arrays(cum_offs, pa.array(cum)),
             pa.array([buf[a * width:b * width] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())],
            names=["sequence_id", "n_tokens", "ids_of", "segments", "cu_seqlens", "tokens"])
        made += n

    size = 0
    for rb in batches:
        for lo, hi, raw, offs in text_blocks(rb.column(1), BLOCK):
            ids, counts = with_end(*enc.encode(raw, offs), end)
            held.append((rb.column(0).slice(lo, hi - lo), ids, counts))
            size += len(ids)
            if size >= shard_tokens:
                yield from shard()
                held, size = [], 0
    if size:
        yield from shard()


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per sequence: ``sequence_id`` (unique), ``n_tokens``, the ids of
    its documents in order (``<id>s``), ``segments`` (piece number, start in the
    document, length), ``cu_seqlens`` (0, then the end of each segment: positions
    restart at each of them) and ``tokens`` (little-endian unsigned 16-bit ids, 32-bit
    for larger vocabularies).

    A document is its token ids and then ``end_id``; one longer than
    ``capacity`` is split into full pieces and a rest. Null and empty texts are
    the end id alone; repeated rows are packed as often as they occur; ids may be null.
    An empty table gives no rows. Other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(
        lambda it: _pack(it, tokenizer, capacity, end_id, shard_tokens),
        f"sequence_id long, n_tokens int, ids_of array<{kind}>, segments array<struct<piece:int,start:long,length:int>>, "
        "cu_seqlens array<int>, tokens binary")
    return out.withColumnRenamed("ids_of", f"{id_col}s")


def _matrices(batches: Iterator[pa.RecordBatch], capacity: int, rows: int, pad: int) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for lo in range(0, rb.num_rows, rows):
            part = rb.slice(lo, rows)
            n = part.num_rows
            ids = np.full((n, capacity), pad, "<u4")
            positions = np.zeros((n, capacity), "<u4")
            cum: list[int] = [0]
            for i, (tok, size, cu) in enumerate(zip(part.column("tokens").to_pylist(), part.column("n_tokens").to_pylist(),
                                                    part.column("cu_seqlens").to_pylist(), strict=True)):
                ids[i, :size] = np.frombuffer(tok, "<u2" if len(tok) == 2 * size else "<u4")
                at = np.arange(size)
                positions[i, :size] = at - np.repeat(cu[:-1], np.diff(cu))
                base = i * capacity
                cum += [base + x for x in cu[1:]] + ([base + capacity] if size < capacity else [])
            yield pa.RecordBatch.from_arrays(
                [part.column("sequence_id").slice(0, 1), pa.array([n], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([positions.tobytes()], pa.binary()), pa.array([cum], pa.list_(pa.int32()))],
                names=["first_sequence", "rows", "ids", "positions", "cu_seqlens"])


def write_matrices(sequences: DataFrame, path: str, capacity: int = CAPACITY, rows: int = MATRIX_ROWS, pad_id: int = 0) -> None:
    """Writes ``packed`` sequences as Parquet rows of whole matrices: ``ids``
    and ``positions`` (rows x capacity, little-endian unsigned 32-bit; positions
    restart at 0 with each segment) and ``cu_seqlens`` over the flattened matrix
    (padding at a row's end is a segment of its own). Spark writes the files,
    to any store that it reaches."""
    src = sequences.select("sequence_id", "n_tokens", "cu_seqlens", "tokens")
    src.mapInArrow(lambda it: _matrices(it, capacity, rows, pad_id),
                   "first_sequence long, rows int, ids binary, positions binary, cu_seqlens array<int>").write.parquet(path)
