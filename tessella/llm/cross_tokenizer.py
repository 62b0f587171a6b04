"""Alignment of two tokenizers over whole texts (operator 13).

Tokens of both are laid over the bytes of a text, and linked where their byte
ranges overlap. The work on a block of texts is an Arrow pipeline: ids come as
list arrays, which are flattened with their parent indices; token ends are
cumulative sums of byte lengths within each text; an Acero full outer join on
(document, end) finds where both tokenizers end. In order of that key, a token
missing on one side is the one that ends next, so each row of the join is one link.
``Table.group_by`` counts links within texts and documents by pair within tasks, and
Spark merges the counts.

Tokenizing is most of the work. Both vocabularies part a text before a single
space that follows a non-space and precedes a letter, digit or sign, so the parts
between such borders are encoded on their own, a part that a worker has met
before from a table of bounded size. Offsets and joins are over whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, materialize, ragged, span_hash, text_blocks

BLOCK = 1 << 19
#: Parts, and ids of parts, that a worker remembers; then it starts again.
REMEMBER, REMEMBER_IDS = 400_000, 4_000_000
#: A token's key: number of the document in its block, then the byte where it ends.
_END_BITS = 40
#: Rows of the table of pairs that are broadcast at once; a larger table goes in parts.
PAIRS_AT_ONCE = 1_000_000
#: Groups of (pair, count) that a task holds before it sends them on.
HELD_PAIRS = 500_000

#: Bytes after a space that start a part: signs, digits and letters of ASCII, and
#: first bytes of two-byte characters, of which those from 0xC3 on are never white space.
_STARTS = np.zeros(256, bool)
_STARTS[0x21:0x7F] = True
_STARTS[0xC3:0xE0] = True


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable bytes
    of Latin-1 are themselves, the others follow from 256 on in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes, byte lengths and decimal text of each id."""

    def __init__(self, entries: list[bytes]):
        self.bytes = pa.array(entries, pa.large_binary())
        self.length = pa.array([len(e) for e in entries], pa.int64())
        self.decimal = pa.array([str(i) for i in range(len(entries))], pa.string())

    def joined(self, flat: pa.Array) -> bytes:
        """The bytes of all tokens, one after the other."""
        taken = self.bytes.take(flat)
        data = taken.buffers()[2]
        return b"" if data is None or not len(taken) else data.to_pybytes()[:pc.sum(self.length.take(flat)).as_py()]


class Pair:
    """Both tokenizers, and the parts that this worker knows; one per worker and pair of files."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # strings of special tokens are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        signs, entries = byte_alphabet(), [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            entries[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self.a_vocab = Vocabulary(entries)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_vocab = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                                   for i, p in enumerate(pieces)])
        #: Parts may be encoded apart if no piece holds a space after another sign.
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = [np.zeros(0, np.int64)] * 2
        self.size = [np.zeros(0, np.int64)] * 2
        self.flat = [np.zeros(0, np.int32)] * 2

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        at = np.searchsorted(self.known, hashes)
        ids = ([e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)],
               # the model itself puts a space before a text
               self.b.encode([p[1:] for p in parts], num_threads=1))
        for k in (0, 1):
            size = np.fromiter(map(len, ids[k]), np.int64, len(parts))
            start = np.cumsum(size) - size + len(self.flat[k])
            new = np.fromiter((i for x in ids[k] for i in x), np.int32, int(size.sum()))
            self.flat[k] = np.concatenate([self.flat[k], new])
            self.start[k], self.size[k] = np.insert(self.start[k], at, start), np.insert(self.size[k], at, size)
        self.known = np.insert(self.known, at, hashes)

    def encode(self, x: np.ndarray, offs: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of both tokenizers for texts ``x`` that each begin with a space."""
        n = len(offs) - 1
        if not len(x):
            none = lists(pa.array([], pa.int32()), np.zeros(n, np.int64))
            return none, none
        cut = np.zeros(len(x), bool)
        if self.parts:
            space = x == 0x20
            # a space of the model's own sign (its last byte: 0x81) is one, too
            cut[1:-1] = space[1:-1] & ~space[:-2] & (x[:-2] != 0x81) & _STARTS[x[2:]]
        cut[offs[:-1][offs[:-1] < offs[1:]]] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(x))
        uniq, first, inv = np.unique(span_hash(x, s, e), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER or max(map(len, self.flat)) > REMEMBER_IDS:
            self.reset()
        at = np.searchsorted(self.known, uniq)
        new = np.ones(len(uniq), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != uniq[inside]
        if new.any():
            buf = x.tobytes()
            self._learn(uniq[new], [buf[i:j].decode() for i, j in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.known, uniq)
        out = []
        for k in (0, 1):
            size = self.size[k][at][inv]
            upto = np.concatenate([[0], np.cumsum(size)])
            flat = self.flat[k][ragged(self.start[k][at][inv], size)]
            out.append(lists(pa.array(flat), np.diff(upto[np.searchsorted(s, offs)])))
        return out[0], out[1]


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


# ------------------------------------------------------------ Arrow pipeline

def counts_of(ids: pa.ListArray) -> np.ndarray:
    return np.diff(ids.offsets.to_numpy())


def ends(ids: pa.ListArray, vocab: Vocabulary) -> pa.Array:
    """Key (document, end) of each token."""
    flat, doc = pc.list_flatten(ids), pc.cast(pc.list_parent_indices(ids), pa.int64())
    upto = pc.cumulative_sum(vocab.length.take(flat))
    # a text's sums start anew: what stands before its first token is taken off
    before = pa.concat_arrays([pa.array([0], pa.int64()), upto]).take(ids.offsets.slice(0, len(ids)))
    return pc.add(pc.shift_left(doc, _END_BITS), pc.subtract(upto, before.take(doc)))


def restored(ids: pa.ListArray, vocab: Vocabulary, x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts the bytes of their tokens give back."""
    flat = pc.list_flatten(ids)
    got = vocab.joined(flat)
    want = x.tobytes()
    if got == want and len(counts_of(ids)) == 1:
        return np.ones(1, bool)
    upto = np.concatenate([[0], np.cumsum(vocab.length.take(flat).to_numpy())])[ids.offsets.to_numpy()]
    return np.array([got[p:q] == want[i:j] for p, q, i, j in
                     zip(upto[:-1].tolist(), upto[1:].tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True)], bool)


def only(ids: pa.ListArray, keep: np.ndarray) -> pa.ListArray:
    """Lists of the texts in ``keep``; the others are empty."""
    if keep.all():
        return ids
    counts = counts_of(ids)
    return lists(pc.list_flatten(ids).filter(pa.array(np.repeat(keep, counts))), counts * keep)


def group_texts(ids: pa.ListArray, closes: np.ndarray, vocab: Vocabulary) -> pa.Array:
    """The ids of each group, comma-joined. ``closes``: whether a token is its group's last."""
    last = np.flatnonzero(closes) + 1
    return pc.binary_join(lists(vocab.decimal.take(pc.list_flatten(ids)), np.diff(np.concatenate([[0], last]))), ",")


def align(a: pa.ListArray, b: pa.ListArray, a_vocab: Vocabulary, b_vocab: Vocabulary) -> dict[str, pa.Array]:
    """Groups and links of texts whose tokens cover the same bytes."""
    n = len(a)
    ta = pa.table({"at": ends(a, a_vocab), "a": pc.cast(pc.list_flatten(a), pa.int64())})
    tb = pa.table({"at": ends(b, b_vocab), "b": pc.cast(pc.list_flatten(b), pa.int64())})
    both = ta.join(tb, "at", join_type="full outer", use_threads=False).combine_chunks()
    both = both.take(pc.sort_indices(both["at"]))
    at, ia, ib = (both[c].combine_chunks() if both.num_rows else pa.array([], pa.int64()) for c in ("at", "a", "b"))
    has_a, has_b = (pc.is_valid(x).to_numpy(zero_copy_only=False) for x in (ia, ib))
    doc = pc.shift_right(at, _END_BITS).to_numpy()
    n_groups = np.bincount(doc[has_a & has_b], minlength=n)
    groups = pc.binary_join_element_wise(group_texts(a, has_b[has_a], a_vocab), group_texts(b, has_a[has_b], b_vocab), "|")
    # the token of the other side that covers an end is the next one to end
    pair = pc.add(pc.shift_left(pc.fill_null_backward(ia), 32), pc.fill_null_backward(ib))
    found = pa.table({"doc": pa.array(doc), "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    found = found.take(pc.sort_indices(found["doc"])).combine_chunks()
    per = np.bincount(found["doc"].to_numpy(), minlength=n)
    flat = [found[c].combine_chunks() if found.num_rows else pa.array([], pa.int64()) for c in ("pair", "count_all")]
    return {
        "n_a": pa.array(counts_of(a).astype(np.int64)), "n_b": pa.array(counts_of(b).astype(np.int64)),
        "n_groups": pa.array(n_groups.astype(np.int64)), "n_links": pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
        "groups": pc.binary_join(lists(groups, n_groups), ";"),
        "pairs": lists(flat[0], per), "times": lists(pc.cast(flat[1], pa.int64()), per),
    }


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]


def _aligned(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    pair = pair_of(a_path, b_path)
    for rb in batches:
        for lo, hi, raw, offs in text_blocks(rb.column(2), BLOCK):
            some = offs[:-1] < offs[1:]
            x = np.insert(raw, offs[:-1][some], 0x20)
            x_offs = offs + np.concatenate([[0], np.cumsum(some)])
            a, b = pair.encode(x, x_offs)
            keep = some & restored(a, pair.a_vocab, x, x_offs) & restored(b, pair.b_vocab, x, x_offs)
            out = align(only(a, keep), only(b, keep), pair.a_vocab, pair.b_vocab)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).slice(lo, hi - lo), rb.column(1).slice(lo, hi - lo), *[out[c] for c in _COLUMNS]],
                names=["row", "id", *_COLUMNS])


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, as a written table: ``row`` (a number of its own),
    ``id_col``, ``n_a``, ``n_b`` (tokens), ``n_groups`` (spans between bytes where tokens of
    both end), ``n_links``, ``groups`` (``a1,a2|b1;a3|b2``: ids of each span), and ``pairs``,
    ``times``: its distinct linked pairs (``a * 2**32 + b``) and their numbers of links.

    A space goes before a text. Null and empty texts, and those that either
    tokenizer's bytes don't give back, have no tokens: zeros and empty lists.
    Repeated rows are rows of their own; an empty table gives no rows; other columns are not read.
    """
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                      F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(
        lambda it: _aligned(it, a_path, b_path),
        f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")
    return materialize(out.withColumnRenamed("id", id_col), "alignments")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def summed():
        return (pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("docs", "sum")])
                .rename_columns(["pair", "docs"]))

    for rb in batches:
        t = pa.table({"pair": pc.list_flatten(rb.column(0))}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        held.append(t.rename_columns(["pair", "docs"]).cast(pa.schema([("pair", pa.int64()), ("docs", pa.int64())])))
        if sum(h.num_rows for h in held) > HELD_PAIRS:
            held = [summed()]
            if held[0].num_rows > HELD_PAIRS // 2:
                yield from held.pop().to_batches()
    if held:
        yield from summed().to_batches()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, docs, best``: how many documents link the pair, and whether no
    other pair of the same A id has more; as a written table."""
    counts = materialize(aligned.select("pairs").mapInArrow(_count, "pair long, docs long")
                         .groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    a = F.shiftright("pair", 32).alias("a")
    top = counts.groupBy(a).agg(F.max("docs").alias("top"))
    return materialize(counts.withColumn("a", F.shiftright("pair", 32)).join(top, "a")
                       .select("pair", "docs", (F.col("docs") == F.col("top")).alias("best")), "best")


def link_totals(aligned: DataFrame, counts: DataFrame, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """``row, n_best, count_sum`` of rows with links. The table of pairs is broadcast in
    parts of ``at_once`` rows or so, a scan of the links each; the links themselves are
    not shuffled, only a sum per document."""
    parts = max(1, -(-counts.count() // at_once))
    sums = None
    for p in range(parts):
        part = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(parts)) == p) if parts > 1 else counts
        links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
            "row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
        one = links.join(F.broadcast(part), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        sums = one if sums is None else sums.unionByName(one)
    return sums if parts == 1 else sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
