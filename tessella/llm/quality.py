"""Quality classifier from weak labels (operator 8).

1. Heuristic labellers vote good, bad or nothing on every document. Several
   look at each kind of junk, so their votes overlap.
2. Spark counts how often each pattern of votes occurs over all documents: at
   most 3**labellers rows, whatever the corpus. From these counts expectation-
   maximisation finds how often each labeller votes which way on good and on
   bad documents, and with that the posterior of each pattern.
3. The posteriors label a bounded sample of documents (``sample``, 8,000 by
   default, chosen by a hash) on which a linear scorer of hashed features is
   trained. It scores every document. No hand-made label is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch, lists, runs_of, span_hash, text_blocks, with_text

SAMPLE = 8_000
#: Weights of the hashed linear scorer.
DIM = 1 << 16
#: Words added to a text's number of words where features are made frequencies:
#: a text of few words says little for or against itself.
SMOOTH = 4
GOOD, BAD, NONE = 0, 1, 2

_UPPER, _LOWER, _HIGH, _SIGN, _BANG, _BAR, _STOP = (np.zeros(256, bool) for _ in range(7))
_UPPER[0x41:0x5B] = True
_LOWER[0x61:0x7B] = True
_HIGH[0x80:] = True
_SIGN[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]] = True
_BANG[[ord(c) for c in "!?"]] = True
_BAR[[ord("|"), ord("\t")]] = True
_STOP[[ord(c) for c in ".,;:"]] = True

#: Shape of a byte: capitals, small letters (all of 0x80-0xFF too), digits, and each sign as itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x30:0x3A] = ord("0")


@dataclass(frozen=True)
class Labeller:
    """Votes bad where a measure is at ``bad`` or above (below, if bad < good),
    good where it is at ``good`` or beyond, nothing between, and nothing at
    all for texts of fewer than ``words`` words."""

    name: str
    measure: str
    good: float
    bad: float
    words: int = 5


LABELLERS = (
    Labeller("shouting", "upper", 0.25, 0.50, 3),
    Labeller("signs", "signs", 0.01, 0.04),
    Labeller("sign words", "sign_words", 0.08, 0.25),
    Labeller("exclamations", "bangs", 0.05, 0.25, 3),
    Labeller("separators", "bars", 0.02, 0.15),
    Labeller("stutter", "same", 0.05, 0.25),
    Labeller("one word", "top", 0.12, 0.30, 10),
    Labeller("poor vocabulary", "repeats", 0.60, 0.85, 30),
)


class Shapes:
    """Words of a block of texts and what labellers and scorer read of them."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw, self.offs = raw, offs
        self.starts, self.ends = runs_of(raw > 0x20, offs)
        self.first = np.searchsorted(self.starts, offs)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.words = span_hash(raw, self.starts, self.ends)
        self.same = np.zeros(len(self.words), bool)
        self.same[1:] = (self.words[1:] == self.words[:-1]) & (self.doc[1:] == self.doc[:-1])

    def bytes_in(self, table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[self.raw])])
        return np.diff(total[self.offs]).astype(np.float64)

    def words_with(self, table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[self.raw])])
        has = total[self.ends] > total[self.starts]
        return np.bincount(self.doc, weights=has, minlength=len(self.n))

    def measures(self) -> dict[str, np.ndarray]:
        n = np.maximum(1, self.n)
        size = np.maximum(1, np.diff(self.offs))
        o = np.lexsort((self.words, self.doc))
        d, h = self.doc[o], self.words[o]
        new = np.ones(len(h), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(h)))
        top = np.zeros(len(self.n))
        np.maximum.at(top, d[at], times)
        upper, lower = self.bytes_in(_UPPER), self.bytes_in(_LOWER) + self.bytes_in(_HIGH) / 2
        return {
            "upper": upper / np.maximum(1, upper + lower), "signs": self.bytes_in(_SIGN) / size,
            "sign_words": self.words_with(_SIGN) / n, "bangs": self.words_with(_BANG) / n,
            "bars": self.bytes_in(_BAR) / n,
            "same": np.bincount(self.doc, weights=self.same, minlength=len(self.n)) / n, "top": top / n,
            "repeats": 1 - np.bincount(d[at], minlength=len(self.n)) / n,
        }

    def features(self) -> np.ndarray:
        """A hashed feature for each word (its shape, runs folded) and one more
        (that shape, the shape before it, and whether the words are equal)."""
        shape = _SHAPE[self.raw]
        keep = np.zeros(len(shape), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[self.starts] = True
        upto = np.concatenate([[0], np.cumsum(keep)])
        h = span_hash(shape[keep], upto[self.starts], upto[self.ends])
        before = np.zeros_like(h)
        before[1:] = h[:-1]
        start = self.first[:-1][self.n > 0]
        before[start] = U64(0)
        pair = (before * U64(0x9FB21C651E98DF25)) ^ h ^ (self.same.astype(U64) << U64(63))
        pair ^= pair >> U64(29)
        pair *= U64(0xBF58476D1CE4E5B9)
        return np.concatenate([h >> U64(48), pair >> U64(48)]).astype(np.int64) % DIM


def votes(shapes: Shapes, labellers=LABELLERS) -> np.ndarray:
    """Vote of each labeller (columns) on each text (rows)."""
    m = shapes.measures()
    out = np.full((len(shapes.n), len(labellers)), NONE, np.int64)
    for j, lab in enumerate(labellers):
        x = m[lab.measure]
        out[x <= lab.good, j] = GOOD
        out[x >= lab.bad, j] = BAD
        out[shapes.n < lab.words, j] = NONE
    return out


#: Rates of (good, bad) among the votes that are expected of a labeller on good and
#: on bad documents, before any is seen, and the share of all documents that this
#: expectation weighs. Without it, junk of one kind, on which most labellers
#: vote good, can pass for a habit of labellers on good documents.
EXPECTED = ((0.99, 0.01), (0.65, 0.35))
EXPECTED_WEIGHT = (0.5, 0.05)


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """P(good) of each vote pattern, by expectation-maximisation over the
    labellers' rates of either vote on good and on bad documents. No vote says
    nothing: it depends on a text's length, not on its quality."""
    k = patterns.shape[1]
    rate = np.array(EXPECTED)[:, None, :]
    weigh = np.array(EXPECTED_WEIGHT)[:, None, None] * counts.sum()
    p = np.repeat(rate, k, axis=1)
    prior = np.array([0.85, 0.15])
    one_hot = np.eye(3)[patterns][:, :, :2]
    for _ in range(rounds):
        log = np.log(prior)[:, None] + np.einsum("nkv,ckv->cn", one_hot, np.log(p))
        log -= log.max(axis=0)
        post = np.exp(log)
        post /= post.sum(axis=0)
        weight = post * counts
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        p = np.einsum("cn,nkv->ckv", weight, one_hot) + weigh * rate + 1e-9
        p /= p.sum(axis=2, keepdims=True)
    return post[0]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    labellers: tuple = LABELLERS


def fit(good: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, rounds: int = 300, l2: float = 1e-5) -> Model:
    """Logistic scorer of posterior labels, by full-gradient steps with a rate per weight."""
    n = max(1, len(good))
    w, b = np.zeros(DIM), 0.0
    sw, sb = np.full(DIM, 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(row, weights=w[col] * value, minlength=len(good))
        g = (0.5 * (1 + np.tanh(z / 2)) - good) / n
        gw = np.bincount(col, weights=g[row] * value, minlength=DIM) + l2 * w
        gb = g.sum()
        sw += gw * gw
        sb += gb * gb
        w -= 0.3 * gw / np.sqrt(sw)
        b -= 0.3 * gb / np.sqrt(sb)
    return Model(w, b)


def _vote_rows(batches: Iterator[pa.RecordBatch], labellers) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("pattern", pa.int64()), ("n", pa.int64())])
    power = 3 ** np.arange(len(labellers))
    total: dict[int, int] = {}
    for rb in batches:
        for _, _, raw, offs in text_blocks(rb.column(0)):
            for p, n in zip(*np.unique(votes(Shapes(raw, offs), labellers) @ power, return_counts=True), strict=True):
                total[int(p)] = total.get(int(p), 0) + int(n)
    yield batch(schema, pattern=list(total), n=list(total.values()))


def _sample_rows(batches: Iterator[pa.RecordBatch], labellers) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("pattern", pa.int64()), ("slot", pa.list_(pa.int64())), ("value", pa.list_(pa.float64()))])
    power = 3 ** np.arange(len(labellers))
    for rb in batches:
        for _, _, raw, offs in text_blocks(rb.column(0)):
            s = Shapes(raw, offs)
            key = np.concatenate([s.doc, s.doc]) * DIM + s.features()
            key, num = np.unique(key, return_counts=True)
            doc, slot = np.divmod(key, DIM)
            per = np.bincount(doc, minlength=len(s.n))
            yield batch(schema, pattern=votes(s, labellers) @ power, slot=lists(pa.array(slot), per),
                        value=lists(pa.array(num / (s.n[doc] + SMOOTH)), per))


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE,
          labellers=LABELLERS) -> Model:
    """A scorer from weak labels: see the module's description. Vote patterns
    are counted over all documents; null and empty texts get no votes."""
    src = docs.select(F.col(text_col).cast("string").alias("text"))
    rows = src.mapInArrow(lambda it: _vote_rows(it, labellers), "pattern long, n long").groupBy("pattern").agg(
        F.sum("n").alias("n")).collect()
    code = np.array(sorted(r["pattern"] for r in rows), np.int64)
    num = dict((r["pattern"], r["n"]) for r in rows)
    counts = np.array([num[c] for c in code.tolist()], np.float64)
    pattern = code[:, None] // 3 ** np.arange(len(labellers)) % 3
    good = posteriors(pattern, counts) if len(code) else np.zeros(0)
    share = min(1.0, sample / max(1.0, counts.sum()))
    pick = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) < int(share * (1 << 30))
    got = docs.where(pick).select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        lambda it: _sample_rows(it, labellers), "pattern long, slot array<long>, value array<double>").toArrow()
    seen = got.column("pattern").to_numpy()
    y = good[np.searchsorted(code, seen)]
    slots, values = got.column("slot").chunks, got.column("value").chunks
    none = [np.zeros(0)]
    per = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in slots] or none).astype(np.int64)
    col = np.concatenate([c.flatten().to_numpy() for c in slots] or none).astype(np.int64)
    val = np.concatenate([c.flatten().to_numpy() for c in values] or none)
    model = fit(y, np.repeat(np.arange(len(y)), per), col, val)
    model.labellers = labellers
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The text, the last column, becomes its score."""
    for rb in batches:
        out = []
        for _, _, raw, offs in text_blocks(rb.column(rb.num_columns - 1)):
            s = Shapes(raw, offs)
            w = model.weights[s.features()]
            per_word = w[:len(w) // 2] + w[len(w) // 2:]
            z = model.bias + np.bincount(s.doc, weights=per_word, minlength=len(s.n)) / (s.n + SMOOTH)
            out.append(np.where(s.n > 0, 0.5 * (1 + np.tanh(z / 2)), 0.0))
        if out:
            got = pa.array(np.round(np.concatenate(out), 9))
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], got], names=[*rb.schema.names[:-1], "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``score`` (0 to 1, good is high)
    and ``good`` (a half or more). Null, empty and blank texts score 0; repeated
    rows each get a row; an empty table gives none. Other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(lambda it: _score(it, held.value), f"id {src.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).alias("good"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are good, with the columns they had."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    out = src.mapInArrow(lambda it: _score(with_text(it, text_col), held.value), f"doc {src.schema['doc'].dataType.simpleString()}, score double")
    return out.where("score >= 0.5").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
