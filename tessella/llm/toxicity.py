"""Toxicity by cumulative-link ordinal regression (operator 7).

P(severity <= k) = logistic(theta_k - w.x) with ordered thresholds theta_k
that all share the weights w of sparse word features. A document's score is
its expected severity, the sum over k of P(severity > k).

The labels are 0 or 1, so severity grades for training are derived: grade 0 is
not toxic; a toxic document has grade 1, 2 or 3 by the number of words that are
over e**2 times as frequent in toxic documents as in others (below
``GRADE_AT[0]``, below ``GRADE_AT[1]``, or more).

The model is fitted on a bounded sample of labelled rows (``sample``, 10,000 by
default, chosen by a hash of the id); every document is scored, whole, in one
scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, batch, lists, mix, span_hash, text_blocks, word_table

SAMPLE = 10_000
#: Training documents that a word must occur in to be a feature, however small a share they are.
MIN_DOCS = 8
#: Least log ratio of a feature's frequencies in toxic and in other documents;
#: longer documents hold more of every word, which alone must not make them toxic.
MIN_ODDS = 1.5
#: Bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 6, 8)
GRADE_AT = (3, 6)
GRADES = 4
#: Fixed value: words are runs of 0-9, a-z (after lower-casing) and bytes from 0x80.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = True
IS_WORD[0x61:0x7B] = True
IS_WORD[0x80:] = True


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Model:
    features: np.ndarray  # sorted word hashes
    weights: np.ndarray
    theta: np.ndarray  # ascending thresholds

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(severity > k) of each score, a column per threshold."""
        return sigmoid(score[:, None] - self.theta[None, :])


def word_features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word and of the longer words' beginnings, which
    inflected and compound words share."""
    starts, ends, h, first = word_table(raw, offs, IS_WORD)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    docs, hashes, low = [doc], [h], LOWER[raw]
    for i, size in enumerate(PREFIXES):
        at = np.flatnonzero(ends - starts > size)
        docs.append(doc[at])
        hashes.append(span_hash(low, starts[at], starts[at] + size) + U64(i + 1))
    return np.concatenate(docs), np.concatenate(hashes)


def word_counts(raw: np.ndarray, offs: np.ndarray):
    """(text, feature, count) of the distinct features of each text."""
    doc, h = word_features(raw, offs)
    o = np.lexsort((h, doc))
    d, h = doc[o], h[o]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("toxic", pa.int32()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
    for rb in batches:
        for lo, hi, raw, offs in text_blocks(rb.column(1)):
            d, h, n = word_counts(raw, offs)
            per = np.bincount(d, minlength=hi - lo)
            yield batch(schema, toxic=rb.column(0).slice(lo, hi - lo), words=lists(pa.array(h.view(np.int64)), per),
                        counts=lists(pa.array(n.astype(np.int32)), per))


def fit(toxic: np.ndarray, row: np.ndarray, word: np.ndarray, count: np.ndarray, rounds: int = 2000,
        l1: float = 3e-5) -> Model:
    """Weights and thresholds from sparse counts (row, word, count), by
    proximal gradient steps with an L1 penalty: most words end with weight 0."""
    # documents with the same words, copies mostly, are one training row
    sign = np.zeros(len(toxic), np.uint64)
    np.add.at(sign, row, mix(word) * count.astype(np.uint64))
    _, once = np.unique(np.stack([sign, toxic.astype(np.uint64)]), axis=1, return_index=True)
    one = np.zeros(len(toxic), bool)
    one[once] = True
    new = np.cumsum(one) - 1
    toxic, word, count, row = toxic[one], word[one[row]], count[one[row]], new[row[one[row]]]
    n = max(1, len(toxic))
    uniq, inv, df = np.unique(word, return_inverse=True, return_counts=True)
    bad = np.bincount(inv, weights=toxic[row], minlength=len(uniq))
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((df - bad + 0.5) / (n - toxic.sum() + 1))
    good = (df >= MIN_DOCS) & (np.abs(odds) >= MIN_ODDS)
    keep = good[inv]
    slot = np.cumsum(good) - 1
    features, row, col, count = uniq[good], row[keep], slot[inv[keep]], count[keep]
    m = len(features)
    strong = (odds[good] > 2) & (bad[good] >= MIN_DOCS)
    hits = np.bincount(row, weights=count * strong[col], minlength=len(toxic))
    grade = np.where(toxic > 0, 1 + np.searchsorted(GRADE_AT, hits, side="right"), 0)
    x = np.sqrt(count.astype(np.float64))
    w = np.zeros(m)
    share = np.array([(grade > k).sum() / n for k in range(GRADES - 1)]).clip(1 / (n + 2), 1 - 1 / (n + 2))
    theta = np.log((1 - share) / share)
    step_w, step_t = np.full(m, 1e-8), np.full(GRADES - 1, 1e-8)
    for _ in range(rounds if m else 0):
        score = np.bincount(row, weights=w[col] * x, minlength=len(toxic))
        lo = np.concatenate([[-np.inf], theta])[grade]
        hi = np.concatenate([theta, [np.inf]])[grade]
        a, b = sigmoid(lo - score), sigmoid(hi - score)
        p = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        g_score = (db - da) / p  # d(-log p) / d score
        g_theta = np.array([(da * (grade == k + 1) / p).sum() - (db * (grade == k) / p).sum() for k in range(GRADES - 1)]) / n
        g = np.bincount(col, weights=g_score[row] * x, minlength=m) / n
        step_w += g * g
        step_t += g_theta * g_theta
        rate = 0.2 / np.sqrt(step_w)
        w -= rate * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1)
        theta = np.sort(theta - 0.2 * g_theta / np.sqrt(step_t))
    used = w != 0
    return Model(features[used], w[used], theta)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most about ``sample`` labelled documents. A document
    labelled more than once counts as toxic if any label says so; labels
    without a value, and those without a document, are not used."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(
        "id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    total = lab.count()
    share = min(1.0, sample / max(1, total))
    lab = lab.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    lab = F.broadcast(lab)  # about ``sample`` rows of two numbers
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(lab, "id").select(
        "toxic", "text").mapInArrow(_features, "toxic int, words array<long>, counts array<int>").toArrow().combine_chunks()
    toxic = got.column("toxic").to_numpy().astype(np.float64)
    words = [c for c in got.column("words").chunks] or [pa.array([], pa.list_(pa.int64()))]
    counts = [c for c in got.column("counts").chunks] or [pa.array([], pa.list_(pa.int32()))]
    per = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in words]).astype(np.int64)
    flat = np.concatenate([c.flatten().to_numpy() for c in words]).view(np.uint64)
    num = np.concatenate([c.flatten().to_numpy() for c in counts])
    return fit(toxic, np.repeat(np.arange(len(toxic)), per), flat, num)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << 16, bool)
    seen[(model.features & U64(0xFFFF)).astype(np.int64)] = True
    for rb in batches:
        schema = pa.schema([rb.schema.field(0), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32())])
        score = []
        for _, _, raw, offs in text_blocks(rb.column(1)):
            of, h = word_features(raw, offs)
            at = np.flatnonzero(seen[(h & U64(0xFFFF)).astype(np.int64)])
            f = np.searchsorted(model.features, h[at])
            f[f == len(model.features)] = 0
            ok = model.features[f] == h[at] if len(model.features) else np.zeros(len(at), bool)
            at, f = at[ok], f[ok]
            key, num = np.unique(of[at] * max(1, len(model.features)) + f, return_counts=True)
            doc, f = np.divmod(key, max(1, len(model.features)))
            score.append(np.bincount(doc, weights=model.weights[f] * np.sqrt(num), minlength=len(offs) - 1))
        if not score:
            continue
        p = model.exceed(np.concatenate(score))
        level = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
        yield batch(schema, **{rb.schema.names[0]: rb.column(0)}, severity=np.round(p.sum(axis=1), 9),
                    p_toxic=np.round(p[:, 0], 9), grade=level.argmax(axis=1).astype(np.int32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``severity`` (expected, 0 to 3),
    ``p_toxic`` (of a grade over 0), ``grade`` (the likeliest), ``toxic``
    (p_toxic of a half or more). Null and empty texts have no features: their
    score is that of the thresholds alone. Other columns are not read."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = src.mapInArrow(lambda it: _score(it, held.value),
                         f"id {src.schema['id'].dataType.simpleString()}, severity double, p_toxic double, grade int")
    return out.select(F.col("id").alias(id_col), "severity", "p_toxic", "grade", (F.col("p_toxic") >= 0.5).alias("toxic"))
