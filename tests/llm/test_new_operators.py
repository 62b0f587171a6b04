"""Exact duplicates, hard negatives and tokenizer alignment: against brute force."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import cross_tokenizer, exact_dedup, hard_negatives, queries
from tessella.session import table
from tests.llm.cases import DOC_SCHEMA, clash, odd_rows, words

# ------------------------------------------------------------ exact duplicates


def copies(rows):
    """(id, keep_id, size, kept, sha) of each row."""
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[t or ""].append((i is not None, i or 0, n))
    out = []
    for t, members in groups.items():
        known, last, _ = max(members)
        keep = last if known else None
        one = False
        for k, i, _ in members:
            kept = not one and (k, i) == (known, last)
            one |= kept
            out.append((i if k else None, keep, len(members), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def dedup_rows():
    rng = random.Random(1)
    # same length and prefix but another end; same length only; copies of all sizes
    start = "same beginning of the text " * 5
    rows = [(100 + i, start + f"{i % 7:03d}") for i in range(40)]
    rows += [(200 + i, " ".join(words(rng, 30))) for i in range(30)]
    rows += [(300 + i, None if i % 3 else "") for i in range(50)]
    return rows + odd_rows() + [(None, "only null ids"), (None, "only null ids")]


@pytest.mark.parametrize("bits", [exact_dedup.SIEVE_BITS, 1])
def test_exact_copies_match_brute_force(spark, bits):
    """With one bit the sieves let everything through."""
    rows = dedup_rows()
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)
    got = exact_dedup.exact_dedup(df, digest_all=True, bits=bits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == copies(rows)


def test_the_full_hash_is_taken_of_surviving_groups_alone(spark):
    rows = [(1, "a"), (2, "bb"), (3, "cc"), (4, "x" * 70 + "1"), (5, "x" * 70 + "2"), (6, "ddd"), (7, "ddd")]
    got = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    # 1 has a length, 2 and 3 a prefix of their own
    assert [i for i in sorted(got) if got[i] is not None] == [4, 5, 6, 7]


def test_exact_copies_of_clashing_columns_and_an_empty_table(spark):
    rows = odd_rows()
    got = exact_dedup.exact_dedup(clash(spark, rows), digest_all=True)
    assert sorted((tuple(r) for r in got.collect()), key=str) == copies(rows)
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_every_bit_of_a_sieve_is_found_again(spark):
    keys = spark.range(40_000).selectExpr("id % 20000 AS k").unionAll(spark.range(20_000, 40_000).selectExpr("id AS k"))
    found = exact_dedup.with_repeats(keys, [keys["k"]], exact_dedup.sieve(keys, ["k"], 1 << 24), "again", 1 << 24)
    n = found.groupBy("again").count().collect()
    n = {r["again"]: r["count"] for r in n}
    assert n[True] >= 40_000 and n[False] > 19_900


# ------------------------------------------------------------ hard negatives

VECS = "vec_id long, label int, embedding array<float>"


def mined(rows, every=50, positives=5, negatives=3):
    ok = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a, ya, va in {(i, y, tuple(v)) for i, y, v in ok if i % every == 0}:
        near = [(dot(va, v), i, y) for i, y, v in ok if len(v) == len(va)]
        pos = sorted(((-s, i) for s, i, y in near if y == ya and i != a))[:positives]
        for p, pid in pos:
            p = -p
            neg = sorted((-s, i) for s, i, y in near if y != ya and 50 * p <= 100 * s <= 95 * p)[:negatives]
            out += [(a, pid, k + 1, i, p, -s) for k, (s, i) in enumerate(neg)]
    return sorted(out)


def vec_rows(seed: int, n: int, dim: int = 8):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 4)), (rng.normal(0.2, 0.3, dim)).tolist()) for i in range(n)]
    # ties: equal vectors under several ids and labels
    rows += [(n + i, i % 3, rows[7][2]) for i in range(12)]
    return rows


ODD_VECS = [(None, 1, [1.0] * 8), (50, None, [1.0] * 8), (100, 1, None), (150, 1, [1.0, None] * 4), (200, 1, [math.nan] * 8),
            (250, 1, [math.inf] + [0.0] * 7), (300, 2, [0.0] * 8), (350, 2, []), (351, 2, []), (352, 3, []), (400, 1, [0.5, 0.5]),
            (401, 1, [0.5, 0.25]), (402, 2, [0.25, 0.25]), (-50, 1, [0.3] * 8), (450, 1, [0.4] * 8), (450, 1, [0.4] * 8), (450, 2, [0.4] * 8)]


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [hard_negatives.BLOCK_COMPONENTS, 20])
def test_negatives_match_brute_force(spark, block):
    rows = vec_rows(1, 260) + ODD_VECS
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECS).repartition(4), block_components=block)
    assert result(got) == mined(rows)
    assert len(mined(rows)) > 50


def test_negatives_of_very_large_components(spark):
    rng = np.random.default_rng(4)
    rows = vec_rows(2, 120)
    rows += [(1000 + i, i % 2, (np.float32(10.0) ** rng.integers(0, 6, 8) * rng.random(8)).astype(np.float32).tolist()) for i in range(20)]
    assert result(hard_negatives.hard_negatives(spark.createDataFrame(rows, VECS))) == mined(rows)


def test_negatives_without_rows_anchors_or_own_columns(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECS)).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0])], VECS)).collect() == []
    rows = vec_rows(3, 110)
    more = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], VECS + ", id string, v string, anchor int")
    assert result(hard_negatives.hard_negatives(more)) == mined(rows)


@pytest.mark.parametrize("top", [1, 3, 200, 2**11, 2**27, 2**40, 2**70])
def test_packed_products_are_exact(top):
    rng = random.Random(top)
    kind = object if top > 2**53 else np.int64
    a = np.array([[rng.randint(-top, top) for _ in range(5)] for _ in range(7)], kind)
    c = np.array([[rng.randint(-top, top) for _ in range(5)] for _ in range(31)], kind)
    want = a.astype(object) @ c.astype(object).T
    assert (hard_negatives.packed_scores(a, c) == want).all()
    c[3] = c[4] = 1
    assert (hard_negatives.scores(a, c) == a.astype(object) @ c.astype(object).T).all()


# ------------------------------------------------------------ tokenizer alignment

TEXTS = ["don't stop, 'really'  now", " two  spaces ", "É ß 日本 テスト한글 ｆｕｌｌ", "<|endoftext|> <s> <unk> <0x41> </s>", "a▁b", "\t\n x \r\n y",
         " nbsp 　wide  em \u0085nel", "1234567 12,5 %%%", "naïve café ñandú été", "x" * 300, "🙂🙃 ok", "\x00\x01 a", " ", "   ", "a\n b\n\n c", "λόγος и слово"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(queries.TOKENIZER_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER_B)


def tokens(both, text):
    a, b = both
    signs = cross_tokenizer.byte_alphabet()
    whole = " " + (text or "")
    ta = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(whole, add_special_tokens=False).ids] if text else []
    tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
          for i in (b.encode(text) if text else [])]
    if any(b"".join(x for _, x in t) != whole.encode() for t in (ta, tb)):
        return [], []
    return ta, tb


def aligned(both, rows):
    found = []
    for _, text in rows:
        ta, tb = tokens(both, text)
        spans = []
        for t in (ta, tb):
            at, out = 0, []
            for i, x in t:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        sa, sb = spans
        links, lo = [], 0
        for s, e, i in sa:
            while lo < len(sb) and sb[lo][1] <= s:
                lo += 1
            k = lo
            while k < len(sb) and sb[k][0] < e:
                links.append((i, sb[k][2]))
                k += 1
        common = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        of_group = [defaultdict(list), defaultdict(list)]
        for sp, out in zip(spans, of_group, strict=True):
            for _, e, i in sp:
                out[bisect.bisect_left(common, e)].append(str(i))
        text_of = ["|".join(",".join(out[g]) for out in of_group) for g in range(len(common))]
        found.append((len(sa), len(sb), len(common), links, ";".join(text_of)))
    docs = Counter(p for *_, links, _ in found for p in set(links))
    top = defaultdict(int)
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    return sorted(((i, na, nb, ng, len(links), sum(docs[p] == top[p[0]] for p in links), sum(docs[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if ng else "") for (i, _), (na, nb, ng, links, g) in zip(rows, found, strict=True)), key=str)


def query_rows(spark, df, at_once=cross_tokenizer.PAIRS_AT_ONCE):
    al = cross_tokenizer.alignments(df, queries.TOKENIZER_A, queries.TOKENIZER_B)
    totals = {r["row"]: (r["n_best"], r["count_sum"]) for r in
              cross_tokenizer.link_totals(al, cross_tokenizer.pair_counts(al), at_once).collect()}
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], *totals.get(r["row"], (0, 0)),
                    hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_groups"] else "") for r in al.collect()), key=str)


def test_parts_of_a_text_give_the_ids_of_the_whole(spark, sf_dir, both):
    rng = random.Random(2)
    signs = "aAzZéÉ'sS 09.,;!&-_<>|\n\tßñ 　日▁ë  "
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(60)) for _ in range(500)]
    texts += [r["text"] for r in table(spark, sf_dir, "documents").collect() if r["text"]]
    pair = cross_tokenizer.Pair(queries.TOKENIZER_A, queries.TOKENIZER_B)
    raw = [(" " + t).encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    a, b = pair.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
    whole_a = [e.ids for e in both[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    for t, x, y, p, q in zip(texts, a.to_pylist(), b.to_pylist(), whole_a, both[1].encode(texts), strict=True):
        assert x == p, t[:80]
        assert y == q, t[:80]


@pytest.mark.parametrize("at_once", [cross_tokenizer.PAIRS_AT_ONCE, 3000])
def test_alignment_matches_brute_force(spark, sf_dir, both, at_once):
    rows = [(1000 + i, t) for i, t in enumerate(TEXTS)] + [r for r in odd_rows() if len(r[1] or "") < 50_000]
    rows += [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").limit(60).collect()]
    assert query_rows(spark, spark.createDataFrame(rows, DOC_SCHEMA).repartition(3), at_once) == aligned(both, rows)


def test_alignment_of_a_long_text_an_empty_table_and_clashing_columns(spark, both):
    rng = random.Random(3)
    rows = [(1, " ".join(words(rng, 60_000))), (2, "é" * 20_000), (3, None), (4, "")]
    assert query_rows(spark, spark.createDataFrame(rows, DOC_SCHEMA)) == aligned(both, rows)
    assert query_rows(spark, spark.createDataFrame([], DOC_SCHEMA)) == []
    rows = [(5, "a b"), (5, "a b"), (None, "c d")]
    assert query_rows(spark, clash(spark, rows)) == aligned(both, rows)


def test_a_text_one_tokenizer_does_not_give_back_has_no_tokens():
    v = cross_tokenizer.Vocabulary([b" a", b"b", b" ", b"ab"])
    x = np.frombuffer(b" ab ab", np.uint8)
    ids = pa.array([[0, 1], [2, 1]], pa.list_(pa.int32()))
    assert cross_tokenizer.restored(ids, v, x, np.array([0, 3, 6])).tolist() == [True, False]
    out = cross_tokenizer.align(*[cross_tokenizer.only(i, np.array([True, False])) for i in (ids, pa.array([[2, 3], [2, 3]], pa.list_(pa.int32())))], v, v)
    assert out["groups"].to_pylist() == ["0,1|2,3", ""]
    assert out["n_links"].to_pylist() == [3, 0]
