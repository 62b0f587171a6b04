"""Decontamination, line de-duplication, repeated bytes: against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import decontaminate, line_dedup, suffix_array
from tests.llm.cases import DOC_SCHEMA, clash, odd_rows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, bench, window=13):
    grams = defaultdict(set)
    for item, text in bench:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[i:i + n])].add(item)
    out = []
    for d, text in docs:
        w, items = split(text), set()
        hit = np.zeros(len(w), bool)
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                found = grams.get(tuple(w[i:i + n]))
                if found:
                    hit[i:i + n] = True
                    items |= found
        out.append((d, len(w), int(hit.sum()), sorted(str(i) for i in items if i is not None)))
    return sorted(out, key=str)


def contaminated_docs():
    rng = random.Random(11)
    bench = [(i, " ".join(words(rng, rng.choice([1, 3, 6, 12, 13, 14, 40]), 3000))) for i in range(40)]
    bench += [(40, ""), (41, None), (None, "the null item has words " + " ".join(words(rng, 20))), (7, bench[3][1]), (100, bench[5][1])]
    docs = []
    for i in range(120):
        w = words(rng, rng.randrange(0, 80), 3000)
        item = split(rng.choice(bench)[1])
        a = rng.randrange(0, max(1, len(item) - 5))
        at = rng.randrange(0, len(w) + 1)
        docs.append((i, ", ".join([*w[:at], *[x.upper() for x in item[a:a + rng.choice([5, 12, 13, 30])]], *w[at:]])))
    return docs, bench


def hits_of(df):
    return sorted(((r[0], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 24, 700])
def test_decontamination_matches_brute_force(spark, block):
    docs, bench = contaminated_docs()
    docs += odd_rows() + [docs[0]]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, DOC_SCHEMA), spark.createDataFrame(bench, "item_id long, text string"),
                                      block_bytes=block)
    assert hits_of(got) == brute_hits(docs, bench)


def test_decontamination_runs_and_columns(spark):
    item = " ".join(f"q{i}" for i in range(15))
    docs = [(1, f"a b {item} c {item}"), (2, "x"), (3, None)]
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    out = decontaminate.mark(clash(spark, docs), bench).orderBy("doc_id").collect()
    assert [[(s["start"], s["end"]) for s in r["runs"]] for r in out] == [[(2, 17), (18, 33)], [], []]
    assert out[0]["length"] == "x" and out[0]["n_hit"] == 30
    none = decontaminate.decontaminate(spark.createDataFrame(docs, DOC_SCHEMA), bench.limit(0))
    assert hits_of(none) == brute_hits(docs, [])
    assert decontaminate.decontaminate(spark.createDataFrame([], DOC_SCHEMA), bench).count() == 0


def test_winnowing_keeps_a_gram_of_every_long_span():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 3000).astype(np.uint64)
    h = decontaminate.grams(text, 5)
    keep = decontaminate.winnowed(h, np.ones(len(h), bool), 9)
    assert (np.diff(np.concatenate([[-1], keep, [len(h)]])) <= 9).all()
    part = text[700:713]
    own = decontaminate.winnowed(decontaminate.grams(part, 5), np.ones(9, bool), 9)
    assert set(own + 700) <= set(keep)


def brute_lines(rows):
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()[:16]))
    first, cover = {}, defaultdict(set)
    for d in docs:
        lines = d[1].split("\n")
        for j in range(len(lines) - 2):
            w = "\n".join(lines[j:j + 3])
            if any(ord(c) > 32 for c in w):
                if w in first:
                    cover[d] |= {j, j + 1, j + 2}
                first.setdefault(w, (d, j))
    out = []
    for i, t in rows:
        gone = cover.get((i, t), set())
        lines = (t or "").split("\n")
        spans = sum(1 for j in gone if j - 1 not in gone)
        kept = t if not gone else "\n".join(x for j, x in enumerate(lines) if j not in gone)
        out.append((i, kept, len(lines) if t else 0, len(gone), spans))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(words(rng, 4, 50)) for _ in range(25)] + ["", " ", "x\r"]
    rows = [(i, "\n".join(rng.choice(pool[:6] if i % 3 else pool) for _ in range(rng.randrange(1, 15)))) for i in range(80)]
    rows += odd_rows() + rows[:2] + [(500, "\n\n\n\n\n"), (501, "\n\n\n\n\n"), (None, rows[4][1])]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, DOC_SCHEMA))
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["n_spans"]) for r in out.collect()), key=str) == brute_lines(rows)


def test_line_dedup_keeps_other_columns(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny")]
    out = line_dedup.line_dedup(clash(spark, rows)).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["a\nb\nc\nd", "x\ny"] and out[0]["lines"] == "x" and out[1]["n_removed"] == 3
    assert line_dedup.line_dedup(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def brute_bytes(rows, size):
    count = Counter(b[i:i + size] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - size + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if count[b[i:i + size]] > 1:
                gone[i:i + size] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "seed", "group"), [(40, 8, 512), (33, 32, 3)])
def test_repeated_bytes_match_brute_force(spark, size, seed, group):
    rng = random.Random(8)
    base = [" ".join(words(rng, rng.randrange(5, 60), 300)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(base[:4] * 2)]
    shared = " ".join(words(rng, 25, 300))
    for i in range(30):
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = "é"
        rows.append((200 + i, " ".join(w)))
        rows.append((300 + i, " ".join([*words(rng, 6), shared, *words(rng, 6)])))
    rows += [(1, None), (2, ""), (4, "one"), (4, "one"), (None, base[7]), (None, "ab" * 60), (12, "a" * 500), (7, "first"), rows[0]]
    out = suffix_array.remove_repeats(spark.createDataFrame(rows, DOC_SCHEMA), length=size, seed=seed, group=group)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()), key=str)
    assert got == brute_bytes(rows, size)


def test_repeated_bytes_at_the_contract_length(spark):
    rng = random.Random(9)
    passage = " ".join(words(rng, 300, 5000))
    rows = [(1, passage[:399]), (2, passage[:399]), (3, "start " + passage), (4, passage + " end"), (5, " ".join(words(rng, 30_000, 9999)))]
    out = {r["doc_id"]: r for r in suffix_array.remove_repeats(clash(spark, rows)).collect()}
    assert [out[i]["n_removed"] for i in (1, 2, 5)] == [0, 0, 0]
    assert bytes(out[3]["kept"]) == b"start " and bytes(out[4]["kept"]) == b" end" and out[1]["kept"] is None
    assert [(s["start"], s["end"]) for s in out[3]["spans"]] == [(6, 6 + len(passage))]
    assert suffix_array.remove_repeats(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(5)
    for n, letters in ((1, 2), (50, 2), (400, 3), (600, 30)):
        codes = rng.integers(2, 2 + letters, n).astype(np.uint16)
        sa, rank = suffix_array.suffix_ranks(codes, n)
        text = codes.tolist()
        assert sa.tolist() == sorted(range(n), key=lambda i: text[i:])
        assert (rank[sa] == np.arange(n)).all()
        lcp = suffix_array.common_prefixes(codes, sa, n)
        for a, b, k in zip(sa[:-1], sa[1:], lcp[1:]):
            assert text[a:a + k] == text[b:b + k] and text[a + k:a + k + 1] != text[b + k:b + k + 1]
