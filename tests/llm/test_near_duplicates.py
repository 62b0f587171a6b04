"""SimHash and embedding near-duplicates, components: against brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
import xxhash

from tessella.llm import embedding, simhash
from tessella.llm.components import connected
from tessella.session import table
from tests.llm.cases import DOC_SCHEMA, clash, components, odd_rows, words


def fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum((2 * n > len(grams)) << b for b, n in enumerate(count))


def expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    pairs = [(a[0], b[0]) for a, f in zip(rows, fps) for b, g in zip(rows, fps)
             if a[0] is not None and b[0] is not None and (f ^ g).bit_count() <= 3]
    comp = components(ids, pairs)
    out = []
    for (i, _), f in zip(rows, fps):
        near = [comp[j] for (j, _), g in zip(rows, fps) if j is not None and (f ^ g).bit_count() <= 3 and f == g]
        c = comp[i] if i is not None else min(near, default=None)
        out.append((i, f"{f:016x}", c, i == c))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_copies(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    rows = []
    for k in range(30):
        base = words(rng, 150)
        for c in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(c % 3):
                w[rng.randrange(len(w))] = "X"
            rows.append((1000 - len(rows), " ".join(w)))
    return rows


def test_simhash_matches_brute_force(spark):
    rows = near_copies(1) + odd_rows()
    assert got(simhash.simhash_dedup(spark.createDataFrame(rows, DOC_SCHEMA))) == expected(rows)


def test_simhash_ignores_other_columns_and_takes_an_empty_table(spark):
    rows = odd_rows()[:8]
    assert got(simhash.simhash_dedup(clash(spark, rows))) == expected(rows)
    assert got(simhash.simhash_dedup(spark.createDataFrame([], DOC_SCHEMA))) == []


@pytest.mark.parametrize("chunk", [7, 2048])
def test_every_pair_within_the_radius_is_linked(spark, chunk):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 6, dtype=np.int64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for c in centre for _ in range(40)}
    fps |= set(rng.integers(-2**63, 2**63 - 1, 50, dtype=np.int64).tolist())
    fps = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long"), 3, chunk=chunk)
    mine = components(range(len(fps)), [(r["a"], r["b"]) for r in links.collect()])
    mask = (1 << 64) - 1
    brute = components(range(len(fps)), [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps)
                                         if ((a & mask) ^ (b & mask)).bit_count() <= 3])
    assert mine == brute


def test_sliced_counters_for_each_radius():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 100, dtype=np.int64).view(np.uint64)
    fps[50:] = fps[:50] ^ (np.uint64(1) << rng.integers(0, 63, 50).astype(np.uint64))
    planes = simhash.planes_of(fps, np.arange(100) // 64, np.arange(100) % 64, 2)
    for radius in (0, 1, 2, 5, 30):
        q, w = np.repeat(fps, 2), np.tile([0, 1], 100)
        hit, mask = simhash.sliced_matches(planes, q, w, radius)
        found = {(int(h) // 2, int(w[h]) * 64 + b) for h, m in zip(hit, mask) for b in range(64) if int(m) >> b & 1 and w[h] * 64 + b < 100}
        near = {(i, j) for i in range(100) for j in range(100) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
        assert near == found


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(6, 40)] + [(70, 71), (71, 72), (72, 70), (9, 9)]
    edges += [(None, 4)]
    df = connected(spark.createDataFrame(edges, "a long, b long"))
    plain = [(a, b) for a, b in edges if a is not None]
    want = components({x for e in plain for x in e if e[0] != e[1]}, plain)
    assert {r["node"]: r["component"] for r in df.collect()} == want
    assert df.count() == len(want)


VEC = "vec_id long, embedding array<float>, label int, v string, links string, near string"


def brute_links(rows, threshold=0.93):
    ok, n = [], len(rows)
    for r in rows:
        x = r[1]
        good = r[2] is not None and x and all(y is not None and math.isfinite(y) for y in x) and any(x)
        ok.append(np.array(x, np.float32).astype(float) if good else None)
    links, pairs = [0] * n, []
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                if ok[i] @ ok[j] / math.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= threshold:
                    links[i] += 1
                    pairs.append((i, j))
    return links, pairs


def test_embedding_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [], 1), (7, [nan, 1.0], 1),
            (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.1], 1), (12, [-1.0, 0.0], 1), (13, [1.0, 0.0, 0.0], 1),
            (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (14, [3e38, 3e38], 3), (15, [1e-40, 1e-40], 3)]
    links, pairs = brute_links(rows)
    comp = components({r[0] for r in rows if r[0] is not None}, [(rows[a][0], rows[b][0]) for a, b in pairs if None not in (rows[a][0], rows[b][0])])
    want = sorted([(r[0], n, comp.get(r[0], 1), r[0] == comp.get(r[0], 1)) for r, n in zip(rows, links)], key=str)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VEC)
    assert got(embedding.embedding_dedup(df)) == want
    assert got(embedding.embedding_dedup(spark.createDataFrame([], VEC))) == []


@pytest.mark.parametrize("chunk", [16, 1024])
def test_embedding_recall_and_exact_links(spark, chunk, monkeypatch):
    monkeypatch.setattr(embedding, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        c = rng.normal(size=64)
        for _ in range(rng.choice([1, 3, 25])):
            x = c + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.3])
            rows.append((len(rows), [float(np.float32(v)) for v in x], int(k % 3)))
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r["vec_id"]: r for r in embedding.embedding_dedup(df).collect()}
    links, _ = brute_links(rows)
    mine = sum(out[r[0]]["n_links"] for r in rows)
    assert all(out[r[0]]["n_links"] <= n for r, n in zip(rows, links))
    assert mine >= 0.99 * sum(links) > 0


def test_embedding_query_recall_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    links, _ = brute_links(rows)
    from tessella.llm.queries import op2_embedding
    mine = {r["vec_id"]: r["n_links"] for r in op2_embedding(spark, sf_dir).collect()}
    assert sum(mine.values()) >= 0.9 * sum(links) and all(mine[r[0]] <= n for r, n in zip(rows, links))
