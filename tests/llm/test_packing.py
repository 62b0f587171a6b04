"""Token ids and both packings: exact round trips and lower bounds."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessella.llm import pack_bfd, pack_local
from tessella.llm.common import text_blocks, utf8
from tessella.llm.queries import TOKENIZER
from tessella.llm.tokens import encoder
from tessella.session import table
from tests.llm.cases import DOC_SCHEMA, clash, odd_rows

ODD = ["don't won'ts 'really 's,''s \"'\" it's 5's l'été áb ÁB H̱ x≮ 12345 1⃣ Ⅷ ٣٤ K İstanbul ǅ ΣΑΣ ς \x1c\x1d a b c\u0085d 　",
       "<|endoftext|> hi <|startoftext|>", "日本語 テスト한글 ｆｕｌｌ ﬁ ŉ ªº µ ß ẞ", "a" * 5000, "é" * 300 + "'s", "́̂abc",
       "'S 'LL you'LL ''s'' --'s", "x​Y Z̈z", "!!'re ?'t a'b'c", "\x00\x01a\x7fb", "", "   \n", "T́e STOP.Now A,B;c#d $5.00%"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(TOKENIZER)


def test_ids_equal_the_tokenizers(spark, sf_dir, tok):
    texts = ODD + [r["text"] for r in table(spark, sf_dir, "documents").collect()]
    rng = random.Random(1)
    signs = "aAzZéÉ'sS 09.,;!&-_<>|\n\tßñÑ́ "
    texts += ["".join(rng.choice(signs) for _ in range(40)) for _ in range(400)]
    flat, counts = [], []
    for _, _, raw, offs in text_blocks(pa.array(texts), 20_000):
        i, c = encoder(TOKENIZER).encode(raw, offs)
        flat += i.tolist()
        counts += c.tolist()
    at = 0
    for t, n, e in zip(texts, counts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert flat[at:at + n] == e.ids, t[:80]
        at += n


def test_utf8_of_slices_and_nulls():
    raw, offs = utf8(pa.array(["ab", None, "é", ""]).slice(1))
    assert raw.tobytes() == "é".encode() and offs.tolist() == [0, 0, 2, 2]


def whole_ids(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(rows, docs, tok, capacity):
    """Pieces restore every document, and fill sequences without gap or overlap."""
    want = Counter()
    for d, t in docs:
        ids = np.array(whole_ids(tok, t), "<u4")
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want[d, p, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_local_search_packing_restores_documents(spark, sf_dir, tok):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()] + odd_rows()
    for capacity in (4096, 97):
        rows = pack_local.pack(spark.createDataFrame(docs, DOC_SCHEMA), TOKENIZER, capacity=capacity).collect()
        bins = check_pieces(rows, docs, tok, capacity)
        assert bins <= 1.003 * sum(r["length"] for r in rows) / capacity + 1
    rows = pack_local.pack(clash(spark, docs[:5]), TOKENIZER).collect()
    check_pieces(rows, docs[:5], tok, 4096)
    assert pack_local.pack(spark.createDataFrame([], DOC_SCHEMA), TOKENIZER).count() == 0


def test_local_search_empties_bins():
    # best fit decreasing needs 3 bins of 10 here; 2 are enough
    hist = {6: 2, 4: 1, 2: 2}
    hist = {7: 2, 6: 2, 4: 2, 3: 2}
    kinds = Counter({((7, 1),): 2, ((6, 1), (3, 1)): 2, ((4, 2),): 1})
    better = pack_local.local_search(kinds, 10)
    assert sum(better.values()) == 4
    used = Counter()
    for kind, n in better.items():
        assert pack_local.fill(kind) <= 10
        for x, k in kind:
            used[x] += k * n
    assert used == Counter(hist)


def test_local_search_on_hard_lengths():
    rng = np.random.default_rng(2)
    lengths = rng.integers(900, 2500, 600)
    kinds = pack_local.best_fit_kinds(Counter(lengths.tolist()), 4096)
    better = pack_local.local_search(kinds, 4096, 300)
    used = Counter()
    for kind, n in better.items():
        assert pack_local.fill(kind) <= 4096
        for x, k in kind:
            used[x] += k * n
    assert used == Counter(lengths.tolist())
    assert -(-int(lengths.sum()) // 4096) <= sum(better.values()) < sum(kinds.values())


def test_pairs_of_all_lengths_of_a_bin_are_offered():
    kind = tuple((x, 1) for x in [*range(640, 0, -10), 3, 1])
    assert dict(pack_local._options(kind))[4] == (3, 1)


def test_best_fit_takes_the_least_room_that_fits():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 60, 500)
    seq, offset, n = pack_bfd.best_fit(lengths, 100)
    rooms: list[int] = []
    for x in sorted(lengths.tolist(), reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms[rooms.index(min(fit))] -= x
        else:
            rooms.append(100 - x)
    assert n == len(rooms)
    for s in range(n):
        own = sorted((int(o), int(x)) for o, x, q in zip(offset, lengths, seq) if q == s)
        assert all(a + x == b for (a, x), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 100


@pytest.mark.parametrize("shard", [4 << 20, 500])
def test_token_output_round_trip(spark, sf_dir, tok, shard, scratch):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()[:80]] + odd_rows()
    out = pack_bfd.packed(spark.createDataFrame(docs, DOC_SCHEMA), TOKENIZER, capacity=512, shard_tokens=shard)
    rows = out.collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    found = Counter()
    for r in rows:
        ids = np.frombuffer(r["tokens"], "<u2")
        assert len(ids) == r["n_tokens"] <= 512 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == len(ids)
        for d, s, a, b in zip(r["doc_ids"], r["segments"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            assert b - a == s["length"]
            found[d, s["piece"], s["start"], tuple(ids[a:b].tolist())] += 1
    want = Counter()
    for d, t in docs:
        ids = whole_ids(tok, t)
        for p, s in enumerate(range(0, len(ids), 512)):
            want[d, p, s, tuple(ids[s:s + 512])] += 1
    assert found == want
    pack_bfd.write_matrices(out, f"{scratch}/m", capacity=512, rows=3)
    total = 0
    for m in spark.read.parquet(f"{scratch}/m").collect():
        ids = np.frombuffer(m["ids"], "<u4").reshape(m["rows"], 512)
        pos = np.frombuffer(m["positions"], "<u4").reshape(m["rows"], 512)
        cum = m["cu_seqlens"]
        assert cum[0] == 0 and cum[-1] == ids.size or ids[-1, -1] == 0
        starts = set(cum[:-1])
        flat = pos.ravel()
        real = np.concatenate([np.arange(b - a) for a, b in zip(cum[:-1], cum[1:])])
        keep = flat > 0
        assert (flat[:len(real)][keep[:len(real)]] == real[keep[:len(real)]]).all() and len(starts) == len(cum) - 1
        total += m["rows"]
    assert total == len(rows)


def test_token_output_of_an_empty_table(spark):
    assert pack_bfd.packed(spark.createDataFrame([], DOC_SCHEMA), TOKENIZER).count() == 0
    assert pack_bfd.packed(clash(spark, odd_rows()[:4]).coalesce(1), TOKENIZER).count() == 1
