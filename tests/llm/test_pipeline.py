"""The corpus pipeline: each stage acts on what the one before kept."""

from __future__ import annotations

import random

import corpus_pipeline
from tessella.session import table
from tests.llm.cases import words


def prose(rng, n):
    return ". ".join(" ".join(words(rng, 8, 5000)).capitalize() for _ in range(n)) + "."


def test_stages_drop_what_they_should(spark, scratch):
    rng = random.Random(6)
    shared = "\n".join(prose(rng, 2) for _ in range(4))
    item = " ".join(words(rng, 30, 5000))
    clean = [(i, prose(rng, 12)) for i in range(60)]
    junk = [(200 + i, " ".join(w.upper() + "!!" for w in words(rng, 60))) for i in range(8)]
    junk += [(300 + i, f"spam{i} " * 80) for i in range(8)] + [(400 + i, " ".join(w + "$$$" for w in words(rng, 60))) for i in range(8)]
    rows = clean + junk + [(100, " ".join(w.upper() + "!!" for w in words(rng, 60))), (101, "spam " * 80), (102, clean[3][1]),
                    (103, clean[4][1].replace(" ", "  ")), (104, prose(rng, 3) + "\n" + shared), (105, prose(rng, 3) + "\n" + shared + "\nlast line"),
                    (106, prose(rng, 2) + " " + item), (107, None), (108, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    kept, seen = spark.read.parquet(f"{scratch}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, scratch)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{scratch}/{name}")
        kept = spark.read.parquet(f"{scratch}/{name}")
        seen.append({r["doc_id"]: r["text"] for r in kept.collect()})
    quality, lines, near, decon = seen
    assert {i for i, _ in clean} <= set(quality) and not {100, 101, 107, 108, *dict(junk)} & set(quality)
    assert shared in lines[104] and lines[105].endswith("last line") and shared not in lines[105]
    assert 3 in near and 4 in near and 102 not in near and 103 not in near
    assert set(near) - set(decon) == {106}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, scratch)
    assert {r["doc_id"] for r in packed.collect()} == set(decon)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, scratch).collect()} == set(decon)


def test_names_and_tables(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    empty = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
