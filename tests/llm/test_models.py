"""Quality and toxicity: held-out accuracy, planted cases and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality, toxicity
from tessella.session import table
from tests.llm.cases import DOC_SCHEMA, clash, odd_rows

SF = "/root/testdata/sf0.01"


def test_posteriors_find_the_good_labellers():
    rng = np.random.default_rng(1)
    bad = rng.random(20_000) < 0.2
    votes = np.full((20_000, 5), quality.NONE)
    for j, (finds, wrong) in enumerate([(0.9, 0.01), (0.8, 0.02), (0.7, 0.001), (0.6, 0.05), (0.5, 0.01)]):
        says = rng.random(20_000) < np.where(bad, finds, wrong)
        votes[:, j] = np.where(rng.random(20_000) < 0.1, quality.NONE, np.where(says, quality.BAD, quality.GOOD))
    pattern, inv, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good = quality.posteriors(pattern, count)[inv.ravel()]
    assert ((good > 0.5) == ~bad).mean() > 0.96


def test_quality_on_labelled_documents(spark):
    docs = table(spark, SF, "documents")
    out = quality.score(docs, quality.train(docs)).join(table(spark, SF, "labels"), "doc_id")
    rate = {r["quality"]: r["share"] for r in out.groupBy("quality").agg(F.avg(F.col("good").cast("int")).alias("share")).collect()}
    assert rate[1] >= 0.97 and rate[0] <= 0.1


def test_quality_of_odd_rows(spark):
    model = quality.train(table(spark, SF, "documents"))
    rows = odd_rows()
    out = quality.score(clash(spark, rows), model).collect()
    assert len(out) == len(rows)
    none = [r for r, (_, t) in zip(out, rows) if not (t or "").strip()]
    assert none and all(r["score"] == 0 and not r["good"] for r in none)
    kept = quality.keep_good(clash(spark, [(1, "A plain sentence of words, with a stop. And one more of them.")]), model)
    assert kept.count() == 1 and kept.first()["score"] == "x"
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert quality.score(empty, quality.train(empty)).count() == 0


def test_quality_shapes_match_a_plain_count():
    from tessella.llm.common import utf8
    import pyarrow as pa
    raw, offs = utf8(pa.array(["The The dog!! # B", "", "É é | x"]))
    s = quality.Shapes(raw, offs)
    m = s.measures()
    assert s.n.tolist() == [5, 0, 4]
    assert m["same"].tolist() == [0.2, 0, 0] and m["top"].tolist() == [0.4, 0, 0.25]
    assert m["bangs"].tolist() == [0.2, 0, 0] and m["bars"].tolist() == [0, 0, 0.25]
    assert m["signs"][0] == pytest.approx(1 / 17)


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF.replace("0.01", "0.1"), "documents"), table(spark, SF.replace("0.01", "0.1"), "labels")
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2))
    model = toxicity.train(docs, labels.where(half == 0))
    assert (np.diff(model.theta) >= 0).all()
    out = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(labels.where(half == 1), "doc_id")
    rate = {r["toxic"]: r["share"] for r in out.groupBy("toxic").agg(F.avg(F.col("found").cast("int")).alias("share")).collect()}
    assert rate[1] >= 0.8 and rate[0] <= 0.01
    grade = {r["toxic"]: r["s"] for r in out.groupBy("toxic").agg(F.avg("severity").alias("s")).collect()}
    assert grade[1] > 5 * grade[0]


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"fine words u{i}x here " + ("awful " * (i % 8) if i % 2 else "good ")) for i in range(200)], DOC_SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (999, 1), (3, 0), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = odd_rows()
    out = toxicity.score(clash(spark, rows), model).collect()
    assert len(out) == len(rows) and all(0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 for r in out)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert got[1]["toxic"] and not got[0]["toxic"] and got[7]["severity"] > got[1]["severity"]
    empty = spark.createDataFrame([], DOC_SCHEMA)
    none = toxicity.train(empty, labels.limit(0))
    assert toxicity.score(empty, none).count() == 0 and toxicity.score(docs, none).count() == 200


def test_toxicity_of_a_rare_insult():
    # 1,100 toxic documents: 20 hold word 2 and no other insult, the rest word 1; every one holds some of 500 neutral words
    rng = np.random.default_rng(7)
    toxic = np.repeat([1.0, 0.0], [1_100, 6_000])
    words = [[*(10 + rng.choice(500, 20, replace=False)), *([2 if i < 20 else 1] if t else [])] for i, t in enumerate(toxic)]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.concatenate(words).astype(np.uint64)
    model = toxicity.fit(toxic, row, flat, np.ones(len(flat), np.int64))
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    p = lambda ws: model.exceed(np.array([sum(weight.get(int(w), 0.0) for w in ws)]))[0, 0]
    assert all(p(w) >= 0.5 for w in words[:20]) and p(words[50]) >= 0.5
    assert sum(p(w) >= 0.5 for w in words[1_100:]) <= 60
