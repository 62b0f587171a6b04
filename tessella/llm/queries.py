"""Registered queries of the training-data operators, and their DuckDB SQL.

Each query applies one operator, with production parameters, to a whole
table and derives digest columns from its output where its contract asks for
them. Operators without an entry in ``ORACLE`` are checked in ``tests/llm``
against brute force, an exact round trip or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import (
    cross_tokenizer,
    decontaminate,
    embedding,
    exact_dedup,
    hard_negatives,
    html_extract,
    line_dedup,
    pack_bfd,
    pack_local,
    quality,
    simhash,
    suffix_array,
    toxicity,
)

#: Fixed value: the vocabulary file named by the packing contract.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The two vocabulary files named by the alignment contract.
TOKENIZER_A = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER_B = public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf, "documents"))


def op2_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.embedding_dedup(table(spark, sf, "embeddings"))


def op3_token_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_bfd.packed(table(spark, sf, "documents"), TOKENIZER)


def op4_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract(table(spark, sf, "pages"))


def op5_suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffix_array.remove_repeats(table(spark, sf, "documents"), all_kept=True)
    # a cut may part a character: what is left of it reads as U+FFFD
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text.alias("text"))


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    hit = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return hit.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      decontaminate.is_contaminated().alias("contaminated"))


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels")))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.train(docs))


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = line_dedup.line_dedup(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", "n_spans", "text")


def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_local.pack(table(spark, sf, "documents"), TOKENIZER)


def op11_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf, "documents"), digest_all=True)


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings")
    label = F.col("label").cast("long")
    # the contract's labels; a null id or label stays null
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(vecs.select("vec_id", shifted.alias("label"), "embedding"))


def op13_cross_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    aligned = cross_tokenizer.alignments(table(spark, sf, "documents"), TOKENIZER_A, TOKENIZER_B)
    totals = cross_tokenizer.link_totals(aligned, cross_tokenizer.pair_counts(aligned))
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))
    docs = aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"))
    return docs.join(totals, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_embedding": op2_embedding,
    "op3_token_packing": op3_token_packing,
    "op4_html_extraction": op4_html_extraction,
    "op5_suffix_array": op5_suffix_array,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}

ORACLE: dict[str, str] = {
    "op6_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
pos AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM s))),
hit AS (SELECT r, i, pos.n, item FROM pos JOIN win ON pos.g = win.g AND pos.n = win.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op9_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
u AS (SELECT DISTINCT doc_id, text, l FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, i, array_to_string(l[i:i + 2], chr(10)) AS g
      FROM (SELECT doc_id, text, l, unnest(range(1, len(l) - 1)) AS i FROM u)),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, text, i) AS k FROM w
      WHERE regexp_matches(g, '[^\x00-\x20]')),
c AS (SELECT DISTINCT doc_id, text, unnest([i, i + 1, i + 2]) AS i FROM f WHERE k > 1),
k AS (SELECT u.doc_id, u.text, u.i, u.line, c.i IS NOT NULL AS gone,
             lag(c.i) OVER (PARTITION BY u.doc_id, u.text ORDER BY u.i) IS NOT NULL AS before
      FROM (SELECT doc_id, text, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM u) u
      LEFT JOIN c ON u.doc_id = c.doc_id AND u.text = c.text AND u.i = c.i),
s AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
             count(*) FILTER (gone AND NOT before) AS n_spans,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
      FROM k GROUP BY doc_id, text)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE n_lines END AS n_lines,
       coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept AS text
FROM d LEFT JOIN s ON d.doc_id = s.doc_id AND d.text = s.text""",
    "op11_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op12_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
      FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3""",
}

#: Queries that SQL cannot express, and where they are checked instead.
NO_ORACLE_REASON: dict[str, str] = {
    "op1_simhash": "XXH64 and connected components; brute force in tests/llm",
    "op2_embedding": "an index with a recall below one, and components; brute force in tests/llm",
    "op3_token_packing": "a tokenizer; exact round trip in tests/llm",
    "op4_html_extraction": "inferred wrappers; pages with known text in tests/llm",
    "op5_suffix_array": "suffixes of whole texts; brute force in tests/llm",
    "op7_toxicity": "a trained model; held-out labels in tests/llm",
    "op8_quality": "a trained model; held-out labels in tests/llm",
    "op10_best_fit_packing": "a tokenizer; round trip and lower bound in tests/llm",
    "op13_cross_tokenizer": "two tokenizers; brute force in tests/llm",
}
