"""Small inputs and brute-force versions shared by the operator tests."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string"
#: As DOC_SCHEMA, with extra columns whose names the operators use themselves.
CLASH_SCHEMA = (
    "doc_id long, text string, id long, key string, fp string, component_id string, score string, good string, n_lines string, "
    "n_removed string, lines string, runs string, items string, n_words string, length string, start string, doc string, host string")


def clash(spark, rows):
    extra = CLASH_SCHEMA.count(",") - 1
    return spark.createDataFrame([(i, t, *[7] * 1, *["x"] * (extra - 1)) for i, t in rows], CLASH_SCHEMA)


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size):x}" for _ in range(n)]


def odd_rows() -> list[tuple[int | None, str | None]]:
    """Null ids and texts, empty and blank texts, repeated rows, one id with two
    texts, odd characters and a long text."""
    rng = random.Random(5)
    long = " ".join(words(rng, 40_000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "two words"), (6, "a b c d e"), (None, "a b c d e"),
        (None, None), (7, "first text of seven"), (7, "other text of the same id"), (8, "É   ß 日本 \x00 x"), (9, long),
        (10, long + " end"), (-3, "Negative ID a B C"), (11, "line\nline\nline\nline\nline"), (12, "a" * 3000),
    ]


def components(nodes, pairs) -> dict:
    """Smallest node reachable from each node."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
