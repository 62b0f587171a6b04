"""Exact duplicates by progressive refinement (operator 11).

Rows are grouped by length, those whose length repeats by a hash of their first
bytes, and those that still share a group by the SHA-256 of the whole text.
Whatever is alone in its group after a step has no copy and goes no further.

No text is shuffled and none is collected: a step hands on which groups repeat
as a *sieve*, a bitmap of fixed size (``bitmap_construct_agg``) that is
broadcast. Two groups may share a bit, so a row that is alone may pass, and is
told apart by the full hash; a row with a copy always passes. On a corpus with more
repeated groups than bits the sieve lets everything through: the full hash is
then taken of every text, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of a text that the second step hashes.
PREFIX_BYTES = 64
#: Bits of a sieve: 8 MB, whatever the corpus.
SIEVE_BITS = 1 << 26
#: Bits of one bitmap of Spark's bitmap functions (fixed there).
_BITMAP = 32768


def _bit(key: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits)) + 1


def sieve(rows: DataFrame, key: list[str], bits: int = SIEVE_BITS) -> DataFrame:
    """Bitmaps (``sieve_no``, ``sieve_map``) of the values of ``key`` that more than one row has."""
    bit = _bit([F.col(k) for k in key], bits)
    return (rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select(F.bitmap_bucket_number(bit).alias("sieve_no"), F.bitmap_bit_position(bit).alias("at"))
            .groupBy("sieve_no").agg(F.bitmap_construct_agg("at").alias("sieve_map")))


def with_repeats(rows: DataFrame, key: list[Column], sieved: DataFrame, name: str, bits: int = SIEVE_BITS) -> DataFrame:
    """``rows`` with a column ``name``: false only where no other row has the same key."""
    bit = _bit(key, bits)
    at = F.bitmap_bit_position(bit)
    byte = F.substring(F.col("sieve_map"), (at / 8).cast("int") + 1, F.lit(1))
    is_set = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    found = rows.withColumn("sieve_no", F.bitmap_bucket_number(bit)).join(F.broadcast(sieved), "sieve_no", "left")
    return found.withColumn(name, F.coalesce(is_set, F.lit(False))).drop("sieve_no", "sieve_map")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False,
                prefix_bytes: int = PREFIX_BYTES, bits: int = SIEVE_BITS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep_id`` (largest id of the rows
    with the same text), ``group_size``, ``kept`` and ``text_sha256`` (of rows that
    reached the last step; of every row with ``digest_all``).

    A null text is an empty one. Null ids count as smaller than any other, and
    ``keep_id`` is null in a group of null ids alone. Of rows that share the
    largest id and the text, one is kept. An empty table gives no rows; other
    columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    length, prefix = F.octet_length("body").cast("long"), F.xxhash64(F.substring("body", 1, prefix_bytes))

    # lengths and prefixes of all rows: 16 bytes each, from one read of the texts
    keys = materialize(src.select(length.alias("length"), prefix.alias("prefix")), "keys")
    by_length = sieve(keys, ["length"], bits)
    longer = with_repeats(keys, [F.col("length")], by_length, "again", bits).filter("again")
    by_prefix = materialize(sieve(longer, ["length", "prefix"], bits), "sieve")

    again = with_repeats(src.withColumns({"length": length, "prefix": prefix}),
                         [F.col("length"), F.col("prefix")], by_prefix, "again", bits)
    full = F.sha2("body", 256)
    rows = materialize(again.select(
        "id", F.monotonically_increasing_id().alias("row"), "again",
        (full if digest_all else F.when(F.col("again"), full)).alias("sha")), "rows")

    # groups are few rows beside their members: written down, so that the join can split a hot one's members
    groups = materialize(
        rows.filter("again").groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("last"))
        .filter("n > 1"), "groups")
    alone = rows.filter("NOT again").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    copies = rows.filter("again").join(groups, "sha", "left").select(
        F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("last.row"))).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(copies)
