"""Small plan helpers shared by the operators."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (file sizes after
    pruning for scans, upper bounds through projections and joins)."""
    try:
        v = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(v) if isinstance(v, int) else int(v.toString())
    except Exception:  # noqa: BLE001 - no estimate available: treat as unknown
        return None


def counted_rows(df: DataFrame, max_rows: int) -> int:
    """Row count, stopping once it exceeds ``max_rows``."""
    return df.limit(max_rows + 1).count()


def measured_bytes(df: DataFrame) -> int:
    """Sum of the rows' real sizes: strings, arrays and structs by their text
    form, other columns by 16 bytes. One aggregate over the (counted) rows."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("array", "struct", "map"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        elif f.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        else:
            size = size + 16
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                       max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind proven bounds: at most ``max_rows`` rows
    (counted, stopping at ``max_rows + 1``) whose measured size stays under
    ``max_bytes``. For a plain scan Catalyst's size estimate (file sizes) can say
    no before any counting. Otherwise the join is left to the planner (sort-merge,
    which AQE may still convert at runtime from measured shuffle sizes)."""
    est = estimated_bytes(df)
    if est is not None and est > 8 * max_bytes:
        return df
    if counted_rows(df, max_rows) > max_rows or measured_bytes(df) > max_bytes:
        return df
    return F.broadcast(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the session's shared checkpoint folder and read back: computed
    once however often it is read, column by column."""
    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tessella-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, within: list[str], order: list[Column], name: str, first: int = 1,
             buckets: int | None = None) -> DataFrame:
    """``row_number() over (partition by within order by order)`` from ``first`` on (``order``:
    values in ascending order, NULLs first; negate a number to descend), without a task per group: rows are dealt out by range over group and order and written
    down once, numbered inside each range, and each range adds the rows its group has in the
    ranges before it. Those counts are one row per group and range that meet, at most
    groups + ranges rows. Rows equal in group and order get one of their numbers each, any of them.
    """
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    dealt = (df.withColumns(keys).repartitionByRange(n, *[F.col(c) for c in within], *[F.col(k) for k in keys])
             .withColumn("_range", F.spark_partition_id()).checkpoint(eager=True))
    here = Window.partitionBy(*within, "_range").orderBy(*keys)
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)], F.col("_range").alias("_at"), "_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(within)] + [F.col("_range") == F.col("_at")]
    return (dealt.withColumn("_row", F.row_number().over(here)).join(starts, reduce(and_, same))
            .withColumn(name, F.col("_start") + F.col("_row") + (first - 1))
            .select(*df.columns, name))
