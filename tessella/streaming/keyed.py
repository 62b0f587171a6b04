"""Change classification with Structured Streaming's own keyed state.

Upsert sources (rows that are inserts or updates, optionally flagged as
deletes) are classified per key against the last content hash of that key,
which Spark keeps in its state store: partitioned by key over the shuffle
partitions, versioned with the query checkpoint and restored after executor
or driver loss, so every key's state survives restarts and each batch's
output is written exactly once by the file sink.

The hash is computed JVM-side (``xxhash64``); only the batch's rows of one
key reach Python, Arrow batch by Arrow batch (``applyInPandasWithState``), of which
the last row so far is kept. The store is RocksDB with a changelog unless the
session names another: keys live on disk, and a batch writes the keys it touches.
"""

from __future__ import annotations

from typing import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cdc import CHANGE_COL, DELETE, INSERT, UPDATE, content_digest, row_hash

STATE_T = "row_hash long"


# Spark's default, which keeps all keys of a partition in memory
HDFS_PROVIDER = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _place(row) -> tuple:
    import pandas as pd
    known = not pd.isna(row["_ord"])
    return known, row["_ord"] if known else 0, row["_tie"]


def classify_changes(stream: DataFrame, pk: str, hash_cols: list[str], order_col: str | None = None,
                     delete_col: str | None = None) -> DataFrame:
    """Streaming DataFrame of change rows: the latest row of each key in the
    batch with ``_change_type`` insert / update / delete; unchanged rows
    (same hash as the stored one) and deletes of unknown keys are dropped.

    The latest row is the one of the greatest ``order_col`` (NULLs lowest). Of
    rows that tie, all of them without ``order_col``, the one with the greatest
    digest of its content is taken, so a batch run again gives the same rows."""
    keep = [c for c in stream.columns if c != delete_col]
    src = stream.withColumn("_hash", row_hash(hash_cols))
    if delete_col:
        src = src.withColumn("_del", F.coalesce(F.col(delete_col).cast("boolean"), F.lit(False)))
    else:
        src = src.withColumn("_del", F.lit(False))
    if order_col:
        src = src.withColumn("_ord", F.col(order_col))
    else:
        src = src.withColumn("_ord", F.lit(0))
    src = src.withColumn("_tie", content_digest(stream.columns)).select(*keep, "_hash", "_del", "_ord", "_tie")
    out_schema = T.StructType([f for f in stream.schema.fields if f.name != delete_col]
                              + [T.StructField(CHANGE_COL, T.StringType())])
    fields = [f.name for f in out_schema.fields]

    def step(key, pdfs: Iterator, state) -> Iterator:
        import pandas as pd
        last = None
        for pdf in pdfs:     # a key may have any number of rows: one batch at a time
            row = pdf.sort_values(["_ord", "_tie"], na_position="first").iloc[-1]
            if last is None or _place(row) > _place(last):
                last = row
        known = state.exists
        old = state.get[0] if known else None
        if bool(last["_del"]):
            if known:
                state.remove()
                out = {c: None for c in fields}
                out[pk] = last[pk]
                out[CHANGE_COL] = DELETE
                yield pd.DataFrame([out], columns=fields)
            return
        new = int(last["_hash"])
        state.update((new,))
        if known and old == new:
            return
        out = {c: last[c] for c in keep}
        out[CHANGE_COL] = UPDATE if known else INSERT
        yield pd.DataFrame([out], columns=fields)

    return src.groupBy(pk).applyInPandasWithState(step, out_schema, STATE_T, "append", "NoTimeout")


def stream_changes_stateful(spark: SparkSession, landing_dir: str, schema: T.StructType | str, pk: str,
                            hash_cols: list[str], out_path: str, checkpoint_dir: str,
                            order_col: str | None = None, delete_col: str | None = None, fmt: str = "parquet",
                            available_now: bool = False, interval_seconds: int = 86400):
    """Start the stateful classification stream writing change rows to
    ``out_path`` (file sink, exactly-once with the checkpoint)."""
    stream = spark.readStream.schema(schema).format(fmt).load(landing_dir)
    changes = classify_changes(stream, pk, hash_cols, order_col, delete_col)
    w = (changes.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{int(interval_seconds)} seconds")
    # the query takes the session's settings as they are at its start, a restarted one those of its checkpoint
    unset = {} if spark.conf.get(next(iter(ROCKSDB)), None) not in (None, HDFS_PROVIDER) else ROCKSDB
    before = {k: spark.conf.get(k, None) for k in unset}
    for k, v in unset.items():
        spark.conf.set(k, v)
    try:
        return w.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
