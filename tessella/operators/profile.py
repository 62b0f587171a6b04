"""Layer profiling.

Per-layer figures are single aggregations (partial aggregates per task,
one tiny merge); multi-layer results are unions of one-row frames. Value
listings unpivot all fields at once so a layer is scanned once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DISTINCT_VALUES_LIMIT = 50   # fixed value: distinct values listed per field
SAMPLE_FEATURES = 100        # fixed value: features sampled for value mapping


def layer_profile(name: str, df: DataFrame, geom_col: str | None = None, pk: str | None = None) -> DataFrame:
    """A1: one row of a layer's metadata, measured in one aggregate: feature
    count, column count (geometry column excluded), geometry type, srid, key.

    ``geometry_type``: the one type that all geometries have, its multi form where
    single and multi mix, else ``Geometry``; ``srid``: theirs if they agree, else
    NULL (``quality.srid_mismatch`` says which there are). ``pk``: the given column, or
    else the first whole-number column without NULLs or repeats, else NULL. A column
    with a range below its row count has repeats; the others are counted by value,
    one after the other until one has none, so the layer is read here.
    """
    from pyspark.sql import types as T
    cols = [f for f in df.schema.fields if f.name != geom_col]
    aggs = [F.count(F.lit(1)).alias("feature_count")]
    if geom_col:
        g = F.col(geom_col)
        aggs += [F.min(g["type"]).alias("_t0"), F.max(g["type"]).alias("_t1"), F.min(F.regexp_replace(g["type"], "^Multi", "")).alias("_b0"),
                 F.max(F.regexp_replace(g["type"], "^Multi", "")).alias("_b1"), F.min(g["srid"]).alias("_s0"), F.max(g["srid"]).alias("_s1")]
    whole = [f.name for f in cols if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))] if pk is None else []
    for i, c in enumerate(whole):
        aggs += [F.count(c).alias(f"_n{i}"), F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}")]
    kind = F.lit(None).cast("string")
    srid = F.lit(None).cast("int")
    if geom_col:
        kind = F.when(F.col("_t0") == F.col("_t1"), F.col("_t0")).when(
            F.col("_b0") == F.col("_b1"), F.concat(F.lit("Multi"), "_b0")).when(F.col("_t0").isNotNull(), F.lit("Geometry"))
        srid = F.when(F.col("_s0") == F.col("_s1"), F.col("_s0"))
    key = F.lit(pk).cast("string")
    row = df.agg(*aggs)
    if whole:
        got = row.collect()
        row = df.sparkSession.createDataFrame(got, row.schema)
        n = got[0]["feature_count"]
        full = [c for i, c in enumerate(whole) if got[0][f"_n{i}"] == n and (n == 0 or got[0][f"_hi{i}"] - got[0][f"_lo{i}"] >= n - 1)]
        key = F.lit(next((c for c in full if not _repeats(df, c)), None)).cast("string")
    return row.select(
        F.lit(name).alias("layer"), "feature_count", F.lit(len(cols)).alias("column_count"), kind.alias("geometry_type"),
        srid.cast("int").alias("srid"), key.alias("pk"))


def _repeats(df: DataFrame, col: str) -> bool:
    """Whether a value of the column stands in two rows."""
    return not df.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def layer_extent(name: str, df: DataFrame, cols=("min_x", "min_y", "max_x", "max_y")) -> DataFrame:
    """A2: min/max x, y of one layer (NaN ignored)."""
    clean = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
    minx, miny, maxx, maxy = cols
    return df.agg(F.min(clean(minx)).alias("min_x"), F.min(clean(miny)).alias("min_y"),
                  F.max(clean(maxx)).alias("max_x"), F.max(clean(maxy)).alias("max_y")) \
        .select(F.lit(name).alias("layer"), "*")


def global_extent(extents: DataFrame) -> DataFrame:
    """A3: running min/max across layer extents, NaN and NULL ignored."""
    clean = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
    return extents.agg(F.min(clean("min_x")).alias("min_x"), F.min(clean("min_y")).alias("min_y"),
                       F.max(clean("max_x")).alias("max_x"), F.max(clean("max_y")).alias("max_y"))


def geometry_type_set(df: DataFrame, geom_col: str = "geometry") -> DataFrame:
    """A4: distinct geometry types with counts; ``mixed`` when more than one."""
    t = df.groupBy(F.coalesce(F.col(geom_col)["type"], F.lit("Unknown")).alias("geometry_type")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("mixed", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > 1)


def _unpivot_strings(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value) with every field cast to string; one scan for all fields."""
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
                                  for f in fields]))
    return df.select(stacked.alias("_fv")).select("_fv.field", "_fv.value")


def distinct_values(df: DataFrame, fields: list[str] | None = None,
                    limit: int | None = DISTINCT_VALUES_LIMIT) -> DataFrame:
    """A5: up to ``limit`` distinct values per field (None: all), as strings,
    NULL and '' dropped, smallest first (a deterministic choice; the reference
    takes the database's order). ``n_distinct`` says how many there are and
    ``truncated`` whether some are not listed.

    Plan: distinct (field, value) pairs, shuffled on the pair, so one field
    with huge cardinality still spreads over all tasks; then
    ``row_number() <= limit`` per field, for which Spark places a partial
    top-``limit`` (``WindowGroupLimit``) in every task before the shuffle by
    field, so that shuffle carries at most ``limit`` rows per field and task.
    The counts are a partial aggregate, a row per field.
    """
    fields = fields or df.columns
    pairs = _unpivot_strings(df, fields).filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct()
    counts = pairs.groupBy("field").agg(F.count(F.lit(1)).alias("n_distinct"))
    w = Window.partitionBy("field").orderBy("value")
    ranked = pairs.withColumn("rank", F.row_number().over(w))
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    more = F.lit(False) if limit is None else F.col("n_distinct") > limit
    # a row per field of a stated list of columns
    return ranked.join(F.broadcast(counts), "field").withColumn("truncated", more)


def sampled_values(df: DataFrame, pk: str, fields: list[str] | None = None,
                   sample: int = SAMPLE_FEATURES, limit: int = DISTINCT_VALUES_LIMIT) -> DataFrame:
    """Distinct values of the first ``sample`` features by PK (top-k, no
    global sort), then A5 on them."""
    first = df.orderBy(F.col(pk).asc_nulls_last()).limit(sample)
    return distinct_values(first, [f for f in (fields or df.columns)], limit)


# ---- A7: type inference ----

def infer_types(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """A7 whole-column mode: for each field, ``integer`` if every non-null
    value parses as an integer, else ``number`` if every one parses as a
    number, else ``boolean`` if every one is true/false, else ``string``.
    Stricter than the reference, which looks at the first feature only."""
    fields = fields or df.columns
    sums = []
    for i, f in enumerate(fields):
        v = F.trim(F.col(f).cast("string"))
        number = v.try_cast("double").isNotNull() & v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        sums += [F.count(F.col(f)).alias(f"n{i}"), F.count_if(v.rlike(r"^[+-]?[0-9]+$")).alias(f"i{i}"),
                 F.count_if(number).alias(f"f{i}"), F.count_if(F.lower(v).isin("true", "false")).alias(f"b{i}")]
    # one pass and one row for all fields; the row is then turned on its side
    kinds = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n{i}").alias("n"), F.when(
        F.col(f"i{i}") == F.col(f"n{i}"), "integer").when(F.col(f"f{i}") == F.col(f"n{i}"), "number").when(
        F.col(f"b{i}") == F.col(f"n{i}"), "boolean").otherwise("string").alias("base_type")) for i, f in enumerate(fields)])
    return df.agg(*sums).select(F.inline(kinds)).where("n > 0").select("field", "base_type")


def json_field_types(df: DataFrame, json_col: str) -> DataFrame:
    """A7 on a JSON text column (GeoJSON-style properties).

    Values are parsed as VARIANT so JSON numbers, booleans and strings keep
    their JSON type; a number is ``integer`` when it has no fractional part
    (JavaScript ``Number.isInteger``). ``mode='all'``: a key's type holds for
    every row (mixed -> string, integer+number -> number); ``mode='first'``:
    the type of the key in the row with the smallest ordinal, as the reference
    does with the first feature.
    """
    kv = df.select(F.explode(F.from_json(F.col(json_col), "map<string,variant>")).alias("key", "v"))
    sch = F.schema_of_variant(F.col("v"))
    num = F.expr("try_variant_get(v, '$', 'double')")
    t = (F.when(sch.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
         .when(sch.startswith("DECIMAL") | sch.isin("DOUBLE", "FLOAT"),
               F.when(num == F.floor(num), "integer").otherwise("number"))
         .when(sch == "BOOLEAN", "boolean")
         .otherwise("string"))
    typed = kv.select("key", t.alias("t"))
    return typed.groupBy("key").agg(
        F.when(F.count_if(F.col("t") == "string") > 0, "string")
        .when((F.count_if(F.col("t") == "boolean") > 0)
              & (F.count_if(F.col("t") == "boolean") < F.count(F.lit(1))), "string")
        .when(F.count_if(F.col("t") == "boolean") > 0, "boolean")
        .when(F.count_if(F.col("t") == "number") > 0, "number")
        .otherwise("integer").alias("base_type"))


def json_field_types_first(df: DataFrame, json_col: str, order_col: str) -> DataFrame:
    """A7 parity mode: key types taken from the first feature (smallest
    ``order_col``), found with a top-1, not a sort."""
    first = df.orderBy(F.col(order_col).asc_nulls_last()).limit(1)
    kv = first.select(F.explode(F.from_json(F.col(json_col), "map<string,variant>")).alias("key", "v"))
    sch = F.schema_of_variant(F.col("v"))
    num = F.expr("try_variant_get(v, '$', 'double')")
    return kv.select("key", (F.when(sch.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
                             .when(sch.startswith("DECIMAL") | sch.isin("DOUBLE", "FLOAT"),
                                   F.when(num == F.floor(num), "integer").otherwise("number"))
                             .when(sch == "BOOLEAN", "boolean").otherwise("string")).alias("base_type"))


def null_profile(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """NULL count and ratio per field in one pass; a field with no NULL
    is inferred required (``1..1``), otherwise ``0..1``."""
    fields = fields or df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f).isNull()).alias(f"_null_{i}")
                                                 for i, f in enumerate(fields)])
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_null_{i}").alias("nulls"))
                                  for i, f in enumerate(fields)]))
    return row.select("_n", stacked.alias("s")).select(
        "s.field", "s.nulls",
        F.when(F.col("_n") > 0, F.col("s.nulls") / F.col("_n")).otherwise(F.lit(0.0)).alias("null_ratio"),
        F.when(F.col("s.nulls") == 0, "1..1").otherwise("0..1").alias("multiplicity"))


def validity_summary(name: str, df: DataFrame, valid_col) -> DataFrame:
    """Total, invalid, ``round(100*valid/total)`` (JS rounding), 100 when empty."""
    v = F.col(valid_col) if isinstance(valid_col, str) else valid_col
    agg = df.agg(F.count(F.lit(1)).alias("total_features"),
                 F.coalesce(F.sum(F.when(v, 0).otherwise(1)), F.lit(0)).alias("invalid_count"))
    pct = F.when(F.col("total_features") > 0,
                 F.floor((F.col("total_features") - F.col("invalid_count")) * 100.0 / F.col("total_features") + 0.5)
                 ).otherwise(F.lit(100)).cast("int")
    return agg.select(F.lit(name).alias("layer"), "total_features", "invalid_count", pct.alias("valid_percent"))


def issue_counts(issues: DataFrame, layer_col: str = "layer_id") -> DataFrame:
    """A10: issues per layer; model-level issues under ``__model__``."""
    return issues.groupBy(F.coalesce(F.col(layer_col), F.lit("__model__")).alias("layer")) \
        .agg(F.count(F.lit(1)).alias("issues"))


def change_stats(changes: DataFrame, type_col: str = "change_type") -> DataFrame:
    """Added / modified / deleted / total in one aggregate."""
    t = F.col(type_col)
    return changes.agg(F.count_if(t == "added").alias("added"), F.count_if(t == "modified").alias("modified"),
                       F.count_if(t == "deleted").alias("deleted"), F.count(F.lit(1)).alias("total"))


def group_columns_by_table(columns: DataFrame, table_col: str = "table_name",
                           ordinal_col: str = "ordinal_position") -> DataFrame:
    """One row per table with its columns as an ordered array."""
    others = [c for c in columns.columns if c not in (table_col,)]
    return columns.groupBy(table_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(ordinal_col), *[F.col(c) for c in others
                                                                    if c != ordinal_col]))).alias("columns"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
