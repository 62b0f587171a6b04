"""The reference's two data lifecycles as composed Spark jobs.

Entry 1, import (file in -> profiled model): one summary row per layer with
feature count, column count, geometry type, SRID, PK, extent and the PK
checks, plus the global extent and the import verdict. Per layer, count,
extent and NULL-key count come from ONE aggregate pass; duplicate keys need
the keyed aggregation (partial counts combined map-side).

Entry 2, transform (mapping -> output): field mapping, value maps,
reprojection, geometry-type conform, then append to the output, all lazy
Column work per layer ending in one write.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import mapping as M
from ..operators import quality as C


@dataclass
class LayerSource:
    df: DataFrame
    geometry_type: str | None = None
    srid: int | None = None
    pk: str | None = None
    geom_col: str | None = None
    bbox_cols: tuple[str, str, str, str] | None = None   # (min_x, min_y, max_x, max_y)


def layer_summary(name: str, src: LayerSource) -> DataFrame:
    """Entry 1 for one layer: a single aggregate for count, extent and NULL
    keys; a keyed aggregate for duplicate keys; schema checks from metadata."""
    df = src.df
    cols = [c for c in df.columns if c != src.geom_col and (not src.bbox_cols or c not in src.bbox_cols)]
    aggs = [F.count(F.lit(1)).alias("feature_count")]
    if src.bbox_cols:
        clean = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
        aggs += [F.min(clean(src.bbox_cols[0])).alias("min_x"), F.min(clean(src.bbox_cols[1])).alias("min_y"),
                 F.max(clean(src.bbox_cols[2])).alias("max_x"), F.max(clean(src.bbox_cols[3])).alias("max_y")]
    else:
        aggs += [F.lit(None).cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    has_pk = bool(src.pk) and src.pk in df.columns
    aggs.append(F.count_if(F.col(src.pk).isNull()).alias("null_pk") if has_pk else F.lit(None).cast("long").alias("null_pk"))
    one = df.agg(*aggs)
    if has_pk:
        dup = df.groupBy(src.pk).agg(F.count(F.lit(1)).alias("n")).agg(
            F.count_if(F.col("n") > 1).alias("duplicate_pk_groups"))
        # combine the two one-row results: union, then take the non-null value per column
        both = one.unionByName(dup, allowMissingColumns=True)
        one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    else:
        one = one.withColumn("duplicate_pk_groups", F.lit(None).cast("long"))
    schema_issues = C.pk_schema_issues(name, df.schema, src.pk)
    schema_error = any(i["severity"] == "error" for i in schema_issues)
    schema_warning = any(i["severity"] == "warning" for i in schema_issues)
    errors = (F.lit(1 if schema_error else 0) + F.when(F.coalesce(F.col("null_pk"), F.lit(0)) > 0, 1).otherwise(0)
              + F.when(F.coalesce(F.col("duplicate_pk_groups"), F.lit(0)) > 0, 1).otherwise(0))
    return one.select(
        F.lit(name).alias("layer"), "feature_count", F.lit(len(cols)).alias("column_count"),
        F.lit(src.geometry_type).cast("string").alias("geometry_type"), F.lit(src.srid).cast("int").alias("srid"),
        F.lit(src.pk).cast("string").alias("pk"), "min_x", "min_y", "max_x", "max_y", "null_pk",
        "duplicate_pk_groups", errors.alias("n_errors"), F.lit(1 if schema_warning else 0).alias("n_warnings"))


def import_summary(layers: dict[str, LayerSource]) -> tuple[DataFrame, DataFrame]:
    """Entry 1: (per-layer summary, one-row global extent + verdict)."""
    from functools import reduce
    rows = reduce(lambda a, b: a.unionByName(b), [layer_summary(n, s) for n, s in layers.items()])
    total = rows.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"),
                     F.max("max_y").alias("max_y"), (F.sum("n_errors") == 0).alias("is_valid"),
                     F.count(F.lit(1)).alias("layers"))
    return rows, total


@dataclass
class LayerMapping:
    field_map: dict[str, str] = field(default_factory=dict)          # source -> target
    value_maps: dict[str, dict] = field(default_factory=dict)        # target field -> {source value: target}
    src_srid: int | None = None
    dst_srid: int | None = None
    geometry_type: str | None = None                                  # forced output type (-nlt)
    geom_col: str = "geometry"


def transform_layer(df: DataFrame, m: LayerMapping) -> tuple[DataFrame, DataFrame]:
    """Entry 2 for one layer: (conformed rows, rejected rows)."""
    has_geom = m.geom_col in df.columns
    out = M.map_fields(df, m.field_map, m.geom_col if has_geom else None)
    for target, pairs in m.value_maps.items():
        out = M.map_values(out, target, pairs)
    if has_geom and m.src_srid and m.dst_srid and m.src_srid != m.dst_srid:
        out = out.withColumn(m.geom_col, G.reproject_geometry(m.geom_col, m.src_srid, m.dst_srid))
    if has_geom and m.geometry_type:
        return M.conform_geometry(out, m.geometry_type, m.geom_col)
    return out, out.limit(0)


def transform_layers(layers: dict[str, tuple[DataFrame, LayerMapping]], path: str) -> dict[str, DataFrame]:
    """Entry 2 for several layers appended to one output (first layer
    creates, the rest append; the layer name is a partition column).
    Returns the rejected rows per layer (lazy)."""
    rejected = {}
    for i, (name, (df, m)) in enumerate(layers.items()):
        ok, bad = transform_layer(df, m)
        (ok.withColumn("layer", F.lit(name)).write.mode("overwrite" if i == 0 else "append")
         .partitionBy("layer").parquet(path))
        rejected[name] = bad
    return rejected
