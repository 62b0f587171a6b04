"""Mapping a source layer onto a target model.

Every operator returns a lazy DataFrame; none collects rows. A value map given
as a table becomes a join against one row per source value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import broadcast_if_small


def map_fields(df: DataFrame, mapping: dict[str, str] | None, geom_col: str | None = None) -> DataFrame:
    """``"src" AS "target"`` for mapped properties only (plus the geometry
    column when given). With no mapped field the layer passes whole
    (``SELECT *``), as the executed path of the reference does."""
    if not mapping:
        return df
    cols = [F.col(s).alias(t) for s, t in mapping.items()]
    if geom_col and geom_col not in mapping:
        cols.append(F.col(geom_col))
    return df.select(*cols)


def _target_lit(v) -> Column:
    # an empty target maps the value to NULL; targets are text, whatever their Python type
    return F.lit(None if v is None or v == "" else str(v)).cast("string")


def value_case(col: str | Column, pairs: dict) -> Column:
    """F10 as a Column: ``CASE WHEN src='a' THEN 'b' ... ELSE src END``."""
    c = F.col(col) if isinstance(col, str) else col
    out = c.cast("string")
    for src, tgt in reversed(list(pairs.items())):
        out = F.when(c.cast("string") == F.lit(str(src)), _target_lit(tgt)).otherwise(out)
    return out


def map_values(df: DataFrame, field: str, pairs: dict | DataFrame, out_col: str | None = None,
               broadcast_rows: int = 1_000_000) -> DataFrame:
    """replace values of ``field`` by a value map.

    ``pairs`` is a dict (a CASE chain of its size) or a DataFrame
    ``(source_value, target_value[, ordinal])``. The result is text, and each row of
    ``df`` stays one row: of several pairs for one source value the first by
    ``ordinal`` counts (without that column, the smallest target). A value mapped to
    NULL or to an empty target becomes NULL, an unmapped one keeps its value.
    """
    out_col = out_col or field
    if isinstance(pairs, dict):
        return df.withColumn(out_col, value_case(field, pairs))
    target = F.col("target_value").cast("string")
    order = F.col("ordinal") if "ordinal" in pairs.columns else F.lit(0)
    m = pairs.where("source_value is not null").groupBy(F.col("source_value").cast("string").alias("_src")).agg(
        F.min(F.struct(order.alias("o"), target.alias("t"))).alias("_first"))
    m = m.select("_src", F.when(F.col("_first.t") != "", F.col("_first.t")).alias("_tgt"), F.lit(True).alias("_found"))
    m = broadcast_if_small(m, broadcast_rows)
    j = df.join(m, F.col(field).cast("string") == F.col("_src"), "left")
    mapped = F.when(F.col("_found"), F.col("_tgt")).otherwise(F.col(field).cast("string"))
    return j.withColumn(out_col, mapped).drop("_src", "_tgt", "_found")


def auto_map(source_columns: DataFrame, target_fields: DataFrame) -> DataFrame:
    """for each target field, the first source column (by ordinal) whose
    name equals, case-insensitively, the target's name or title.

    ``source_columns``: (layer_id, column_name, ordinal);
    ``target_fields``: (layer_id, field_id, name, title). Works for whole
    catalogs at once, by equi-joins.
    """
    s = source_columns.select("layer_id", "column_name", "ordinal",
                              F.lower("column_name").alias("_k"))
    t = target_fields.select("layer_id", "field_id", "name", "title")
    # one equi-join on (layer, lower-case key): a field asks by its name and by its title
    asks = t.withColumn("_k", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("title")))))
    first = s.groupBy("layer_id", "_k").agg(F.min(F.struct("ordinal", "column_name")).alias("_c"))
    j = asks.join(first, ["layer_id", "_k"], "left")
    return j.groupBy("layer_id", "field_id", "name").agg(F.min("_c").alias("_c")).select(
        "layer_id", "field_id", "name", F.col("_c.column_name").alias("source_column"))


def concrete_layers(layers: DataFrame) -> DataFrame:
    """layers that are not abstract (abstract ones get no table)."""
    return layers.filter(~F.coalesce(F.col("is_abstract"), F.lit(False)))


def fill_defaults(df: DataFrame, defaults: dict, omitted_only: bool = False) -> DataFrame:
    """a column's DEFAULT when the value is absent.

    SQL DEFAULT applies only when the column is omitted from the insert: with
    ``omitted_only=True`` a missing column is added with its default and
    present NULLs stay NULL; otherwise NULLs are filled too.
    """
    out = df
    for name, value in defaults.items():
        if name not in df.columns:
            out = out.withColumn(name, F.lit(value))
        elif not omitted_only:
            dt = df.schema[name].dataType
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(dt)))
    return out


def conform_schema(df: DataFrame, schema: T.StructType, key_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """cast every declared field to its type with ``try_cast``.

    Returns ``(conformed, rejects)``: rejects are ``key_cols + (field, value)``
    for each value that is not NULL in the source but NULL after the cast.
    Both come from one projection, so the source is read once per output.
    """
    casts = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields}
    conformed = df.select(*key_cols, *[casts[f.name].alias(f.name) for f in schema.fields if f.name not in key_cols])
    bad = F.array_compact(F.array(*[
        F.when(F.col(f.name).isNotNull() & casts[f.name].isNull(),
               F.struct(F.lit(f.name).alias("field"), F.col(f.name).cast("string").alias("value")))
        for f in schema.fields]))
    rejects = df.select(*key_cols, F.explode(bad).alias("_r")).select(*key_cols, "_r.field", "_r.value")
    return conformed, rejects


def conform_geometry(df: DataFrame, target_type: str, geom_col: str = "geometry") -> tuple[DataFrame, DataFrame]:
    """force the output geometry type (``-nlt``): a single type is
    promoted to its multi form, the same type passes, others are rejected.
    Returns ``(conformed, rejected)``."""
    t = F.col(geom_col)["type"]
    base = target_type[5:] if target_type.startswith("Multi") else target_type
    ok = t.isin(target_type, base)
    promoted = F.struct(F.lit(target_type).alias("type"), F.col(geom_col)["srid"].alias("srid"),
                        F.col(geom_col)["parts"].alias("parts"))
    return (df.filter(ok).withColumn(geom_col, promoted), df.filter(~ok | t.isNull()))
