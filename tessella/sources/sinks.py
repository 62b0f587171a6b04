"""Sinks (S6, S8-S12): GeoJSON text, split by geometry type, appends,
full/delta outputs, table creation.

All writers are DataFrameWriter calls: Spark writes one file per task, so
output size never passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import SPARK_TYPES
from ..functions.wkt import to_wkt


def _xy_json(p):
    return F.array(p["x"], p["y"])


def geometry_geojson(g: Column | str) -> Column:
    """GeoJSON text of a geometry column (null for a null geometry)."""
    gc = F.col(g) if isinstance(g, str) else g
    t = gc["type"]
    parts = gc["parts"]
    ring_coords = lambda r: F.transform(r, _xy_json)
    coords = (
        F.when(t == "Point", F.to_json(_xy_json(parts[0][0][0])))
        .when(t == "MultiPoint", F.to_json(F.transform(parts, lambda pt: _xy_json(pt[0][0]))))
        .when(t == "LineString", F.to_json(ring_coords(parts[0][0])))
        .when(t == "MultiLineString", F.to_json(F.transform(parts, lambda pt: ring_coords(pt[0]))))
        .when(t == "Polygon", F.to_json(F.transform(parts[0], ring_coords)))
        .when(t == "MultiPolygon", F.to_json(F.transform(parts, lambda pt: F.transform(pt, ring_coords))))
    )
    return F.when(gc.isNull(), F.lit(None)).otherwise(
        F.concat(F.lit('{"type":"'), t, F.lit('","coordinates":'), coords, F.lit("}")))


def to_geojson_features(df: DataFrame, id_col: str | None, geom_col: str = "geometry",
                        limit: int | None = None, properties: list[str] | None = None) -> DataFrame:
    """One GeoJSON Feature string per row (``feature`` column).

    ``limit`` is the reference's optional max-features option (a feature of
    the export, not a sampling device). Properties exclude the geometry.
    """
    props = properties or [c for c in df.columns if c != geom_col]
    feat = F.concat(
        F.lit('{"type":"Feature",'),
        (F.concat(F.regexp_replace(F.to_json(F.struct(F.col(id_col).alias("id"))), r"^\{|\}$", ""), F.lit(","))
         if id_col else F.lit("")),
        F.lit('"properties":'), F.to_json(F.struct(*[F.col(c) for c in props])),
        F.lit(',"geometry":'), F.coalesce(geometry_geojson(geom_col), F.lit("null")),
        F.lit("}"))
    out = df.select(*([F.col(id_col)] if id_col else []), feat.alias("feature"))
    return out.limit(limit) if limit is not None else out


def write_geojson_lines(df: DataFrame, path: str, id_col: str | None, geom_col: str = "geometry",
                        limit: int | None = None, src_srid: int | None = None, dst_srid: int | None = None) -> None:
    """S12 sink: newline-delimited GeoJSON features (GeoJSONSeq), written
    in parallel, one file per task; optionally reprojected on the way out
    (``src_srid`` -> ``dst_srid``) and capped at ``limit`` features."""
    if src_srid and dst_srid and src_srid != dst_srid:
        from ..functions import geometry as G
        df = df.withColumn(geom_col, G.reproject_geometry(geom_col, src_srid, dst_srid))
    to_geojson_features(df, id_col, geom_col, limit).select("feature").write.mode("overwrite").text(path)


def split_by_geometry(df: DataFrame, geom_col: str = "geometry") -> DataFrame:
    """Tag every feature with its geometry type; missing -> ``Unknown``.
    Write with ``partitionBy('geometry_type')`` to get one layer per type."""
    return df.withColumn("geometry_type", F.coalesce(F.col(geom_col)["type"], F.lit("Unknown")))


def write_split_by_geometry(df: DataFrame, path: str, geom_col: str = "geometry") -> None:
    split_by_geometry(df, geom_col).write.mode("overwrite").partitionBy("geometry_type").parquet(path)


def append_layers(layers: dict[str, DataFrame], path: str) -> None:
    """First layer creates the output, following layers append; the
    layer name becomes a partition column."""
    for i, (name, df) in enumerate(layers.items()):
        (df.withColumn("layer", F.lit(name)).write
         .mode("overwrite" if i == 0 else "append").partitionBy("layer").parquet(path))


def full_output_path(base: str, table: str) -> str:
    """``<tbl>_full``."""
    return f"{base.rstrip('/')}/{table}_full"


def delta_output_path(base: str, table: str, now_iso: str) -> str:
    """``<tbl>_delta_<date>`` (first ten characters of the run time)."""
    return f"{base.rstrip('/')}/{table}_delta_{now_iso[:10]}"


def deletes_output_path(base: str, table: str, now_iso: str) -> str:
    """Deletes go to their own ``<tbl>_deletes`` output."""
    return f"{delta_output_path(base, table, now_iso)}/{table}_deletes"


def object_store_path(bucket: str, prefix: str, name: str, scheme: str = "s3a") -> str:
    """Outputs are written straight to the bucket by the executors."""
    p = prefix.strip("/")
    return f"{scheme}://{bucket}/{p + '/' if p else ''}{name}"


def layer_struct_type(fields: list[dict]):
    """StructType of a layer from its field rows; ``1..1``/``1..*`` are
    NOT NULL, ``*`` multiplicities become arrays. A relation that is no foreign
    key has no column."""
    from pyspark.sql import types as T
    out = []
    for f in fields:
        if f.get("kind") == "feature-ref" and f.get("relation_type", "foreign_key") != "foreign_key":
            continue
        dt = SPARK_TYPES.get(f.get("base_type") or "string", T.StringType())
        mult = f.get("multiplicity") or "0..1"
        if mult.endswith("*"):
            dt = T.ArrayType(dt)
        out.append(T.StructField(f["name"], dt, nullable=not mult.startswith("1")))
    return T.StructType(out)


def conform_rows(df: DataFrame, fields: list[dict], geom_col: str | None = None, geom_required: bool = False,
                 keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows of a layer as its table stores them, and those it must refuse.

    Rows: a column per field, in its type, the geometry as WKT, then ``keep``.
    A row is refused where a required field is null or an empty list (or absent from
    ``df``) or where a value cannot be read as its field's type; refused rows
    keep their columns as they came, with ``missing`` and ``mistyped``: the names
    of these fields. A geometry that has no text form is mistyped. Both come from one
    projection, without a shuffle."""
    from pyspark.sql import types as T
    made, missing, mistyped = {}, [], []
    for f in layer_struct_type(fields).fields:
        if f.name not in df.columns:
            made[f.name] = F.lit(None).cast(f.dataType)
        else:
            src = F.col(f"`{f.name}`")
            made[f.name] = src.try_cast(f.dataType)
            bad = src.isNotNull() & made[f.name].isNull()
            if isinstance(f.dataType, T.ArrayType):  # a null among the values is no fault, one that the cast makes is
                nulls = lambda a: F.size(F.filter(a, lambda x: x.isNull()))
                bad = bad | (nulls(made[f.name]) > nulls(src))
            mistyped.append(F.when(bad, F.lit(f.name)))
        if not f.nullable:
            gone = made[f.name].isNull() if f.name not in df.columns else F.col(f"`{f.name}`").isNull()
            if isinstance(f.dataType, T.ArrayType):
                gone = gone | (F.size(made[f.name]) == 0)
            missing.append(F.when(gone, F.lit(f.name)))
    if geom_col is not None:
        made[geom_col] = to_wkt(geom_col)
        mistyped.append(F.when(F.col(geom_col).isNotNull() & made[geom_col].isNull(), F.lit(geom_col)))
        if geom_required:
            missing.append(F.when(F.col(geom_col).isNull(), F.lit(geom_col)))
    none = F.array().cast("array<string>")
    faults = {"missing": F.array_compact(F.array(*missing)) if missing else none,
              "mistyped": F.array_compact(F.array(*mistyped)) if mistyped else none}
    fine = (F.size(faults["missing"]) == 0) & (F.size(faults["mistyped"]) == 0)
    rows = df.where(fine).select(*[c.alias(n) for n, c in made.items()], *keep)
    return rows, df.where(~fine).withColumns(faults)


def create_table(df: DataFrame, name: str, fields: list[dict] | None = None, pk: str | None = None,
                 is_abstract: bool = False, fmt: str = "parquet", geom_col: str | None = None, rejects: str | None = None) -> bool:
    """Create a lakehouse table from a layer; abstract layers are
    skipped; with no PK an identity ``fid`` is added (``monotonically_increasing_id``
    is unique without a shuffle, unlike ``row_number`` over a global window).

    With ``fields`` the table has their columns and types, NOT NULL where they are
    required (the key and ``fid`` too), and the geometry as WKT. Rows that break this
    (see ``conform_rows``) go to the table ``rejects``; without one the first such row
    ends the job, and no table is left. Spark's own catalog keeps no NOT NULL for file
    formats, so the property ``required`` names these columns as well."""
    if is_abstract:
        return False
    out = df if pk else df.withColumn("fid", F.monotonically_increasing_id())
    if not fields:
        out.writeTo(name).using(fmt).create()
        return True
    # the key is required, whatever its field says
    fields = [f | {"multiplicity": "1..1"} if f["name"] == pk else f for f in fields]
    rows, refused = conform_rows(out, fields, geom_col, keep=() if pk else ("fid",))
    if rejects is None and (first := refused.select("missing", "mistyped").first()):
        raise ValueError(f"{name}: a row lacks {first['missing']}, has no valid {first['mistyped']}")
    required = {f.name for f in layer_struct_type(fields).fields if not f.nullable} | {"fid"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{' NOT NULL' if f.name in required else ''}" for f in rows.schema.fields)
    names = ",".join(f.name for f in rows.schema.fields if f.name in required)
    df.sparkSession.sql(f"CREATE TABLE {name} ({ddl}) USING {fmt} TBLPROPERTIES ('required' = '{names}')")
    rows.write.insertInto(name)
    if rejects is not None:
        refused.write.format(fmt).saveAsTable(rejects)
    return True
