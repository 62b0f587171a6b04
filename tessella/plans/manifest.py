"""Export manifest (M1-M4): one catalog item per written output file.

Files are listed and hashed by Spark's ``binaryFile`` source, one task per
file, so checksums of a large export are computed in parallel and only the
item rows (one per file) exist afterwards. A file is loaded whole into its
task; keep output part files well under 2 GB (``maxRecordsPerFile``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

# The world box used when a model has no extent.
WORLD_BBOX = (-180.0, -90.0, 180.0, 90.0)


def default_bbox(west: Column, south: Column, east: Column, north: Column, parity: bool = False) -> Column:
    """M2: the metadata extent, else the world box, per corner.

    ``parity=True`` keeps the reference's ``parseFloat(x) || default``: a
    true 0 (or an unparseable value) is replaced by the default, too."""
    out = []
    for c, d in zip((west, south, east, north), WORLD_BBOX):
        v = c.try_cast("double")
        bad = v.isNull() | F.isnan(v) | ((v == 0) if parity else F.lit(False))
        out.append(F.when(bad, F.lit(d)).otherwise(v))
    return F.array(*out)


# Version and extensions that an item names.
ITEM_VERSION = "1.0.0"
ITEM_EXTENSIONS = tuple(f"https://stac-extensions.github.io/{x}/schema.json" for x in ("timestamps/v1.1.0", "projection/v1.1.0", "file/v2.1.0"))
#: Media types of assets by the ending of the file.
MEDIA_TYPES = {"parquet": "application/vnd.apache.parquet", "json": "application/geo+json", "txt": "application/geo+json-seq", "csv": "text/csv"}


def _file_key(path: Column) -> Column:
    """A file's path in one spelling (``file:/x`` and ``file:///x`` are the same)."""
    return F.regexp_replace(path, "^([a-zA-Z][a-zA-Z0-9+.-]*):/{2,}(?=[^/]*/?)", "$1:/")


def file_extents(spark: SparkSession, output_path: str, geom_col: str = "geometry", epsg: int = 4326) -> DataFrame:
    """(file, bbox) of every Parquet file under ``output_path``: the box, of the
    points brought to WGS84, of the geometries that it really holds. One scan of the geometry column, aggregated
    by file before its shuffle of a row per task and file. Null and empty geometries
    and NaN coordinates have no box; a file with nothing else has a null one."""
    geometry = F.col(geom_col) if epsg in G.GEOGRAPHIC else G.reproject_geometry(geom_col, epsg, 4326)
    g = spark.read.option("recursiveFileLookup", "true").parquet(output_path).select(
        _file_key(F.col("_metadata.file_path")).alias("file"), geometry["parts"].alias("parts"))
    g = g.select("file", F.flatten(F.flatten("parts")).alias("p"))
    real = F.filter("p", lambda q: ~F.isnan(q["x"]) & ~F.isnan(q["y"]))
    x, y = F.transform(real, lambda q: q["x"]), F.transform(real, lambda q: q["y"])
    box = g.groupBy("file").agg(F.min(F.array_min(x)).alias("x0"), F.min(F.array_min(y)).alias("y0"),
                                F.max(F.array_max(x)).alias("x1"), F.max(F.array_max(y)).alias("y1"))
    return box.select("file", F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1")).alias("bbox"))


def export_manifest(spark: SparkSession, output_path: str, layer: str, export_type: str, epsg: int,
                    bbox: Column | None = None, created: str | None = None, glob: str = "*.parquet",
                    collection_id: str = "exports", geom_col: str | None = None, public_base: str = ".") -> DataFrame:
    """M1: one item row per output file under ``output_path``: id, href,
    size, ``sha256:`` checksum, created, epsg, export type, layer, bbox, and
    the item as JSON text (``item_json``, with its links and its asset).

    With ``geom_col`` each file's box is measured (``file_extents``); a file without
    geometries, and an export without ``geom_col``, takes ``bbox``, or else the world box.
    ``created`` is the file's own time unless given, so that a second run over the same
    files gives the same items. ``public_base`` is what the asset's link begins with."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(output_path))
    made = F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    checksum = F.concat(F.lit("sha256:"), F.sha2(F.col("content"), 256))
    given = bbox if bbox is not None else F.array(*[F.lit(v) for v in WORLD_BBOX])
    items = files.select(F.col("path").alias("href"), F.col("length").alias("size"), checksum.alias("checksum"),
                         (F.lit(created) if created else made).alias("created"))
    if geom_col is not None:
        # a row per file on both sides
        boxes = file_extents(spark, output_path, geom_col, epsg).withColumnRenamed("bbox", "_box")
        items = items.join(boxes, _file_key(F.col("href")) == F.col("file"), "left").drop("file")
    else:
        items = items.withColumn("_box", F.lit(None).cast("array<double>"))
    items = items.select(
        F.concat_ws("-", F.lit(layer), F.lit(export_type), F.regexp_replace("created", "[-:Z]", ""),
                    F.substring(F.sha2(F.concat(F.substring_index("href", "/", -1), F.col("checksum")), 256), 1, 8)).alias("id"),
        "href", "size", "checksum", "created", F.lit(int(epsg)).alias("epsg"),
        F.lit(export_type).alias("export_type"), F.lit(layer).alias("layer"), F.coalesce("_box", given).alias("bbox"),
        F.lit(collection_id).alias("collection"))
    name = F.substring_index("href", "/", -1)
    media = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), F.substring_index("href", ".", -1)),
                       F.lit("application/octet-stream"))

    def link(rel: str, href: Column) -> Column:
        return F.struct(F.lit(rel).alias("rel"), href.alias("href"), F.lit("application/json").alias("type"))

    item = F.struct(
        F.lit("Feature").alias("type"), F.lit(ITEM_VERSION).alias("stac_version"),
        F.array(*[F.lit(x) for x in ITEM_EXTENSIONS]).alias("stac_extensions"), F.col("id"),
        F.lit(None).cast("string").alias("geometry"), F.col("bbox"),
        F.struct(F.lit(None).cast("string").alias("datetime"), F.col("created"), F.col("created").alias("updated"),
                 F.col("epsg").alias("proj:epsg"), F.col("size").alias("file:size"), F.col("checksum").alias("file:checksum"),
                 F.col("export_type"), F.col("layer"), F.col("collection")).alias("properties"),
        F.array(link("self", F.concat(F.lit("./"), name, F.lit(".stac.json"))), link("root", F.lit("./stac/catalog.json")),
                link("parent", F.lit(f"./stac/{layer}/catalog.json")),
                link("collection", F.lit(f"./stac/collections/{collection_id}/collection.json"))).alias("links"),
        F.struct(F.struct(F.concat(F.lit(public_base.rstrip("/") + "/"), name).alias("href"), F.lit(f"{layer} ({export_type})").alias("title"),
                          media.alias("type"), F.array(F.lit("data")).alias("roles"), F.col("size").alias("file:size"),
                          F.col("checksum").alias("file:checksum")).alias("data")).alias("assets"),
        F.col("collection"))
    return items.withColumn("item_json", F.to_json(item, {"ignoreNullFields": "false"}))


def append_item_links(links: DataFrame, items: DataFrame) -> DataFrame:
    """M3: links of a layer catalog plus one ``item`` link per new href;
    an href already linked is not added again (anti join, not a list scan)."""
    new = items.select(F.lit("item").alias("rel"), F.col("href"), F.lit("application/json").alias("type")) \
        .dropDuplicates(["href"])
    return links.unionByName(new.join(links.select("href"), "href", "left_anti").select("rel", "href", "type"))


def collection_extent(items: DataFrame) -> DataFrame:
    """M4: spatial extent (union of item boxes) and temporal interval
    (first and last ``created``) of a collection, one aggregate."""
    b = F.col("bbox")
    return items.agg(F.min(b[0]).alias("west"), F.min(b[1]).alias("south"), F.max(b[2]).alias("east"),
                     F.max(b[3]).alias("north"), F.min("created").alias("interval_start"),
                     F.max("created").alias("interval_end"), F.count(F.lit(1)).alias("items"))
