"""Feature query surface (F1-F8, O7): bbox, attribute filters, paging,
item lookup, queryables and collection listing.

Every filter is a plain Column predicate, so Catalyst pushes it into the
Parquet scan (``PushedFilters``) and, on layers written with bbox columns,
row groups are skipped by their min/max statistics.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's.
COMPARISON_OPS = ("=", "<>", ">", "<", ">=", "<=")
PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX = 10, 10000
QUERYABLES_SKIP = ("geometry", "id")
# Filter-text restore: the reference's alternation order (">=" is read as ">").
FILTER_TERM_RE_PARITY = r"""([a-zA-Z0-9_]+)\s*(=|>|<|>=|<=|<>)\s*(['"]?)(.*?)\3"""
# Our fix: longest operator first, and unquoted values read up to whitespace.
FILTER_TERM_RE = r"""([a-zA-Z0-9_]+)\s*(>=|<=|<>|=|>|<)\s*(?:'([^']*)'|"([^"]*)"|([^\s'"]+))"""

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def items_bbox(df: DataFrame, w: float, s: float, e: float, n: float,
               cols=("min_x", "min_y", "max_x", "max_y")) -> DataFrame:
    """features whose bbox meets ``w,s,e,n`` (closed intervals).

    For point layers pass ``cols=("x", "y", "x", "y")``.
    """
    minx, miny, maxx, maxy = (F.col(c) for c in cols)
    return df.filter((maxx >= F.lit(w)) & (minx <= F.lit(e)) & (maxy >= F.lit(s)) & (miny <= F.lit(n)))


def _typed_literal(df: DataFrame, prop: str, value) -> Column:
    """Literal typed by the column: numeric columns get a bare number,
    others a string cast to the column type (the panel quotes them)."""
    dt = df.schema[prop].dataType
    return F.lit(value).cast(dt)


def _compare(c: Column, op: str, v: Column) -> Column:
    if op == "=":
        return c == v
    if op == "<>":
        return c != v
    if op == ">":
        return c > v
    if op == "<":
        return c < v
    if op == ">=":
        return c >= v
    if op == "<=":
        return c <= v
    raise ValueError(f"operator {op!r} not in {COMPARISON_OPS}")


def items_equals(df: DataFrame, props: dict) -> DataFrame:
    """``prop=value`` for one or more properties, AND-ed."""
    if not props:
        return df
    return df.filter(reduce(and_, [F.col(k) == _typed_literal(df, k, v) for k, v in props.items()]))


def compare_predicate(df: DataFrame, terms) -> Column:
    """F3 as a Column: ``[(prop, op, value), ...]`` AND-ed."""
    preds = [_compare(F.col(p), op, _typed_literal(df, p, v)) for p, op, v in terms]
    return reduce(and_, preds) if preds else F.lit(True)


def items_compare(df: DataFrame, terms) -> DataFrame:
    """comparison terms joined by AND."""
    return df.filter(compare_predicate(df, terms))


def filter_text(df: DataFrame, terms) -> str:
    """F3 text form as the panel writes it: numeric values bare, others quoted."""
    out = []
    for p, op, v in terms:
        numeric = isinstance(df.schema[p].dataType, _NUMERIC)
        out.append(f"{p} {op} {v}" if numeric else f"{p} {op} '{v}'")
    return " AND ".join(out)


def filter_terms(text: Column | str, parity: bool = False) -> Column:
    """F4 over a column of filter strings: array<struct<attr, op, val>>.

    ``parity=True`` keeps the reference's reading (``a >= 5`` comes back as
    op ``>`` and an empty value); the default reads the longest operator.
    Runs JVM-side with ``regexp_extract_all`` so it scales with the column.
    """
    t = F.col(text) if isinstance(text, str) else text
    if parity:
        # Java regex supports the back-reference; the lazy group then yields ''
        # for an unquoted value, as in the reference.
        rx = FILTER_TERM_RE_PARITY
        attrs = F.regexp_extract_all(t, F.lit(rx), 1)
        ops = F.regexp_extract_all(t, F.lit(rx), 2)
        vals = F.regexp_extract_all(t, F.lit(rx), 4)
    else:
        rx = FILTER_TERM_RE
        attrs = F.regexp_extract_all(t, F.lit(rx), 1)
        ops = F.regexp_extract_all(t, F.lit(rx), 2)
        q1 = F.regexp_extract_all(t, F.lit(rx), 3)
        q2 = F.regexp_extract_all(t, F.lit(rx), 4)
        bare = F.regexp_extract_all(t, F.lit(rx), 5)
        vals = F.zip_with(F.zip_with(q1, q2, lambda a, b: F.concat(a, b)), bare, lambda a, b: F.concat(a, b))
    return F.arrays_zip(attrs.alias("attr"), ops.alias("op"), vals.alias("val"))


def parse_filter_text(text: str, parity: bool = False) -> list[tuple[str, str, str]]:
    """F4 for one request parameter (driver-side, a single short string)."""
    if parity:
        return [(m.group(1), m.group(2), m.group(4)) for m in re.finditer(FILTER_TERM_RE_PARITY, text)]
    out = []
    for m in re.finditer(FILTER_TERM_RE, text):
        val = m.group(3) if m.group(3) is not None else m.group(4) if m.group(4) is not None else m.group(5)
        out.append((m.group(1), m.group(2), val))
    return out


def page_limit(limit: int | None) -> int:
    if limit is None:
        return PAGE_LIMIT_DEFAULT
    return max(0, min(int(limit), PAGE_LIMIT_MAX))


def items_page(df: DataFrame, pk: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """ordered page. ``limit`` defaults to 10 and is capped at 10000.

    Planned as a top-k (``TakeOrderedAndProject`` of offset+limit rows), so no
    global sort runs; deep pages should use ``items_after`` instead.
    """
    q = df.orderBy(F.col(pk).asc_nulls_last())
    if offset:
        q = q.offset(int(offset))
    return q.limit(page_limit(limit))


def items_after(df: DataFrame, pk: str, last_pk, limit: int | None = None) -> DataFrame:
    """F5 keyset variant: the page after ``last_pk``; the predicate is pushed
    into the scan so cost does not grow with the page number."""
    return df.filter(F.col(pk) > F.lit(last_pk)).orderBy(F.col(pk).asc()).limit(page_limit(limit))


def item_by_id(df: DataFrame, pk: str, item_id) -> DataFrame:
    """``items/{id}``."""
    return df.filter(F.col(pk) == _typed_literal(df, pk, item_id))


def item_neighbours(df: DataFrame, pk: str, partition_by: list[str] | None = None,
                    buckets: int | None = None) -> DataFrame:
    """Previous and next id of every item (``prev_id``, ``next_id``),
    within each layer when ``partition_by`` is given. Rows with a NULL id
    are left out.

    A plain ``lag/lead`` window would sort a whole layer (or, with no layer,
    the whole table) in one task. Instead the ids, of any type that has an order,
    are dealt out by range over layer and id (``buckets`` partitions; Spark finds the
    bounds by sampling) and written down once; a window per (partition, layer)
    gives neighbours inside a range, and the ends of each range are patched from
    the next ranges of the layer, a table of at most layers + buckets rows.
    """
    from ..session import ensure_checkpoint_dir
    cols = list(partition_by or [])
    nb = int(buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(*cols, F.col(pk).alias("_k")).filter(F.col("_k").isNotNull())
    ensure_checkpoint_dir(df.sparkSession)
    keys = keys.repartitionByRange(nb, *cols, "_k").withColumn("_b", F.spark_partition_id()).checkpoint(eager=True)
    w = Window.partitionBy(*cols, "_b").orderBy("_k")
    local = keys.withColumns({"_prev": F.lag("_k").over(w), "_next": F.lead("_k").over(w)})
    bounds = keys.groupBy(*cols, "_b").agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
    wb = Window.partitionBy(*cols).orderBy("_b")
    bounds = bounds.withColumns({"_prev_hi": F.lag("_hi").over(wb), "_next_lo": F.lead("_lo").over(wb)}) \
        .select(*[F.col(c).alias(f"_d_{c}") for c in cols], F.col("_b").alias("_db"), "_prev_hi", "_next_lo")
    cond = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in cols] + [F.col("_b") == F.col("_db")])
    return (local.join(bounds, cond)
            .select(*cols, F.col("_k").alias(pk),
                    F.coalesce("_prev", "_prev_hi").alias("prev_id"),
                    F.coalesce("_next", "_next_lo").alias("next_id")))


def queryables(schema: T.StructType, enums: dict[str, list[str]] | None = None,
               titles: dict[str, str] | None = None) -> list[dict]:
    """property -> JSON-schema type/format/enum, skipping ``geometry``
    and ``id``. Integers are reported as ``number`` like the reference."""
    enums = enums or {}
    titles = titles or {}
    out = []
    for f in schema.fields:
        if f.name in QUERYABLES_SKIP:
            continue
        dt = f.dataType
        if isinstance(dt, _NUMERIC):
            q = {"type": "number"}
        elif isinstance(dt, T.BooleanType):
            q = {"type": "boolean"}
        elif isinstance(dt, T.DateType):
            q = {"type": "string", "format": "date"}
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            q = {"type": "string", "format": "date-time"}
        else:
            q = {"type": "string"}
        if f.name in enums:
            q = {"type": "string", "enum": list(enums[f.name])}
        out.append({"property": f.name, "title": titles.get(f.name, f.name), **q})
    return out


def layer_bbox(df: DataFrame, cols=("min_x", "min_y", "max_x", "max_y")) -> DataFrame:
    """One-row extent of a layer: partial aggregates per task, one tiny merge."""
    minx, miny, maxx, maxy = cols
    return df.agg(F.min(minx).alias("min_x"), F.min(miny).alias("min_y"),
                  F.max(maxx).alias("max_x"), F.max(maxy).alias("max_y"))


def collections(layers: dict[str, tuple[DataFrame, tuple[str, str, str, str]]],
                crs: str = "EPSG:4326", titles: dict[str, str] | None = None,
                keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """F8: one row per layer with id, title, CRS84 bbox, CRS list, keywords.

    Each layer contributes a one-row partial aggregate; the union is
    ``len(layers)`` rows, so no shuffle of feature data happens.
    """
    from ..functions import geometry as G
    titles = titles or {}
    keywords = keywords or {}
    parts = []
    for lid, (df, cols) in layers.items():
        minx, miny, maxx, maxy = cols
        b = df.agg(F.min(minx).alias("min_x"), F.min(miny).alias("min_y"),
                   F.max(maxx).alias("max_x"), F.max(maxy).alias("max_y"),
                   F.count(F.lit(1)).alias("feature_count"))
        parts.append(b.withColumns({"id": F.lit(lid), "title": F.lit(titles.get(lid, lid))}))
    u = reduce(lambda a, b: a.unionByName(b), parts)
    srid = int(re.search(r"(\d{4,5})$", crs).group(1)) if re.search(r"(\d{4,5})$", crs) else 4326
    box = G.bbox_to_wgs84("min_x", "min_y", "max_x", "max_y", srid)
    kw = F.create_map(*[x for k, v in keywords.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]) \
        if keywords else None
    return u.select(
        "id", "title", "feature_count",
        box["west"].alias("west"), box["south"].alias("south"),
        box["east"].alias("east"), box["north"].alias("north"),
        G.crs_list(F.lit(crs)).alias("crs"),
        (kw[F.col("id")] if kw is not None else F.array().cast("array<string>")).alias("keywords"))


def items_response(df: DataFrame, pk: str, limit: int | None = None, offset: int = 0, href: str = "items",
                   geom_col: str = "geometry") -> DataFrame:
    """F5 response: one row holding the items page as a GeoJSON
    FeatureCollection with ``numberMatched`` (features passing the filters),
    ``numberReturned`` and ``self`` / ``prev`` / ``next`` links, the fields a
    feature-API client reads. Also returns the parts as columns.

    The page is at most 10000 features (the limit cap), so gathering it into
    one array is bounded; the match count is a separate partial aggregate.
    The two one-row results are combined by a union and an aggregate.
    """
    from ..sources.sinks import to_geojson_features
    lim = page_limit(limit)
    page = items_page(df, pk, lim, offset)
    feats = to_geojson_features(page, pk, geom_col) if geom_col in df.columns else page.select(
        F.col(pk), F.to_json(F.struct(*[F.col(c) for c in page.columns])).alias("feature"))
    collected = feats.agg(F.sort_array(F.collect_list(F.struct(F.col(pk).alias("k"), "feature"))).alias("_p"))
    matched = df.agg(F.count(F.lit(1)).alias("number_matched"))
    both = collected.unionByName(matched, allowMissingColumns=True)
    one = both.agg(F.first("_p", ignorenulls=True).alias("_p"), F.max("number_matched").alias("number_matched"))
    n_ret = F.size(F.coalesce("_p", F.array()))
    link = lambda o: F.concat(F.lit(f"{href}?offset="), o.cast("string"), F.lit(f"&limit={lim}"))
    nxt = F.when(F.lit(offset) + n_ret < F.col("number_matched"), link(F.lit(offset + lim)))
    prv = F.when(F.lit(offset) > 0, link(F.lit(max(0, offset - lim))))
    out = one.select(
        F.col("number_matched"), n_ret.alias("number_returned"), link(F.lit(offset)).alias("self_href"),
        nxt.alias("next_href"), prv.alias("prev_href"),
        F.coalesce("_p", F.array()).alias("_p"))
    links = F.concat_ws(",", F.array_compact(F.array(
        F.concat(F.lit('{"rel":"self","href":"'), F.col("self_href"), F.lit('"}')),
        F.when(F.col("prev_href").isNotNull(), F.concat(F.lit('{"rel":"prev","href":"'), F.col("prev_href"), F.lit('"}'))),
        F.when(F.col("next_href").isNotNull(), F.concat(F.lit('{"rel":"next","href":"'), F.col("next_href"), F.lit('"}'))))))
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['),
                    F.concat_ws(",", F.transform("_p", lambda p: p["feature"])),
                    F.lit('],"numberMatched":'), F.col("number_matched").cast("string"),
                    F.lit(',"numberReturned":'), F.col("number_returned").cast("string"),
                    F.lit(',"links":['), links, F.lit("]}"))
    return out.select("number_matched", "number_returned", "self_href", "next_href", "prev_href",
                      F.when(F.size("_p") > 0, F.col("_p")[0]["k"]).alias("first_id"),
                      F.when(F.size("_p") > 0, F.element_at("_p", -1)["k"]).alias("last_id"),
                      body.alias("response"))
