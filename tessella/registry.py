"""Registered queries over the driver tables and their DuckDB twins.

Each entry of ``QUERIES`` is ``(spark, sf_dir) -> DataFrame`` and reads the
whole tables it names; each entry of ``ORACLE`` is SQL over the same
tables that must return the same rows (column names included).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import wkt as W
from .operators import query as Q
from .session import table
from .sources import layers as L
from .sources import sinks as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
# Queries with no SQL twin, and why; each is checked against brute force in tests/.
NO_ORACLE_REASON: dict[str, str] = {}


def register(name: str, sql: str | None = None, no_oracle: str | None = None):
    if (sql is None) == (no_oracle is None):
        raise ValueError(f"{name}: give either oracle SQL or the reason there is none")

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        else:
            NO_ORACLE_REASON[name] = no_oracle
        return fn
    return deco


PX, PY = L.SQL_POINT_X, L.SQL_POINT_Y
BBOX = (10.0, 60.0, 20.0, 66.0)


# ---------------------------------------------------------------- flagship

def _flagship_page(spark, sf):
    pts = L.event_points(spark, sf, with_geometry=True)
    q = Q.items_bbox(pts, *BBOX, cols=("x", "y", "x", "y"))
    q = Q.items_compare(q, [("value", ">=", 10.0), ("event_type", "<>", "error")])
    return Q.items_page(q, "event_id", limit=100)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    page = _flagship_page(spark, sf).select("event_id", "event_type", "value", "geometry")
    return S.to_geojson_features(page, "event_id")


@register("items_bbox_compare_page", f"""
SELECT event_id, event_type, value, {PX} AS x, {PY} AS y FROM events
WHERE {PX} >= 10.0 AND {PX} <= 20.0 AND {PY} >= 60.0 AND {PY} <= 66.0
  AND value >= 10.0 AND event_type <> 'error'
ORDER BY event_id LIMIT 100""")
def q_items_bbox_compare_page(spark, sf):
    return _flagship_page(spark, sf).select("event_id", "event_type", "value", "x", "y")


# ---------------------------------------------------------------- F1-F7, O7

@register("items_bbox", f"""
SELECT event_id, {PX} AS x, {PY} AS y FROM events
WHERE {PX} >= 10.0 AND {PX} <= 20.0 AND {PY} >= 60.0 AND {PY} <= 66.0""")
def q_items_bbox(spark, sf):
    pts = L.event_points(spark, sf)
    return Q.items_bbox(pts, *BBOX, cols=("x", "y", "x", "y")).select("event_id", "x", "y")


@register("items_bbox_polygons", f"""
SELECT n_nationkey, n_name FROM nation
WHERE {L.SQL_RECT_X0} + {L.SQL_RECT_W} >= 10.0 AND {L.SQL_RECT_X0} <= 20.0
  AND {L.SQL_RECT_Y0} + {L.SQL_RECT_H} >= 60.0 AND {L.SQL_RECT_Y0} <= 66.0""")
def q_items_bbox_polygons(spark, sf):
    return Q.items_bbox(L.nation_polygons(spark, sf), *BBOX).select("n_nationkey", "n_name")


@register("items_equals", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""")
def q_items_equals(spark, sf):
    o = table(spark, sf, "orders")
    return Q.items_equals(o, {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"}) \
        .select("o_orderkey", "o_custkey", "o_totalprice")


@register("items_compare", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
WHERE l_quantity > 20 AND l_discount <= 0.05 AND l_returnflag <> 'R' AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'""")
def q_items_compare(spark, sf):
    li = table(spark, sf, "lineitem")
    return Q.items_compare(li, [("l_quantity", ">", 20), ("l_discount", "<=", 0.05),
                                ("l_returnflag", "<>", "R"), ("l_shipdate", ">=", "1996-01-01 00:00:00")]) \
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@register("items_page", """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20""")
def q_items_page(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return Q.items_page(o, "o_orderkey", limit=10, offset=20)


@register("items_page_max", """
SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 10000""")
def q_items_page_max(spark, sf):
    """A limit above the maximum is clamped to 10000."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return li.orderBy("l_orderkey", "l_linenumber").limit(Q.page_limit(50000))


@register("items_after", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25""")
def q_items_after(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return Q.items_after(o, "o_orderkey", 500, limit=25)


@register("item_by_id", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 42""")
def q_item_by_id(spark, sf):
    o = table(spark, sf, "orders")
    return Q.item_by_id(o, "o_orderkey", 42).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@register("item_neighbours", """
SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS prev_id,
       lead(o_orderkey) OVER (ORDER BY o_orderkey) AS next_id FROM orders""")
def q_item_neighbours(spark, sf):
    return Q.item_neighbours(table(spark, sf, "orders"), "o_orderkey")


@register("item_neighbours_by_layer", """
SELECT o_orderpriority, o_orderkey,
       lag(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS prev_id,
       lead(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS next_id FROM orders""")
def q_item_neighbours_by_layer(spark, sf):
    return Q.item_neighbours(table(spark, sf, "orders"), "o_orderkey", partition_by=["o_orderpriority"])


_TERM_RE_SQL = Q.FILTER_TERM_RE.replace("'", "''")


@register("filter_text_terms", f"""
WITH f AS (
  SELECT event_id, 'event_type = ''' || event_type || ''' AND user_id >= ' || CAST(user_id AS VARCHAR)
         || ' AND event_id<>' || CAST(event_id AS VARCHAR) AS filter FROM events),
u AS (
  SELECT event_id,
         unnest(regexp_extract_all(filter, '{_TERM_RE_SQL}', 1)) AS attr,
         unnest(regexp_extract_all(filter, '{_TERM_RE_SQL}', 2)) AS op,
         unnest(regexp_extract_all(filter, '{_TERM_RE_SQL}', 3)) AS q1,
         unnest(regexp_extract_all(filter, '{_TERM_RE_SQL}', 4)) AS q2,
         unnest(regexp_extract_all(filter, '{_TERM_RE_SQL}', 5)) AS q3
  FROM f)
SELECT event_id, attr, op, concat(q1, q2, q3) AS val FROM u""")
def q_filter_text_terms(spark, sf):
    """F4 over filter strings Spark builds from every event (round trip)."""
    ev = table(spark, sf, "events")
    f = ev.select("event_id", F.concat(
        F.lit("event_type = '"), F.col("event_type"), F.lit("' AND user_id >= "), F.col("user_id").cast("string"),
        F.lit(" AND event_id<>"), F.col("event_id").cast("string")).alias("filter"))
    return f.select("event_id", F.inline(Q.filter_terms("filter")))


# ---------------------------------------------------------------- C1-C15 row and key rules

from .operators import quality as C  # noqa: E402
from .operators import profile as A  # noqa: E402
from .functions import geometry as G  # noqa: E402

LINEITEM_RULES = [
    C.Rule("required", "l_shipdate"),
    C.Rule("min", "l_quantity", 5), C.Rule("max", "l_quantity", 45),
    C.Rule("max", "l_discount", 0.08),
    C.Rule("pattern", "l_returnflag", "^[AN]"),
    C.Rule("enumeration", "l_linestatus", ["O"]),
    C.Rule("compare", "l_tax", other="l_discount", op="<="),
]


@register("dq_lineitem_rules", """
SELECT l_orderkey, l_linenumber, 'required' AS rule, 'l_shipdate' AS field, CAST(l_shipdate AS VARCHAR) AS value FROM lineitem WHERE l_shipdate IS NULL
UNION ALL SELECT l_orderkey, l_linenumber, 'min', 'l_quantity', CAST(l_quantity AS VARCHAR) FROM lineitem WHERE l_quantity < 5
UNION ALL SELECT l_orderkey, l_linenumber, 'max', 'l_quantity', CAST(l_quantity AS VARCHAR) FROM lineitem WHERE l_quantity > 45
UNION ALL SELECT l_orderkey, l_linenumber, 'max', 'l_discount', CAST(l_discount AS VARCHAR) FROM lineitem WHERE l_discount > 0.08
UNION ALL SELECT l_orderkey, l_linenumber, 'pattern', 'l_returnflag', l_returnflag FROM lineitem WHERE NOT regexp_matches(l_returnflag, '^[AN]')
UNION ALL SELECT l_orderkey, l_linenumber, 'enumeration', 'l_linestatus', l_linestatus FROM lineitem WHERE l_linestatus NOT IN ('O')
UNION ALL SELECT l_orderkey, l_linenumber, 'compare:<=', 'l_tax', CAST(l_tax AS VARCHAR) FROM lineitem WHERE NOT (l_tax <= l_discount)""")
def q_dq_lineitem_rules(spark, sf):
    """All row rules of a layer in one scan."""
    return C.row_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], LINEITEM_RULES)


CUSTOMER_RULES = C.rules_for_field("c_name", C.Constraints(min_length=18, max_length=18, pattern="^Customer#0000000"),
                                   required=True) \
    + C.rules_for_field("c_acctbal", C.Constraints(min=0.0)) \
    + C.rules_for_field("c_mktsegment", C.Constraints(enumeration=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]))


@register("dq_customer_rules", """
SELECT c_custkey, 'required' AS rule, 'c_name' AS field, c_name AS value FROM customer WHERE c_name IS NULL
UNION ALL SELECT c_custkey, 'min_length', 'c_name', c_name FROM customer WHERE length(c_name) < 18
UNION ALL SELECT c_custkey, 'max_length', 'c_name', c_name FROM customer WHERE length(c_name) > 18
UNION ALL SELECT c_custkey, 'pattern', 'c_name', c_name FROM customer WHERE NOT regexp_matches(c_name, '^Customer#0000000')
UNION ALL SELECT c_custkey, 'min', 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer WHERE c_acctbal < 0.0
UNION ALL SELECT c_custkey, 'enumeration', 'c_mktsegment', c_mktsegment FROM customer
  WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')""")
def q_dq_customer_rules(spark, sf):
    """Field constraints (C1-C5) compiled from a Constraints record."""
    return C.row_violations(table(spark, sf, "customer"), ["c_custkey"], CUSTOMER_RULES)


@register("dq_codelist", """
SELECT s_suppkey, 'codelist' AS rule, 's_nationkey' AS field, CAST(s_nationkey AS VARCHAR) AS value FROM supplier
WHERE s_nationkey IS NOT NULL AND s_nationkey NOT IN (
  SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')""")
def q_dq_codelist(spark, sf):
    """Supplier nation must be in the code list of European nations."""
    codes = (table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .filter(F.col("r_name") == "EUROPE").select(F.col("n_nationkey").alias("code")))
    return C.codelist_violations(table(spark, sf, "supplier"), ["s_suppkey"], "s_nationkey", codes)


@register("dq_unique", """
SELECT p_partkey, 'unique' AS rule, 'p_name' AS field, p_name AS value FROM part
WHERE p_name IN (SELECT p_name FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1)""")
def q_dq_unique(spark, sf):
    """Rows whose non-null value is not unique."""
    return C.unique_violations(table(spark, sf, "part"), ["p_partkey"], ["p_name"])


@register("dq_composite_key_groups", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_dq_composite_key_groups(spark, sf):
    """Duplicated composite-key groups."""
    return C.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("dq_primary_key", """
SELECT l_orderkey, l_linenumber, 'primary_key_null' AS rule, 'l_orderkey,l_linenumber' AS field, CAST(NULL AS VARCHAR) AS value
FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL
UNION ALL
SELECT l_orderkey, l_linenumber, 'primary_key_duplicate', 'l_orderkey,l_linenumber',
       CAST(l_orderkey AS VARCHAR) || ',' || CAST(l_linenumber AS VARCHAR)
FROM lineitem WHERE (l_orderkey, l_linenumber) IN (
  SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def q_dq_primary_key(spark, sf):
    """Rows breaking a composite primary key (NULL parts, duplicates)."""
    return C.primary_key_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("dq_cross_field", """
SELECT l_orderkey, l_linenumber, 'compare:>' AS rule, 'l_shipdate' AS field, CAST(l_shipdate AS VARCHAR) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (l_shipdate > o_orderdate)""")
def q_dq_cross_field(spark, sf):
    """C9 across a FK: ship date must be after the order date."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"),
                                           F.col("l_orderkey") == F.col("o_orderkey"))
    return C.row_violations(li, ["l_orderkey", "l_linenumber"],
                            [C.Rule("compare", "l_shipdate", other="o_orderdate", op=">")])


_PK_LAYERS = [("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("customer", "c_custkey"), ("part", "p_name")]


@register("pk_stats", " UNION ALL ".join(
    f"""SELECT '{t}' AS layer, count(*) AS feature_count, count(*) FILTER (WHERE {k} IS NULL) AS null_pk,
       (SELECT count(*) FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1)) AS duplicate_pk_groups FROM {t}"""
    for t, k in _PK_LAYERS))
def q_pk_stats(spark, sf):
    """C10/C11 per layer: NULL PK count and duplicated PK groups."""
    return A.union_all([C.pk_stats(table(spark, sf, t), k).select(F.lit(t).alias("layer"), "*")
                        for t, k in _PK_LAYERS])


_ISSUE_LAYERS = [("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("part", "p_name"), ("events", "fid")]


def _import_issues(spark, sf):
    return A.union_all([C.import_issues(t, table(spark, sf, t), k) for t, k in _ISSUE_LAYERS])


_ISSUES_SQL = """
SELECT 'lineitem' AS layer, 'l_orderkey' AS "column", 'non_unique_pk' AS type, 'error' AS severity
WHERE EXISTS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'orders', 'o_orderkey', 'non_unique_pk', 'error'
WHERE EXISTS (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'orders', 'o_orderkey', 'null_pk', 'error' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey IS NULL)
UNION ALL SELECT 'lineitem', 'l_orderkey', 'null_pk', 'error' WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey IS NULL)
UNION ALL SELECT 'part', 'p_name', 'non_integer_pk', 'warning'
UNION ALL SELECT 'part', 'p_name', 'null_pk', 'error' WHERE EXISTS (SELECT 1 FROM part WHERE p_name IS NULL)
UNION ALL SELECT 'part', 'p_name', 'non_unique_pk', 'error'
WHERE EXISTS (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)
UNION ALL SELECT 'events', 'fid', 'no_primary_key', 'error'"""


@register("import_issues", _ISSUES_SQL)
def q_import_issues(spark, sf):
    """Import warnings of several layers."""
    return _import_issues(spark, sf)


@register("import_verdict", f"""
SELECT count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid, true AS can_proceed FROM ({_ISSUES_SQL})""")
def q_import_verdict(spark, sf):
    """C14: isValid / canProceed over the issues above."""
    return C.import_verdict(_import_issues(spark, sf))


@register("issue_counts", f"""
SELECT coalesce(layer, '__model__') AS layer, count(*) AS issues FROM (
  SELECT layer FROM ({_ISSUES_SQL}) UNION ALL SELECT CAST(NULL AS VARCHAR)) GROUP BY 1""")
def q_issue_counts(spark, sf):
    """A10: issues per layer; a model-level issue (no layer) counts under __model__."""
    issues = _import_issues(spark, sf).select("layer")
    model_level = spark.range(1).select(F.lit(None).cast("string").alias("layer"))
    return A.issue_counts(issues.unionByName(model_level), "layer")


# ---------------------------------------------------------------- D2-D8, D10, O6 change capture

from .operators import cdc as D  # noqa: E402

SINCE = "1998-01-01 00:00:00"
_PREV_SQL = "(SELECT o_orderkey AS pk FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00')"
_CUR_SQL = "(SELECT * FROM orders WHERE o_orderstatus <> 'P')"


def _snapshots(spark, sf):
    """Previous sync saw the orders dated before 2000; pending orders have
    since been withdrawn. Both snapshots are read from the whole table."""
    o = table(spark, sf, "orders")
    prev = D.state_from_snapshot(o.filter(F.col("o_orderdate") < F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")),
                                 "o_orderkey")
    cur = o.filter(F.col("o_orderstatus") != "P")
    return prev, cur


@register("cdc_inserts", f"""
SELECT c.o_orderkey, c.o_orderdate, 'insert' AS _change_type FROM {_CUR_SQL} c
WHERE c.o_orderkey NOT IN (SELECT pk FROM {_PREV_SQL})""")
def q_cdc_inserts(spark, sf):
    prev, cur = _snapshots(spark, sf)
    return D.cdc_inserts(cur.select("o_orderkey", "o_orderdate"), prev, "o_orderkey")


@register("cdc_deletes", f"""
SELECT pk AS o_orderkey, 'delete' AS _change_type FROM {_PREV_SQL}
WHERE pk NOT IN (SELECT o_orderkey FROM {_CUR_SQL})""")
def q_cdc_deletes(spark, sf):
    prev, cur = _snapshots(spark, sf)
    return D.cdc_deletes(cur, prev, "o_orderkey")


@register("cdc_updates", f"""
SELECT c.o_orderkey, c.o_orderdate, 'update' AS _change_type FROM {_CUR_SQL} c
WHERE c.o_orderdate > TIMESTAMP '{SINCE}' AND c.o_orderkey IN (SELECT pk FROM {_PREV_SQL})""")
def q_cdc_updates(spark, sf):
    prev, cur = _snapshots(spark, sf)
    return D.cdc_updates(cur.select("o_orderkey", "o_orderdate"), prev, "o_orderkey", "o_orderdate", SINCE)


@register("cdc_changes", f"""
SELECT c.o_orderkey, c.o_orderdate, c.o_totalprice,
       CASE WHEN c.o_orderkey IN (SELECT pk FROM {_PREV_SQL}) THEN 'update' ELSE 'insert' END AS _change_type
FROM {_CUR_SQL} c
WHERE c.o_orderdate > TIMESTAMP '{SINCE}' OR c.o_orderkey NOT IN (SELECT pk FROM {_PREV_SQL})""")
def q_cdc_changes(spark, sf):
    prev, cur = _snapshots(spark, sf)
    return D.cdc_changes(cur.select("o_orderkey", "o_orderdate", "o_totalprice"), prev, "o_orderkey",
                         "o_orderdate", SINCE)


_DIFF_SQL = f"""
SELECT coalesce(c.o_orderkey, p.pk) AS o_orderkey, c.o_orderdate,
  CASE WHEN p.pk IS NULL THEN 'insert' WHEN c.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS _change_type
FROM {_CUR_SQL} c FULL OUTER JOIN {_PREV_SQL} p ON c.o_orderkey = p.pk
WHERE p.pk IS NULL OR c.o_orderkey IS NULL OR c.o_orderdate > TIMESTAMP '{SINCE}'"""


@register("cdc_diff", _DIFF_SQL)
def q_cdc_diff(spark, sf):
    """D2+D3+D4 in one full outer join."""
    prev, cur = _snapshots(spark, sf)
    return D.cdc_diff(cur.select("o_orderkey", "o_orderdate"), prev, "o_orderkey", "o_orderdate", SINCE)


@register("cdc_summary", f"""
SELECT 'orders' AS layer, _change_type, count(*) AS n FROM ({_DIFF_SQL}) GROUP BY _change_type""")
def q_cdc_summary(spark, sf):
    """Per layer and change type."""
    return D.change_summary(q_cdc_diff(spark, sf), "orders")


@register("change_stats", f"""
SELECT count(*) FILTER (WHERE _change_type = 'insert') AS added,
       count(*) FILTER (WHERE _change_type = 'update') AS modified,
       count(*) FILTER (WHERE _change_type = 'delete') AS deleted, count(*) AS total FROM ({_DIFF_SQL})""")
def q_change_stats(spark, sf):
    """A11 over the change rows (insert/update/delete as added/modified/deleted)."""
    d = q_cdc_diff(spark, sf).select(F.col("_change_type").alias("t"))
    d = d.select(F.when(F.col("t") == "insert", "added").when(F.col("t") == "update", "modified")
                 .otherwise("deleted").alias("change_type"))
    return A.change_stats(d)


_HASH_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _hash_snapshots(spark, sf):
    """Current snapshot: orders from before 1997 that were open are now
    fulfilled (status O -> F); no timestamp marks the change."""
    o = table(spark, sf, "orders")
    prev = D.state_from_snapshot(o, "o_orderkey", _HASH_COLS)
    cur = o.withColumn("o_orderstatus", F.when(
        (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")),
        F.lit("F")).otherwise(F.col("o_orderstatus")))
    return prev, cur


@register("cdc_hash", """
WITH cur AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority,
  CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' THEN 'F' ELSE o_orderstatus END
  AS o_orderstatus FROM orders)
SELECT c.o_orderkey, c.o_orderstatus, 'update' AS _change_type FROM cur c JOIN orders p ON c.o_orderkey = p.o_orderkey
WHERE c.o_orderstatus IS DISTINCT FROM p.o_orderstatus OR c.o_custkey IS DISTINCT FROM p.o_custkey
   OR c.o_totalprice IS DISTINCT FROM p.o_totalprice OR c.o_orderpriority IS DISTINCT FROM p.o_orderpriority""")
def q_cdc_hash(spark, sf):
    """Updates found by content hash, with no timestamp column."""
    prev, cur = _hash_snapshots(spark, sf)
    return D.cdc_diff(cur, prev, "o_orderkey", hash_cols=_HASH_COLS).select("o_orderkey", "o_orderstatus",
                                                                           "_change_type")


@register("key_difference", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)""")
def q_key_difference(spark, sf):
    """Orders with no line items (set difference of keys)."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return D.key_difference(table(spark, sf, "orders"), li, "o_orderkey")


# ---------------------------------------------------------------- J5-J9 spatial relations

from .operators import spatial as SP  # noqa: E402

_PTS_SQL = f"(SELECT event_id, {PX} AS x, {PY} AS y FROM events)"
_RECTS = L.SQL_NATION_RECTS


def _points(spark, sf):
    return L.event_points(spark, sf, with_geometry=True).select("event_id", "geometry")


def _nations(spark, sf):
    return L.nation_polygons(spark, sf).select("n_nationkey", "geometry")


@register("spatial_intersects", f"""
SELECT p.event_id, r.n_nationkey FROM {_PTS_SQL} p, {_RECTS} r
WHERE p.x >= r.x0 AND p.x <= r.x1 AND p.y >= r.y0 AND p.y <= r.y1""")
def q_spatial_intersects(spark, sf):
    """Points intersecting nation polygons (boundary included)."""
    return SP.spatial_join(_points(spark, sf), _nations(spark, sf), "intersects", kinds=("point", "polygon"))


@register("spatial_contains", f"""
SELECT r.n_nationkey, p.event_id FROM {_RECTS} r, {_PTS_SQL} p
WHERE p.x > r.x0 AND p.x < r.x1 AND p.y > r.y0 AND p.y < r.y1""")
def q_spatial_contains(spark, sf):
    """Polygons containing points (interior only)."""
    return SP.spatial_join(_nations(spark, sf), _points(spark, sf), "contains", kinds=("polygon", "point"))


@register("spatial_within", f"""
SELECT p.event_id, r.n_nationkey FROM {_PTS_SQL} p, {_RECTS} r
WHERE p.x > r.x0 AND p.x < r.x1 AND p.y > r.y0 AND p.y < r.y1""")
def q_spatial_within(spark, sf):
    """Points within polygons (J6 reversed)."""
    return SP.spatial_join(_points(spark, sf), _nations(spark, sf), "within", kinds=("point", "polygon"))


@register("spatial_touches_points", f"""
SELECT p.event_id, r.n_nationkey FROM {_PTS_SQL} p, {_RECTS} r
WHERE p.x >= r.x0 AND p.x <= r.x1 AND p.y >= r.y0 AND p.y <= r.y1
  AND NOT (p.x > r.x0 AND p.x < r.x1 AND p.y > r.y0 AND p.y < r.y1)""")
def q_spatial_touches_points(spark, sf):
    """Points on a polygon's boundary."""
    return SP.spatial_join(_points(spark, sf), _nations(spark, sf), "touches", kinds=("point", "polygon"))


@register("spatial_touches_polygons", f"""
SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM {_RECTS} a, {_RECTS} b
WHERE a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
  AND NOT (a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)""")
def q_spatial_touches_polygons(spark, sf):
    """Neighbouring polygons (shared edge or corner, interiors disjoint)."""
    n = _nations(spark, sf)
    return SP.spatial_join(n.withColumnRenamed("n_nationkey", "a_key"), n.withColumnRenamed("n_nationkey", "b_key"),
                           "touches", kinds=("polygon", "polygon"))


@register("spatial_intersects_polygons", f"""
SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM {_RECTS} a, {_RECTS} b
WHERE a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def q_spatial_intersects_polygons(spark, sf):
    """J5 polygon/polygon (a polygon intersects itself)."""
    n = _nations(spark, sf)
    return SP.spatial_join(n.withColumnRenamed("n_nationkey", "a_key"), n.withColumnRenamed("n_nationkey", "b_key"),
                           "intersects", kinds=("polygon", "polygon"))


_REGION_BOX_SQL = f"""(SELECT n_regionkey AS r_regionkey, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM {_RECTS} GROUP BY n_regionkey)"""


@register("spatial_within_polygons", f"""
SELECT a.n_nationkey, b.r_regionkey FROM {_RECTS} a, {_REGION_BOX_SQL} b
WHERE a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1""")
def q_spatial_within_polygons(spark, sf):
    """J7 polygon/polygon: nation rectangles within region boxes."""
    boxes = L.region_boxes(spark, sf).select("r_regionkey", "geometry")
    return SP.spatial_join(_nations(spark, sf), boxes, "within", kinds=("polygon", "polygon"))


def _sql_cross(ax, ay, bx, by, px, py):
    return f"(({bx}) - ({ax})) * (({py}) - ({ay})) - (({by}) - ({ay})) * (({px}) - ({ax}))"


def _sql_sign(v):
    return f"(CASE WHEN {v} > 0 THEN 1 WHEN {v} < 0 THEN -1 ELSE 0 END)"


def _sql_proper(s, e):
    """Segments s and e (tuples of 4 SQL expressions) cross at one inner point."""
    o1 = _sql_sign(_sql_cross(*e, s[0], s[1]))
    o2 = _sql_sign(_sql_cross(*e, s[2], s[3]))
    o3 = _sql_sign(_sql_cross(*s, e[0], e[1]))
    o4 = _sql_sign(_sql_cross(*s, e[2], e[3]))
    return f"({o1} * {o2} < 0 AND {o3} * {o4} < 0)"


_SEG = ("s.x1", "s.y1", "s.x2", "s.y2")
_RECT_EDGES = [("r.x0", "r.y0", "r.x1", "r.y0"), ("r.x1", "r.y0", "r.x1", "r.y1"),
               ("r.x1", "r.y1", "r.x0", "r.y1"), ("r.x0", "r.y1", "r.x0", "r.y0")]


def _sql_inside(x, y):
    return f"({x} > r.x0 AND {x} < r.x1 AND {y} > r.y0 AND {y} < r.y1)"


def _sql_outside(x, y):
    return f"({x} < r.x0 OR {x} > r.x1 OR {y} < r.y0 OR {y} > r.y1)"


@register("spatial_crosses", f"""
SELECT s.event_id, r.n_nationkey FROM
  (SELECT event_id, {PX} AS x1, {PY} AS y1, {L.SQL_NEXT_X} AS x2, {L.SQL_NEXT_Y} AS y2 FROM events) s, {_RECTS} r
WHERE {' OR '.join(_sql_proper(_SEG, e) for e in _RECT_EDGES)}
   OR (({_sql_inside('s.x1', 's.y1')} OR {_sql_inside('s.x2', 's.y2')})
       AND ({_sql_outside('s.x1', 's.y1')} OR {_sql_outside('s.x2', 's.y2')}))""")
def q_spatial_crosses(spark, sf):
    """Movement segments crossing nation polygons (inside and outside)."""
    seg = L.event_segments(spark, sf).select("event_id", "geometry")
    return SP.spatial_join(seg, _nations(spark, sf), "crosses", kinds=("line", "polygon"))


def _sql_in_parcel(x, y):
    return (f"({x} > r.x0 AND {x} < r.x0 + 1.5 AND {y} > r.y0 AND {y} < r.y0 + 1.5 AND NOT "
            f"({x} >= r.x0 + 0.25 AND {x} <= r.x0 + 1.0 AND {y} >= r.y0 + 0.25 AND {y} <= r.y0 + 1.0))")


def _sql_off_parcel(x, y):
    return (f"({x} < r.x0 OR {x} > r.x0 + 1.5 OR {y} < r.y0 OR {y} > r.y0 + 1.5 OR "
            f"({x} > r.x0 + 0.25 AND {x} < r.x0 + 1.0 AND {y} > r.y0 + 0.25 AND {y} < r.y0 + 1.0))")


_TRAIL_XY = [(f"(p.x + {dx})", f"(p.y + {dy})") for dx, dy in L.TRAIL]
_TRAIL_NEAR = "p.x + 0.5 >= r.x0 AND p.x <= r.x0 + 1.5 AND p.y + 0.75 >= r.y0 AND p.y <= r.y0 + 1.5"


@register("spatial_within_parcels", f"""
SELECT p.event_id, r.o_orderkey FROM {L.SQL_VISITS} p JOIN {L.SQL_PARCELS} r
ON p.x > r.x0 AND p.x < r.x0 + 1.5 AND p.y > r.y0 AND p.y < r.y0 + 1.5 WHERE {_sql_in_parcel('p.x', 'p.y')}""")
def q_spatial_within_parcels(spark, sf):
    """Points, a third of them in one town, within a polygon with a hole per order; cells from the data."""
    return SP.spatial_join(L.town_visits(spark, sf).select("event_id", "geometry"), L.order_parcels(spark, sf), "within",
                           kinds=("point", "polygon"))


@register("spatial_trails_cross_parcels", f"""
SELECT p.event_id, r.o_orderkey FROM {L.SQL_VISITS} p JOIN {L.SQL_PARCELS} r ON {_TRAIL_NEAR}
WHERE ({' OR '.join(_sql_in_parcel(*xy) for xy in _TRAIL_XY)}) AND ({' OR '.join(_sql_off_parcel(*xy) for xy in _TRAIL_XY)})""")
def q_spatial_trails_cross_parcels(spark, sf):
    """Multi-points with places inside and outside of a polygon with a hole (inside the hole is outside)."""
    trails = L.town_visits(spark, sf).select("event_id", F.col("trail").alias("geometry"))
    return SP.spatial_join(trails, L.order_parcels(spark, sf), "crosses", kinds=("point", "polygon"))


@register("spatial_trails_within_parcels", f"""
SELECT r.o_orderkey, p.event_id FROM {L.SQL_VISITS} p JOIN {L.SQL_PARCELS} r ON {_TRAIL_NEAR}
WHERE ({' OR '.join(_sql_in_parcel(*xy) for xy in _TRAIL_XY)}) AND NOT ({' OR '.join(_sql_off_parcel(*xy) for xy in _TRAIL_XY)})""")
def q_spatial_trails_within_parcels(spark, sf):
    """Polygons with a hole that contain all places of a multi-point."""
    trails = L.town_visits(spark, sf).select("event_id", F.col("trail").alias("geometry"))
    return SP.spatial_join(L.order_parcels(spark, sf), trails, "contains", kinds=("polygon", "point"))


# ---------------------------------------------------------------- A1-A9 profile

def _point_layer(spark, sf):
    return L.event_points(spark, sf).withColumns({"min_x": F.col("x"), "min_y": F.col("y"),
                                                  "max_x": F.col("x"), "max_y": F.col("y")})


@register("layer_profile", """
SELECT 'events' AS layer, count(*) AS feature_count,
  (SELECT count(*) FROM information_schema.columns WHERE table_name = 'events') AS column_count,
  'Point' AS geometry_type, 4326 AS srid, 'event_id' AS pk FROM events
UNION ALL SELECT 'nation', count(*), (SELECT count(*) FROM information_schema.columns WHERE table_name = 'nation'),
  'Polygon', 4326, 'n_nationkey' FROM nation
UNION ALL SELECT 'orders', count(*), (SELECT count(*) FROM information_schema.columns WHERE table_name = 'orders'),
  NULL, NULL, 'o_orderkey' FROM orders""")
def q_layer_profile(spark, sf):
    """A1: feature count, column count (geometry excluded), type, srid, PK per layer."""
    return A.union_all([
        A.layer_profile("events", L.event_points(spark, sf, with_geometry=True).drop("x", "y"), "geometry"),
        A.layer_profile("nation", L.nation_polygons(spark, sf).select(*table(spark, sf, "nation").columns, "geometry"), "geometry"),
        A.layer_profile("orders", table(spark, sf, "orders"))])


_EXTENTS_SQL = f"""
SELECT 'events' AS layer, min({PX}) AS min_x, min({PY}) AS min_y, max({PX}) AS max_x, max({PY}) AS max_y FROM events
UNION ALL SELECT 'nation', min(x0), min(y0), max(x1), max(y1) FROM {_RECTS}"""


@register("layer_extent", _EXTENTS_SQL)
def q_layer_extent(spark, sf):
    """A2: per-layer extent."""
    return A.union_all([A.layer_extent("events", _point_layer(spark, sf)),
                        A.layer_extent("nation", L.nation_polygons(spark, sf))])


@register("global_extent", f"""
SELECT min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM ({_EXTENTS_SQL})""")
def q_global_extent(spark, sf):
    """A3: extent over all layers (a second aggregate over A2's rows)."""
    return A.global_extent(q_layer_extent(spark, sf))


@register("geometry_type_set", """
SELECT geometry_type, count(*) AS n, true AS mixed FROM (
  SELECT 'Point' AS geometry_type FROM events UNION ALL SELECT 'LineString' FROM events
  UNION ALL SELECT 'Polygon' FROM nation) GROUP BY geometry_type""")
def q_geometry_type_set(spark, sf):
    """A4: geometry types of a mixed collection (points, segments, polygons)."""
    mixed = (_points(spark, sf).select("geometry")
             .unionByName(L.event_segments(spark, sf).select("geometry"))
             .unionByName(_nations(spark, sf).select("geometry")))
    return A.geometry_type_set(mixed)


_DV_FIELDS = ["c_custkey", "c_mktsegment", "c_nationkey", "c_name", "c_acctbal"]


@register("distinct_values", " UNION ALL ".join(f"""
SELECT field, value, rank, n_distinct, n_distinct > 50 AS truncated FROM (
  SELECT '{f}' AS field, value, row_number() OVER (ORDER BY value) AS rank, count(*) OVER () AS n_distinct
  FROM (SELECT DISTINCT CAST({f} AS VARCHAR) AS value FROM customer
        WHERE {f} IS NOT NULL AND CAST({f} AS VARCHAR) <> '')) WHERE rank <= 50""" for f in _DV_FIELDS))
def q_distinct_values(spark, sf):
    """A5: up to 50 distinct values per field, smallest first (all fields in one scan)."""
    return A.distinct_values(table(spark, sf, "customer"), _DV_FIELDS)


@register("sampled_values", " UNION ALL ".join(f"""
SELECT field, value, rank, n_distinct, n_distinct > 50 AS truncated FROM (
  SELECT '{f}' AS field, value, row_number() OVER (ORDER BY value) AS rank, count(*) OVER () AS n_distinct
  FROM (SELECT DISTINCT CAST({f} AS VARCHAR) AS value FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)
        WHERE {f} IS NOT NULL AND CAST({f} AS VARCHAR) <> '')) WHERE rank <= 50""" for f in ("o_orderstatus", "o_orderpriority", "o_custkey")))
def q_sampled_values(spark, sf):
    """Distinct values among the first 100 features by PK."""
    return A.sampled_values(table(spark, sf, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"])


@register("infer_types", r"""
WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS VARCHAR) AS p_size,
                  CAST(p_retailprice AS VARCHAR) AS p_retailprice, p_brand, p_name, p_type FROM part),
u AS (UNPIVOT s ON p_partkey, p_size, p_retailprice, p_brand, p_name, p_type INTO NAME field VALUE value),
a AS (SELECT field, count(*) AS n,
        count(*) FILTER (WHERE regexp_full_match(trim(value), '[+-]?[0-9]+')) AS n_int,
        count(*) FILTER (WHERE TRY_CAST(trim(value) AS DOUBLE) IS NOT NULL
                         AND regexp_full_match(trim(value), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')) AS n_num,
        count(*) FILTER (WHERE lower(trim(value)) IN ('true', 'false')) AS n_bool
      FROM u WHERE value IS NOT NULL GROUP BY field)
SELECT field, CASE WHEN n_int = n THEN 'integer' WHEN n_num = n THEN 'number' WHEN n_bool = n THEN 'boolean'
                   ELSE 'string' END AS base_type FROM a""")
def q_infer_types(spark, sf):
    """A7 whole-column mode over the string forms of part's columns."""
    p = table(spark, sf, "part")
    return A.infer_types(p.select([F.col(c).cast("string").alias(c) for c in p.columns]))


@register("json_field_types", """
SELECT k AS key, CASE WHEN bool_or(t = 'VARCHAR') OR (bool_or(t = 'BOOLEAN') AND NOT bool_and(t = 'BOOLEAN'))
                      THEN 'string' WHEN bool_and(t = 'BOOLEAN') THEN 'boolean'
                      WHEN bool_or(t = 'DOUBLE' AND v <> floor(v)) THEN 'number' ELSE 'integer' END AS base_type
FROM (SELECT k, json_type(props, '$."' || k || '"') AS t,
             TRY_CAST(json_extract_string(props, '$."' || k || '"') AS DOUBLE) AS v
      FROM (SELECT props, unnest(json_keys(props)) AS k FROM events)) GROUP BY k""")
def q_json_field_types(spark, sf):
    """A7 on a JSON properties column: per key, the type that fits every row."""
    return A.json_field_types(table(spark, sf, "events"), "props")


@register("null_profile", " UNION ALL ".join(f"""
SELECT '{f}' AS field, count(*) FILTER (WHERE {f} IS NULL) AS nulls,
  CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE {f} IS NULL) AS DOUBLE) / count(*) ELSE 0.0 END AS null_ratio,
  CASE WHEN count(*) FILTER (WHERE {f} IS NULL) = 0 THEN '1..1' ELSE '0..1' END AS multiplicity FROM documents"""
                                        for f in ("doc_id", "text", "lang", "source", "n_chars")))
def q_null_profile(spark, sf):
    """NULL count/ratio and inferred multiplicity per field, one pass."""
    return A.null_profile(table(spark, sf, "documents"))


def _sql_seg_intersect(e, f):
    """Closed segments e, f (4 SQL expressions each) share a point (same
    orientation arithmetic as the Spark predicate)."""
    o1 = _sql_sign(_sql_cross(*e, f[0], f[1]))
    o2 = _sql_sign(_sql_cross(*e, f[2], f[3]))
    o3 = _sql_sign(_sql_cross(*f, e[0], e[1]))
    o4 = _sql_sign(_sql_cross(*f, e[2], e[3]))

    def on(o, s, px, py):
        return (f"({o} = 0 AND {px} >= least({s[0]}, {s[2]}) AND {px} <= greatest({s[0]}, {s[2]}) "
                f"AND {py} >= least({s[1]}, {s[3]}) AND {py} <= greatest({s[1]}, {s[3]}))")
    return (f"(({o1} * {o2} < 0 AND {o3} * {o4} < 0) OR {on(o1, e, f[0], f[1])} OR {on(o2, e, f[2], f[3])} "
            f"OR {on(o3, f, e[0], e[1])} OR {on(o4, f, e[2], e[3])})")


_BC = ("(q.x0 + 1.0)", "0.0", "(q.x0 + q.u)", "1.0")
_DA = ("(q.x0 + q.v)", "1.0", "q.x0", "0.0")
_QUAD_VALID_SQL = f"(q.o_orderstatus <> 'P' AND NOT {_sql_seg_intersect(_BC, _DA)})"


@register("is_valid", f"SELECT q.o_orderkey, {_QUAD_VALID_SQL} AS valid FROM {L.SQL_QUADS} q")
def q_is_valid(spark, sf):
    """Per-feature validity (unclosed rings, bow-ties, repeated vertices)."""
    return L.order_quads(spark, sf).select("o_orderkey", G.is_valid("geometry").alias("valid"))


@register("validity_summary", f"""
SELECT 'order_quads' AS layer, count(*) AS total_features, count(*) FILTER (WHERE NOT valid) AS invalid_count,
  CAST(floor((count(*) - count(*) FILTER (WHERE NOT valid)) * 100.0 / count(*) + 0.5) AS INTEGER) AS valid_percent
FROM (SELECT {_QUAD_VALID_SQL} AS valid FROM {L.SQL_QUADS} q)""")
def q_validity_summary(spark, sf):
    """Total, invalid and valid percent (JS rounding)."""
    return A.validity_summary("order_quads", L.order_quads(spark, sf), G.is_valid("geometry"))


def _shoelace(pts):
    n = len(pts)
    terms = [f"({pts[i][0]} * {pts[(i + 1) % n][1]} - {pts[(i + 1) % n][0]} * {pts[i][1]})" for i in range(n)]
    return "(" + " + ".join(terms) + ") / 2"


_QA, _QB = ("q.x0", "0.0"), ("(q.x0 + 1.0)", "0.0")
_QC, _QD = ("(q.x0 + q.u)", "1.0"), ("(q.x0 + q.v)", "1.0")


# crossing point X of the bow-tie's edges B->C (e) and D->A (f), same arithmetic as the Spark repair
_E = {"ax": "(q.x0 + 1.0)", "ay": "0.0", "bx": "(q.x0 + q.u)", "by": "1.0"}
_F = {"ax": "(q.x0 + q.v)", "ay": "1.0", "bx": "q.x0", "by": "0.0"}
_RX, _RY = f"({_E['bx']} - {_E['ax']})", f"({_E['by']} - {_E['ay']})"
_SX, _SY = f"({_F['bx']} - {_F['ax']})", f"({_F['by']} - {_F['ay']})"
_T = (f"((({_F['ax']} - {_E['ax']}) * {_SY} - ({_F['ay']} - {_E['ay']}) * {_SX})"
      f" / ({_RX} * {_SY} - {_RY} * {_SX}))")
_QX = (f"({_E['ax']} + {_T} * {_RX})", f"({_E['ay']} + {_T} * {_RY})")


@register("polygon_faults", f"SELECT o_orderkey, fault FROM {L.SQL_SHAPES} WHERE fault IS NOT NULL")
def q_polygon_faults(spark, sf):
    from .operators import planar
    return planar.polygon_faults(L.order_shapes(spark, sf), "o_orderkey")


@register("repair_polygons", f"""
SELECT o_orderkey, fault, CAST(n_parts AS INTEGER) AS n_parts, CAST(n_rings AS INTEGER) AS n_rings,
       round(area, 6) AS area, true AS valid_after FROM {L.SQL_SHAPES}""")
def q_repair_polygons(spark, sf):
    """Polygons of several crossings, overlapping parts and misplaced holes, made valid; validity afterwards is measured."""
    from .operators import planar
    fixed = planar.with_validity(planar.repair(L.order_shapes(spark, sf), "o_orderkey"), "o_orderkey", name="valid_after")
    parts = F.col("geometry.parts")
    return fixed.select("o_orderkey", "fault", F.size(parts).alias("n_parts"), F.size(F.flatten(parts)).alias("n_rings"),
                        F.round(planar.area("geometry"), 6).alias("area"), "valid_after")


@register("make_valid", f"""
SELECT q.o_orderkey, {_QUAD_VALID_SQL} AS valid_before, true AS valid_after,
  CASE WHEN q.u < q.v THEN 2 ELSE 1 END AS n_parts,
  round(CASE WHEN q.u < q.v THEN abs({_shoelace([_QA, _QB, _QX])}) + abs({_shoelace([_QX, _QC, _QD])})
             WHEN q.u = q.v THEN abs({_shoelace([_QA, _QB, _QC])})
             ELSE abs({_shoelace([_QA, _QB, _QC, _QD])}) END, 6) AS area_after
FROM {L.SQL_QUADS} q""")
def q_make_valid(spark, sf):
    """Repair (drop repeated vertices, close, split bow-ties at the
    crossing, orient CCW): every quad becomes valid; area summed over parts."""
    q = L.order_quads(spark, sf).withColumn("fixed", G.make_valid("geometry"))
    area = F.aggregate(F.col("fixed")["parts"], F.lit(0.0), lambda acc, part: acc + F.abs(G._signed_area(part[0])))
    return q.select("o_orderkey", G.is_valid("geometry").alias("valid_before"),
                    G.is_valid("fixed").alias("valid_after"), F.size(F.col("fixed")["parts"]).alias("n_parts"),
                    F.round(area, 6).alias("area_after"))


# ---------------------------------------------------------------- G1, G2, G5, G6 reprojection and extents

def _sql_merc(lon, lat):
    R = G.WGS84_A
    return (f"({R} * radians({lon}))", f"({R} * ln(tan(pi() / 4 + radians({lat}) / 2)))")


def _sql_utm_forward(lon, lat, zone):
    """The same Krüger series as G.from_wgs84, spelled in SQL."""
    import math
    n, Acoef, alpha, _, _ = G._kruger(G.GRS80_A, G.GRS80_F)
    lam0 = math.radians(zone * 6 - 183)
    k = 2 * math.sqrt(n) / (1 + n)
    sphi = f"sin(radians({lat}))"
    t = f"sinh(atanh({sphi}) - {k!r} * atanh({k!r} * {sphi}))"
    dl = f"(radians({lon}) - {lam0!r})"
    xi = f"atan({t} / cos({dl}))"
    eta = f"atanh(sin({dl}) / sqrt(1 + {t} * {t}))"
    e_sum, n_sum = eta, xi
    for j, al in enumerate(alpha, start=1):
        e_sum = f"({e_sum} + {al!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta}))"
        n_sum = f"({n_sum} + {al!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta}))"
    kA = G.UTM_K0 * Acoef
    return f"({G.UTM_E0!r} + {kA!r} * {e_sum})", f"({kA!r} * {n_sum})"


_MX, _MY = _sql_merc(PX, PY)


@register("reproject_mercator", f"SELECT event_id, round({_MX}, 3) AS x, round({_MY}, 3) AS y FROM events")
def q_reproject_mercator(spark, sf):
    """G1: points EPSG:4326 -> EPSG:3857."""
    p = L.event_points(spark, sf)
    x, y = G.reproject_xy(F.col("x"), F.col("y"), 4326, 3857)
    return p.select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_UX, _UY = _sql_utm_forward(PX, PY, 33)


@register("reproject_utm", f"SELECT event_id, round({_UX}, 3) AS x, round({_UY}, 3) AS y FROM events")
def q_reproject_utm(spark, sf):
    """G1: points EPSG:4326 -> EPSG:25833 (transverse Mercator, Krüger series)."""
    p = L.event_points(spark, sf)
    x, y = G.reproject_xy(F.col("x"), F.col("y"), 4326, 25833)
    return p.select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@register("reproject_roundtrip", "SELECT count(*) AS n, true AS within_1e_9_deg FROM events")
def q_reproject_roundtrip(spark, sf):
    """G1 both ways: 4326 -> 25833 -> 4326 returns every point within 1e-9 degrees."""
    p = L.event_points(spark, sf)
    x, y = G.reproject_xy(F.col("x"), F.col("y"), 4326, 25833)
    q = p.select("x", "y", x.alias("ux"), y.alias("uy"))
    lon, lat = G.reproject_xy(F.col("ux"), F.col("uy"), 25833, 4326)
    err = F.greatest(F.abs(lon - F.col("x")), F.abs(lat - F.col("y")))
    return q.agg(F.count(F.lit(1)).alias("n"), (F.max(err) < 1e-9).alias("within_1e_9_deg"))


@register("bbox_to_wgs84", f"""
SELECT n_regionkey, round(degrees(mx0 / {G.WGS84_A}), 9) AS west,
  round(degrees(2 * atan(exp(my0 / {G.WGS84_A})) - pi() / 2), 9) AS south,
  round(degrees(mx1 / {G.WGS84_A}), 9) AS east,
  round(degrees(2 * atan(exp(my1 / {G.WGS84_A})) - pi() / 2), 9) AS north
FROM (SELECT n_regionkey, min({_sql_merc('x0', 'y0')[0]}) AS mx0, min({_sql_merc('x0', 'y0')[1]}) AS my0,
             max({_sql_merc('x1', 'y1')[0]}) AS mx1, max({_sql_merc('x1', 'y1')[1]}) AS my1
      FROM {_RECTS} GROUP BY n_regionkey)""")
def q_bbox_to_wgs84(spark, sf):
    """Per-region extent held in EPSG:3857, converted corner-wise to WGS84."""
    n = L.nation_polygons(spark, sf)
    x0, y0 = G.reproject_xy(F.col("min_x"), F.col("min_y"), 4326, 3857)
    x1, y1 = G.reproject_xy(F.col("max_x"), F.col("max_y"), 4326, 3857)
    ext = n.select("n_regionkey", x0.alias("a"), y0.alias("b"), x1.alias("c"), y1.alias("d")) \
        .groupBy("n_regionkey").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.max("c").alias("c"),
                                    F.max("d").alias("d"))
    box = G.bbox_to_wgs84("a", "b", "c", "d", 3857)
    return ext.select("n_regionkey", *[F.round(box[k], 9).alias(k) for k in ("west", "south", "east", "north")])


_LON_SQL = f"(({PX} - 18.0) * 20.0)"
_LAT_SQL = f"(({PY} - 64.5) * 20.0)"


@register("clamp_round_extent", f"""
SELECT event_id, floor(greatest(-180.0, least(180.0, {_LON_SQL})) / 7.0 * 10000.0 + 0.5) / 10000.0 AS lon,
  floor(greatest(-90.0, least(90.0, {_LAT_SQL})) / 7.0 * 10000.0 + 0.5) / 10000.0 AS lat FROM events""")
def q_clamp_round_extent(spark, sf):
    """Clamp to +-180 / +-90, then round half up to 4 decimals (JS rounding)."""
    p = L.event_points(spark, sf)
    lon = (F.col("x") - 18.0) * 20.0
    lat = (F.col("y") - 64.5) * 20.0
    return p.select("event_id", G.round_half_up(G.clamp_lon(lon) / 7.0, 4).alias("lon"),
                    G.round_half_up(G.clamp_lat(lat) / 7.0, 4).alias("lat"))


@register("extent_checks", """
SELECT o_orderkey, abs(e - w) AS width, abs(n - s) AS height,
  NOT (abs(e - w) > 0.00001 AND abs(n - s) > 0.00001) AS degenerate, (w >= e OR s >= n) AS invalid_order
FROM (SELECT o_orderkey, CAST(o_custkey % 100 AS DOUBLE) AS w, CAST(o_orderkey % 50 AS DOUBLE) AS s,
             CAST(o_custkey % 100 AS DOUBLE) + (o_totalprice - 50000.0) / 100000.0 AS e,
             CAST(o_orderkey % 50 AS DOUBLE) + CAST(o_orderkey % 7 - 1 AS DOUBLE) AS n FROM orders)""")
def q_extent_checks(spark, sf):
    """Width, height, degenerate and inverted boxes (boxes derived per order)."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 100).cast("double").alias("w"),
        (F.col("o_orderkey") % 50).cast("double").alias("s"),
        ((F.col("o_custkey") % 100).cast("double") + (F.col("o_totalprice") - 50000.0) / 100000.0).alias("e"),
        ((F.col("o_orderkey") % 50).cast("double") + (F.col("o_orderkey") % 7 - 1).cast("double")).alias("n"))
    c = G.extent_checks("w", "s", "e", "n")
    return o.select("o_orderkey", *[c[k].alias(k) for k in ("width", "height", "degenerate", "invalid_order")])


# ---------------------------------------------------------------- T1-T4, T8 names and checksums

from .functions import names as N  # noqa: E402


def _sql_technical_name(c):
    x = f"strip_accents(replace(replace(replace(lower({c}), 'æ', 'ae'), 'ø', 'oe'), 'å', 'aa'))"
    x = f"regexp_replace(regexp_replace(regexp_replace({x}, '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '_+$', '')"
    x = f"(CASE WHEN regexp_matches({x}, '^[0-9]') THEN '_' || {x} ELSE regexp_replace({x}, '^_+', '') END)"
    return f"(CASE WHEN {c} IS NULL OR {c} = '' THEN '' WHEN {x} = '' THEN 'untitled_field' ELSE {x} END)"


@register("technical_names", f"""
SELECT p_partkey, {_sql_technical_name('p_name')} AS technical_name,
  regexp_replace(lower(p_type), '[^a-z0-9]', '_', 'g') AS table_name,
  upper(substr({_sql_technical_name('p_name')}, 1, 1)) || replace(substr({_sql_technical_name('p_name')}, 2), '_', ' ')
    AS title FROM part""")
def q_technical_names(spark, sf):
    """Technical name, table name and title over every part name/type."""
    p = table(spark, sf, "part")
    tn = N.technical_name("p_name")
    return p.select("p_partkey", tn.alias("technical_name"), N.table_name("p_type").alias("table_name"),
                    N.title_from_name(tn).alias("title"))


@register("document_names", f"""
SELECT doc_id, {_sql_technical_name('text')} AS technical_name FROM documents""")
def q_document_names(spark, sf):
    """T1 over whole document texts (four languages, accents, junk characters)."""
    return table(spark, sf, "documents").select("doc_id", N.technical_name("text").alias("technical_name"))


@register("strip_extension", r"""
SELECT page_id, regexp_replace(url, '\.[^/.]+$', '') AS stem FROM pages""")
def q_strip_extension(spark, sf):
    """T4: trailing extension removed from every page URL."""
    return table(spark, sf, "pages").select("page_id", N.strip_extension("url").alias("stem"))


@register("content_checksum", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def q_content_checksum(spark, sf):
    """SHA-256 of each document's content."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"))


# ---------------------------------------------------------------- F9-F15 mapping

from .operators import mapping as M  # noqa: E402
from .operators import joins as J  # noqa: E402


@register("map_fields", """
SELECT o_orderkey AS id, o_totalprice AS price, o_orderdate AS created FROM orders""")
def q_map_fields(spark, sf):
    """mapped properties only, renamed to the target model."""
    return M.map_fields(table(spark, sf, "orders"), {"o_orderkey": "id", "o_totalprice": "price",
                                                    "o_orderdate": "created"})


_PRIORITY_MAP = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "normal", "5-LOW": ""}


@register("map_values", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' WHEN o_orderpriority = '2-HIGH' THEN 'high'
  WHEN o_orderpriority = '3-MEDIUM' THEN 'normal' WHEN o_orderpriority = '5-LOW' THEN NULL
  ELSE o_orderpriority END AS priority FROM orders""")
def q_map_values(spark, sf):
    """F10, CASE form: an empty target maps to NULL, unmapped values pass."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return M.map_values(o, "o_orderpriority", _PRIORITY_MAP, out_col="priority").select("o_orderkey", "priority")


_NAME_MAP_SQL = """(SELECT c_name AS source_value,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE lower(c_name) END AS target_value FROM customer WHERE c_acctbal > 0)"""


@register("map_values_table", f"""
SELECT c.c_custkey, CASE WHEN m.source_value IS NOT NULL THEN NULLIF(m.target_value, '') ELSE c.c_name END AS c_name
FROM customer c LEFT JOIN {_NAME_MAP_SQL} m ON c.c_name = m.source_value""")
def q_map_values_table(spark, sf):
    """F10, table form: a value map with one pair per customer in credit (far
    more than 100 pairs), applied by a join with a found flag; customers in
    debit keep their name, building-segment names map to NULL."""
    c = table(spark, sf, "customer")
    m = c.filter(F.col("c_acctbal") > 0).select(
        F.col("c_name").alias("source_value"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.lower("c_name")).alias("target_value"))
    return M.map_values(c.select("c_custkey", "c_name"), "c_name", m)


@register("fill_defaults", """
SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(n_chars, 0) AS n_chars, 'import' AS origin FROM documents""")
def q_fill_defaults(spark, sf):
    """NULLs filled with column defaults; an omitted column is added with its default."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return M.fill_defaults(d, {"lang": "und", "n_chars": 0, "origin": "import"})


def _conform(spark, sf):
    from pyspark.sql import types as T
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"),
                                             F.col("n_chars").cast("string").alias("n_chars"), "lang", "source", "text")
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("n_chars", T.LongType()),
                           T.StructField("text", T.DateType()),
                           T.StructField("lang", T.BooleanType()), T.StructField("source", T.DoubleType())])
    return M.conform_schema(d, schema, ["doc_id"])


@register("conform_rejects", """
SELECT doc_id, field, value FROM (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'n_chars' AS field, CAST(n_chars AS VARCHAR) AS value FROM documents
    WHERE n_chars IS NOT NULL AND TRY_CAST(CAST(n_chars AS VARCHAR) AS BIGINT) IS NULL
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'text', text FROM documents WHERE TRY_CAST(text AS DATE) IS NULL AND text IS NOT NULL
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'lang', lang FROM documents
    WHERE lang IS NOT NULL AND TRY_CAST(lang AS BOOLEAN) IS NULL
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'source', source FROM documents
    WHERE source IS NOT NULL AND TRY_CAST(source AS DOUBLE) IS NULL)""")
def q_conform_rejects(spark, sf):
    """values that do not parse as the declared type are set aside."""
    return _conform(spark, sf)[1]


@register("conform_geometry", """
SELECT geometry_type, rejected, count(*) AS n FROM (
  SELECT 'MultiPoint' AS geometry_type, false AS rejected FROM events
  UNION ALL SELECT 'LineString', true FROM events UNION ALL SELECT 'Polygon', true FROM nation)
GROUP BY geometry_type, rejected""")
def q_conform_geometry(spark, sf):
    """a mixed layer forced to MultiPoint: points promoted, others rejected."""
    mixed = (_points(spark, sf).select("geometry")
             .unionByName(L.event_segments(spark, sf).select("geometry"))
             .unionByName(_nations(spark, sf).select("geometry")))
    ok, bad = M.conform_geometry(mixed, "MultiPoint")
    return (ok.select(F.col("geometry.type").alias("geometry_type"), F.lit(False).alias("rejected"))
            .unionByName(bad.select(F.col("geometry.type").alias("geometry_type"), F.lit(True).alias("rejected")))
            .groupBy("geometry_type", "rejected").agg(F.count(F.lit(1)).alias("n")))


def _sql_wkt_pair(a, b):
    number = lambda c, d: f"regexp_replace(CAST({c} + CAST({d} AS DOUBLE) AS VARCHAR), '[.]0$', '')"
    return f"concat({number('x0', a)}, ' ', {number('y0', b)})"


def _sql_wkt_ring(a, b):
    corners = ((a, a), (b, a), (b, b), (a, b), (a, a))
    return "concat('(', " + ", ', ', ".join(_sql_wkt_pair(*c) for c in corners) + ", ')')"


_SQL_OUTER, _SQL_INNER = _sql_wkt_ring(0.0, 1.5), _sql_wkt_ring(0.25, 1.0)
_SQL_RINGS = "o_orderkey, 10, x0, y0, x0 + CAST(0.25 AS DOUBLE), y0 + CAST(0.25 AS DOUBLE)"


@register("geometry_wkt", f"""
SELECT 'Point' AS type, event_id AS id, 1 AS n_points, {PX} AS first_x, {PY} AS first_y, {PX} AS last_x, {PY} AS last_y,
  CAST(NULL AS VARCHAR) AS wkt FROM events
UNION ALL SELECT 'LineString', event_id, 2, {PX}, {PY}, {L.SQL_NEXT_X}, {L.SQL_NEXT_Y}, NULL FROM events
UNION ALL SELECT 'MultiPoint', event_id, 3, x, y, x + CAST(0.5 AS DOUBLE), y + CAST(0.75 AS DOUBLE), NULL FROM {L.SQL_VISITS}
UNION ALL SELECT 'Polygon', {_SQL_RINGS}, concat('POLYGON (', {_SQL_OUTER}, ', ', {_SQL_INNER}, ')') FROM {L.SQL_PARCELS}
UNION ALL SELECT 'MultiLineString', {_SQL_RINGS}, concat('MULTILINESTRING (', {_SQL_OUTER}, ', ', {_SQL_INNER}, ')') FROM {L.SQL_PARCELS}
UNION ALL SELECT 'MultiPolygon', {_SQL_RINGS}, concat('MULTIPOLYGON ((', {_SQL_OUTER}, '), (', {_SQL_INNER}, '))') FROM {L.SQL_PARCELS}""")
def q_geometry_wkt(spark, sf):
    """Geometries of all types written as text and read again: their points, and the text of those with rings or lines."""
    parcels = L.order_parcels(spark, sf, spread=True).select(F.col("o_orderkey").alias("id"), "geometry")
    apart = F.transform(F.col("geometry.parts")[0], lambda ring: F.array(ring))
    several = [parcels.select("id", F.struct(F.lit(t).alias("type"), F.col("geometry.srid").alias("srid"), apart.alias("parts")).alias("geometry"))
               for t in ("MultiLineString", "MultiPolygon")]
    places = L.narrow(spark, sf, "events", "event_id", spread=True).select("event_id", G.point(L.point_x(), L.point_y(), 4326).alias("geometry"))
    events = [places, L.event_segments(spark, sf, spread=True).select("event_id", "geometry"),
              L.town_visits(spark, sf, spread=True).select("event_id", F.col("trail").alias("geometry"))]
    layers = [e.withColumnRenamed("event_id", "id") for e in events] + [parcels, *several]
    rows = [x.select("id", W.from_wkt(W.to_wkt("geometry")).alias("g")) for x in layers]
    points = F.flatten(F.flatten("g.parts"))
    first, last = F.get(points, F.lit(0)), F.element_at(points, -1)
    return A.union_all([x.select(
        F.col("g.type").alias("type"), "id", F.size(points).alias("n_points"), first["x"].alias("first_x"), first["y"].alias("first_y"),
        last["x"].alias("last_x"), last["y"].alias("last_y"),
        F.when(F.col("g.type").isin("Polygon", "MultiLineString", "MultiPolygon"), W.to_wkt("g")).alias("wkt")) for x in rows])


# ---------------------------------------------------------------- J2-J4, J10, J11 key joins

@register("join_reference", """
SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, o.o_orderdate FROM lineitem l LEFT JOIN orders o
  ON l.l_orderkey = o.o_orderkey""")
def q_join_reference(spark, sf):
    """Every line item with its order's attributes (FK left join)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return J.join_reference(li, table(spark, sf, "orders"), "l_orderkey", "o_orderkey", ["o_custkey", "o_orderdate"])


@register("fk_orphans", """
SELECT 'lineitem.l_orderkey' AS fk, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem
  WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL)
UNION ALL SELECT 'orders.o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
  WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)
UNION ALL SELECT 'lineitem.l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem
  WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL)
UNION ALL SELECT 'customer.c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
  WHERE c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey IS NOT NULL)""")
def q_fk_orphans(spark, sf):
    """Child keys with no parent, over four foreign keys."""
    t = lambda n: table(spark, sf, n)
    checks = [("lineitem.l_orderkey", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
              ("orders.o_custkey", t("orders"), "o_custkey", t("customer"), "c_custkey"),
              ("lineitem.l_partkey", t("lineitem"), "l_partkey", t("part"), "p_partkey"),
              ("customer.c_nationkey", t("customer"), "c_nationkey", t("nation"), "n_nationkey")]
    return A.union_all([J.fk_orphans(c.select(fk), p, fk, pk).select(F.lit(name).alias("fk"),
                                                                      F.col(fk).cast("string").alias("key"))
                        for name, c, fk, p, pk in checks])


@register("cascade_delete", """
WITH n AS (SELECT n_nationkey AS key FROM nation WHERE n_name = 'NATION_7'),
c AS (SELECT c_custkey AS key FROM customer WHERE c_nationkey IN (SELECT key FROM n)),
o AS (SELECT o_orderkey AS key FROM orders WHERE o_custkey IN (SELECT key FROM c)),
l AS (SELECT l_orderkey AS key FROM lineitem WHERE l_orderkey IN (SELECT key FROM o))
SELECT level, count(*) AS deleted FROM (
  SELECT 0 AS level FROM n UNION ALL SELECT 1 FROM c UNION ALL SELECT 2 FROM o UNION ALL SELECT 3 FROM l)
GROUP BY level""")
def q_cascade_delete(spark, sf):
    """Deleting a nation removes its customers, their orders and line items."""
    t = lambda n: table(spark, sf, n)
    root = t("nation").filter(F.col("n_name") == "NATION_7").select("n_nationkey")
    levels = J.cascade_delete([(t("customer"), "c_nationkey", "c_custkey"), (t("orders"), "o_custkey", "o_orderkey"),
                               (t("lineitem"), "l_orderkey", "l_orderkey")], root)
    return A.union_all([k.select(F.lit(i).alias("level")) for i, k in enumerate(levels)]) \
        .groupBy("level").agg(F.count(F.lit(1)).alias("deleted"))


@register("codelist_labels", """
SELECT c.c_custkey, c.c_nationkey, n.n_name AS c_nationkey_label FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def q_codelist_labels(spark, sf):
    """Code -> label from the nation code list (broadcast, size-checked)."""
    return J.codelist_labels(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey",
                             table(spark, sf, "nation"), "n_nationkey", "n_name")


@register("inverse_pairs", """
SELECT c.c_custkey, o.o_orderkey AS inverse_o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey""")
def q_inverse_pairs(spark, sf):
    """The inverse end of orders.o_custkey, as (customer, order) rows."""
    return J.inverse_pairs(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey",
                           "o_orderkey")


@register("inverse_counts", """
SELECT c.c_custkey, count(o.o_orderkey) AS n_inverse FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey""")
def q_inverse_counts(spark, sf):
    """J11 summary: orders per customer (zero included)."""
    return J.inverse_counts(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey")


# ---------------------------------------------------------------- C16-C18 nested constraints

_RATE = C.Constraints(min=0.0, max=0.08)   # a shared type "rate" with type-level constraints


@register("dq_nested", """
SELECT l_orderkey, l_linenumber, 'min' AS rule, 'terms.discount' AS field, CAST(l_discount AS VARCHAR) AS value
  FROM lineitem WHERE l_discount < 0.0
UNION ALL SELECT l_orderkey, l_linenumber, 'max', 'terms.discount', CAST(l_discount AS VARCHAR) FROM lineitem
  WHERE l_discount > 0.08
UNION ALL SELECT l_orderkey, l_linenumber, 'min', 'terms.tax', CAST(l_tax AS VARCHAR) FROM lineitem WHERE l_tax < 0.0
UNION ALL SELECT l_orderkey, l_linenumber, 'max', 'terms.tax', CAST(l_tax AS VARCHAR) FROM lineitem WHERE l_tax > 0.05
UNION ALL SELECT l_orderkey, l_linenumber, 'required', 'terms.qty', NULL FROM lineitem WHERE l_quantity IS NULL""")
def q_dq_nested(spark, sf):
    """A struct field typed by a shared type; the type's constraints
    hold for its leaves, the field overrides ``tax`` max; ``qty`` is required."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.struct(F.col("l_quantity").alias("qty"), F.col("l_discount").alias("discount"),
                 F.col("l_tax").alias("tax")).alias("terms"))
    rules = C.rules_for_struct("terms", {"tax": C.Constraints(max=0.05)},
                               type_leaves={"discount": _RATE, "tax": _RATE}, required_leaves=["qty"])
    return C.row_violations(li, ["l_orderkey", "l_linenumber"], rules)


@register("dq_array_items", """
SELECT vec_id, 'non_empty' AS rule, 'embedding' AS field, CAST(len(embedding) AS VARCHAR) AS value FROM embeddings
  WHERE len(embedding) < 1
UNION ALL SELECT vec_id, 'required', 'embedding[]', CAST(len(embedding) AS VARCHAR) FROM embeddings
  WHERE len(embedding) > list_count(embedding)
UNION ALL SELECT vec_id, 'max', 'embedding[]', CAST(len(embedding) AS VARCHAR) FROM embeddings
  WHERE list_max(embedding) > 0.25
UNION ALL SELECT vec_id, 'min', 'embedding[]', CAST(len(embedding) AS VARCHAR) FROM embeddings
  WHERE list_min(embedding) < -0.25""")
def q_dq_array_items(spark, sf):
    """A ``1..*`` array must be non-empty, items are required and
    each item lies in [-0.25, 0.25]."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    rules = [C.Rule("non_empty", "embedding"), C.Rule("item_required", "embedding", name="required"),
             C.Rule("item_max", "embedding", 0.25, name="max"), C.Rule("item_min", "embedding", -0.25, name="min")]
    return C.row_violations(e, ["vec_id"], rules)


# ---------------------------------------------------------------- F8 collections

def _merc_inv_sql(x, y):
    R = G.WGS84_A
    return f"degrees({x} / {R})", f"degrees(2 * atan(exp({y} / {R})) - pi() / 2)"


_MERC_EXT = f"""(SELECT min({_MX}) AS x0, min({_MY}) AS y0, max({_MX}) AS x1, max({_MY}) AS y1, count(*) AS n
  FROM events)"""


@register("collections", f"""
SELECT 'events' AS id, 'Events' AS title, n AS feature_count,
  round({_merc_inv_sql('x0', 'y0')[0]}, 9) AS west, round({_merc_inv_sql('x0', 'y0')[1]}, 9) AS south,
  round({_merc_inv_sql('x1', 'y1')[0]}, 9) AS east, round({_merc_inv_sql('x1', 'y1')[1]}, 9) AS north,
  ['http://www.opengis.net/def/crs/OGC/1.3/CRS84', 'http://www.opengis.net/def/crs/EPSG/0/3857',
   'http://www.opengis.net/def/crs/EPSG/0/4326', 'http://www.opengis.net/def/crs/EPSG/0/4258'] AS crs,
  ['events', 'points'] AS keywords
FROM {_MERC_EXT}
UNION ALL
SELECT 'nation', 'nation', count(*),
  round({_merc_inv_sql(f"min({_sql_merc('x0', 'y0')[0]})", "0")[0]}, 9),
  round({_merc_inv_sql("0", f"min({_sql_merc('x0', 'y0')[1]})")[1]}, 9),
  round({_merc_inv_sql(f"max({_sql_merc('x1', 'y1')[0]})", "0")[0]}, 9),
  round({_merc_inv_sql("0", f"max({_sql_merc('x1', 'y1')[1]})")[1]}, 9),
  ['http://www.opengis.net/def/crs/OGC/1.3/CRS84', 'http://www.opengis.net/def/crs/EPSG/0/3857',
   'http://www.opengis.net/def/crs/EPSG/0/4326', 'http://www.opengis.net/def/crs/EPSG/0/4258'],
  CAST([] AS VARCHAR[]) FROM {_RECTS}""")
def q_collections(spark, sf):
    """F8: one row per layer held in EPSG:3857: id, title, count, CRS84 bbox
    (corners converted), CRS list, keywords. One partial aggregate per layer."""
    p = L.event_points(spark, sf)
    px, py = G.reproject_xy(F.col("x"), F.col("y"), 4326, 3857)
    pts = p.select(px.alias("x"), py.alias("y"))
    n = L.nation_polygons(spark, sf)
    ax, ay = G.reproject_xy(F.col("min_x"), F.col("min_y"), 4326, 3857)
    bx, by = G.reproject_xy(F.col("max_x"), F.col("max_y"), 4326, 3857)
    rects = n.select(ax.alias("min_x"), ay.alias("min_y"), bx.alias("max_x"), by.alias("max_y"))
    c = Q.collections({"events": (pts, ("x", "y", "x", "y")), "nation": (rects, ("min_x", "min_y", "max_x", "max_y"))},
                      crs="EPSG:3857", titles={"events": "Events"}, keywords={"events": ["events", "points"]})
    return c.select("id", "title", "feature_count", *[F.round(k, 9).alias(k) for k in ("west", "south", "east", "north")],
                    "crs", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


# ---------------------------------------------------------------- C15 SRID mismatch

@register("srid_mismatch", """
SELECT 'events' AS layer, CASE WHEN event_type = 'error' THEN 3857 ELSE 4326 END AS srid, count(*) AS n FROM events
WHERE event_type = 'error' OR user_id % 3 = 0 GROUP BY ALL""")
def q_srid_mismatch(spark, sf):
    """A layer with geometries in three systems against a model in EPSG:25833."""
    pts = L.event_points(spark, sf, with_geometry=True)
    srid = F.when(F.col("event_type") == "error", 3857).when(F.col("user_id") % 3 == 0, 4326).otherwise(25833)
    return C.srid_mismatch("events", pts.withColumn("geometry", F.col("geometry").withField("srid", srid)), 25833)


@register("json_field_types_first", """
SELECT k AS key, CASE WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean'
  WHEN t = 'DOUBLE' AND v <> floor(v) THEN 'number' WHEN t IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN 'integer'
  ELSE 'string' END AS base_type
FROM (SELECT k, json_type(props, '$."' || k || '"') AS t,
             TRY_CAST(json_extract_string(props, '$."' || k || '"') AS DOUBLE) AS v
      FROM (SELECT props, unnest(json_keys(props)) AS k FROM (SELECT props FROM events ORDER BY event_id LIMIT 1)))""")
def q_json_field_types_first(spark, sf):
    """A7 parity mode: key types read from the first feature only (top-1 by id)."""
    return A.json_field_types_first(table(spark, sf, "events"), "props", "event_id")


# ---------------------------------------------------------------- Entry 1: import summary

from .plans import layers as P  # noqa: E402


def _import_layers(spark, sf):
    return {"events": P.LayerSource(_point_layer(spark, sf).drop("x", "y"), "Point", 4326, "event_id",
                                    bbox_cols=("min_x", "min_y", "max_x", "max_y")),
            "nation": P.LayerSource(L.nation_polygons(spark, sf), "Polygon", 4326, "n_nationkey", "geometry",
                                    ("min_x", "min_y", "max_x", "max_y")),
            "lineitem": P.LayerSource(table(spark, sf, "lineitem"), None, None, "l_orderkey"),
            "part": P.LayerSource(table(spark, sf, "part"), None, None, "p_name")}


_SUMMARY_SQL = f"""
SELECT 'events' AS layer, count(*) AS feature_count,
  (SELECT count(*) FROM information_schema.columns WHERE table_name = 'events') AS column_count,
  'Point' AS geometry_type, 4326 AS srid,
  'event_id' AS pk, min({PX}) AS min_x, min({PY}) AS min_y, max({PX}) AS max_x, max({PY}) AS max_y,
  count(*) FILTER (WHERE event_id IS NULL) AS null_pk,
  (SELECT count(*) FROM (SELECT event_id FROM events GROUP BY event_id HAVING count(*) > 1)) AS duplicate_pk_groups
FROM events
UNION ALL SELECT 'nation', count(*), (SELECT count(*) FROM information_schema.columns WHERE table_name = 'nation'),
  'Polygon', 4326, 'n_nationkey', min(x0), min(y0), max(x1), max(y1),
  count(*) FILTER (WHERE n_nationkey IS NULL),
  (SELECT count(*) FROM (SELECT n_nationkey FROM nation GROUP BY n_nationkey HAVING count(*) > 1)) FROM {_RECTS}
UNION ALL SELECT 'lineitem', count(*), (SELECT count(*) FROM information_schema.columns WHERE table_name = 'lineitem'),
  NULL, NULL, 'l_orderkey', NULL, NULL, NULL, NULL, count(*) FILTER (WHERE l_orderkey IS NULL),
  (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)) FROM lineitem
UNION ALL SELECT 'part', count(*), (SELECT count(*) FROM information_schema.columns WHERE table_name = 'part'),
  NULL, NULL, 'p_name', NULL, NULL, NULL, NULL, count(*) FILTER (WHERE p_name IS NULL),
  (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)) FROM part"""


@register("import_summary", f"""
SELECT *, (CASE WHEN null_pk > 0 THEN 1 ELSE 0 END) + (CASE WHEN duplicate_pk_groups > 0 THEN 1 ELSE 0 END) AS n_errors,
  CASE WHEN layer = 'part' THEN 1 ELSE 0 END AS n_warnings FROM ({_SUMMARY_SQL})""")
def q_import_summary(spark, sf):
    """Entry 1: per-layer import summary (A1, A2, C10-C13) from one aggregate
    pass per layer plus the keyed duplicate count."""
    return P.import_summary(_import_layers(spark, sf))[0]


# ---------------------------------------------------------------- F5 items response

@register("items_response", """
WITH m AS (SELECT event_id FROM events WHERE value >= 10.0 AND event_type <> 'error'),
p AS (SELECT event_id FROM m ORDER BY event_id LIMIT 25 OFFSET 50)
SELECT (SELECT count(*) FROM m) AS number_matched, (SELECT count(*) FROM p) AS number_returned,
  'items?offset=50&limit=25' AS self_href,
  CASE WHEN 50 + (SELECT count(*) FROM p) < (SELECT count(*) FROM m) THEN 'items?offset=75&limit=25' END AS next_href,
  'items?offset=25&limit=25' AS prev_href,
  (SELECT min(event_id) FROM p) AS first_id, (SELECT max(event_id) FROM p) AS last_id,
  (SELECT count(*) FROM p) AS body_features, (SELECT CAST(min(event_id) AS VARCHAR) FROM p) AS body_first_id""")
def q_items_response(spark, sf):
    """F5 response parts: match count, page size, paging links and the page's
    first and last ids, and the number of features and the first id in the GeoJSON body."""
    pts = L.event_points(spark, sf, with_geometry=True).select("event_id", "event_type", "value", "geometry")
    q = Q.items_compare(pts, [("value", ">=", 10.0), ("event_type", "<>", "error")])
    body = F.col("response")
    return Q.items_response(q, "event_id", limit=25, offset=50).select(
        "*", F.json_array_length(F.get_json_object(body, "$.features")).cast("long").alias("body_features"),
        F.get_json_object(body, "$.features[0].id").alias("body_first_id")).drop("response")


# ---------------------------------------------------------------- catalog jobs over derived catalogs

from .functions import types as TYP  # noqa: E402
from .operators import catalog as CAT  # noqa: E402
from .plans import catalogs as K  # noqa: E402
from .sources import readers as RD  # noqa: E402

_LAYERS_SQL, _FIELDS_SQL, _ENUMS_SQL = (K.sql(t, "duckdb") for t in (K.LAYERS, K.FIELDS, K.ENUMS))
_NEXT_SQL = K.sql(K.LAYERS_NEXT, "duckdb")
_CAT_WITH = f"l AS ({_LAYERS_SQL}), f AS ({_FIELDS_SQL}), e AS (SELECT DISTINCT model_id, enum_id FROM ({_ENUMS_SQL}))"
_UP_SQL = """par AS (SELECT l.model_id, l.layer_id, p.layer_id AS up FROM l JOIN l p ON l.model_id = p.model_id AND l.extends_id = p.layer_id),
walk AS (SELECT model_id, layer_id, layer_id AS anc, 0 AS dist, [layer_id] AS seen FROM l UNION ALL
  SELECT w.model_id, w.layer_id, p.up, w.dist + 1, list_append(w.seen, p.up) FROM walk w
  JOIN par p ON w.model_id = p.model_id AND w.anc = p.layer_id WHERE NOT list_contains(w.seen, p.up))"""


def _layers_cat(spark, sf):
    return K.catalog(spark, sf, K.LAYERS)


def _fields_cat(spark, sf):
    return K.catalog(spark, sf, K.FIELDS)


@register("catalog_lint_layers", f"""
WITH RECURSIVE {_CAT_WITH}, {_UP_SQL},
loops AS (SELECT DISTINCT w.model_id, w.layer_id FROM walk w JOIN par p ON w.model_id = p.model_id AND w.anc = p.layer_id
  WHERE list_contains(w.seen, p.up)),
n AS (SELECT model_id, layer_id, count(*) AS n, count(*) FILTER (WHERE is_pk) AS pk FROM f GROUP BY ALL),
k AS (SELECT model_id, layer_id, arg_min(kind, ordinal) AS kind, arg_min(base_type, ordinal) AS t, arg_min(multiplicity, ordinal) AS mult
  FROM f WHERE is_pk GROUP BY ALL),
j AS (SELECT l.*, coalesce(n.n, 0) AS n, coalesce(n.pk, 0) AS pk, k.kind, k.t, k.mult,
  EXISTS (SELECT 1 FROM l c WHERE c.model_id = l.model_id AND c.extends_id = l.layer_id) AS has_child,
  EXISTS (SELECT 1 FROM l p WHERE p.model_id = l.model_id AND p.layer_id = l.extends_id) AS has_parent
  FROM l LEFT JOIN n USING (model_id, layer_id) LEFT JOIN k USING (model_id, layer_id))
SELECT model_id, layer_id, 'error' AS severity, 'LAYER_DUPLICATE_NAME' AS code FROM
  (SELECT *, count(*) OVER (PARTITION BY model_id, coalesce(name, '(unnamed)')) AS c FROM l) WHERE c > 1
UNION ALL SELECT model_id, layer_id, 'error', 'LAYER_EXTENDS_CIRCULAR_DEEP' FROM loops
UNION ALL SELECT model_id, layer_id, 'warning', 'LAYER_NO_PROPERTIES' FROM j WHERE NOT is_abstract AND n = 0
UNION ALL SELECT model_id, layer_id, 'warning', 'LAYER_NO_PK' FROM j WHERE NOT is_abstract AND pk = 0 AND trim(pk_col) = ''
UNION ALL SELECT model_id, layer_id, 'warning', 'LAYER_PK_MULTIPLICITY' FROM j WHERE NOT is_abstract AND mult IN ('0..1', '0..*')
UNION ALL SELECT model_id, layer_id, 'hint', 'LAYER_PK_TYPE' FROM j WHERE NOT is_abstract AND kind = 'primitive' AND t <> 'integer'
UNION ALL SELECT model_id, layer_id, 'warning', 'LAYER_MULTIPLE_PKS' FROM j WHERE NOT is_abstract AND pk > 1
UNION ALL SELECT model_id, layer_id, 'warning', 'LAYER_NO_GEOM_COLUMN' FROM j WHERE NOT is_abstract AND geometry_type <> 'None' AND geom_col IS NULL
UNION ALL SELECT model_id, layer_id, 'hint', 'LAYER_NO_DESCRIPTION' FROM j WHERE trim(coalesce(description, '')) = ''
UNION ALL SELECT model_id, layer_id, 'hint', 'LAYER_ABSTRACT_UNUSED' FROM j WHERE is_abstract AND NOT has_child
UNION ALL SELECT model_id, layer_id, 'error', 'LAYER_EXTENDS_UNKNOWN' FROM j WHERE extends_id IS NOT NULL AND NOT has_parent""")
def q_catalog_lint_layers(spark, sf):
    """L1, L3-L6g: layer checks over all models."""
    out = CAT.lint(_layers_cat(spark, sf), _fields_cat(spark, sf), K.catalog(spark, sf, K.ENUMS))
    return out.where("field_id IS NULL").select("model_id", "layer_id", "severity", "code")


@register("catalog_lint_fields", f"""
WITH {_CAT_WITH}, i AS (SELECT model_id, layer_id, field_id, kind AS k FROM f),
j AS (SELECT f.*, l.layer_id IS NOT NULL AS tgt, l.geometry_type AS tg, i.k AS inv, e.enum_id IS NOT NULL AS known,
  row_number() OVER (PARTITION BY f.model_id, f.layer_id, f.name ORDER BY f.ordinal) AS r
  FROM f LEFT JOIN l ON f.model_id = l.model_id AND f.ref_layer_id = l.layer_id
  LEFT JOIN i ON f.model_id = i.model_id AND f.ref_layer_id = i.layer_id AND f.inverse_field_id = i.field_id
  LEFT JOIN e ON f.model_id = e.model_id AND f.enum_ref = e.enum_id),
x AS (SELECT model_id, layer_id, field_id, unnest([
  CASE WHEN r > 1 THEN 'error FIELD_DUPLICATE_NAME' END, CASE WHEN length(name) > 63 THEN 'warning FIELD_NAME_TOO_LONG' END,
  CASE WHEN kind = 'datatype-ref' AND trim(type_id) = '' THEN 'error FIELD_DATATYPE_REF_EMPTY' END,
  CASE WHEN kind = 'feature-ref' AND ref_layer_id IS NULL THEN 'error FIELD_FEATURE_REF_EMPTY' END,
  CASE WHEN kind = 'feature-ref' AND tgt AND tg = 'None' THEN 'hint FIELD_REF_TO_NONSPATIAL' END,
  CASE WHEN kind = 'feature-ref' AND tgt AND inverse_field_id IS NOT NULL AND coalesce(inv, '') <> 'feature-ref'
    THEN 'hint FIELD_FEATURE_REF_INVERSE_MISMATCH' END,
  CASE WHEN kind = 'codelist' AND mode = 'shared' AND (trim(enum_ref) = '' OR NOT known) THEN 'error FIELD_SHARED_ENUM_REF_MISSING' END,
  CASE WHEN kind = 'geometry' AND multiplicity IN ('0..*', '1..*') THEN 'hint MULTIPLICITY_ARRAY_ON_GEOMETRY' END]) AS v FROM j)
SELECT model_id, layer_id, field_id, split_part(v, ' ', 1) AS severity, split_part(v, ' ', 2) AS code FROM x WHERE v IS NOT NULL""")
def q_catalog_lint_fields(spark, sf):
    """Field checks over all models."""
    out = CAT.field_issues(_layers_cat(spark, sf), _fields_cat(spark, sf), K.catalog(spark, sf, K.ENUMS))
    return out.select("model_id", "layer_id", "field_id", "severity", "code")


@register("catalog_effective_fields", f"""
WITH RECURSIVE {_CAT_WITH}, {_UP_SQL}
SELECT w.model_id, w.layer_id, f.layer_id AS from_layer_id, f.field_id,
  CAST(row_number() OVER (PARTITION BY w.model_id, w.layer_id ORDER BY w.dist DESC, f.ordinal) AS INT) AS position
FROM walk w JOIN f ON w.model_id = f.model_id AND w.anc = f.layer_id""")
def q_catalog_effective_fields(spark, sf):
    """Fields of every layer through its parents, cycles cut."""
    out = CAT.effective_fields(_layers_cat(spark, sf), _fields_cat(spark, sf))
    return out.select("model_id", "layer_id", "from_layer_id", "field_id", "position")


@register("catalog_topo_order", f"""
WITH RECURSIVE {_CAT_WITH}, {_UP_SQL},
first AS (SELECT w.model_id, w.anc AS layer_id, min(l.ordinal) AS first FROM walk w JOIN l USING (model_id, layer_id) GROUP BY ALL),
deep AS (SELECT model_id, layer_id, max(dist) AS depth FROM walk GROUP BY ALL)
SELECT model_id, layer_id, CAST(row_number() OVER (PARTITION BY model_id ORDER BY first, depth, ordinal) AS INT) AS topo_position
FROM l JOIN first USING (model_id, layer_id) JOIN deep USING (model_id, layer_id)""")
def q_catalog_topo_order(spark, sf):
    """Parents before children."""
    placed = CAT.topo_order(_layers_cat(spark, sf))
    return placed.select("model_id", "layer_id", F.col("topo_position").cast("int").alias("topo_position"))


_DRIFT_SQL = f"""
SELECT model_id, layer_id, CASE WHEN o.layer_id IS NULL THEN 'added' WHEN n.layer_id IS NULL THEN 'deleted' ELSE 'modified' END AS type,
  coalesce(n.name, o.name) AS item_name,
  CASE WHEN o.layer_id IS NOT NULL AND n.layer_id IS NOT NULL THEN
    (o.name IS DISTINCT FROM n.name)::INT + (o.geometry_type IS DISTINCT FROM n.geometry_type)::INT
    + (o.description IS DISTINCT FROM n.description)::INT ELSE 0 END AS n_changes
FROM (SELECT * FROM l) o FULL JOIN (SELECT * FROM x) n USING (model_id, layer_id)"""


def _drift(spark, sf):
    f = _fields_cat(spark, sf)
    return CAT.schema_drift(_layers_cat(spark, sf), K.catalog(spark, sf, K.LAYERS_NEXT), f, f)


@register("catalog_drift", f"""
WITH {_CAT_WITH}, x AS ({_NEXT_SQL}) SELECT * FROM ({_DRIFT_SQL}) WHERE type <> 'modified' OR n_changes > 0""")
def q_catalog_drift(spark, sf):
    """Layers added, deleted and modified between two versions."""
    return _drift(spark, sf).select("model_id", "layer_id", "type", "item_name",
                                    F.coalesce(F.size("modified_fields"), F.lit(0)).alias("n_changes"))


_FIELD_CHANGES = " + ".join(f"(o.{c} IS DISTINCT FROM n.{c})::INT" for c in ("name", "base_type", "multiplicity", "default_value"))


@register("catalog_field_drift", f"""
SELECT * FROM (SELECT model_id, layer_id, field_id,
  CASE WHEN o.ordinal IS NULL THEN 'added' WHEN n.ordinal IS NULL THEN 'deleted' ELSE 'modified' END AS type,
  coalesce(n.name, o.name) AS item_name, CASE WHEN o.ordinal IS NOT NULL AND n.ordinal IS NOT NULL THEN {_FIELD_CHANGES} ELSE 0 END AS n_changes,
  CASE WHEN o.ordinal IS NOT NULL AND n.ordinal IS NOT NULL AND o.base_type IS DISTINCT FROM n.base_type THEN o.base_type END AS old_type
FROM ({K.sql(K.FIELDS, "duckdb")}) o FULL JOIN ({K.sql(K.FIELDS_NEXT, "duckdb")}) n USING (model_id, layer_id, field_id))
WHERE type <> 'modified' OR n_changes > 0""")
def q_catalog_field_drift(spark, sf):
    """Fields added, deleted and modified between two versions of the same layers; the old type where it changed."""
    layers = _layers_cat(spark, sf)
    drift = CAT.schema_drift(layers, layers, _fields_cat(spark, sf), K.catalog(spark, sf, K.FIELDS_NEXT))
    was = F.filter("modified_fields", lambda m: m["field"] == "base_type")
    return drift.filter("item_type = 'property'").select(
        "model_id", "layer_id", "field_id", "type", "item_name", F.coalesce(F.size("modified_fields"), F.lit(0)).alias("n_changes"),
        F.get(was, F.lit(0))["old_value"].alias("old_type"))


# Items of an order as fields within it; of the next version some are gone, new, renamed or of another type.
_SQL_NESTED = f"""
WITH items AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL), o AS ({K.sql(K.FIELDS, "duckdb")}), n AS ({K.sql(K.FIELDS_NEXT, "duckdb")}),
oc AS (SELECT model_id, layer_id, field_id AS parent, concat(field_id, '.', l_linenumber) AS field_id,
  concat('item', l_linenumber) AS name, l_returnflag AS base_type, concat(name, ' ▸ item', l_linenumber) AS path
  FROM o JOIN items ON ordinal = l_orderkey),
nc AS (SELECT model_id, layer_id, field_id AS parent,
  concat(field_id, '.', l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 37 = 0 THEN 'n' ELSE '' END) AS field_id,
  concat('item', l_linenumber, CASE WHEN l_linenumber = 3 THEN '_v2' ELSE '' END) AS name,
  CASE WHEN l_linenumber = 5 AND l_orderkey % 7 = 0 THEN 'X' ELSE l_returnflag END AS base_type,
  concat(name, ' ▸ item', l_linenumber, CASE WHEN l_linenumber = 3 THEN '_v2' ELSE '' END) AS path
  FROM n JOIN items ON ordinal = l_orderkey WHERE (l_orderkey + l_linenumber) % 29 <> 0)"""


@register("catalog_nested_drift", f"""{_SQL_NESTED}
SELECT * FROM (SELECT model_id, layer_id, field_id,
  CASE WHEN o.ordinal IS NULL THEN 'added' WHEN n.ordinal IS NULL THEN 'deleted' ELSE 'modified' END AS type,
  coalesce(n.name, o.name) AS item_name, CASE WHEN o.ordinal IS NOT NULL AND n.ordinal IS NOT NULL THEN {_FIELD_CHANGES} ELSE 0 END AS n_changes
  FROM o FULL JOIN n USING (model_id, layer_id, field_id)
UNION ALL SELECT model_id, layer_id, field_id,
  CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'deleted' ELSE 'modified' END, coalesce(b.path, a.path),
  CASE WHEN a.name IS NULL OR b.name IS NULL THEN 0
       ELSE (a.name IS DISTINCT FROM b.name)::INT + (a.base_type IS DISTINCT FROM b.base_type)::INT END
  FROM oc a FULL JOIN nc b USING (model_id, layer_id, parent, field_id)
  WHERE parent IN (SELECT field_id FROM o) AND parent IN (SELECT field_id FROM n))
WHERE type <> 'modified' OR n_changes > 0""")
def q_catalog_nested_drift(spark, sf):
    """Fields and the fields within them, added, deleted and modified between two versions, named by their paths."""
    old, new = _fields_cat(spark, sf), K.catalog(spark, sf, K.FIELDS_NEXT)
    line, key = F.col("l_linenumber"), F.col("l_orderkey")
    # line numbers repeat within an order: one item each
    items = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))

    def nested(fields, rows, field_id, name, base_type):
        inner = rows.join(fields, F.col("ordinal") == key).select(
            "model_id", "layer_id", field_id.alias("field_id"), F.col("field_id").alias("parent_field_id"),
            name.alias("name"), base_type.alias("base_type"))
        return fields.withColumn("parent_field_id", F.lit(None).cast("string")).unionByName(inner, allowMissingColumns=True)

    before = nested(old, items, F.concat("field_id", F.lit("."), line), F.concat(F.lit("item"), line), F.col("l_returnflag"))
    after = nested(new, items.where((key + line) % 29 != 0),
                   F.concat(F.col("field_id"), F.lit("."), line, F.when((key + line) % 37 == 0, "n").otherwise("")),
                   F.concat(F.lit("item"), line, F.when(line == 3, "_v2").otherwise("")),
                   F.when((line == 5) & (key % 7 == 0), "X").otherwise(F.col("l_returnflag")))
    layers = _layers_cat(spark, sf)
    return CAT.schema_drift(layers, layers, before, after).filter("item_type = 'property'").select(
        "model_id", "layer_id", "field_id", "type", "item_name", F.coalesce(F.size("modified_fields"), F.lit(0)).alias("n_changes"))


@register("catalog_next_version", f"""
WITH {_CAT_WITH}, x AS ({_NEXT_SQL}), d AS (SELECT * FROM ({_DRIFT_SQL}) WHERE type <> 'modified' OR n_changes > 0)
SELECT model_id, count(*) FILTER (type = 'deleted') AS n_deleted, count(*) FILTER (type = 'added') AS n_added, count(*) AS n_total,
  CASE WHEN count(*) FILTER (type = 'deleted') > 0 THEN '3.0.0' WHEN count(*) FILTER (type = 'added') > 0 THEN '2.5.0' ELSE '2.4.8' END AS version
FROM d GROUP BY model_id""")
def q_catalog_next_version(spark, sf):
    """Changes grouped by model through the changelog's sections, and the next version after 2.4.7."""
    lines = CAT.changelog_lines(_drift(spark, sf))
    n = lines.groupBy("model_id").agg(
        F.count_if(F.col("section") == "Breaking Changes").alias("n_deleted"),
        F.count_if(F.col("section") == "New Features").alias("n_added"), F.count(F.lit(1)).alias("n_total"))
    return n.withColumn("version", CAT.next_version(F.lit("2.4.7"), F.col("n_deleted"), F.col("n_added"), F.col("n_total")))


@register("catalog_group_changes", f"""
WITH {_CAT_WITH}, x AS ({_NEXT_SQL}) SELECT model_id, layer_id, 'layers' AS section, 1 AS layer_changes, 0 AS property_changes
FROM ({_DRIFT_SQL}) WHERE type <> 'modified' OR n_changes > 0""")
def q_catalog_group_changes(spark, sf):
    """Changes per owner."""
    g = CAT.group_changes(_drift(spark, sf))
    return g.select("model_id", "layer_id", "section", F.size("layer_changes").alias("layer_changes"),
                    F.size("property_changes").alias("property_changes"))


@register("catalog_clear_inverse", f"""
WITH {_CAT_WITH}, gone AS (SELECT model_id, layer_id, field_id FROM f WHERE ordinal % 5 = 3)
SELECT f.model_id, f.layer_id, f.field_id, CASE WHEN g.field_id IS NULL THEN f.inverse_field_id END AS inverse_field_id
FROM f LEFT JOIN gone g ON f.model_id = g.model_id AND f.ref_layer_id = g.layer_id AND f.inverse_field_id = g.field_id
WHERE f.ordinal % 5 <> 3""")
def q_catalog_clear_inverse(spark, sf):
    """Inverse pointers to deleted fields are cleared."""
    f = _fields_cat(spark, sf)
    out = CAT.clear_inverse_refs(f, f.where("ordinal % 5 = 3").select("model_id", "layer_id", "field_id"))
    return out.select("model_id", "layer_id", "field_id", "inverse_field_id")


@register("catalog_concrete_layers", f"SELECT model_id, layer_id FROM ({_LAYERS_SQL}) WHERE NOT is_abstract")
def q_catalog_concrete_layers(spark, sf):
    """layers that get a table."""
    return M.concrete_layers(_layers_cat(spark, sf)).select("model_id", "layer_id")


@register("catalog_rendering_order", f"""
WITH l AS ({_LAYERS_SQL}), o AS (SELECT model_id, list(layer_id ORDER BY ordinal DESC) AS ids FROM l WHERE ordinal % 3 > 0 GROUP BY model_id)
SELECT l.model_id, l.layer_id, CAST(list_position(o.ids, l.layer_id) - 1 AS INT) AS render_position
FROM l JOIN o ON l.model_id = o.model_id AND list_contains(o.ids, l.layer_id)""")
def q_catalog_rendering_order(spark, sf):
    """Layers by an explicit order per model."""
    l = _layers_cat(spark, sf)
    order = l.where("ordinal % 3 > 0").select("model_id", "layer_id", "ordinal")
    placed = CAT.rendering_order(l, order, by=[-F.col("ordinal")])
    return placed.select("model_id", "layer_id", F.col("render_position").cast("int").alias("render_position"))


@register("catalog_auto_map", f"""
WITH f AS ({_FIELDS_SQL}), s AS (SELECT layer_id, upper(name) AS c, min(ordinal) AS o FROM f WHERE ordinal % 2 = 0 GROUP BY ALL)
SELECT f.layer_id, f.field_id, f.name, arg_min(s.c, s.o) AS source_column FROM f
LEFT JOIN s ON f.layer_id = s.layer_id AND (lower(s.c) = lower(f.name) OR lower(s.c) = lower('F' || (f.ordinal % 5)))
GROUP BY ALL""")
def q_catalog_auto_map(spark, sf):
    """each field finds the first source column named as it or as its title."""
    f = _fields_cat(spark, sf)
    src = f.where("ordinal % 2 = 0").groupBy("layer_id", F.upper("name").alias("column_name")).agg(F.min("ordinal").alias("ordinal"))
    fields = f.select("layer_id", "field_id", "name", F.concat(F.lit("F"), F.col("ordinal") % 5).alias("title"))
    return M.auto_map(src, fields)


@register("describe_columns", """
SELECT 'public' AS table_schema, 's' || s_nationkey AS table_name, s_name AS column_name, CAST(s_suppkey AS INT) AS ordinal_position,
  CASE WHEN s_suppkey % 3 = 0 THEN 'PRIMARY KEY' WHEN s_suppkey % 3 = 1 THEN 'UNIQUE' END AS constraint_type,
  CASE WHEN s_suppkey % 4 = 0 THEN 'integer' WHEN s_suppkey % 4 = 1 THEN 'number' WHEN s_suppkey % 4 = 2 THEN 'date-time' ELSE 'geometry' END AS base_type,
  CASE WHEN s_acctbal < 0 THEN '0..1' ELSE '1..1' END AS multiplicity, s_suppkey % 3 = 0 AS is_pk, s_suppkey % 4 = 3 AS is_geometry FROM supplier""")
def q_describe_columns(spark, sf):
    """Described columns joined with their constraints, as fields."""
    s = table(spark, sf, "supplier")
    where = [F.lit("public").alias("table_schema"), F.concat(F.lit("s"), "s_nationkey").alias("table_name"), F.col("s_name").alias("column_name")]
    kind = F.element_at(F.array(*map(F.lit, ("bigint", "double precision", "timestamp", "geometry"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    cols = s.select(*where, F.col("s_suppkey").cast("int").alias("ordinal_position"), kind.alias("data_type"), kind.alias("udt_name"),
                    F.when(F.col("s_acctbal") < 0, "YES").otherwise("NO").alias("is_nullable"), F.lit(None).cast("string").alias("column_default"))
    used = s.where("s_suppkey % 3 < 2")
    name = F.concat(F.lit("c"), "s_suppkey").alias("constraint_name")
    usage = used.select(*where, name, F.lit("public").alias("constraint_schema"))
    rules = used.select(name, F.lit("public").alias("constraint_schema"),
                        F.when(F.col("s_suppkey") % 3 == 0, "PRIMARY KEY").otherwise("UNIQUE").alias("constraint_type"))
    d = CAT.describe_columns(cols, usage, rules)
    fields = CAT.import_catalog_fields(d)
    return d.join(fields, ["table_schema", "table_name", "column_name", "ordinal_position"]).select(
        "table_schema", "table_name", "column_name", "ordinal_position", "constraint_type", "base_type", "multiplicity", "is_pk", "is_geometry")


@register("connection_parts", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey ELSE '' END AS user,
  CASE WHEN c_custkey % 2 = 0 THEN 'p:' || c_custkey ELSE '' END AS password,
  'h' || (c_custkey % 7) AS host, CASE WHEN c_custkey % 3 = 0 THEN '6543' ELSE '5432' END AS port, 'db' || c_nationkey AS dbname,
  CASE WHEN c_custkey % 2 = 1 AND c_custkey % 5 = 0 THEN 'geo' ELSE 'public' END AS schema FROM customer""")
def q_connection_parts(spark, sf):
    """Parts of connection strings in both forms, one per customer."""
    c = table(spark, sf, "customer")
    k, port = F.col("c_custkey").cast("string"), F.col("c_custkey") % 3 == 0
    host, db = F.concat(F.lit("h"), F.col("c_custkey") % 7), F.concat(F.lit("db"), "c_nationkey")
    url = F.concat(F.lit("postgresql://u"), k, F.lit(":p%3A"), k, F.lit("@"), host, F.when(port, ":6543").otherwise(""), F.lit("/"), db, F.lit("?sslmode=require"))
    words = F.concat(F.lit("host="), host, F.lit(" dbname="), db, F.when(port, " port=6543").otherwise(""),
                     F.when(F.col("c_custkey") % 5 == 0, " schema=geo").otherwise(""))
    p = RD.parse_connection_col(F.when(F.col("c_custkey") % 2 == 0, url).otherwise(words))
    return c.select("c_custkey", p.alias("p")).select("c_custkey", "p.*")


@register("type_rules", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' WHEN 3 THEN 'date-time'
    WHEN 4 THEN 'geometry' ELSE 'string' END AS base_type,
  CASE p_partkey % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'MultiPoint' WHEN 2 THEN 'LineString' WHEN 3 THEN 'Point' ELSE 'Polygon' END AS geometry_type,
  CASE p_partkey % 3 WHEN 0 THEN 25830 + p_size % 5 WHEN 1 THEN 4326 END AS epsg FROM part""")
def q_type_rules(spark, sf):
    """SQL types, geometry type names and EPSG codes, one of each per part."""
    p = table(spark, sf, "part")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % n + 1).cast("int"))
    wkt = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('PROJCS["x",AUTHORITY["EPSG","'), (25830 + F.col("p_size") % 5).cast("string"), F.lit('"]]'))) \
        .when(F.col("p_partkey") % 3 == 1, F.lit('GEOGCRS["WGS 84",ID["EPSG",4326]]')).otherwise(F.lit("LOCAL_CS[]"))
    return p.select(
        "p_partkey",
        TYP.sql_type_to_field_type(pick(6, "BIGINT", "double precision", "boolean", "timestamp", "geometry(Point)", "text")).alias("base_type"),
        TYP.normalize_geometry_type(pick(5, "none", "MULTIPOINT Z", "linestring", "3D Point", "surface")).alias("geometry_type"),
        G.epsg_from_wkt(wkt).alias("epsg"))
