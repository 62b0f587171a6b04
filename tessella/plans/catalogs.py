"""Model catalogs derived from the given tables, so that catalog jobs run on
rows that grow with the data: customers are layers (twenty models), orders are
their fields, parts their code lists.

Each catalog is one SQL text that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table

# idx numbers the layers of a model. Parents: a third of the way down, two layers
# that extend one another in every fourth model, now and then an unknown layer.
LAYERS = """
SELECT concat('m', CAST(m AS STRING)) AS model_id, CAST(c_custkey AS STRING) AS layer_id,
  CASE WHEN i % 13 = 0 THEN NULL ELSE concat(lower(c_mktsegment), '_', CAST(i % 29 AS STRING)) END AS name,
  CASE i % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Point' WHEN 2 THEN 'LineString' ELSE 'Polygon' END AS geometry_type,
  CASE WHEN i % 3 = 0 THEN NULL ELSE 'geom' END AS geom_col, CASE WHEN i % 5 = 0 THEN 'id' ELSE ' ' END AS pk_col,
  CASE WHEN i = 0 THEN NULL WHEN i = 2 AND m % 4 = 0 THEN CAST(7 * 20 + m AS STRING) WHEN i = 7 THEN CAST(2 * 20 + m AS STRING)
       WHEN i % 11 = 5 THEN concat('gone', CAST(i AS STRING)) ELSE CAST((i - i % 3) / 3 * 20 + m AS STRING) END AS extends_id,
  CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS description, i % 6 = 1 AS is_abstract, CAST(i AS INT) AS ordinal
FROM (SELECT *, c_custkey % 20 AS m, (c_custkey - c_custkey % 20) {div} 20 AS i FROM customer)"""

FIELDS = """
SELECT concat('m', CAST(o_custkey % 20 AS STRING)) AS model_id, CAST(o_custkey AS STRING) AS layer_id,
  CAST(o_orderkey AS STRING) AS field_id,
  CASE WHEN o_orderkey % 17 = 3 THEN repeat('long_', 14) ELSE concat('f', CAST(o_orderkey % 7 AS STRING)) END AS name,
  CASE o_orderkey % 5 WHEN 0 THEN 'primitive' WHEN 1 THEN 'geometry' WHEN 2 THEN 'datatype-ref' WHEN 3 THEN 'feature-ref' ELSE 'codelist' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'integer' WHEN 'O' THEN 'string' ELSE 'number' END AS base_type,
  CASE WHEN o_orderkey % 2 = 0 THEN 'shared' ELSE 'inline' END AS mode,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 't1' END AS type_id,
  CASE o_orderkey % 4 WHEN 0 THEN '0..1' WHEN 1 THEN '1..1' WHEN 2 THEN '0..*' ELSE '1..*' END AS multiplicity,
  CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS default_value, o_orderkey % 6 = 0 AS is_pk,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN 'nowhere' ELSE CAST(o_custkey % 20 + 20 * (o_orderkey % 3) AS STRING) END AS ref_layer_id,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey + 5 AS STRING) END AS inverse_field_id,
  CASE WHEN o_orderkey % 10 = 4 THEN ' ' ELSE concat('e', CAST(o_orderkey % 30 AS STRING)) END AS enum_ref, CAST(o_orderkey AS INT) AS ordinal
FROM orders"""

ENUMS = """
SELECT concat('m', CAST(p_partkey % 20 AS STRING)) AS model_id, concat('e', CAST(p_size % 30 AS STRING)) AS enum_id,
  p_brand AS code, p_name AS label FROM part"""

# The next version of each model: layers gone, renamed and new.
LAYERS_NEXT = """
SELECT model_id, CASE WHEN ordinal % 23 = 4 THEN concat(layer_id, 'b') ELSE layer_id END AS layer_id,
  CASE WHEN ordinal % 9 = 2 THEN concat(coalesce(name, 'new'), '_v2') ELSE name END AS name,
  CASE WHEN ordinal % 19 = 3 THEN 'Point' ELSE geometry_type END AS geometry_type, geom_col, pk_col, extends_id,
  CASE WHEN ordinal % 9 = 2 THEN NULL ELSE description END AS description, is_abstract, ordinal
FROM ({layers})"""

# The next version of each field: gone and new ones, other names, types, multiplicities and defaults.
FIELDS_NEXT = """
SELECT model_id, layer_id, CASE WHEN ordinal % 31 = 5 THEN concat(field_id, 'b') ELSE field_id END AS field_id,
  CASE WHEN ordinal % 10 = 2 THEN concat(name, '_v2') ELSE name END AS name, kind,
  CASE WHEN ordinal % 12 = 2 THEN 'boolean' ELSE base_type END AS base_type,
  CASE WHEN ordinal % 14 = 3 THEN '0..1' ELSE multiplicity END AS multiplicity,
  CASE WHEN ordinal % 9 = 3 THEN NULL WHEN ordinal % 9 = 4 THEN 'y' ELSE default_value END AS default_value, is_pk, ref_layer_id,
  inverse_field_id, enum_ref, ordinal
FROM ({fields})"""


def sql(text: str, engine: str) -> str:
    """The catalog's SQL for ``spark`` or ``duckdb`` (whole division differs)."""
    layers = LAYERS.replace("{div}", "DIV" if engine == "spark" else "//")
    out = text.replace("{layers}", layers).replace("{fields}", FIELDS).replace("{div}", "DIV" if engine == "spark" else "//")
    return out if engine == "spark" else out.replace("AS STRING)", "AS VARCHAR)")


def catalog(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """A catalog over the tables of ``sf``."""
    names = [t for t in ("customer", "orders", "part", "supplier") if f" {t}" in sql(text, "spark")]
    return spark.sql(_bound(sql(text, "spark"), names), **{t: table(spark, sf, t) for t in names})


def _bound(text: str, names: list[str]) -> str:
    for t in names:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return text
