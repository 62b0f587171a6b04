"""Catalog jobs on a small hand-made model that trips every lint rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.operators import catalog as K

LAYER_SCHEMA = ("model_id string, layer_id string, name string, geometry_type string, geom_col string, "
                "pk_col string, extends_id string, description string, is_abstract boolean, ordinal int")
FIELD_SCHEMA = ("model_id string, layer_id string, field_id string, name string, kind string, base_type string, "
                "mode string, type_id string, multiplicity string, default_value string, is_pk boolean, "
                "ref_layer_id string, inverse_field_id string, enum_ref string, ordinal int")

LAYERS = [
    ("m", "base", "Base", "None", None, None, None, "root type", True, 0),
    ("m", "road", "Road", "LineString", "geom", "id", "base", "", False, 1),
    ("m", "town", "Town", "Point", None, None, None, "towns", False, 2),
    ("m", "empty", "Town", "None", None, None, None, "x", False, 3),
    ("m", "c1", "C1", "None", None, "id", "c2", "d", False, 4),
    ("m", "c2", "C2", "None", None, "id", "c1", "d", False, 5),
    ("m", "c3", "C3", "None", None, "id", "c1", "d", False, 6),
    ("m", "orphan", "Orphan", "None", None, "id", "nowhere", "d", False, 7),
    ("m", "abs2", "Abs2", "None", None, None, None, "d", True, 8),
]
F_ = lambda *a: ("m",) + a
FIELDS = [
    F_("base", "b_id", "id", "primitive", "integer", None, None, "1..1", None, True, None, None, None, 0),
    F_("base", "b_note", "note", "primitive", "string", None, None, "0..1", "n/a", False, None, None, None, 1),
    F_("road", "r_name", "name", "primitive", "string", None, None, "0..1", None, False, None, None, None, 0),
    F_("road", "r_name2", "name", "primitive", "string", None, None, "0..1", None, False, None, None, None, 1),
    F_("road", "r_town", "town", "feature-ref", None, None, None, "0..1", None, False, "town", "t_code", None, 2),
    F_("road", "r_note", "note", "primitive", "integer", None, None, "0..1", None, False, None, None, None, 3),
    F_("town", "t_code", "code", "primitive", "string", None, None, "0..1", None, True, None, None, None, 0),
    F_("town", "t_road", "road", "feature-ref", None, None, None, "0..1", None, False, "road", "gone", None, 1),
    F_("town", "t_kind", "kind", "codelist", None, "shared", None, "1..1", None, False, None, None, "E_missing", 2),
    F_("town", "t_kind2", "kind2", "codelist", None, "shared", None, "1..1", None, False, None, None, None, 3),
    F_("town", "t_geom", "geom", "geometry", None, None, None, "0..*", None, False, None, None, None, 4),
    F_("town", "t_long", "x" * 64, "primitive", "string", None, None, "0..1", None, False, None, None, None, 5),
    F_("town", "t_dt", "addr", "datatype-ref", None, None, None, "0..1", None, False, None, None, None, 6),
    F_("town", "t_fr", "rel", "feature-ref", None, None, None, "0..1", None, False, None, None, None, 7),
    F_("town", "t_ns", "emp", "feature-ref", None, None, None, "0..1", None, False, "empty", None, None, 8),
    F_("town", "t_pk2", "code2", "primitive", "integer", None, None, "1..1", None, True, None, None, None, 9),
    F_("town", "t_ok", "kind3", "codelist", None, "shared", None, "1..1", None, False, None, None, "E1", 10),
]
ENUMS = [("m", "E1", "a", "A"), ("m", "E1", "b", "B")]


@pytest.fixture(scope="module")
def model(spark):
    return (spark.createDataFrame(LAYERS, LAYER_SCHEMA), spark.createDataFrame(FIELDS, FIELD_SCHEMA),
            spark.createDataFrame(ENUMS, "model_id string, enum_id string, code string, label string"))


def test_lint_every_rule(model):
    layers, fields, enums = model
    got = {(r.code, r.layer_id, r.field_id, r.severity) for r in K.lint(layers, fields, enums).collect()}
    want = {
        ("LAYER_DUPLICATE_NAME", "town", None, "error"), ("LAYER_DUPLICATE_NAME", "empty", None, "error"),
        ("LAYER_EXTENDS_CIRCULAR_DEEP", "c1", None, "error"), ("LAYER_EXTENDS_CIRCULAR_DEEP", "c2", None, "error"),
        ("LAYER_EXTENDS_CIRCULAR_DEEP", "c3", None, "error"),
        ("LAYER_EXTENDS_UNKNOWN", "orphan", None, "error"),
        ("LAYER_ABSTRACT_UNUSED", "abs2", None, "hint"),
        ("LAYER_NO_PROPERTIES", "empty", None, "warning"), ("LAYER_NO_PK", "empty", None, "warning"),
        ("LAYER_PK_MULTIPLICITY", "town", None, "warning"), ("LAYER_PK_TYPE", "town", None, "hint"),
        ("LAYER_MULTIPLE_PKS", "town", None, "warning"), ("LAYER_NO_GEOM_COLUMN", "town", None, "warning"),
        ("LAYER_NO_DESCRIPTION", "road", None, "hint"),
        ("FIELD_DUPLICATE_NAME", "road", "r_name2", "error"),
        ("FIELD_NAME_TOO_LONG", "town", "t_long", "warning"),
        ("FIELD_DATATYPE_REF_EMPTY", "town", "t_dt", "error"),
        ("FIELD_FEATURE_REF_EMPTY", "town", "t_fr", "error"),
        ("FIELD_REF_TO_NONSPATIAL", "town", "t_ns", "hint"),
        ("FIELD_FEATURE_REF_INVERSE_MISMATCH", "town", "t_road", "hint"),
        ("FIELD_FEATURE_REF_INVERSE_MISMATCH", "road", "r_town", "hint"),
        ("FIELD_SHARED_ENUM_REF_MISSING", "town", "t_kind", "error"),
        ("FIELD_SHARED_ENUM_REF_MISSING", "town", "t_kind2", "error"),
        ("MULTIPLICITY_ARRAY_ON_GEOMETRY", "town", "t_geom", "hint"),
    }
    assert want <= got, sorted(want - got)
    assert not {g for g in got if g[0] == "LAYER_NO_PK" and g[1] in ("road", "base")}
    assert not {g for g in got if g[2] == "t_ok"}
    assert not {g for g in got if g[0] == "LAYER_EXTENDS_CIRCULAR_DEEP" and g[1] in ("road", "orphan")}


def test_effective_fields_and_order(model):
    layers, fields, _ = model
    eff = K.effective_fields(layers, fields).filter("layer_id = 'road'").orderBy("position").collect()
    assert [r.field_id for r in eff] == ["b_id", "b_note", "r_name", "r_name2", "r_town", "r_note"]
    by_name = K.effective_fields_by_name(layers, fields).filter("layer_id = 'road'").orderBy("position").collect()
    # the child's "note" overrides the parent's at the parent's position; a repeated name keeps the last one
    assert [(r.name, r.field_id) for r in by_name] == [("id", "b_id"), ("note", "r_note"), ("name", "r_name2"),
                                                        ("town", "r_town")]
    # cycles are cut: c1 sees c2's fields (none) and stops
    assert K.effective_fields(layers, fields).filter("layer_id = 'c1'").count() == 0


def test_topo_order_matches_depth_first_visit(spark):
    rows = [("m", "child", "Child", "None", None, None, "mid", "d", False, 0),
            ("m", "x", "X", "None", None, None, None, "d", False, 1),
            ("m", "mid", "Mid", "None", None, None, "root", "d", False, 2),
            ("m", "root", "Root", "None", None, None, None, "d", False, 3),
            ("m", "y", "Y", "None", None, None, "x", "d", False, 4)]
    layers = spark.createDataFrame(rows, LAYER_SCHEMA)
    got = [r.layer_id for r in K.topo_order(layers).orderBy("topo_position").collect()]

    def dfs(ls):
        by_id, seen, out = {r[1]: r for r in ls}, set(), []

        def visit(r):
            if r[1] in seen:
                return
            if r[6] and r[6] in by_id:
                visit(by_id[r[6]])
            seen.add(r[1])
            out.append(r[1])
        for r in ls:
            visit(r)
        return out
    assert got == dfs(rows) == ["root", "mid", "child", "x", "y"]


def test_rendering_order(spark, model):
    layers, _, _ = model
    order = spark.createDataFrame([("m", ["town", "nope", "road"])], "model_id string, layer_ids array<string>")
    got = [r.layer_id for r in K.rendering_order(layers, order).orderBy("render_position").collect()]
    assert got == ["town", "road"]


def test_drift_changelog_and_version(spark, model):
    layers, fields, _ = model
    new_layers = layers.filter("layer_id <> 'abs2'").withColumn(
        "description", F.when(F.col("layer_id") == "road", F.lit("roads")).otherwise(F.col("description")))
    new_layers = new_layers.unionByName(spark.createDataFrame(
        [("m", "lake", "Lake", "Polygon", "geom", "id", None, "d", False, 9)], LAYER_SCHEMA))
    new_fields = fields.filter("field_id <> 't_long'").withColumn(
        "multiplicity", F.when(F.col("field_id") == "t_code", "1..1").otherwise(F.col("multiplicity")))
    ch = K.schema_drift(layers, new_layers, fields, new_fields)
    got = {(r.item_type, r.type, r.layer_id, r.field_id) for r in ch.collect()}
    assert got == {("layer", "deleted", "abs2", None), ("layer", "added", "lake", None),
                   ("layer", "modified", "road", None), ("property", "deleted", "town", "t_long"),
                   ("property", "modified", "town", "t_code")}
    mod = ch.filter("layer_id = 'road'").first().modified_fields
    assert [(m.field, m.old_value, m.new_value) for m in mod] == [("description", "", "roads")]
    lines = K.changelog_lines(ch).collect()
    assert {r.section for r in lines} == {"Breaking Changes", "New Features", "Improvements"}
    groups = K.group_changes(ch).collect()
    assert {r.layer_id for r in groups} == {"abs2", "lake", "road", "town"}
    stats = ch.agg(F.count_if(F.col("type") == "deleted").alias("d"), F.count_if(F.col("type") == "added").alias("a"),
                   F.count(F.lit(1)).alias("t"))
    v = spark.createDataFrame([("1.4.2",), ("2.0",), ("0.9.9",)], "v string")
    got = [r.nv for r in v.crossJoin(stats).select(K.next_version("v", F.col("d"), F.col("a"), F.col("t")).alias("nv"))
           .collect()]
    assert got == ["2.0.0", "1.0.0", "1.0.0"]
    only_mod = v.select(K.next_version("v", F.lit(0), F.lit(0), F.lit(3)).alias("nv")).collect()
    assert [r.nv for r in only_mod] == ["1.4.3", "1.0.0", "0.9.10"]


def test_drift_of_nested_fields(spark):
    layers = spark.createDataFrame([("m", "town", "Town", "Point", "geom", "id", None, "d", False, 1)], LAYER_SCHEMA)
    cols = ["field_id", "parent_field_id", "name", "base_type", "title", "description", "constraints"]
    old = [("a", None, "address", None, "Address", "", None), ("s", "a", "street", "string", "", "", "max 5"), ("z", "a", "zip", "string", "", "", None),
           ("n", "z", "number", "integer", "", "", None), ("g", None, "gone", None, "", "", None), ("gi", "g", "inner", "string", "", "", None),
           ("q", "nowhere", "lost", "string", "", "", None), ("l1", "l2", "loop1", None, "", "", None), ("l2", "l1", "loop2", None, "", "", None),
           ("same", "a", "same", "string", "", "", None), ("same", "g", "same", "string", "", "", None)]
    new = [("a", None, "address", None, "Adresse", "", None), ("s", "a", "street", "string", "", "", "max 9"), ("z", "a", "postcode", "string", "", "x", None),
           ("n", "z", "number", "string", "", "", None), ("e", "z", "extra", "string", "", "", None), ("h", None, "here", None, "", "", None),
           ("hi", "h", "inner", "string", "", "", None), ("q", "nowhere", "lost", "integer", "", "", None), ("l1", "l2", "loop1", None, "", "", None),
           ("l2", "l1", "loop2", None, "", "", None)]

    def table_of(rows):
        df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
        return df.select(F.lit("m").alias("model_id"), F.lit("town").alias("layer_id"), "*", *[
            F.lit(None).cast("string").alias(c) for c in K.FIELD_ATTRS if c not in cols])

    ch = K.schema_drift(layers, layers, table_of(old), table_of(new))
    got = {(r.type, r.item_name): sorted(m.field for m in r.modified_fields or []) for r in ch.collect()}
    assert got == {("modified", "address"): ["title"], ("modified", "address ▸ street"): ["constraints"],
                   ("modified", "address ▸ postcode"): ["description", "name"], ("modified", "address ▸ postcode ▸ number"): ["base_type"],
                   ("added", "address ▸ postcode ▸ extra"): [], ("added", "here"): [], ("deleted", "gone"): [], ("deleted", "address ▸ same"): [],
                   ("modified", "lost"): ["base_type"]}
    assert K.schema_drift(layers, layers, table_of(old), table_of(old)).count() == 0
    assert K.field_paths(table_of([])).count() == 0


def test_drift_of_nested_fields_computes_each_row_once(spark):
    """both versions were computed again for every step that reads them."""
    layers = spark.createDataFrame([("m", "town", "Town", "Point", "geom", "id", None, "d", False, 1)], LAYER_SCHEMA)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rb in batches:
            seen.add(rb.num_rows)
            yield rb

    def table_of(rows):
        df = spark.createDataFrame([("m", "town", *r) for r in rows], "model_id string, layer_id string, field_id string, "
                                   "parent_field_id string, name string, base_type string")
        df = df.mapInArrow(counted, df.schema)
        return df.select("*", *[F.lit(None).cast("string").alias(c) for c in K.FIELD_ATTRS if c not in ("name", "base_type")])

    # three levels; the outermost field comes twice in the new version, so there are two ways to all within it
    old = [("a", None, "a", "x"), ("b", "a", "b", "x"), ("c", "b", "c", "x"), ("d", "b", "d", "x"), (None, None, "nameless", "x")]
    new = [("a", None, "a", "x"), ("a", None, "a", "x"), ("b", "a", "b2", "x"), ("c", "b", "c", "y")]
    ch = K.schema_drift(layers, layers, table_of(old), table_of(new)).collect()
    assert sorted((r.type, r.item_name or "", r.field_id or "") for r in ch) == [
        ("deleted", "", ""), ("deleted", "a ▸ b ▸ d", "d"), ("modified", "a ▸ b2", "b"), ("modified", "a ▸ b2", "b"),
        ("modified", "a ▸ b2 ▸ c", "c"), ("modified", "a ▸ b2 ▸ c", "c")]
    assert seen.value == len(old) + len(new)


def test_describe_and_import_columns(spark):
    cols = spark.createDataFrame([
        ("public", "roads", "id", 1, "integer", "int4", "NO", "nextval('s')"),
        ("public", "roads", "Navn på vei", 2, "text", "text", "YES", None),
        ("public", "roads", "geom", 3, "USER-DEFINED", "geometry", "YES", None),
        ("public", "roads", "opened", 4, "timestamp without time zone", "timestamp", "YES", None),
        ("public", "towns", "id", 1, "bigint", "int8", "NO", None)],
        "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, "
        "udt_name string, is_nullable string, column_default string")
    ku = spark.createDataFrame([("public", "roads", "id", "roads_pkey", "public"),
                                ("public", "roads", "id", "roads_uq", "public"),
                                ("public", "towns", "id", "towns_pkey", "public")],
                               "table_schema string, table_name string, column_name string, constraint_name string, "
                               "constraint_schema string")
    tc = spark.createDataFrame([("roads_pkey", "public", "PRIMARY KEY"), ("roads_uq", "public", "UNIQUE"),
                                ("towns_pkey", "public", "PRIMARY KEY")],
                               "constraint_name string, constraint_schema string, constraint_type string")
    d = K.describe_columns(cols, ku, tc)
    rows = d.collect()
    assert len(rows) == 6  # roads.id is in two constraints
    assert [(r.table_name, r.ordinal_position) for r in rows][:3] == [("roads", 1), ("roads", 1), ("roads", 2)]
    f = {r.column_name: r for r in K.import_catalog_fields(d).collect()}
    assert f["id"].is_pk and f["id"].multiplicity == "1..1" and f["id"].base_type == "integer"
    assert f["Navn på vei"].name == "navn_paa_vei" and f["Navn på vei"].multiplicity == "0..1"
    assert f["geom"].is_geometry and f["opened"].base_type == "date-time"


def test_flatten_and_clear_inverse(spark, model):
    from pyspark.sql import types as T
    df = spark.createDataFrame([(1, (2, (3, "x")))], "id int, a struct<b:int, c:struct<d:int, e:string>>")
    assert K.flatten_struct_columns(df).columns == ["id", "a_b", "a_c_d", "a_c_e"]
    paths = K.flatten_schema(df.schema)
    assert ("a.c.e", 2, "string") in paths
    layers, fields, _ = model
    deleted = spark.createDataFrame([("m", "town", "t_code")], "model_id string, layer_id string, field_id string")
    out = K.clear_inverse_refs(fields, deleted)
    assert out.filter("field_id = 'r_town'").first().inverse_field_id is None
    assert out.filter("field_id = 't_code'").count() == 0
    assert out.filter("field_id = 't_road'").first().inverse_field_id == "gone"
    assert isinstance(out.schema["inverse_field_id"].dataType, T.StringType)


def test_auto_map_concrete_layers_and_group_by_table(spark, model):
    from tessella.operators import mapping as M
    from tessella.operators import profile as A
    src = spark.createDataFrame([("road", "NAME", 0), ("road", "Lanes", 1), ("road", "name", 2), ("road", "x", 3)],
                                "layer_id string, column_name string, ordinal int")
    tgt = spark.createDataFrame([("road", "f1", "name", "Name"), ("road", "f2", "lane_count", "lanes"),
                                 ("road", "f3", "width", "Width")],
                                "layer_id string, field_id string, name string, title string")
    got = {r.field_id: r.source_column for r in M.auto_map(src, tgt).collect()}
    # first match by ordinal wins; the title counts too; no match -> NULL
    assert got == {"f1": "NAME", "f2": "Lanes", "f3": None}
    layers, _, _ = model
    assert {r.layer_id for r in M.concrete_layers(layers).collect()} == {r[1] for r in LAYERS if not r[8]}
    cols = spark.createDataFrame([("b", 2, "y"), ("a", 1, "k"), ("b", 1, "x")],
                                 "table_name string, ordinal_position int, column_name string")
    g = {r.table_name: [c.column_name for c in r.columns] for r in A.group_columns_by_table(cols).collect()}
    assert g == {"a": ["k"], "b": ["x", "y"]}


def test_parent_by_name_fallback(spark, model):
    layers, fields, _ = model
    renamed = layers.withColumn("extends_id", F.when(F.col("layer_id") == "road", F.lit("Base"))
                                .otherwise(F.col("extends_id")))
    by_name = K.effective_fields_by_name(renamed, fields).filter("layer_id = 'road'").collect()
    assert {r.name for r in by_name} == {"id", "note", "name", "town"}
    # the id-only variant does not resolve a name: road keeps its own fields only
    by_id = K.effective_fields(renamed, fields).filter("layer_id = 'road'").collect()
    assert {r.from_layer_id for r in by_id} == {"road"}


def test_drift_model_meta_and_shared_types(spark, model):
    layers, fields, _ = model
    mo = spark.createDataFrame([("m", "Roads", "1.0.0", "EPSG:25833", "d")],
                               "model_id string, name string, version string, crs string, description string")
    mn = mo.withColumn("crs", F.lit("EPSG:4326"))
    to = spark.createDataFrame([("m", "addr", "Address"), ("m", "old", "Old")], "model_id string, type_id string, name string")
    tn = spark.createDataFrame([("m", "addr", "Postal address"), ("m", "new", "New")],
                               "model_id string, type_id string, name string")
    ch = K.schema_drift(layers, layers, fields, fields, mo, mn, to, tn)
    got = {(r.item_type, r.type, r.layer_id) for r in ch.collect()}
    assert got == {("model_meta", "modified", None), ("shared_type", "modified", "sharedtype:addr"),
                   ("shared_type", "deleted", "sharedtype:old"), ("shared_type", "added", "sharedtype:new")}
    meta = ch.filter("item_type = 'model_meta'").first().modified_fields
    assert [(m.field, m.old_value, m.new_value) for m in meta] == [("crs", "EPSG:25833", "EPSG:4326")]
    sections = {r.section for r in K.group_changes(ch).collect()}
    assert sections == {"model_meta", "shared_types"}


def test_numbered_equals_a_window_in_hot_groups(spark):
    from pyspark.sql import Window

    from tessella.operators._util import numbered
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"m{i % 5}", (i * 7919) % 1009, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, k int, id int")
    got = numbered(df, ["g"], [-F.col("k"), F.col("id")], "n", first=0, buckets=13)
    w = Window.partitionBy("g").orderBy(F.col("k").desc(), "id")
    want = df.withColumn("n", (F.row_number().over(w) - 1).cast("long"))
    assert got.columns == ["g", "k", "id", "n"] and got.count() == 1000
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert numbered(df.limit(0), ["g"], [F.col("k")], "n").count() == 0


def test_rendering_order_by_rows(spark, model):
    layers, _, _ = model
    order = spark.createDataFrame([("m", "road", 3), ("m", "nope", 2), ("m", "town", 1)], "model_id string, layer_id string, z int")
    got = K.rendering_order(layers, order, by=[F.col("z")]).orderBy("render_position").collect()
    assert [(r.layer_id, r.render_position) for r in got] == [("town", 0), ("road", 2)]
