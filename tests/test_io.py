"""Sources, sinks, change-capture runs, the sync stream and the manifest."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tessella.operators import cdc as D
from tessella.plans import manifest as MF
from tessella.session import table
from tessella.sources import readers as R
from tessella.sources import sinks as S
from tessella.streaming import sync as ST

FC = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "id": 1, "properties": {"name": "a", "n": 1, "v": 2.5},
     "geometry": {"type": "Point", "coordinates": [10.0, 60.0]}},
    {"type": "Feature", "id": 2, "properties": {"name": "b", "n": 2, "v": 3},
     "geometry": {"type": "LineString", "coordinates": [[10.0, 60.0], [11.0, 61.0]]}},
    {"type": "Feature", "id": 3, "properties": {"name": "c", "n": 3},
     "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
    {"type": "Feature", "id": 4, "properties": {"name": "d"}, "geometry": None},
    {"type": "Feature", "id": 5, "properties": {"name": "e"},
     "geometry": {"type": "GeometryCollection", "geometries": [
         {"type": "Point", "coordinates": [1, 2]},
         {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 0]]]]}]}},
]}


def test_geojson_scan_split_and_roundtrip(spark, scratch):
    p = os.path.join(scratch, "fc.geojson")
    with open(p, "w") as f:
        json.dump(FC, f)
    with open(os.path.join(scratch, "arr.geojson"), "w") as f:
        json.dump(FC["features"][:2], f)
    df = R.scan_geojson(spark, p)
    rows = {(r.id, r.geometry.type if r.geometry else None) for r in df.collect()}
    assert rows == {("1", "Point"), ("2", "LineString"), ("3", "Polygon"), ("4", None), ("5", "Point"),
                    ("5", "MultiPolygon")}
    assert dict(df.dtypes)["n"] == "bigint" and dict(df.dtypes)["v"] == "double"
    poly = df.filter("id = '3'").first().geometry
    assert [(p.x, p.y) for p in poly.parts[0][0]] == [(0, 0), (1, 0), (1, 1), (0, 0)]
    assert R.scan_geojson(spark, os.path.join(scratch, "arr.geojson")).count() == 2
    split = S.split_by_geometry(df).groupBy("geometry_type").count()
    assert {r.geometry_type: r["count"] for r in split.collect()} == {
        "Point": 2, "LineString": 1, "Polygon": 1, "Unknown": 1, "MultiPolygon": 1}
    out = os.path.join(scratch, "split")
    S.write_split_by_geometry(df, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("geometry_type=")) == [
        "geometry_type=LineString", "geometry_type=MultiPolygon", "geometry_type=Point", "geometry_type=Polygon",
        "geometry_type=Unknown"]
    feats = S.to_geojson_features(df.filter("id in ('1', '4')"), "id").orderBy("id").collect()
    f1 = json.loads(feats[0].feature)
    assert f1["geometry"] == {"type": "Point", "coordinates": [10.0, 60.0]} and f1["properties"]["name"] == "a"
    assert json.loads(feats[1].feature)["geometry"] is None
    S.write_geojson_lines(df, os.path.join(scratch, "seq"), "id", limit=3)
    assert spark.read.text(os.path.join(scratch, "seq")).count() == 3


def test_csv_tsv_and_merge(spark, scratch):
    with open(os.path.join(scratch, "a.csv"), "w") as f:
        f.write("id,name\n1,x\n2,y\n")
    with open(os.path.join(scratch, "b.tsv"), "w") as f:
        f.write("id\tname\textra\n3\tz\tq\n")
    a = R.scan_csv(spark, os.path.join(scratch, "a.csv"))
    b = R.scan_csv(spark, os.path.join(scratch, "b.tsv"))
    assert a.count() == 2 and b.columns == ["id", "name", "extra"]
    merged = R.merge_layers([{"roads": a}, {"roads": b, "lakes": a}])
    assert merged["roads"].count() == 3 and merged["lakes"].count() == 2
    assert merged["roads"].filter("extra IS NULL").count() == 2


def test_connection_strings():
    u = R.parse_connection("postgresql://me:p%40ss@db.example:6543/gis?sslmode=require")
    assert (u["user"], u["password"], u["host"], u["port"], u["dbname"]) == ("me", "p@ss", "db.example", "6543", "gis")
    kv = R.parse_connection("dbname=gis user=me schema=geo")
    assert (kv["host"], kv["port"], kv["dbname"], kv["schema"]) == ("localhost", "5432", "gis", "geo")
    assert R.parse_connection("postgresql://host/db")["host"] == "host"
    assert u["sslmode"] == "require"
    q = R.parse_connection("host=h password='a b\\'c' user = me")
    assert (q["host"], q["password"], q["user"]) == ("h", "a b'c", "me")
    assert R.parse_connection("postgresql://u:a:b@h/d")["password"] == "a:b"
    o = R.jdbc_options("postgres://u:p@h:5432/d", "roads", pk="fid", bounds=(1, 1000), partitions=8)
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["dbtable"] == '"public"."roads"'
    assert (o["partitionColumn"], o["numPartitions"]) == ("fid", "8")


def test_connection_strings_as_columns(spark):
    df = spark.createDataFrame([("postgresql://me:pw@db:6543/gis",), ("host=h dbname=d",), ("postgresql://h/d",)], "c string")
    got = [tuple(r.p) for r in df.select(R.parse_connection_col("c").alias("p")).collect()]
    want = [tuple(R.parse_connection(c)[k] for k in ("user", "password", "host", "port", "dbname", "schema"))
            for c in ("postgresql://me:pw@db:6543/gis", "host=h dbname=d", "postgresql://h/d")]
    assert got == want


def test_create_table_and_append(spark, scratch, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    assert S.create_table(o, "orders_copy", fields=[{"name": "o_custkey", "base_type": "integer",
                                                     "multiplicity": "1..1"},
                                                    {"name": "o_totalprice", "base_type": "number"}])
    t = spark.table("orders_copy")
    assert "fid" in t.columns and t.select("fid").distinct().count() == o.count()
    assert not S.create_table(o, "never", is_abstract=True)
    out = os.path.join(scratch, "appended")
    S.append_layers({"a": o.limit(5), "b": o.limit(7)}, out)
    assert spark.read.parquet(out).groupBy("layer").count().count() == 2


FIELDS_S11 = [{"name": "k", "base_type": "integer", "multiplicity": "0..1"}, {"name": "n", "base_type": "number", "multiplicity": "1..1"},
              {"name": "tags", "base_type": "integer", "multiplicity": "1..*"}, {"name": "d", "base_type": "date"},
              {"name": "near", "kind": "feature-ref", "relation_type": "within"}]


def test_table_with_required_fields_and_geometry_text(spark):
    from tessella.functions.wkt import from_wkt
    rows = [("1", "2.5", ["1", "2"], "2026-01-02", "POINT (1 2)"), ("2", None, ["1"], None, None), (None, "1", ["1"], None, None),
            ("3", "1", [], None, "POINT (1 2)"), ("4", "x", ["1"], None, None), ("5", "1", ["1", "y"], "2026-13-45", None),
            ("6", "3", ["7", None], None, "LINESTRING (0 0, 1 1)")]
    df = spark.createDataFrame(rows, "k string, n string, tags array<string>, d string, w string").withColumn("geom", from_wkt("w")).drop("w")
    assert S.create_table(df, "typed", FIELDS_S11, pk="k", geom_col="geom", rejects="typed_rejects")
    got = {r["k"]: r for r in spark.table("typed").collect()}
    assert sorted(got) == [1, 6] and got[1]["geom"] == "POINT (1 2)" and got[6]["tags"] == [7, None] and str(got[1]["d"]) == "2026-01-02"
    assert spark.table("typed").columns == ["k", "n", "tags", "d", "geom"]
    bad = {r["k"]: (r["missing"], r["mistyped"]) for r in spark.table("typed_rejects").collect()}
    assert bad == {"2": (["n"], []), None: (["k"], []), "3": (["tags"], []), "4": ([], ["n"]), "5": ([], ["tags", "d"])}
    assert spark.sql("SHOW TBLPROPERTIES typed ('required')").first()["value"] == "k,n,tags"
    with pytest.raises(ValueError, match="lacks"):
        S.create_table(df.where("k = '2'"), "refused", FIELDS_S11, pk="k")
    assert not spark.catalog.tableExists("refused")
    # a field that the rows do not have
    assert S.create_table(df.drop("n"), "lacking", FIELDS_S11, pk="k", rejects="lacking_rejects")
    assert spark.table("lacking").count() == 0 and spark.table("lacking_rejects").count() == 7


def test_wkt_both_ways(spark):
    from tessella.functions.wkt import from_wkt, to_wkt
    same = ["POINT (4 57.5)", "POINT EMPTY", "LINESTRING (0 0, 1 1, 2 -3.25)", "MULTIPOINT ((1 2), (3 4))", "MULTIPOINT EMPTY",
            "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
            "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0)), ((10 10, 11 10, 11 11, 10 10), (1 1, 2 1, 2 2, 1 1)))"]
    other = {"point z (1 2 3)": "POINT (1 2)", "POINTZM(1 2 3 4)": "POINT (1 2)", " MultiPoint (1 2, 3 4) ": "MULTIPOINT ((1 2), (3 4))",
             "POINT(1e5 -.5)": "POINT (100000 -0.5)", "LineString M (0 0 9,1. 1 8)": "LINESTRING (0 0, 1 1)"}
    wrong = ["POINT (1)", "POINT (a b)", "POLYGON ((0 0, 1 1", "CIRCLE (1 2)", "", "LINESTRING (0 0, x 1)", "POINT (1 2, 3 4)",
             "MULTIPOLYGON ((0 0, 1 1))", "POLYGON (0 0, 1 1)", "LINESTRING ((0 0, 1 1))", None]
    want = {x: x for x in same} | other | dict.fromkeys(wrong)
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: r["w"] for r in df.select("t", to_wkt(from_wkt("t")).alias("w")).collect()} == want
    # each step is computed once: mentioned several times, it ran as often, and so did the text's making before it
    plan = df.select(from_wkt(to_wkt(from_wkt("t"))).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") < 30 and plan.count("from_json(") < 20
    got = df.select(to_wkt(from_wkt(F.concat(F.lit("SRID=25833;"), "t")), srid=True).alias("w")).where("w IS NOT NULL").collect()
    assert {r["w"] for r in got} == {f"SRID=25833;{x}" for x in want.values() if x}


def _orders_pair(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    prev = o.filter(F.col("o_orderkey") % 10 != 0)
    cur = (o.filter(F.col("o_orderkey") % 7 != 0)
           .withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1)
                       .otherwise(F.col("o_totalprice"))))
    return prev, cur


HASH_COLS = ["o_custkey", "o_orderstatus", "o_totalprice"]


def test_apply_delta_gives_current(spark, sf_dir):
    prev, cur = _orders_pair(spark, sf_dir)
    delta = D.cdc_diff(cur, D.state_from_snapshot(prev, "o_orderkey", HASH_COLS), "o_orderkey", hash_cols=HASH_COLS)
    kinds = {r[D.CHANGE_COL]: r["count"] for r in delta.groupBy(D.CHANGE_COL).count().collect()}
    assert set(kinds) == {"insert", "update", "delete"}
    ins = delta.filter(F.col(D.CHANGE_COL) == "insert").select("o_orderkey")
    dele = delta.filter(F.col(D.CHANGE_COL) == "delete").select("o_orderkey")
    assert ins.intersect(dele).count() == 0
    touched = delta.select("o_orderkey")
    applied = (prev.join(touched, "o_orderkey", "left_anti")
               .unionByName(delta.filter(F.col(D.CHANGE_COL) != "delete").drop(D.CHANGE_COL)))
    assert applied.exceptAll(cur).count() == 0 and cur.exceptAll(applied).count() == 0


def test_run_sync_full_then_delta_and_replay(spark, sf_dir, scratch):
    prev, cur = _orders_pair(spark, sf_dir)
    out = os.path.join(scratch, "sync")
    r1 = D.run_sync(spark, prev, "o_orderkey", out, "orders", 1, since_arg="last", hash_cols=HASH_COLS,
                    now="2026-01-01T00:00:00+00:00")
    assert r1["mode"] == "full" and spark.read.parquet(r1["output"]).count() == prev.count()
    r2 = D.run_sync(spark, cur, "o_orderkey", out, "orders", 2, since_arg="last", hash_cols=HASH_COLS,
                    now="2026-01-02T00:00:00+00:00")
    assert r2["mode"] == "delta" and r2["since"] == "2026-01-01T00:00:00+00:00" and r2["changed"]
    got = D.read_changes(spark, r2)
    want = D.cdc_diff(cur, D.state_from_snapshot(prev, "o_orderkey", HASH_COLS), "o_orderkey", hash_cols=HASH_COLS)
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
    # deletes are stored apart, with the key and the change type only
    assert spark.read.parquet(r2["deletes"]).columns == ["o_orderkey", D.CHANGE_COL]
    assert spark.read.parquet(r2["rows"]).filter(F.col(D.CHANGE_COL) == "delete").count() == 0
    # replaying batch 2 diffs against batch 1's state again: same output
    D.run_sync(spark, cur, "o_orderkey", out, "orders", 2, since_arg="last", hash_cols=HASH_COLS,
               now="2026-01-02T00:00:00+00:00")
    again = D.read_changes(spark, r2)
    assert again.count() == want.count()
    store = D.StateStore(spark, os.path.join(out, "_state"), "orders")
    assert store.latest() == 2 and store.keys().count() == cur.count()
    assert D.resolve_since(None, store) is None and D.resolve_since("2020-01-01", store) == "2020-01-01"


def test_stream_upsert_matches_batch_and_replays(spark, sf_dir, scratch):
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value").withColumn(
        "_deleted", F.lit(None).cast("boolean"))
    landing, out, ck = (os.path.join(scratch, d) for d in ("landing", "out", "ck"))
    ev.repartition(3).write.parquet(os.path.join(landing, "f1"))
    schema = ev.schema
    q = ST.stream_sync(spark, landing + "/*", schema, "event_id", out, "events", ck, mode="upsert", ts_col="ts",
                       hash_cols=["value"], delete_col="_deleted", available_now=True)
    q.awaitTermination(300)
    first = spark.read.parquet(os.path.join(out, "events_delta"))
    assert first.count() == ev.count() and first.filter(F.col(D.CHANGE_COL) != "insert").count() == 0
    # second file: changed values for some keys, delete flags for others, one unchanged row
    upd = (ev.filter(F.col("event_id") % 10 == 0).withColumn("value", F.col("value") + 1)
           .unionByName(ev.filter(F.col("event_id") % 10 == 1).withColumn("_deleted", F.lit(True)))
           .unionByName(ev.filter(F.col("event_id") % 10 == 2)))
    upd.write.parquet(os.path.join(landing, "f2"))
    q = ST.stream_sync(spark, landing + "/*", schema, "event_id", out, "events", ck, mode="upsert", ts_col="ts",
                       hash_cols=["value"], delete_col="_deleted", available_now=True)
    q.awaitTermination(300)
    store = D.StateStore(spark, os.path.join(out, "_state"), "events")
    last = store.latest()
    second = spark.read.parquet(os.path.join(out, "events_delta", f"batch={last}"))
    kinds = {r[D.CHANGE_COL]: r["count"] for r in second.groupBy(D.CHANGE_COL).count().collect()}
    n_second = second.count()
    assert kinds == {"update": ev.filter(F.col("event_id") % 10 == 0).count(),
                     "delete": ev.filter(F.col("event_id") % 10 == 1).count()}
    n_keys = store.keys().count()
    assert n_keys == ev.count() - kinds["delete"]
    # replay the same batch id: state and output unchanged
    ST.upsert_batch(spark, spark.read.schema(schema).parquet(os.path.join(landing, "f2")), last, "event_id", out,
                    "events", store, "ts", ["value"], "_deleted")
    assert store.keys().count() == n_keys
    assert spark.read.parquet(os.path.join(out, "events_delta", f"batch={last}")).count() == n_second


def test_stream_snapshot_mode_equals_batch(spark, sf_dir, scratch):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    src, landing, out, ck = (os.path.join(scratch, d) for d in ("src", "tick", "out", "ck"))
    snap1 = o.filter(F.col("o_orderkey") % 10 != 0)
    snap2 = o.filter(F.col("o_orderkey") % 7 != 0)
    state = {"path": os.path.join(src, "s1")}
    snap1.write.parquet(state["path"])
    tick = spark.createDataFrame([(1,)], "n int")
    tick.write.parquet(os.path.join(landing, "t1"))
    kw = dict(mode="snapshot", read_current=lambda: spark.read.parquet(state["path"]), since_arg="last",
              hash_cols=["o_custkey", "o_totalprice"], available_now=True)
    ST.stream_sync(spark, landing + "/*", "n int", "o_orderkey", out, "orders", ck, **kw).awaitTermination(300)
    snap2.write.parquet(os.path.join(src, "s2"))
    state["path"] = os.path.join(src, "s2")
    tick.write.parquet(os.path.join(landing, "t2"))
    ST.stream_sync(spark, landing + "/*", "n int", "o_orderkey", out, "orders", ck, **kw).awaitTermination(300)
    assert os.path.isdir(os.path.join(out, "orders_full"))
    delta_dir = [d for d in os.listdir(out) if d.startswith("orders_delta_")][0]
    batches = sorted(d for d in os.listdir(os.path.join(out, delta_dir)) if d.startswith("batch="))
    assert len(batches) == 1  # the first batch was the full export
    base = os.path.join(out, delta_dir, batches[0])
    got = D.read_changes(spark, {"rows": os.path.join(base, "orders"), "deletes": os.path.join(base, "orders_deletes")})
    want = D.cdc_diff(snap2, D.state_from_snapshot(snap1, "o_orderkey", ["o_custkey", "o_totalprice"]),
                      "o_orderkey", hash_cols=["o_custkey", "o_totalprice"])
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0


def test_manifest(spark, sf_dir, scratch):
    out = os.path.join(scratch, "export")
    table(spark, sf_dir, "orders").repartition(3).write.parquet(out)
    bbox = MF.default_bbox(F.lit("4.5"), F.lit(None), F.lit("0"), F.lit("72"))
    items = MF.export_manifest(spark, out, "orders", "full", 25833, bbox=bbox, created="2026-01-01T00:00:00Z")
    rows = items.collect()
    assert len(rows) == 3 and all(r.checksum.startswith("sha256:") and r.size > 0 for r in rows)
    assert rows[0].bbox == [4.5, -90.0, 0.0, 72.0]
    parity = spark.range(1).select(MF.default_bbox(F.lit("0"), F.lit("x"), F.lit("1"), F.lit("2"), parity=True)).first()[0]
    assert parity == [-180.0, -90.0, 1.0, 2.0]
    assert json.loads(rows[0].item_json)["properties"]["proj:epsg"] == 25833
    import hashlib
    local = rows[0].href.replace("file:", "")
    with open(local, "rb") as f:
        assert rows[0].checksum == "sha256:" + hashlib.sha256(f.read()).hexdigest()
    links = spark.createDataFrame([("root", "./catalog.json", "application/json"),
                                   ("item", rows[0].href, "application/json")], "rel string, href string, type string")
    merged = MF.append_item_links(links, items.unionByName(items))
    assert merged.count() == 4
    ext = MF.collection_extent(items).first()
    assert (ext.west, ext.north, ext.items, ext.interval_start) == (4.5, 72.0, 3, "2026-01-01T00:00:00Z")


def test_manifest_with_measured_boxes(spark, sf_dir, scratch):
    from tessella.functions import geometry as G
    from tessella.sources import layers as L
    out = os.path.join(scratch, "measured")
    points = L.event_points(spark, sf_dir, with_geometry=True).select("event_id", "geometry", "x", "y")
    points.repartitionByRange(4, "x").write.parquet(out)
    points.limit(1).select("event_id", F.when(F.col("event_id") < 0, F.col("geometry")).alias("geometry"), "x", "y").coalesce(1).write.mode("append").parquet(out)
    rows = MF.export_manifest(spark, out, "events", "full", 4326, geom_col="geometry", public_base="https://files.example.com/x/").collect()
    real = {os.path.basename(r.f): [r.a, r.b, r.c, r.d] for r in spark.read.parquet(out).withColumns(
        {c: F.when(F.col("geometry").isNotNull(), F.col(c)) for c in "xy"}).groupBy(F.input_file_name().alias("f")).agg(
        F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d")).collect()}
    want = {f: box if box[0] is not None else list(MF.WORLD_BBOX) for f, box in real.items()}
    assert {os.path.basename(r.href): r.bbox for r in rows} == want and len({tuple(r.bbox) for r in rows}) == len(rows) == 5
    assert sum(r.bbox == list(MF.WORLD_BBOX) for r in rows) == 1
    again = MF.export_manifest(spark, out, "events", "full", 4326, geom_col="geometry").collect()
    assert {r.id for r in again} == {r.id for r in rows} and len({r.id for r in rows}) == 5
    item = json.loads(rows[0].item_json)
    name = os.path.basename(rows[0].href)
    assert [x["rel"] for x in item["links"]] == ["self", "root", "parent", "collection"] and item["geometry"] is None
    assert item["assets"]["data"]["href"] == f"https://files.example.com/x/{name}" and item["assets"]["data"]["file:size"] == rows[0].size
    assert item["assets"]["data"]["roles"] == ["data"] and item["stac_version"] == "1.0.0" and item["bbox"] == rows[0].bbox
    # boxes of a projected export come in degrees
    flat = os.path.join(scratch, "projected")
    points.select(G.reproject_geometry("geometry", 4326, 25833).alias("geometry")).coalesce(1).write.parquet(flat)
    box = MF.file_extents(spark, flat, epsg=25833).first().bbox
    whole = points.agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d")).first()
    assert box == pytest.approx([whole.a, whole.b, whole.c, whole.d], abs=1e-6)


def test_paths_table_scan_and_densified_bbox(spark, sf_dir):
    from tessella.functions import geometry as G
    assert S.full_output_path("s3a://b/x/", "roads") == "s3a://b/x/roads_full"
    assert S.delta_output_path("/o", "roads", "2026-03-04T05:06:07") == "/o/roads_delta_2026-03-04"
    assert S.deletes_output_path("/o", "roads", "2026-03-04T05:06:07") == "/o/roads_delta_2026-03-04/roads_deletes"
    assert S.object_store_path("bkt", "/exports/", "a.parquet") == "s3a://bkt/exports/a.parquet"
    S.create_table(table(spark, sf_dir, "region"), "region_t", pk="r_regionkey")
    assert R.scan_table(spark, "region_t").count() == table(spark, sf_dir, "region").count()
    # a UTM box: corners only v. densified edges (the curved edge bulges past the corners)
    box = spark.createDataFrame([(300000.0, 6500000.0, 700000.0, 7000000.0)], "a double, b double, c double, d double")
    two = box.select(*G.bbox_to_wgs84("a", "b", "c", "d", 25833).values()).first()
    dense = box.select(*G.bbox_to_wgs84("a", "b", "c", "d", 25833, densify=8).values()).first()
    assert dense[3] >= two[3] and dense[0] <= two[0] and dense[1] <= two[1]


def test_transform_layers_end_to_end(spark, sf_dir, scratch):
    from tessella.plans import layers as P
    from tessella.sources import layers as LY
    pts = LY.event_points(spark, sf_dir, with_geometry=True).select("event_id", "event_type", "value", "geometry")
    segs = LY.event_segments(spark, sf_dir).select("event_id", "user_id", "geometry")
    m1 = P.LayerMapping({"event_id": "id", "event_type": "kind"}, {"kind": {"click": "k", "view": ""}},
                        4326, 25833, "MultiPoint")
    m2 = P.LayerMapping({"event_id": "id"}, {}, 4326, 25833, "MultiPoint")
    out = os.path.join(scratch, "mapped")
    rejected = P.transform_layers({"points": (pts, m1), "segments": (segs, m2)}, out)
    res = spark.read.parquet(out)
    assert res.filter("layer = 'points'").count() == pts.count()
    assert res.filter("layer = 'segments'").count() == 0 and rejected["segments"].count() == segs.count()
    row = res.filter("layer = 'points'").orderBy("id").first()
    assert row.geometry.type == "MultiPoint" and row.geometry.srid == 25833 and row.geometry.parts[0][0][0].y > 6e6
    kinds = {r.kind for r in res.filter("layer = 'points'").select("kind").distinct().collect()}
    assert "click" not in kinds and "view" not in kinds and None in kinds


def test_narrow_diff_equals_wide(spark, sf_dir):
    prev, cur = _orders_pair(spark, sf_dir)
    cur = cur.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    st = D.state_from_snapshot(prev, "o_orderkey", HASH_COLS)
    for kw in ({"hash_cols": HASH_COLS}, {"ts_col": "o_orderdate", "since": "1997-06-01 00:00:00"}):
        narrow = D.cdc_diff(cur, st, "o_orderkey", **kw)
        wide = D.cdc_diff(cur, st, "o_orderkey", narrow=False, **kw)
        assert narrow.count() == wide.count() and narrow.exceptAll(wide).count() == 0


def test_geojson_seq_reads_what_the_sink_writes(spark, scratch):
    p = os.path.join(scratch, "fc.geojson")
    with open(p, "w") as f:
        json.dump(FC, f)
    df = R.scan_geojson(spark, p)
    out = os.path.join(scratch, "seq")
    S.write_geojson_lines(df.filter("geometry IS NOT NULL"), out, "id")
    back = R.scan_geojson_seq(spark, out)
    assert back.count() == df.filter("geometry IS NOT NULL").count()
    assert {r.geometry.type for r in back.collect()} == {"Point", "LineString", "Polygon", "MultiPolygon"}


def test_stateful_stream_classifies_like_upsert_mode(spark, sf_dir, scratch):
    from tessella.streaming import keyed as KS
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value").withColumn(
        "_deleted", F.lit(None).cast("boolean"))
    landing, out, ck = (os.path.join(scratch, d) for d in ("land", "changes", "ck"))
    ev.repartition(2).write.parquet(os.path.join(landing, "f1"))
    kw = dict(order_col="ts", delete_col="_deleted", available_now=True)
    KS.stream_changes_stateful(spark, landing + "/*", ev.schema, "event_id", ["value"], out, ck, **kw) \
        .awaitTermination(300)
    first = spark.read.parquet(out)
    assert first.count() == ev.count() and first.filter(F.col(D.CHANGE_COL) != "insert").count() == 0
    upd = (ev.filter(F.col("event_id") % 10 == 0).withColumn("value", F.col("value") + 1)
           .unionByName(ev.filter(F.col("event_id") % 10 == 1).withColumn("_deleted", F.lit(True)))
           .unionByName(ev.filter(F.col("event_id") % 10 == 2)))
    upd.write.parquet(os.path.join(landing, "f2"))
    KS.stream_changes_stateful(spark, landing + "/*", ev.schema, "event_id", ["value"], out, ck, **kw) \
        .awaitTermination(300)
    allc = spark.read.parquet(out)
    kinds = {r[D.CHANGE_COL]: r["count"] for r in allc.groupBy(D.CHANGE_COL).count().collect()}
    assert kinds == {"insert": ev.count(), "update": ev.filter(F.col("event_id") % 10 == 0).count(),
                     "delete": ev.filter(F.col("event_id") % 10 == 1).count()}
    # deletes carry the key only
    assert allc.filter((F.col(D.CHANGE_COL) == "delete") & F.col("value").isNotNull()).count() == 0


def test_scan_any_by_extension_and_reprojected_export(spark, scratch, sf_dir):
    p = os.path.join(scratch, "fc.geojson")
    with open(p, "w") as f:
        json.dump(FC, f)
    assert R.scan_any(spark, p).count() == 6
    with open(os.path.join(scratch, "t.tsv"), "w") as f:
        f.write("a\tb\n1\t2\n")
    assert R.scan_any(spark, os.path.join(scratch, "t.tsv")).columns == ["a", "b"]
    out = os.path.join(scratch, "pts.geojsonl")
    S.write_geojson_lines(R.scan_any(spark, p).filter("id = '1'"), out, "id", src_srid=4326, dst_srid=3857)
    back = R.scan_any(spark, out).first()
    assert abs(back.geometry.parts[0][0][0].x - 1113194.9079327357) < 1e-6
    assert R.scan_any(spark, os.path.join(sf_dir, "region.parquet")).count() == 5


def test_cdc_edge_rules(spark, scratch):
    rows = [(1, "2026-01-01 00:00:00", 1.0), (2, "2026-01-02 00:00:00", 2.0), (3, "2026-01-03 00:00:00", 3.0)]
    cur = spark.createDataFrame(rows, "k long, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    prev = D.state_from_snapshot(cur, "k")
    # strict ">": a row stamped exactly at `since` is not an update
    ups = D.cdc_updates(cur, prev, "k", "ts", "2026-01-02 00:00:00")
    assert [r.k for r in ups.collect()] == [3]
    ch = D.cdc_changes(cur, prev, "k", "ts", "2026-01-02 00:00:00")
    assert {(r.k, r[D.CHANGE_COL]) for r in ch.collect()} == {(3, "update")}
    # with a timestamp column a run counts as changed even when nothing changed;
    # in hash mode only a written row counts
    out = os.path.join(scratch, "edge")
    D.run_sync(spark, cur, "k", out, "t", 1, since_arg="last", ts_col="ts", now="2030-01-01T00:00:00")
    r_ts = D.run_sync(spark, cur, "k", out, "t", 2, since_arg="last", ts_col="ts", now="2030-01-02T00:00:00")
    assert r_ts["mode"] == "delta" and r_ts["changed"] is True
    assert D.read_changes(spark, r_ts).count() == 0  # nothing changed
    out2 = os.path.join(scratch, "edge_hash")
    D.run_sync(spark, cur, "k", out2, "t", 1, since_arg="last", hash_cols=["v"], now="2030-01-01T00:00:00")
    r_h = D.run_sync(spark, cur, "k", out2, "t", 2, since_arg="last", hash_cols=["v"], now="2030-01-02T00:00:00")
    assert r_h["changed"] is False
    # `since` is the time taken before the previous scan
    assert r_ts["since"] == "2030-01-01T00:00:00"


def test_same_day_runs_keep_both_deltas(spark, scratch, sf_dir):
    prev, cur = _orders_pair(spark, sf_dir)
    out = os.path.join(scratch, "sameday")
    D.run_sync(spark, prev, "o_orderkey", out, "o", 1, since_arg="last", hash_cols=HASH_COLS, now="2026-05-01T01:00:00")
    r2 = D.run_sync(spark, cur, "o_orderkey", out, "o", 2, since_arg="last", hash_cols=HASH_COLS,
                    now="2026-05-01T02:00:00")
    r3 = D.run_sync(spark, prev, "o_orderkey", out, "o", 3, since_arg="last", hash_cols=HASH_COLS,
                    now="2026-05-01T03:00:00")
    assert r2["output"] != r3["output"]
    n2, n3 = D.read_changes(spark, r2).count(), D.read_changes(spark, r3).count()
    assert n2 > 0 and n3 > 0
    assert sorted(os.listdir(os.path.join(out, "o_delta_2026-05-01"))) == ["batch=2", "batch=3"]


def test_upsert_batches_with_string_keys(spark, scratch):
    store = D.StateStore(spark, os.path.join(scratch, "st"), "s")
    out = os.path.join(scratch, "o")
    b1 = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, None)], "k string, v double, d boolean")
    ST.upsert_batch(spark, b1, 1, "k", out, "s", store, None, ["v"], "d")
    b2 = spark.createDataFrame([("a", 1.5, None), ("b", None, True), ("c", 3.0, None)], "k string, v double, d boolean")
    ST.upsert_batch(spark, b2, 2, "k", out, "s", store, None, ["v"], "d")
    got = {(r.k, r[D.CHANGE_COL]) for r in spark.read.parquet(os.path.join(out, "s_delta", "batch=2")).collect()}
    assert got == {("a", "update"), ("b", "delete"), ("c", "insert")}
    assert sorted(r.pk for r in store.keys().collect()) == ["a", "c"]


def test_change_capture_of_repeated_and_null_keys(spark):
    from tessella.operators import cdc
    cur = spark.createDataFrame([(1, "a"), (2, "b"), (9, "n"), (9, "n"), (9, "m"), (None, "x")], "pk long, v string")
    prev = spark.createDataFrame([(1,), (2,), (3,)], "pk long")
    got = sorted(((r["pk"], r["v"], r["_change_type"]) for r in cdc.cdc_diff(cur, prev, "pk").collect()), key=str)
    assert got == sorted([(9, "n", "insert"), (9, "n", "insert"), (9, "m", "insert"), (None, "x", "insert"), (3, None, "delete")], key=str)


def test_row_hash_tells_nulls_apart(spark):
    from tessella.operators import cdc
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "a"), (None, None)], "x string, y string")
    assert df.select(cdc.row_hash(["x", "y"]).alias("h")).distinct().count() == 4


def test_value_maps_behave_alike_at_any_size(spark):
    from tessella.operators import mapping as M
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, c string")
    small = {"a": 5, "b": ""}
    large = small | {f"k{i}": i for i in range(150)}
    want = [(1, "5"), (2, None), (3, None)]
    for pairs in (small, large):
        assert [tuple(r) for r in M.map_values(df, "c", pairs).orderBy("id").collect()] == want
    t = spark.createDataFrame([("a", "second", 2), ("a", "first", 1), ("b", "", 1)], "source_value string, target_value string, ordinal int")
    assert [tuple(r) for r in M.map_values(df, "c", t).orderBy("id").collect()] == [(1, "first"), (2, None), (3, None)]


def test_long_whole_numbers_in_geojson_survive(spark, scratch):
    import os
    os.makedirs(f"{scratch}/g")
    with open(f"{scratch}/g/a.geojsonl", "w") as f:
        f.write('{"type":"Feature","id":1,"properties":{"n":123456789012345678901234567890,"m":7},"geometry":null}\n')
    from tessella.sources import readers as RD
    r = RD.scan_geojson_seq(spark, f"{scratch}/g").first()
    assert int(r["n"]) == 123456789012345678901234567890 and r["m"] == 7


def test_null_and_repeated_keys_through_every_change_function(spark):
    import datetime as dt

    from tessella.operators import cdc
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)
    cur = spark.createDataFrame([(1, "a", old), (2, "b", new), (None, "n", old), (9, "x", old), (9, "y", old)], "pk long, v string, ts timestamp")
    prev = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (None,), (None,)], "pk long")
    got = lambda df: sorted(((r["pk"], r.asDict().get("v"), r["_change_type"]) for r in df.collect()), key=str)
    since = dt.datetime(2024, 3, 1)
    inserts, updates, deletes = [(9, "x", "insert"), (9, "y", "insert")], [(2, "b", "update")], [(3, None, "delete")]
    assert got(cdc.cdc_inserts(cur, prev, "pk")) == inserts
    assert got(cdc.cdc_deletes(cur, prev, "pk")) == deletes
    assert got(cdc.cdc_updates(cur, prev, "pk", "ts", since)) == updates
    assert got(cdc.cdc_changes(cur, prev, "pk", "ts", since)) == sorted(inserts + updates, key=str)
    for narrow in (True, False):
        diff = cdc.cdc_diff(cur, prev, "pk", "ts", since, narrow=narrow)
        assert got(diff) == sorted(inserts + updates + deletes, key=str), narrow
    gone = cur.filter("pk IS NOT NULL")
    assert (None, None, "delete") in got(cdc.cdc_deletes(gone, prev, "pk"))
    assert (None, None, "delete") in got(cdc.cdc_diff(gone, prev, "pk", narrow=False))


def test_upsert_without_order_takes_the_same_row_of_a_key(spark, scratch):
    """Rows of one key in any order and partitioning: one written row, and the stored hash is that row's."""
    rows = [(k, v, f"t{v}") for k in (1, 2, None) for v in range(20)]
    seen = set()
    for i, (n, turn) in enumerate([(1, 1), (7, -1), (3, 1)]):
        store = D.StateStore(spark, os.path.join(scratch, f"st{i}"), "s")
        out = os.path.join(scratch, f"o{i}")
        b = spark.createDataFrame(rows[::turn], "k long, v long, t string").repartition(n)
        ST.upsert_batch(spark, b, 1, "k", out, "s", store, None, ["v", "t"])
        got = spark.read.parquet(os.path.join(out, "s_delta", "batch=1"))
        assert got.count() == 3
        seen.add(tuple(sorted(map(str, got.collect()))))
        stored = {r.pk: r.row_hash for r in store.keys().collect()}
        assert stored == {r.k: r.h for r in got.select("k", D.row_hash(["v", "t"]).alias("h")).collect()}
        # the same batch again is no change, also for the NULL key
        ST.upsert_batch(spark, b, 2, "k", out, "s", store, None, ["v", "t"])
        assert spark.read.schema(got.schema).parquet(os.path.join(out, "s_delta", "batch=2")).count() == 0
    assert len(seen) == 1


def test_keyed_stream_takes_the_last_row_of_a_hot_key(spark, scratch):
    from tessella.streaming import keyed as KS
    rows = [(1, None if i % 7 == 0 else i % 500, float(i)) for i in range(30000)] + [(2, None, 5.0), (2, None, 6.0)]
    ev = spark.createDataFrame(rows, "k long, o long, v double")
    seen = set()
    for i, n in enumerate((1, 5)):
        land, out, ck = (os.path.join(scratch, f"{d}{i}") for d in ("hland", "hout", "hck"))
        ev.repartition(n).write.parquet(land)
        KS.stream_changes_stateful(spark, land, ev.schema, "k", ["v"], out, ck, order_col="o",
                                   available_now=True).awaitTermination(300)
        got = spark.read.parquet(out).collect()
        assert len(got) == 2 and {r.o for r in got} == {499, None}
        seen.add(tuple(sorted(map(str, got))))
    assert len(seen) == 1
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")
