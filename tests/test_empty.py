"""Operators on empty inputs: no errors, sensible empty results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import cdc as D
from tessella.operators import profile as A
from tessella.operators import query as Q
from tessella.operators import spatial as SP
from tessella.plans import layers as P
from tessella.session import table


def test_empty_inputs(spark, sf_dir):
    ev = table(spark, sf_dir, "events").limit(0)
    pts = ev.select("event_id", G.point(F.lit(1.0), F.lit(2.0)).alias("geometry"))
    polys = table(spark, sf_dir, "nation").select(
        "n_nationkey", G.rectangle(F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(5.0)).alias("geometry"))
    assert SP.spatial_join(pts, polys, "intersects", 1.0, kinds=("point", "polygon")).count() == 0
    assert SP.spatial_join(polys.limit(0), pts, "contains", 1.0, kinds=("polygon", "point")).count() == 0
    assert Q.item_neighbours(ev, "event_id").count() == 0
    assert Q.item_neighbours(ev, "event_id", ["event_type"]).count() == 0
    assert A.distinct_values(ev, ["event_type"]).count() == 0
    ext = A.layer_extent("e", ev.withColumns({c: F.lit(1.0) for c in ("min_x", "min_y", "max_x", "max_y")})).first()
    assert ext.min_x is None
    v = A.validity_summary("e", ev, F.lit(True)).first()
    assert (v.total_features, v.invalid_count, v.valid_percent) == (0, 0, 100)
    o = table(spark, sf_dir, "orders")
    st = D.state_from_snapshot(o, "o_orderkey")
    dels = D.cdc_diff(o.limit(0), st, "o_orderkey")
    assert dels.filter(F.col(D.CHANGE_COL) != "delete").count() == 0 and dels.count() == o.count()
    rows, total = P.import_summary({"e": P.LayerSource(ev, "Point", 4326, "event_id")})
    assert rows.first().feature_count == 0 and total.first().is_valid
