"""Plan shapes the operators are designed for (checked on sf0.001 plans)."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from tessella import registry as R


def _plan(spark, sf_dir, name, execute=True):
    """The formatted plan with expression ids removed."""
    df = R.QUERIES[name](spark, sf_dir)
    if execute:
        df.write.format("noop").mode("overwrite").save()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return re.sub(r"#\d+L?", "", buf.getvalue())


def test_paging_is_top_k_without_global_sort(spark, sf_dir):
    p = _plan(spark, sf_dir, "items_page")
    assert "TakeOrderedAndProject" in p and "Exchange rangepartitioning" not in p


def test_all_row_rules_in_one_scan_without_shuffle(spark, sf_dir):
    p = _plan(spark, sf_dir, "dq_lineitem_rules")
    assert len(re.findall(r"\(\d+\) Scan parquet", p)) == 1 and "Exchange" not in p


def test_filters_and_pruning_reach_the_scan(spark, sf_dir):
    p = _plan(spark, sf_dir, "items_compare", execute=False)
    assert "GreaterThan(l_quantity,20.0)" in p and "LessThanOrEqual(l_discount,0.05)" in p
    assert "Not(EqualTo(l_returnflag,R))" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_discount:double," in p


@pytest.mark.parametrize("name", ["spatial_intersects", "spatial_crosses", "spatial_touches_polygons"])
def test_spatial_join_is_an_equi_join_on_cells(spark, sf_dir, name):
    p = _plan(spark, sf_dir, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "[a_cell]" in p and "[b_cell]" in p
    # the pair dedupe is a filter, not a distinct
    assert "HashAggregate" not in p


def test_change_capture_shuffles_keys_not_rows(spark, sf_dir):
    p = _plan(spark, sf_dir, "cdc_diff")
    # the classification join ran before (checkpointed change set); the wide
    # rows meet the change keys in a broadcast join
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_neighbours_never_use_a_single_partition_window(spark, sf_dir):
    for name in ("item_neighbours", "item_neighbours_by_layer"):
        p = _plan(spark, sf_dir, name)
        for line in p.splitlines():
            if "Exchange SinglePartition" in line:
                # only the small per-range bounds table may be gathered
                assert "_b" in p
        assert "Window" in p and "lag(_k" in p


def test_distinct_values_limits_before_the_field_shuffle(spark, sf_dir):
    p = _plan(spark, sf_dir, "distinct_values")
    assert "WindowGroupLimit" in p and "Partial" in p
