"""Key joins between layers.

Foreign keys are equi-joins that shuffle on the key (sort-merge); a side is
broadcast only when its row count is proven under a bound, and AQE may still
convert or split a join at runtime (skew join for hot parents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import broadcast_if_small


def join_reference(child: DataFrame, parent: DataFrame, fk: str, pk: str,
                   parent_cols: list[str] | None = None, broadcast_rows: int | None = None) -> DataFrame:
    """Resolve a feature reference (child.fk -> parent.pk), keeping every
    child row (left join). ``broadcast_rows`` broadcasts a proven-small parent."""
    cols = parent_cols or [c for c in parent.columns if c != pk]
    p = parent.select(F.col(pk).alias("_pk"), *cols)
    if broadcast_rows:
        p = broadcast_if_small(p, broadcast_rows)
    return child.join(p, F.col(fk) == F.col("_pk"), "left").drop("_pk")


def fk_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose non-null key has no parent (``left_anti``)."""
    keys = parent.select(F.col(pk).alias("_pk"))
    return child.filter(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")


def cascade_delete(levels: list[tuple[DataFrame, str, str]], deleted_root_keys: DataFrame) -> list[DataFrame]:
    """Keys removed at each level when the root keys are deleted.

    ``levels`` = [(child_df, fk, pk), ...] from the root's children downwards;
    level ``i``'s ``fk`` points at level ``i-1``'s key (the root's for i=0).
    Each level is one semi join of the child against the keys deleted one level
    up; returns the deleted key frames, root first. Survivors of a level are
    ``child.join(deleted, fk, 'left_anti')``.
    """
    out = [deleted_root_keys.select(F.col(deleted_root_keys.columns[0]).alias("key"))]
    for child, fk, pk in levels:
        gone = child.join(out[-1], F.col(fk) == F.col("key"), "left_semi").select(F.col(pk).alias("key"))
        out.append(gone)
    return out


def codelist_labels(df: DataFrame, field: str, codes: DataFrame, code_col: str = "code",
                    label_col: str = "label", out_col: str | None = None, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Code -> label by a left join against the code list, broadcast when
    the list is proven small (code lists are)."""
    out_col = out_col or f"{field}_label"
    c = codes.select(F.col(code_col).alias("_code"), F.col(label_col).alias(out_col))
    c = broadcast_if_small(c, broadcast_rows)
    return df.join(c, F.col(field) == F.col("_code"), "left").drop("_code")


def inverse_pairs(parent: DataFrame, child: DataFrame, pk: str, fk: str, child_pk: str) -> DataFrame:
    """The other end of a feature reference as (parent key, child key)
    rows; parents with no child appear once with a NULL child key.

    Rows, not one array per parent: a parent holding a third of all children
    would otherwise be one giant value built in one task. For the same hot
    parent the plan avoids ``parent LEFT JOIN child``, where AQE could not
    split the skewed child side: parents with children come from an INNER
    join (AQE's skew join may split either side), childless parents from an
    anti join against the child keys after a partial aggregate (one row per
    key, so nothing is skewed there).
    """
    out_col = f"inverse_{child_pk}"
    c = child.select(F.col(fk).alias("_fk"), F.col(child_pk).alias(out_col)).filter(F.col("_fk").isNotNull())
    p = parent.select(pk)
    with_children = p.join(c, F.col(pk) == F.col("_fk"), "inner").select(pk, out_col)
    keys = c.select("_fk").distinct()
    without = p.join(keys, F.col(pk) == F.col("_fk"), "left_anti").select(
        pk, F.lit(None).cast(child.schema[child_pk].dataType).alias(out_col))
    return with_children.unionByName(without)


def inverse_counts(parent: DataFrame, child: DataFrame, pk: str, fk: str) -> DataFrame:
    """J11 summary: children per parent (0 included). Partial counts are
    combined map-side before the shuffle, so hot parents cost one row per task."""
    counts = child.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("n_inverse"))
    return (parent.select(pk).join(counts, F.col(pk) == F.col("_fk"), "left")
            .select(pk, F.coalesce("n_inverse", F.lit(0)).alias("n_inverse")))
