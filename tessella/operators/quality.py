"""Row constraints.

All row-local rules of a layer compile into ONE projection: each rule is a
``when(violated, struct(rule, field, value))`` element of an array that is
filtered and exploded, so the table is scanned once however many rules
there are. Key rules (unique, primary key, code-list domain) need a shuffle
and run as aggregates or joins; partial aggregation combines hot keys
before the shuffle and AQE splits skewed join partitions.

CHECK semantics: a NULL value passes every rule except ``required``.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import broadcast_if_small

VIOLATION_T = "struct<rule:string,field:string,value:string>"
COMPARE_OPS = (">", "<", ">=", "<=", "==", "!=")


@dataclass
class Rule:
    """One row rule. ``kind`` is one of required, min, max, min_length,
    max_length, pattern, enumeration, compare, non_empty, nested_required."""
    kind: str
    field: str
    value: object = None
    other: str | None = None      # second field of a compare rule
    op: str | None = None         # compare operator
    name: str | None = None       # rule label in the output

    @property
    def label(self) -> str:
        return self.name or (f"{self.kind}:{self.op}" if self.kind == "compare" else self.kind)


@dataclass
class Constraints:
    """Declared constraints of one field: range, length, pattern, uniqueness,
    primary key and enumeration."""
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    is_unique: bool = False
    is_primary_key: bool = False
    enumeration: list = dc_field(default_factory=list)


def inherit_constraints(field_c: Constraints | None, type_c: Constraints | None) -> Constraints:
    """Type-level constraints apply unless the field overrides them."""
    f, t = field_c or Constraints(), type_c or Constraints()
    pick = lambda a, b: a if a is not None else b
    return Constraints(pick(f.min, t.min), pick(f.max, t.max), pick(f.min_length, t.min_length),
                       pick(f.max_length, t.max_length), pick(f.pattern, t.pattern),
                       f.is_unique or t.is_unique, f.is_primary_key or t.is_primary_key,
                       list(f.enumeration or t.enumeration))


def rules_for_field(name: str, c: Constraints, required: bool = False) -> list[Rule]:
    """Row rules implied by a field's constraints and multiplicity."""
    out = []
    if required:
        out.append(Rule("required", name))
    if c.min is not None:
        out.append(Rule("min", name, c.min))
    if c.max is not None:
        out.append(Rule("max", name, c.max))
    if c.min_length is not None:
        out.append(Rule("min_length", name, c.min_length))
    if c.max_length is not None:
        out.append(Rule("max_length", name, c.max_length))
    if c.pattern:
        out.append(Rule("pattern", name, c.pattern))
    if c.enumeration:
        out.append(Rule("enumeration", name, list(c.enumeration)))
    return out


def _col(name: str) -> Column:
    return F.col(name)


def violated(r: Rule) -> Column:
    """Predicate true when the row breaks the rule (NULL passes, except required)."""
    c = _col(r.field)
    k = r.kind
    if k == "required":                                   # C1
        return c.isNull()
    if k == "min":                                        # C2
        return c < F.lit(r.value)
    if k == "max":
        return c > F.lit(r.value)
    if k == "min_length":                                 # C3
        return F.char_length(c) < F.lit(r.value)
    if k == "max_length":
        return F.char_length(c) > F.lit(r.value)
    if k == "pattern":                                    # C4 (unanchored, like POSIX ~)
        return ~c.rlike(str(r.value))
    if k == "enumeration":                                # C5
        return ~c.isin(list(r.value))
    if k == "compare":                                    # C9: the rule states what must hold
        o = _col(r.other)
        holds = {">": c > o, "<": c < o, ">=": c >= o, "<=": c <= o, "==": c == o, "!=": c != o}[r.op]
        return ~holds
    if k == "non_empty":                                  # C18: 1..* arrays
        return F.size(c) < 1
    if k == "nested_required":                            # C17: array items / struct leaves
        sub = str(r.value)
        return F.exists(c, lambda x: x[sub].isNull()) if r.other == "array" else c[sub].isNull()
    if k.startswith("item_"):                             # C16/C17 on every item of an array
        inner = Rule(k[5:], "_", r.value)
        leaf = r.other

        def item_bad(x):
            v = x[leaf] if leaf else x
            return F.coalesce(_violated_on(inner, v), F.lit(False))
        return F.exists(c, item_bad)
    raise ValueError(f"unknown rule kind {k}")


ARRAY_KINDS = ("non_empty", "item_required", "item_min", "item_max", "item_min_length", "item_max_length",
               "item_pattern", "item_enumeration")


def _violated_on(r: Rule, c: Column) -> Column:
    """Scalar rule predicates on an arbitrary Column (array items)."""
    k = r.kind
    if k == "required":
        return c.isNull()
    if k == "min":
        return c < F.lit(r.value)
    if k == "max":
        return c > F.lit(r.value)
    if k == "min_length":
        return F.char_length(c) < F.lit(r.value)
    if k == "max_length":
        return F.char_length(c) > F.lit(r.value)
    if k == "pattern":
        return ~c.rlike(str(r.value))
    if k == "enumeration":
        return ~c.isin(list(r.value))
    raise ValueError(f"rule kind {k} has no item form")


def rules_for_struct(col: str, leaves: dict[str, Constraints], type_leaves: dict[str, Constraints] | None = None,
                     required_leaves: list[str] | None = None, array: bool = False) -> list[Rule]:
    """Rules for the scalar leaves of a struct (or of every struct
    item of an array). Type-level constraints of a shared type apply to each
    leaf unless the field's own constraints override them."""
    type_leaves = type_leaves or {}
    out = []
    for leaf in sorted(set(leaves) | set(type_leaves)):
        c = inherit_constraints(leaves.get(leaf), type_leaves.get(leaf))
        for r in rules_for_field(leaf, c):
            if array:
                out.append(Rule(f"item_{r.kind}", col, r.value, other=leaf, name=r.kind))
            else:
                out.append(Rule(r.kind, f"{col}.{leaf}", r.value))
    for leaf in required_leaves or []:
        out.append(Rule("nested_required", col, leaf, other="array" if array else None, name="required"))
    return out


def row_violations(df: DataFrame, key_cols: list[str], rules: list[Rule]) -> DataFrame:
    """Every violation of every row rule: ``key_cols..., rule, field, value``.

    One scan, one projection; the NULL result of a comparison with a NULL
    value is treated as a pass (``coalesce(pred, false)``).
    """
    def shown(r):
        # arrays are reported by their size (array text formats differ by engine)
        if r.kind in ARRAY_KINDS or (r.kind == "nested_required" and r.other == "array"):
            return F.size(_col(r.field)).cast("string")
        if r.kind == "nested_required":
            return F.lit(None).cast("string")
        return _col(r.field).cast("string")

    checks = [F.when(F.coalesce(violated(r), F.lit(False)),
                     F.struct(F.lit(r.label).alias("rule"),
                              F.lit(f"{r.field}.{r.value}" if r.kind == "nested_required" else
                                    f"{r.field}[].{r.other}" if r.kind.startswith("item_") and r.other else
                                    f"{r.field}[]" if r.kind.startswith("item_") else r.field).alias("field"),
                              shown(r).alias("value")))
              for r in rules]
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return (df.select(*key_cols, arr.alias("_v"))
            .filter(F.size("_v") > 0)
            .select(*key_cols, F.inline("_v")))


def codelist_violations(df: DataFrame, key_cols: list[str], field: str, codes: DataFrame,
                        code_col: str = "code", max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Non-null values missing from the code list table (anti join).
    The code list is broadcast only behind a row-count check."""
    dom = broadcast_if_small(codes.select(F.col(code_col).alias("_code")).distinct(), max_broadcast_rows)
    return (df.filter(F.col(field).isNotNull())
            .join(dom, F.col(field) == F.col("_code"), "left_anti")
            .select(*key_cols, F.lit("codelist").alias("rule"), F.lit(field).alias("field"),
                    F.col(field).cast("string").alias("value")))


def duplicate_keys(df: DataFrame, cols: list[str], include_nulls: bool = False) -> DataFrame:
    """Key groups occurring more than once, with their count.

    ``include_nulls=False`` is SQL UNIQUE (NULLs never collide, C7/C8);
    ``True`` is GROUP BY semantics, where NULL forms a group (C11).
    Partial aggregation collapses a hot key map-side before the shuffle.
    """
    d = df.select(*cols)
    if not include_nulls:
        d = d.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    return d.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


#: Tasks that the rows of one duplicated key are dealt to.
KEY_SALT = 16


def unique_violations(df: DataFrame, key_cols: list[str], cols: list[str], rule: str = "unique") -> DataFrame:
    """C7/C8 rows whose (non-null) value set occurs more than once.

    The duplicated keys are joined back with a semi join on the key and a salt:
    each key stands once per salt, so the rows of a hot key go to ``KEY_SALT``
    tasks whatever the planner does.
    """
    dups = duplicate_keys(df, cols).select(*cols, F.explode(F.sequence(F.lit(0), F.lit(KEY_SALT - 1))).alias("_salt"))
    value = F.concat_ws(",", *[F.col(c).cast("string") for c in cols])
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in key_cols + cols], F.monotonically_increasing_id()),
                                           F.lit(KEY_SALT)).cast("int"))
    return (salted.join(dups, [*cols, "_salt"], "left_semi")
            .select(*key_cols, F.lit(rule).alias("rule"), F.lit(",".join(cols)).alias("field"),
                    value.alias("value")))


def primary_key_violations(df: DataFrame, pk_cols: list[str], key_cols: list[str] | None = None) -> DataFrame:
    """Rows with a NULL in any key column, plus rows of duplicated keys."""
    key_cols = key_cols or pk_cols
    nulls = (df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk_cols]))
             .select(*key_cols, F.lit("primary_key_null").alias("rule"), F.lit(",".join(pk_cols)).alias("field"),
                     F.lit(None).cast("string").alias("value")))
    return nulls.unionByName(unique_violations(df, key_cols, pk_cols, "primary_key_duplicate"))


def pk_stats(df: DataFrame, pk: str) -> DataFrame:
    """C10/C11 for one layer: feature count, NULL PK count and number of
    duplicated PK groups (NULL is a group), from one grouped pass; the
    per-key counts are combined map-side, then reduced to one row."""
    per_key = df.groupBy(pk).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("feature_count"),
        F.coalesce(F.sum(F.when(F.col(pk).isNull(), F.col("n"))), F.lit(0)).cast("long").alias("null_pk"),
        F.count_if(F.col("n") > 1).alias("duplicate_pk_groups"))


INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def pk_schema_issues(layer: str, schema: T.StructType, pk: str | None) -> list[dict]:
    """C12/C13 from the schema: missing PK column (error), non-integer PK (warning)."""
    if not pk or pk not in schema.fieldNames():
        return [{"layer": layer, "column": pk, "type": "no_primary_key", "severity": "error"}]
    if not isinstance(schema[pk].dataType, INTEGER_TYPES):
        return [{"layer": layer, "column": pk, "type": "non_integer_pk", "severity": "warning"}]
    return []


def import_issues(layer: str, df: DataFrame, pk: str | None) -> DataFrame:
    """C10-C13 issues of one layer as rows (layer, column, type, severity)."""
    spark = df.sparkSession
    schema_rows = pk_schema_issues(layer, df.schema, pk)
    issue_t = "layer string, column string, type string, severity string"
    out = spark.createDataFrame(schema_rows, issue_t) if schema_rows else spark.createDataFrame([], issue_t)
    if pk and pk in df.columns:
        st = pk_stats(df, pk)
        data_rows = st.select(F.explode(F.array(
            F.when(F.col("null_pk") > 0, F.struct(F.lit("null_pk").alias("type"), F.lit("error").alias("severity"))),
            F.when(F.col("duplicate_pk_groups") > 0,
                   F.struct(F.lit("non_unique_pk").alias("type"), F.lit("error").alias("severity"))))).alias("i")) \
            .filter(F.col("i").isNotNull()) \
            .select(F.lit(layer).alias("layer"), F.lit(pk).alias("column"), "i.type", "i.severity")
        out = out.unionByName(data_rows)
    return out


def import_verdict(issues: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """C14: ``is_valid`` = no errors and no error-severity warnings;
    ``can_proceed`` = no errors (failed layers)."""
    n_err = errors.count() if errors is not None else 0  # failed-layer list: one row per layer
    return issues.agg(
        ((F.count_if(F.col("severity") == "error") == 0) & F.lit(n_err == 0)).alias("is_valid"),
        F.lit(n_err == 0).alias("can_proceed"))


def srid_mismatch(name: str, df: DataFrame, model_srid: int, geom_col: str = "geometry") -> DataFrame:
    """SRIDs of a layer's geometries that differ from the model's, with the
    number of features that have them."""
    srid = F.col(geom_col)["srid"]
    return df.filter(srid.isNotNull() & (srid != F.lit(model_srid))).groupBy(srid.alias("srid")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "srid", "n")
