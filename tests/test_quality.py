"""Constraint semantics on small hand-made rows."""

from __future__ import annotations

from tessella.operators import quality as C


def _v(df):
    return sorted((r.id, r.rule, r.field) for r in df.collect())


def test_null_passes_every_rule_but_required(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5.0, "zz"), (3, 50.0, "ab")], "id int, n double, s string")
    rules = (C.rules_for_field("n", C.Constraints(min=0.0, max=10.0), required=True)
             + C.rules_for_field("s", C.Constraints(min_length=2, max_length=2, pattern="^a", enumeration=["ab"])))
    got = _v(C.row_violations(df, ["id"], rules))
    assert got == [(1, "required", "n"), (2, "enumeration", "s"), (2, "pattern", "s"), (3, "max", "n")]


def test_compare_rule_and_pattern_is_unanchored(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, "xaby"), (2, 3.0, 2.0, "ab"), (3, None, 2.0, None)],
                               "id int, a double, b double, s string")
    got = _v(C.row_violations(df, ["id"], [C.Rule("compare", "a", other="b", op="<="), C.Rule("pattern", "s", "ab")]))
    assert got == [(2, "compare:<=", "a")]


def test_keys_unique_and_primary(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, None, 2), (4, None, 2), (5, "b", None)],
                               "id int, k string, j int")
    uniq = _v(C.unique_violations(df, ["id"], ["k"]))
    assert uniq == [(1, "unique", "k"), (2, "unique", "k")]  # NULLs are not duplicates of each other
    pk = _v(C.primary_key_violations(df, ["k", "j"], ["id"]))
    assert pk == [(1, "primary_key_duplicate", "k,j"), (2, "primary_key_duplicate", "k,j"),
                  (3, "primary_key_null", "k,j"), (4, "primary_key_null", "k,j"), (5, "primary_key_null", "k,j")]
    st = C.pk_stats(df, "k").first()
    # the import check counts NULL as a key group, as the reference's GROUP BY does
    assert (st.feature_count, st.null_pk, st.duplicate_pk_groups) == (5, 2, 2)


def test_codelist_and_inherited_constraints(spark):
    df = spark.createDataFrame([(1, "x"), (2, "q"), (3, None)], "id int, code string")
    codes = spark.createDataFrame([("x",), ("y",)], "code string")
    assert _v(C.codelist_violations(df, ["id"], "code", codes)) == [(2, "codelist", "code")]
    c = C.inherit_constraints(C.Constraints(max=5.0), C.Constraints(min=1.0, max=9.0, pattern="^a"))
    assert (c.min, c.max, c.pattern) == (1.0, 5.0, "^a")


def test_import_issues_and_verdict(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    issues = {(r.type, r.severity) for r in C.import_issues("L", df, "k").collect()}
    assert issues == {("non_integer_pk", "warning"), ("null_pk", "error"), ("non_unique_pk", "error")}
    assert C.pk_schema_issues("L", T.StructType([T.StructField("x", T.LongType())]), "fid") == [
        {"layer": "L", "column": "fid", "type": "no_primary_key", "severity": "error"}]
    v = C.import_verdict(C.import_issues("L", df, "k")).first()
    assert v.is_valid is False and v.can_proceed is True
