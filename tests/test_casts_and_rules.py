"""Casts and rules on hand-written values."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions import rules as R
from siltworks.functions.casts import coerce
from siltworks.functions.rules import Rule
from siltworks.operators import dq


def cast_all(spark, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    c, _ = coerce(F.col("x"), T.StringType(), expected)
    return [r[0] for r in df.select(c.alias("y"), "i").orderBy("i").collect()]


def test_integer_cast(spark):
    values = ["7", "7.0", "1e3", "7.5", "inf", "abc", "", None, " 12 ", "9007199254740993"]
    assert cast_all(spark, values, "INTEGER") == [7, 7, 1000, None, None, None, None, None, 12, 9007199254740993]


def test_float_cast(spark):
    values = [" 12 ", "1e3", "1d", "NaN", "1,000", "0x1A", "1_0", ".5", "-inf", None]
    assert cast_all(spark, values, "FLOAT") == [12.0, 1000.0, None, None, None, None, None, 0.5, float("-inf"), None]


def test_boolean_cast(spark):
    assert cast_all(spark, ["True", "FALSE", "1", "yes", None], "BOOLEAN") == [True, False, None, None, None]


def test_timestamp_cast(spark):
    out = cast_all(spark, ["2024-01-02", "2024-01-02 03:04:05", "2024", "soon", None], "DATE")
    assert [str(v) if v else None for v in out] == ["2024-01-02 00:00:00", "2024-01-02 03:04:05", None, None, None]


def test_text_cast_keeps_nulls(spark):
    assert cast_all(spark, ["a", None], "STRING") == ["a", None]


def flagged(spark, values, *rules, schema="i int, x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema)
    rows = dq.flag(df, rules).orderBy("i").collect()
    return [r["_dq_invalid"] for r in rows], [r["_dq_warnings"] for r in rows]


def test_cast_failures_count_blank_text_but_not_null(spark):
    bad, _ = flagged(spark, ["7", "7.0", "1e3", "7.5", "inf", "abc", "", None], Rule("x", "INTEGER", "RANGE", "ERROR", ":"))
    assert bad == [False, False, False, True, True, True, True, False]


def test_unique_flags_all_members_and_null_equals_null(spark):
    bad, _ = flagged(spark, [None, None, "1", "1", "2"], Rule("x", "INTEGER", "UNIQUE", "BLOCK"))
    assert bad == [True, True, True, True, False]


@pytest.mark.parametrize("value, want", [("10:", [True, False, False]), (":9", [False, True, False]), ("abc", [False] * 3), ("1:2:3", [False] * 3)])
def test_range(spark, value, want):
    assert flagged(spark, ["9", "10", None], Rule("x", "FLOAT", "RANGE", "ERROR", value))[0] == want


def test_range_refuses_bounds_that_are_no_numbers():
    with pytest.raises(ValueError):
        R.parse_range("a:b")


def test_regex_is_anchored_at_the_start_and_null_passes(spark):
    assert flagged(spark, ["ab1", "1ab", None], Rule("x", "STRING", "REGEX", "ERROR", "[a-z]+"))[0] == [False, True, False]
    assert flagged(spark, ["ab1"], Rule("x", "STRING", "REGEX", "ERROR", ""))[0] == [False]


def test_allowed_values_are_trimmed(spark):
    rule = Rule("x", "STRING", "CUSTOM", "ERROR", "allowed_values=a, b")
    assert flagged(spark, ["a", "b", "c", None], rule)[0] == [False, False, True, False]


def test_negative_check_only_when_true(spark):
    assert flagged(spark, ["-1", "1"], Rule("x", "FLOAT", "CUSTOM", "ERROR", "NEGATIVE_CHECK=true"))[0] == [True, False]
    assert flagged(spark, ["-1", "1"], Rule("x", "FLOAT", "CUSTOM", "ERROR", "NEGATIVE_CHECK=no"))[0] == [False, False]


def test_each_rule_row_counts_its_cast_failure(spark):
    rules = [Rule("x", "INTEGER", "RANGE", "WARN", ":"), Rule("x", "INTEGER", "RANGE", "WARN", ":")]
    assert flagged(spark, ["abc", "1"], *rules)[1] == [2, 0]


def test_missing_column_is_created_as_null(spark):
    df = spark.createDataFrame([(1,)], "i int")
    row = dq.flag(df, [Rule("gone", "INTEGER", "NOT_NULL", "ERROR")]).first()
    assert row["gone"] is None and row["_dq_invalid"]


def test_incomplete_and_inactive_rules_are_skipped(spark):
    rules = [Rule("x", None, "NOT_NULL", "ERROR"), Rule("x", "STRING", "NOT_NULL", None), Rule("x", "STRING", "NOT_NULL", "ERROR", is_active=False)]
    assert flagged(spark, [None], *rules) == ([False], [0])


def test_valid_and_rejected_make_up_the_input(spark):
    df = spark.createDataFrame([(i, str(i % 7)) for i in range(100)], "i int, x string")
    f = dq.flag(df, [Rule("x", "INTEGER", "RANGE", "ERROR", "2:"), Rule("i", "INTEGER", "UNIQUE", "ERROR")])
    assert dq.valid_rows(f).count() + dq.rejected_rows(f).count() == 100
    assert dq.valid_rows(f).columns == ["i", "x"]


def test_samples_repeat_and_are_cut_to_five(spark):
    df = spark.createDataFrame([("b",)] * 3 + [("a",)] * 4 + [("c",)], "x string")
    rules = [Rule("x", "STRING", "CUSTOM", "WARN", "ALLOWED_VALUES=z")]
    row = dq.details(dq.flag(df, rules), rules).first()
    assert row["count"] == 8 and row["samples"] == ["a", "a", "a", "a", "b"]


def test_rules_can_be_added_and_taken_away(spark):
    R.register_rule("SHORT", lambda c, t, v: F.length(c) > int(v))
    try:
        assert flagged(spark, ["abc", "a"], Rule("x", "STRING", "SHORT", "ERROR", "2"))[0] == [True, False]
        with pytest.raises(ValueError):
            R.register_rule("SHORT", lambda c, t, v: c)
    finally:
        R.unregister_rule("SHORT")
    assert flagged(spark, ["abc"], Rule("x", "STRING", "SHORT", "ERROR", "2"))[0] == [False]


def test_rules_from_catalog_are_the_active_ones_in_order(spark):
    rows = [("2", "d", "b", "STRING", "NOT_NULL", None, "WARN", True), ("1", "d", "a", "STRING", "UNIQUE", None, "ERROR", True), ("3", "d", "c", "STRING", "REGEX", "x", "ERROR", False), ("4", "e", "a", "STRING", "REGEX", "x", "ERROR", True)]
    cat = spark.createDataFrame(rows, "id string, dataset_id string, column_name string, expected_data_type string, dq_rule string, rule_value string, severity string, is_active boolean")
    cat = cat.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert [r.column for r in dq.rules_from_catalog(cat, "d")] == ["a", "b"]
