"""Applying catalogued rules to a table: cast, flag, split, count and report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.casts import coerce
from siltworks.functions.rules import Rule, row_mask
from siltworks.operators.exploding import explode_once
from siltworks.operators.literals import literal_table
from siltworks.operators.keyed import first_n_per_key, mark_orphans, mark_repeated

HITS = "_dq_hits"
INVALID = "_dq_invalid"
WARNINGS = "_dq_warnings"
_HIT_TYPE = "array<struct<rule_id:int,kind:string,rejects:boolean,sample:string>>"


def rules_from_catalog(dq_rules: DataFrame, dataset_id: str) -> list[Rule]:
    """The active rules of one dataset, in catalog order (a handful of rows: one dataset's columns)."""
    rows = (
        dq_rules.where((F.col("dataset_id") == dataset_id) & F.col("is_active"))
        .orderBy("created_at", "id")
        .select("column_name", "expected_data_type", "dq_rule", "severity", "rule_value")
        .collect()
    )
    return [Rule(r[0], r[1], r[2], r[3], r[4]) for r in rows]


def flag(df: DataFrame, rules: Sequence[Rule], parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """`df` with its columns cast by the rules, plus `_dq_invalid`, `_dq_warnings` and `_dq_hits` (every rule a row breaks).

    All row rules compile into one projection.  A UNIQUE or REFERENTIAL rule adds one aggregate of its key column, taken
    from the input whatever rules stand before it, and one join.  An incomplete rule (no severity, say) is not enforced.  A cast failure is recorded once per
    rule row, and a later rule on a column sees the value the earlier one left.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    data = list(df.columns)
    original = {c: F.col(f"`{c}`") for c in data}
    current, ctype = dict(original), dict(types)
    hits, relational = [], []
    active = [(i, r) for i, r in enumerate(rules) if r.is_active and r.complete]
    for rule_id, rule in active:
        if rule.column not in current:
            current[rule.column], ctype[rule.column] = F.lit(None), T.NullType()
            original[rule.column] = F.lit(None)
        raw = original[rule.column]
        cast, ctype[rule.column] = coerce(current[rule.column], ctype[rule.column], rule.expected_type)
        current[rule.column] = cast
        sample = raw.cast("string")
        if rule.column in types and not isinstance(types[rule.column], type(ctype[rule.column])):
            hits.append((raw.isNotNull() & cast.isNull(), rule_id, rule.rejects, "CAST_FAIL", sample))
        if rule.rule == "UNIQUE":
            flag_col = f"_dq_u{rule_id}"
            relational.append((rule, cast, ctype[rule.column], flag_col))
            hits.append((F.col(flag_col), rule_id, rule.rejects, rule.rule, sample))
        elif rule.rule == "REFERENTIAL":
            if parents and rule.value in parents:
                flag_col = f"_dq_r{rule_id}"
                relational.append((rule, cast, ctype[rule.column], flag_col))
                hits.append((F.col(flag_col), rule_id, rule.rejects, rule.rule, sample))
        else:
            mask = row_mask(rule.rule, cast, ctype[rule.column], rule.value)
            if mask is not None:
                hits.append((mask, rule_id, rule.rejects, rule.rule, sample))
    out = df
    for rule, key, dtype, flag_col in relational:
        if rule.rule == "UNIQUE":
            out = mark_repeated(out, key, flag_col, isinstance(dtype, T.StringType), source=df)
        else:
            out = mark_orphans(out, key, parents[rule.value], rule.value.rsplit(".", 1)[-1], flag_col, source=df)
    # all three come from the same masks; flat expressions keep them inside generated code
    rejecting = [m for m, _, r, _, _ in hits if r]
    invalid = reduce(lambda a, b: a | b, rejecting) if rejecting else F.lit(False)
    warnings = sum((m.cast("int") for m, _, r, _, _ in hits if not r), F.lit(0))
    empty = F.array().cast(_HIT_TYPE)
    one_each = [F.when(m, F.array(_hit(i, k, r, s)).cast(_HIT_TYPE)).otherwise(empty) for m, i, r, k, s in hits]
    hit_array = F.flatten(F.array(*one_each)) if hits else empty
    return out.select(
        *[current[c].alias(c) for c in current], hit_array.alias(HITS), invalid.alias(INVALID), warnings.cast("int").alias(WARNINGS)
    )


def _hit(rule_id: int, kind: str, rejects: bool, sample):
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(kind).alias("kind"), F.lit(rejects).alias("rejects"), sample.alias("sample")
    )


def valid_rows(flagged: DataFrame) -> DataFrame:
    return flagged.where(~F.col(INVALID)).drop(HITS, INVALID, WARNINGS)


def rejected_rows(flagged: DataFrame) -> DataFrame:
    """Invalid rows whole, with the names of the rules that rejected them."""
    names = F.transform(F.filter(HITS, lambda h: h["rejects"]), lambda h: h["kind"])
    return flagged.where(F.col(INVALID)).withColumn("_dq_failed", F.array_distinct(names)).drop(HITS, INVALID, WARNINGS)


def split_counts(flagged: DataFrame) -> DataFrame:
    """One row: rows_read, failed_rows, valid_rows, warnings."""
    return flagged.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col(INVALID)).alias("failed_rows"),
        F.count_if(~F.col(INVALID)).alias("valid_rows"),
        F.coalesce(F.sum(WARNINGS), F.lit(0)).cast("bigint").alias("warnings"),
    )


def details(flagged: DataFrame, rules: Sequence[Rule], samples: int = 5) -> DataFrame:
    """(bucket, rule_id, column, rule, expected, count, samples): what each rule caught.

    Counts are plain sums per rule; no text crosses a shuffle for them.  The samples are the smallest texts, of which
    every task keeps as many as are wanted before anything moves.
    """
    keys = ["rule_id", "kind", "rejects"]
    long = explode_once(flagged, [], F.col(HITS), "h").select("h.*")
    counts = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    top = first_n_per_key(long, keys, [F.asc_nulls_last("sample")], samples, "_rn")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("_rn", "sample"))), lambda x: x["sample"])
    picked = top.groupBy(*keys).agg(F.filter(texts, lambda t: t.isNotNull()).alias("samples"))
    spark = flagged.sparkSession
    names = literal_table(
        spark, [(i, r.column, r.expected_type) for i, r in enumerate(rules)], "rule_id int, column string, expected string"
    )
    # counts, picked and names have one row per rule: the rule list bounds all three
    return (
        counts.join(F.broadcast(picked), keys, "left")
        .join(F.broadcast(names), "rule_id")
        .select(
            F.when(F.col("rejects"), "violations").otherwise("warnings").alias("bucket"),
            "rule_id",
            "column",
            F.col("kind").alias("rule"),
            F.when(F.col("kind") == "CAST_FAIL", F.col("expected")).alias("expected"),
            "count",
            F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        )
    )
