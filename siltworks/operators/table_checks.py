"""Checks on a whole table, each one observed value and a verdict.

All checks that plain aggregates can answer share one pass.  Distinct counts, duplicates and references each add a
grouped pass over their own column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.keyed import key_counts
from siltworks.operators.literals import literal_table


@dataclass(frozen=True)
class Check:
    """`observed` must lie in [low, high]; an open side is None."""

    name: str
    kind: str
    columns: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    args: dict = field(default_factory=dict)


def _failing(check: Check) -> Column:
    c = F.col(check.columns[0]) if check.columns else None
    a = check.args
    if check.kind == "values_null":
        return c.isNull()
    if check.kind == "values_between":
        return ~c.between(a["min"], a["max"])
    if check.kind == "values_in_set":
        return ~c.isin(list(a["values"]))
    if check.kind == "values_not_in_set":
        return c.isin(list(a["values"]))
    if check.kind == "values_match":
        return ~c.cast("string").rlike(f"^(?:{a['pattern']})")
    if check.kind == "pair_unequal":
        return ~c.eqNullSafe(F.col(check.columns[1]))
    if check.kind == "sum_of_columns_off":
        return reduce(lambda x, y: x + y, [F.col(x) for x in check.columns]) != a["total"]
    raise ValueError(f"unknown check {check.kind!r}")


def _aggregate(check: Check) -> Column:
    c = F.col(check.columns[0]) if check.columns else None
    if check.kind == "row_count":
        return F.count(F.lit(1)).cast("double")
    if check.kind == "sum":
        return F.sum(c).cast("double")
    if check.kind == "mean":
        return F.avg(c)
    if check.kind == "stdev":
        return F.stddev_samp(c)
    if check.kind == "staleness_seconds":
        as_of = F.lit(check.args["as_of"]).cast("timestamp_ntz")
        return F.expr("1D") * F.timestamp_diff("SECOND", F.max(c), as_of)
    return F.count_if(F.coalesce(_failing(check), F.lit(False))).cast("double")


_GROUPED = ("distinct_count", "duplicate_rows", "orphan_rows")
_SCHEMA = ("column_order_differs", "type_differs")


def run_checks(df: DataFrame, checks: Sequence[Check], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(check_name, kind, observed, passed), one row per check."""
    parts = []
    scalar = [c for c in checks if c.kind not in _GROUPED + _SCHEMA]
    if scalar:
        row = df.agg(*[_aggregate(c).alias(f"v{i}") for i, c in enumerate(scalar)])
        pairs = ", ".join(f"{i}, v{i}" for i in range(len(scalar)))
        parts.append((scalar, row.selectExpr(f"stack({len(scalar)}, {pairs}) as (i, observed)")))
    for c in checks:
        if c.kind in _GROUPED:
            counts = key_counts(df, F.col(c.columns[0]))
            if c.kind == "distinct_count":
                value = counts.agg(F.count("_k").cast("double").alias("observed"))
            elif c.kind == "duplicate_rows":
                value = counts.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).cast("double").alias("observed"))
            else:
                ref = c.args["reference"]
                known = parents[ref].select(F.col(ref.rsplit(".", 1)[-1]).alias("_k")).distinct()
                lost = counts.where("_k is not null").join(known, "_k", "left_anti")
                value = lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("double").alias("observed"))
            parts.append(([c], value.select(F.lit(0).alias("i"), "observed")))
        elif c.kind in _SCHEMA:
            if c.kind == "column_order_differs":
                off = list(df.columns) != list(c.args["columns"])
            else:
                off = df.schema[c.columns[0]].dataType.simpleString() != c.args["type"]
            parts.append(([c], df.sparkSession.range(1).select(F.lit(0).alias("i"), F.lit(float(off)).alias("observed"))))
    out = []
    for group, values in parts:
        limits = literal_table(
            df.sparkSession,
            [(i, c.name, c.kind, _f(c.low), _f(c.high)) for i, c in enumerate(group)],
            "i int, check_name string, kind string, low double, high double",
        )
        out.append(values.join(F.broadcast(limits), "i"))
    every = reduce(lambda a, b: a.unionByName(b), out)
    ok = F.coalesce(F.col("observed") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("observed") <= F.col("high"), F.lit(True))
    return every.select("check_name", "kind", "observed", (F.col("observed").isNotNull() & ok).alias("passed"))


def _f(v):
    return None if v is None else float(v)
