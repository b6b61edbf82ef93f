"""Coercing casts: a value that does not fit the expected type becomes null, the job never aborts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPECTED_TYPES = ("STRING", "INTEGER", "FLOAT", "BOOLEAN", "DATE", "TIMESTAMP")

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
_INTEGRAL = r"^\s*[+-]?[0-9]+\s*$"


def to_float(c: Column, source: T.DataType) -> Column:
    """Numbers as text may be padded, signed, exponential or infinite; `1d`, `0x1A`, `1,000` and NaN are refused."""
    if isinstance(source, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    if isinstance(source, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if not isinstance(source, T.StringType):
        return F.lit(None).cast("double")
    return F.when(c.rlike(_NUMBER) | c.rlike(_INFINITE), F.trim(c).try_cast("double"))


def to_integer(c: Column, source: T.DataType) -> Column:
    """A whole number in any numeric spelling; a fraction is a cast failure."""
    if isinstance(source, T.IntegralType):
        return c.cast("bigint")
    d = to_float(c, source)
    from_double = F.when(d == F.floor(d), d.try_cast("bigint"))
    if isinstance(source, T.StringType):
        # plain digits are never read through a double, which would round them: what a bigint cannot hold is a failure
        return F.when(c.rlike(_INTEGRAL), F.trim(c).try_cast("bigint")).otherwise(from_double)
    return from_double


def to_boolean(c: Column, source: T.DataType) -> Column:
    if isinstance(source, T.BooleanType):
        return c
    text = F.lower(c.cast("string"))
    return F.when(text == "true", True).when(text == "false", False)


def to_timestamp(c: Column, source: T.DataType) -> Column:
    if isinstance(source, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(source, T.DateType):
        return c.cast("timestamp_ntz")
    if not isinstance(source, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    # a bare number is not a date, although Spark would read `2024` as one
    return F.when(c.rlike(r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), F.trim(c).try_cast("timestamp_ntz"))


def to_text(c: Column, source: T.DataType) -> Column:
    return c.cast("string")


_CASTS = {
    "STRING": (to_text, T.StringType()),
    "INTEGER": (to_integer, T.LongType()),
    "FLOAT": (to_float, T.DoubleType()),
    "BOOLEAN": (to_boolean, T.BooleanType()),
    "DATE": (to_timestamp, T.TimestampNTZType()),
    "TIMESTAMP": (to_timestamp, T.TimestampNTZType()),
}


def coerce(c: Column, source: T.DataType, expected: str) -> tuple[Column, T.DataType]:
    """Cast `c` to an expected type name; returns the column and its Spark type."""
    fn, target = _CASTS[expected]
    if isinstance(source, T.NullType):
        return F.lit(None).cast(target), target
    if fn is to_timestamp and isinstance(source, T.TimestampType):
        target = source
    return fn(c, source), target


def as_number(c: Column, source: T.DataType) -> Column:
    """The numeric reading a bound check uses, whatever type the column was cast to (a cast leaves no NaN)."""
    return c if isinstance(source, T.DoubleType) else to_float(c, source)


def finite_or_null(c: Column) -> Column:
    """NaN and the infinities become null (for output formats that cannot hold them)."""
    return F.when(F.isnan(c) | F.abs(c).isin(float("inf")), None).otherwise(c)
