"""Lenient readings of text values and name aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")
SOURCE_TYPES = {
    "S3": "AWS", "AWS": "AWS", "ADLS": "AZURE", "AZURE": "AZURE", "API": "REST_API", "REST": "REST_API",
    "REST_API": "REST_API", "FABRIC": "FABRIC", "MICROSOFT_FABRIC": "FABRIC", "LOCAL": "LOCAL",
}
PLATFORMS = {
    "FABRIC": "FABRIC", "MICROSOFT_FABRIC": "FABRIC", "MSFABRIC": "FABRIC", "DATABRICKS": "DATABRICKS",
    "AWS": "AWS", "AMAZON": "AWS", "AZURE": "AZURE", "MICROSOFT": "AZURE",
}
FORMATS = {"text": "txt", "delimitedtext": "csv"}


def _alias(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def boolean(c: Column) -> Column:
    w = F.lower(F.trim(c))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


def active_flag(c: Column) -> Column:
    """Like `boolean`, but anything unclear is inactive."""
    return F.coalesce(boolean(c), F.lit(False))


def integer(c: Column) -> Column:
    digits = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(digits.rlike(r"^-?[0-9]+$"), digits.try_cast("bigint"))


def floating(c: Column) -> Column:
    digits = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(digits.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), digits.try_cast("double"))


def source_type(c: Column) -> Column:
    """Canonical source type; an unknown one stays as it is in upper case, a blank one is null."""
    raw = F.nullif(F.upper(F.trim(c)), F.lit(""))
    return F.coalesce(_alias(raw, SOURCE_TYPES), raw)


def platform(c: Column) -> Column:
    return _alias(F.upper(F.trim(c)), PLATFORMS)


def file_format(c: Column) -> Column:
    raw = F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(_alias(raw, FORMATS), raw)


def iso_timestamp(c: Column) -> Column:
    """ISO date-times with a zone, without one (UTC), with any number of fraction digits, or a bare date."""
    raw = F.trim(c)
    cut = F.regexp_replace(raw, r"(\.[0-9]{6})[0-9]+", "$1")
    has_zone = cut.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$")
    zoned = F.when(has_zone, cut).otherwise(F.concat(cut, F.when(cut.rlike(r"^[0-9-]{10}$"), "T00:00:00Z").otherwise("Z")))
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
    return F.when(cut.rlike(shape), zoned.try_cast("timestamp"))


def mask_secret(c: Column) -> Column:
    """Stars for all but the last four characters."""
    n = F.length(c)
    return F.concat(F.repeat(F.lit("*"), F.greatest(n - 4, F.lit(0))), F.right(c, F.lit(4)))
