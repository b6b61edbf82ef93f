"""Rule builders: each turns (column, argument) into a boolean Column that marks violating rows.

UNIQUE and REFERENTIAL need other rows and are planned in ``operators.dq``; every rule here looks at one row.
Further row rules are added with ``register_rule``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.casts import as_number

SEVERITIES = ("INFO", "WARN", "ERROR", "BLOCK")
REJECTING = ("ERROR", "BLOCK")
BUILTIN_RULES = ("NOT_NULL", "UNIQUE", "RANGE", "REGEX", "REFERENTIAL", "CUSTOM")


@dataclass(frozen=True)
class Rule:
    """One catalogued rule of one column."""

    column: str
    expected_type: str | None
    rule: str | None
    severity: str | None
    value: str | None = None
    is_active: bool = True

    @property
    def complete(self) -> bool:
        return self.expected_type is not None and self.rule is not None and self.severity is not None

    @property
    def rejects(self) -> bool:
        return self.severity in REJECTING


RowRule = Callable[[Column, T.DataType, "str | None"], "Column | None"]
_ROW_RULES: dict[str, RowRule] = {}
_CUSTOM_RULES: dict[str, RowRule] = {}


def register_rule(name: str, fn: RowRule, custom: bool = False) -> None:
    """Add a row rule (or, with ``custom``, a ``KEY=value`` keyword of the CUSTOM rule); a taken name is an error."""
    table = _CUSTOM_RULES if custom else _ROW_RULES
    if name in table:
        raise ValueError(f"rule {name!r} is already registered")
    table[name] = fn


def unregister_rule(name: str, custom: bool = False) -> None:
    (_CUSTOM_RULES if custom else _ROW_RULES).pop(name, None)


def known_rules() -> tuple[str, ...]:
    return tuple(dict.fromkeys(BUILTIN_RULES + tuple(_ROW_RULES)))


def row_mask(rule: str, c: Column, source: T.DataType, value: str | None) -> Column | None:
    """The violation mask, or None where the rule has nothing to say (unknown name, incomplete argument)."""
    fn = _ROW_RULES.get(rule)
    mask = fn(c, source, value) if fn else None
    return None if mask is None else F.coalesce(mask, F.lit(False))


def _not_null(c, source, value):
    return c.isNull() | (F.trim(c.cast("string")) == "")


def parse_range(value: str | None) -> tuple[float | None, float | None]:
    parts = (value or "").split(":")
    if len(parts) != 2:
        return None, None
    return tuple(float(p) if p else None for p in parts)


def _range(c, source, value):
    low, high = parse_range(value)
    d = as_number(c, source)
    masks = [m for m in (None if low is None else d < low, None if high is None else d > high) if m is not None]
    if not masks:
        return None
    return masks[0] if len(masks) == 1 else masks[0] | masks[1]


def _regex(c, source, value):
    # anchored at the start only; a null has nothing to match and passes
    return ~c.cast("string").rlike(f"^(?:{value})") if value else None


def _custom(c, source, value):
    key, eq, arg = (value or "").partition("=")
    fn = _CUSTOM_RULES.get(key.upper()) if eq else None
    return fn(c, source, arg) if fn else None


def _allowed_values(c, source, value):
    return ~c.cast("string").isin([v.strip() for v in value.split(",")])


def _negative_check(c, source, value):
    return as_number(c, source) < 0 if value.strip().lower() == "true" else None


def _valid_json(c, source, value):
    return c.isNotNull() & F.try_parse_json(c.cast("string")).isNull()


register_rule("NOT_NULL", _not_null)
register_rule("RANGE", _range)
register_rule("REGEX", _regex)
register_rule("CUSTOM", _custom)
register_rule("VALID_JSON", _valid_json)
register_rule("ALLOWED_VALUES", _allowed_values, custom=True)
register_rule("NEGATIVE_CHECK", _negative_check, custom=True)
