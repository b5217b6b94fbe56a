"""Null-safe, exact-to-the-edge expressions: every function returns a ``Column``."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE_SPACE = r"(?U)^\s+|\s+$"


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality (NaN equals NaN)."""
    return ~a.eqNullSafe(b)


def holds(e: Column) -> Column:
    """A predicate with unknown read as false."""
    return F.coalesce(e, F.lit(False))


def fails(e: Column) -> Column:
    return ~holds(e)


def safe_ratio(num: Column, den: Column) -> Column:
    """NULL where the denominator is 0 or NULL."""
    return F.try_divide(num.cast("double"), den)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes only U+0020)."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def blank_to_null(c: Column) -> Column:
    """NULL where only white space is left; else the value as it is."""
    return F.when(strip(c) != "", c)


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    return reduce(or_, [c.startswith(p) for p in prefixes])


def normalize_phone(c: Column) -> Column:
    """Trim; blank and "nan" are NULL; drop one leading +, a float's .0 tail, and two or more leading zeros of a number of digits."""
    t = strip(c)
    t = F.when((t != "") & (F.lower(t) != "nan"), t)
    t = F.regexp_replace(t, r"^\+", "")
    t = F.regexp_replace(t, r"^(\d+)\.0+\z", "$1")
    t = F.when(t.rlike(r"^00\d*\z"), F.regexp_replace(t, "^0+", "")).otherwise(t)
    return F.when(t != "", t)


def strict_long(c: Column) -> Column:
    """Text to long; raises on anything but an optional sign and digits."""
    return F.when(c.rlike(r"^[+-]?[0-9]+\z"), c.cast("long")).when(c.isNotNull(), F.raise_error(F.lit("not a whole number")).cast("long"))


def strict_timestamp(c: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text to a UTC timestamp; raises on anything else (needs ANSI mode, Spark's default)."""
    return F.to_timestamp(c, pattern)


def days_between(start: Column, end: Column) -> Column:
    """Inclusive days as ISO text."""
    return F.transform(F.sequence(start, end), lambda d: F.date_format(d, "yyyy-MM-dd"))


def as_text(c: Column, null: str = "<null>") -> Column:
    return F.coalesce(c.cast("string"), F.lit(null))


def matches(c: Column, pattern: str) -> Column:
    """Regex match from the start; a final ``$`` means the very end."""
    if pattern.endswith("$") and not pattern.endswith(r"\$"):
        pattern = pattern[:-1] + r"\z"
    return c.rlike(rf"\A(?:{pattern})")
