"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def let(value: Column, body) -> Column:
    """body(value), where value is computed once, however often body names it: the optimiser may put a column's expression in every place that names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(value: Column, default: str = "") -> Column:
    """value unless it is null, empty or zero; else default. Numbers become text."""
    text = value.cast("string")
    return F.when(text.isNull() | text.isin("", "0", "0.0"), F.lit(default)).otherwise(text)


def text_filled(value: Column, default: str = "") -> Column:
    """A string unless it is null or empty; else default. The string "0" stays."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def joined(values: Column, separator: str = ", ") -> Column:
    """Elements in order; null elements join as empty strings, a null array as an empty one."""
    return F.coalesce(F.array_join(values, separator, ""), F.lit(""))


def matches_text(q: Column, name: Column, description: Column, verticals: Column) -> Column:
    """Whether q is empty or, ignoring case, a literal part of the name, the description or any vertical; q isn't trimmed."""
    q = F.lower(q)
    part = lambda text: F.contains(F.lower(F.coalesce(text, F.lit(""))), q)
    return (q == "") | part(name) | part(description) | F.coalesce(F.exists(verticals, lambda v: F.contains(F.lower(v), q)), F.lit(False))


def score_band(score: Column) -> Column:
    """A from 90, B from 80, C from 70, else D."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").otherwise("D")


def plural(n: Column, one: str, more: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(more))
