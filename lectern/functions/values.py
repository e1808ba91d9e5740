"""Numbers and dates as listings show them, and values that are worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(x: Column, low: Column, high: Column) -> Column:
    """x, or the bound that it lies beyond."""
    return F.greatest(low, F.least(high, x))


def whole_part(x: Column) -> Column:
    """The nearest whole number, halves upwards, and 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(x + 0.5).cast("long"))


def seconds(millis: Column) -> Column:
    """Whole seconds of a time in milliseconds; those before 1970 are rounded down as well."""
    return F.floor(millis / 1000).cast("long")


def long_date(at: Column) -> Column:
    """A date like 'March 5, 2024'."""
    return F.date_format(at, "MMMM d, yyyy")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once for a row however often `then` names it; an expression would be each time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
