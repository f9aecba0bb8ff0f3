"""Column expressions on metric samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def finite(value: Column) -> Column:
    """Whether the number is there: null, NaN and the infinities are missing samples."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def step_start(us: Column, step_s: int) -> Column:
    """Start of the step of a regular grid that holds the instant, in epoch microseconds."""
    step = step_s * MICROS
    return us - F.pmod(us, F.lit(step))


def series_key(labels: Column) -> Column:
    """Text that is equal for equal label maps, whatever the order of their entries."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def whole_match(value: Column, pattern: str) -> Column:
    """Whether the pattern matches the whole string."""
    return value.rlike(f"^(?:{pattern})$")


def percent(usage: Column, limit: Column) -> Column:
    """Usage as percent of the limit; null for a zero or missing limit."""
    return F.try_divide(usage, limit) * F.lit(100.0)
