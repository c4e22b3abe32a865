"""Pointwise operators as Column functions.

Null is the only missing value: it propagates through arithmetic and comparison, logic is three-valued, NaN and infinities
become null where data comes in, and a zero denominator gives null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x without NaN and infinities, which Spark's aggregates would take for values."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def where(condition: Column, a: Column, b: Column) -> Column:
    """a or b; null where the condition is null, unlike when().otherwise()."""
    return F.when(condition, a).when(~condition, b)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(x, F.lit(float(high)))))


def fill(x: Column, value: float) -> Column:
    return F.coalesce(x, F.lit(value))


def float32(x: Column) -> Column:
    """The nearest single-precision number, as a double."""
    return x.cast("float").cast("double")


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def visible(x: Column, available: Column, cutoff: Column, strict: bool = False) -> Column:
    """x if it was available at the cutoff. A value without a clock counts as available at the cutoff."""
    known = F.coalesce(available, cutoff)
    return F.when(known < cutoff if strict else known <= cutoff, x)


def first_reason(pairs: Iterable[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds, else null: precedence is the order of the pairs."""
    return F.coalesce(*(F.when(condition, F.lit(reason)) for reason, condition in pairs))


def ceil_second(clock: Column) -> Column:
    """An availability clock: a fraction of a second counts as the whole one."""
    micros = F.unix_micros(clock)
    return F.timestamp_micros(-F.floor(-micros / 1_000_000) * 1_000_000)


def floor_second(clock: Column) -> Column:
    """A cutoff clock."""
    return F.date_trunc("second", clock)


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day)


def iso_week(day: Column) -> Column:
    return F.extract(F.lit("WEEK"), day)


def calendar_age(session: Column, event: Column) -> Column:
    """Days since an event."""
    return F.datediff(session, event)


def frozen_transform(x: Column, center: Column, scale: Column, bound: float = 3.0) -> Column:
    """Preprocessing that was fitted elsewhere: (x - center) / scale, a scale of 0 as 1, clipped, missing as 0."""
    z = (x - center) / F.when(scale == 0, F.lit(1.0)).otherwise(scale)
    return fill(clip(z, -bound, bound), 0.0)


def unit(column: Column, name: str, unit_: str | None, stage: str | None = None) -> Column:
    """The column under a name, with its unit and stage as metadata."""
    return column.alias(name, metadata={k: v for k, v in (("unit", unit_), ("stage", stage)) if v is not None})
