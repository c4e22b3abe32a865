"""Time-series operators: windows along one security's sessions on the complete grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import divide
from .panel import PANEL, PanelSpec


def shift(x: Column, periods: int, spec: PanelSpec = PANEL) -> Column:
    return (F.lag(x, periods) if periods >= 0 else F.lead(x, -periods)).over(spec.along())


def pct_change(x: Column, periods: int, spec: PanelSpec = PANEL) -> Column:
    """x over its value periods sessions ago, less 1; gaps between don't matter, a zero base gives null."""
    return divide(x, shift(x, periods, spec)) - 1


def frame(window: int, inclusive: bool = True, spec: PanelSpec = PANEL):
    return spec.along().rowsBetween(-(window - 1), 0) if inclusive else spec.along().rowsBetween(-window, -1)


def _median(x, f):
    v = F.sort_array(F.collect_list(x).over(f))
    n = F.size(v)
    at = lambda i: F.get(v, F.floor(i).cast("int"))
    return (at((n - 1) / 2) + at(n / 2)) / 2


def _rank(x, f):
    """Percentile of the current value in its window, ties at their average rank."""
    v = F.collect_list(x).over(f)
    less = F.size(F.filter(v, lambda e: e < x))
    same = F.size(F.filter(v, lambda e: e == x))
    return (less + (same + 1) / F.lit(2.0)) / F.size(v)


REDUCTIONS = {
    "mean": lambda x, f, ddof: F.avg(x).over(f),
    "sum": lambda x, f, ddof: F.sum(x).over(f),
    "min": lambda x, f, ddof: F.min(x).over(f),
    "max": lambda x, f, ddof: F.max(x).over(f),
    "std": lambda x, f, ddof: (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(f),
    "median": lambda x, f, ddof: _median(x, f),
    "rank": lambda x, f, ddof: _rank(x, f),
}


def rolling(x: Column, window: int, reduction: str, *, min_periods: int | None = None, inclusive: bool = True, ddof: int = 1, spec: PanelSpec = PANEL) -> Column:
    """A reduction of the last `window` sessions; null unless min_periods (by default all) of them have a value."""
    f = frame(window, inclusive, spec)
    return F.when(F.count(x).over(f) >= (min_periods or window), REDUCTIONS[reduction](x, f, ddof))


def full_window(value: Column, guard: Column, window: int, spec: PanelSpec = PANEL) -> Column:
    """value where each of the last `window` sessions has a guard value."""
    return F.when(F.count(guard).over(frame(window, spec=spec)) == window, value)
