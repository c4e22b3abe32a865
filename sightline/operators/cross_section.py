"""Cross-sectional operators: statistics of one session's reference members.

Column forms use a window over the session. DataFrame forms aggregate first (partially, on the map side) and join one row of
statistics a session, so a session of any size is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import PANEL, PanelSpec

#: A section whose standard deviation isn't above this has no z-scores.
EPSILON = 1e-12


def _of(spec: PanelSpec, group: tuple[str, ...]) -> list[str]:
    return [spec.session, *group]


def zscore_column(x: Column, member: Column, *, group: tuple[str, ...] = (), ddof: int = 0, spec: PanelSpec = PANEL) -> Column:
    w = spec.across(*group)
    mx = F.when(member, x)
    std = (F.stddev_samp(mx) if ddof else F.stddev_pop(mx)).over(w)
    return F.when(member & (std > EPSILON), (x - F.avg(mx).over(w)) / std)


def zscore(df: DataFrame, x: str, member: str, out: str, *, group: tuple[str, ...] = (), ddof: int = 0, spec: PanelSpec = PANEL) -> DataFrame:
    """Adds (x - mean) / std over members with a value; null for others and in a constant section."""
    mx = F.when(F.col(member), F.col(x))
    stats = df.groupBy(*_of(spec, group)).agg(F.avg(mx).alias("__mean"), (F.stddev_samp(mx) if ddof else F.stddev_pop(mx)).alias("__std"))
    both = df.join(stats, _of(spec, group), "left")
    return both.withColumn(out, F.when(F.col(member) & (F.col("__std") > EPSILON), (F.col(x) - F.col("__mean")) / F.col("__std"))).drop("__mean", "__std")


def average_rank(x: Column, by: list[str]) -> Column:
    """Rank of x among the rows with the same `by`, ties at their average; x must not be null there."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0)


def rank_column(x: Column, member: Column, *, group: tuple[str, ...] = (), spec: PanelSpec = PANEL) -> Column:
    """Percentile of x among members with a value, ties at their average: (rank) / count."""
    inside = member & x.isNotNull()
    keys = [*_of(spec, group), inside]
    return F.when(inside, average_rank(x, keys) / F.count(x).over(Window.partitionBy(*keys)))


def winsorize(df: DataFrame, x: str, member: str, out: str, low: float = 0.01, high: float = 0.99, spec: PanelSpec = PANEL) -> DataFrame:
    """Adds x held between its members' quantiles (linear between values); null for others."""
    mx = F.when(F.col(member), F.col(x))
    stats = df.groupBy(spec.session).agg(F.percentile(mx, [low, high]).alias("__q"))
    both = df.join(stats, spec.session, "left")
    held = F.greatest(F.col("__q")[0], F.least(F.col("__q")[1], F.col(x)))
    return both.withColumn(out, F.when(F.col(member) & F.col(x).isNotNull(), held)).drop("__q")
