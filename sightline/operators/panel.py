"""Panels: rows keyed by security and session on a complete grid, where a row lag is a session lag."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import finite, iso_week, iso_year


class PanelError(ValueError):
    """A panel that breaks its contract: repeated keys, missing grid rows, overlapping folds, changed members."""


@dataclass(frozen=True)
class PanelSpec:
    """Names of a panel's keys and of the calendar position that orders it."""

    security: str = "security_id"
    session: str = "session"
    position: str = "pos"

    @property
    def keys(self) -> list[str]:
        return [self.security, self.session]

    def along(self) -> WindowSpec:
        """One security in calendar order."""
        return Window.partitionBy(self.security).orderBy(self.position)

    def across(self, *more: str) -> WindowSpec:
        """One session, or one group of it."""
        return Window.partitionBy(self.session, *more)


PANEL = PanelSpec()


def ingress(df: DataFrame) -> DataFrame:
    """Doubles and floats without NaN and infinities."""
    return df.select(*(finite(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def calendar(facts: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """session, pos (1, 2, ...) of all sessions that facts have; as many rows as sessions, so one task orders them."""
    days = facts.select(spec.session).distinct()
    return days.select(spec.session, F.row_number().over(Window.orderBy(spec.session)).cast("long").alias(spec.position))


def grid(facts: DataFrame, days: DataFrame, universe: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Every security in every session; facts that are missing are null, never left out.

    The calendar is the small side of the product and is broadcast: it has one row a session.
    """
    keys = universe.select(spec.security).distinct().crossJoin(F.broadcast(days))
    return keys.join(facts, spec.keys, "left")


def grid_reasons(df: DataFrame, fields: list[str]) -> DataFrame:
    """Adds <field>__missing_reason, `grid_hole` where the grid had no fact."""
    return df.select("*", *(F.when(F.col(f).isNull(), F.lit("grid_hole")).alias(f"{f}__missing_reason") for f in fields))


def repeated_keys(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or PANEL.keys)).count().filter("count > 1")


def require_unique(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """df, or an error if a key repeats."""
    found = repeated_keys(df, keys).head(1)
    if found:
        raise PanelError(f"repeated key {found[0].asDict()}")
    return df


def require_same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """An error unless both have exactly the same keys, as often."""
    for x, y, what in ((a, b, "only left"), (b, a, "only right")):
        found = x.select(*keys).exceptAll(y.select(*keys)).head(1)
        if found:
            raise PanelError(f"{what}: {found[0].asDict()}")


def join_one_to_one(a: DataFrame, b: DataFrame, keys: list[str] | None = None, check: bool = True) -> DataFrame:
    """Inner join of two tables that have the same unique keys."""
    keys = keys or PANEL.keys
    if check:
        require_unique(a, keys)
        require_unique(b, keys)
        require_same_keys(a, b, keys)
    return a.join(b, keys)


def merge_domains(parts: dict[str, DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Domains on the same grid side by side, their fields prefixed by alias__."""
    keys = keys or PANEL.keys
    out = None
    for alias, df in parts.items():
        named = df.select(*keys, *(F.col(c).alias(f"{alias}__{c}") for c in df.columns if c not in keys))
        out = named if out is None else out.join(named, keys)
    return out


def first_of_iso_week(days: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """The first session of each ISO week that has one."""
    day = F.col(spec.session)
    return days.groupBy(iso_year(day).alias("iso_year"), iso_week(day).alias("iso_week")).agg(F.min(day).alias(spec.session))


def previous_session(days: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Adds prediction_session: the calendar's strict predecessor."""
    return days.withColumn("prediction_session", F.lag(spec.session).over(Window.orderBy(spec.session)))


def in_universe(df: DataFrame, universe: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    return df.join(universe.select(spec.security).distinct(), spec.security, "left_semi")


def missing_keys(expected: DataFrame, actual: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Keys of the expected grid that the table doesn't have."""
    return expected.select(*spec.keys).join(actual, spec.keys, "left_anti")


def probe_calendar(states: DataFrame, sessions: DataFrame, first: str, last: str, open_states: tuple[str, ...] = ("open",)) -> DataFrame:
    """Civil days from first to last whose market state contradicts the sessions: unprobed, open but no session, or the reverse."""
    spark = sessions.sparkSession
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS session")
    known = days.join(states.select("session", "state"), "session", "left").join(sessions.select("session", F.lit(True).alias("supplied")), "session", "left")
    is_open = F.col("state").isin(*open_states)
    problem = F.when(F.col("state").isNull(), "unprobed").when(is_open & F.col("supplied").isNull(), "open_without_session").when(~is_open & F.col("supplied"), "session_while_closed")
    return known.select("session", problem.alias("problem")).filter("problem is not null")


def concatenate(parts: list[DataFrame], spec: PanelSpec = PANEL) -> DataFrame:
    """Parts of a signal one after the other; an error where their dates overlap or run backwards."""
    last = None
    for df in parts:
        low, high = df.agg(F.min(spec.session), F.max(spec.session)).first()
        if last is not None and low is not None and low <= last:
            raise PanelError(f"sessions from {low} on overlap those up to {last}")
        last = high if high is not None else last
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def membership_conflicts(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Keys to which signals give different membership."""
    return df.groupBy(*spec.keys).agg(F.count_distinct("member").alias("n")).filter("n > 1").select(*spec.keys)


def coalesce_ranges(df: DataFrame, by: list[str], start: str, end: str, step_days: int = 1) -> DataFrame:
    """Date ranges (both ends in) merged where they overlap or adjoin: gaps and islands in one window."""
    order = Window.partitionBy(*by).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col(start) <= F.date_add(F.max(end).over(before), step_days), 0).otherwise(1)
    marked = df.withColumn("__opens", opens).withColumn("__island", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def in_ranges(df: DataFrame, ranges: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Rows whose position lies in some [start, stop). Ranges of a fold plan are few and are merged before."""
    hit = (F.col(spec.position) >= F.col("start")) & (F.col(spec.position) < F.col("stop"))
    return df.join(ranges.select("start", "stop"), hit, "left_semi")
