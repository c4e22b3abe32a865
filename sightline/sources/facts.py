"""Point-in-time reads of daily facts, membership and events, and the sinks for panels."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.asof import latest_revision
from ..operators.panel import PANEL, ingress

#: Names of snapshots that don't pin anything.
MUTABLE_SNAPSHOTS = ("", "current", "latest")

FACTS = T.StructType([
    T.StructField("security_id", T.StringType()), T.StructField("session", T.DateType()), T.StructField("field", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("usable_from", T.TimestampType()), T.StructField("revision_id", T.StringType()), T.StructField("missing_reason", T.StringType()),
])


class SourceError(ValueError):
    """A query that can't be answered as asked."""


def pinned(snapshot: str) -> str:
    """The snapshot's name, if it names one for good."""
    if snapshot.strip().lower() in MUTABLE_SNAPSHOTS or not re.fullmatch(r"[\w.:@/-]+", snapshot):
        raise SourceError(f"snapshot {snapshot!r} isn't pinned")
    return snapshot


@dataclass(frozen=True)
class FactQuery:
    """Fields of securities in a range of sessions, as known at each session's cutoff."""

    fields: tuple[str, ...]
    start: str
    end: str
    securities: tuple[str, ...] | None = None
    cutoff: str = "cutoff"
    lookback: int = 0
    extra: dict = field(default_factory=dict)


def read_facts(spark: SparkSession, root: str, snapshot: str) -> DataFrame:
    """The bitemporal facts of a snapshot: a row a cell version, partitioned by session on disk."""
    return spark.read.schema(FACTS).parquet(f"{root}/{pinned(snapshot)}")


def select_facts(facts: DataFrame, query: FactQuery, cutoffs: DataFrame) -> DataFrame:
    """security_id, session and per field <field>, <field>__at, <field>__missing_reason: each cell's latest version visible at its session's cutoff.

    cutoffs: session, cutoff (one row a session, the small side). Filters on session, field and security reach the scan.
    """
    wanted = facts.filter(F.col("session").between(query.start, query.end) & F.col("field").isin(*query.fields))
    if query.securities is not None:
        wanted = wanted.filter(F.col("security_id").isin(*query.securities))
    timed = wanted.join(F.broadcast(cutoffs.select("session", "cutoff")), "session").filter(F.col("usable_from") <= F.col("cutoff"))
    cells = latest_revision(timed.drop("cutoff"), ["security_id", "session", "field"])
    pick = lambda c, f: F.max(F.when(F.col("field") == f, F.col(c)))
    columns = [x for f in query.fields for x in (pick("value", f).alias(f), pick("usable_from", f).alias(f"{f}__at"), pick("missing_reason", f).alias(f"{f}__missing_reason"))]
    return ingress(cells.groupBy(*PANEL.keys).agg(*columns))


def members(intervals: DataFrame, days: DataFrame) -> DataFrame:
    """security_id, session, member from intervals (security_id, valid_from, valid_to or null); sessions are the small side."""
    inside = (F.col("session") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("session") < F.col("valid_to")))
    return intervals.join(F.broadcast(days.select("session")), inside).select("security_id", "session", F.lit(True).alias("member")).distinct()


def select_events(events: DataFrame, start: str, end: str, cutoff: str, fields: tuple[str, ...], securities: tuple[str, ...] | None = None, filters: dict | None = None) -> DataFrame:
    """Events with a report period in the range that were usable at the cutoff, filtered by equality on other columns."""
    out = events.filter(F.col("report_period").between(start, end) & (F.col("usable_from") <= F.to_timestamp(F.lit(cutoff))))
    for k, v in (filters or {}).items():
        out = out.filter(F.col(k) == v)
    if securities is not None:
        out = out.filter(F.col("security_id").isin(*securities))
    return out.select("security_id", "report_period", "usable_from", "revision_id", *fields)


def read_view(spark: SparkSession, path: str, fields: list[str], start: str, end: str, symbols: list[str] | None = None, universe: DataFrame | None = None) -> DataFrame:
    """Fields of an exported view; either symbols or a universe, and a range inside the view's calendar."""
    if (symbols is None) == (universe is None):
        raise SourceError("give either symbols or a universe")
    view = spark.read.parquet(path)
    low, high = view.agg(F.min("session").cast("string"), F.max("session").cast("string")).first()
    if low is None or start < low or end > high:
        raise SourceError(f"{start} to {end} leaves the exported calendar, {low} to {high}")
    rows = view.filter(F.col("session").between(start, end)).select(*PANEL.keys, *fields)
    return rows.filter(F.col("security_id").isin(*symbols)) if symbols is not None else rows.join(universe.select("security_id").distinct(), "security_id", "left_semi")


def export_view(facts: DataFrame, path: str, fields: list[str], universe: DataFrame | None = None) -> None:
    """Writes fields of a panel as a view that read_view() reads, one folder a session; with a universe only its securities."""
    rows = facts.select(*PANEL.keys, *fields)
    write_panel(rows if universe is None else rows.join(universe.select("security_id").distinct(), "security_id", "left_semi"), path)


def write_panel(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder a session; rows of a session are brought together first, so each folder has few files."""
    df.repartition(F.col("session")).sortWithinPartitions("session", "security_id").write.mode(mode).partitionBy("session").parquet(path)


def read_panel(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col("session") >= F.lit(start).cast("date"))
    return df if end is None else df.filter(F.col("session") <= F.lit(end).cast("date"))


def write_sessions_as_json(df: DataFrame, path: str) -> None:
    df.repartition(F.col("session")).write.mode("errorifexists").partitionBy("session").json(path)
