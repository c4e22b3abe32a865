"""Saved column sources: a complete grid of facts as single-precision values with reason codes and clocks, published once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import PANEL, PanelError
from .documents import content_identity, publish, published, read_json
from .facts import pinned

#: Reason codes; 0 stands for a value that is there.
REASONS = ("grid_hole", "price_missing", "factor_missing", "suspended", "other")


def columns_of(facts: DataFrame, fields: list[str]) -> DataFrame:
    """security_id, session and per field its value in single precision, <field>__code (0 or the reason's place from 1) and <field>__at_us (microseconds, null if unknown).

    facts: fields as doubles, with <field>__missing_reason and <field>__at where there are such.
    """
    out = []
    for f in fields:
        value = F.col(f).cast("float")
        given = F.col(f"{f}__missing_reason") if f"{f}__missing_reason" in facts.columns else F.lit(None).cast("string")
        code = F.lit(len(REASONS))
        for i, reason in enumerate(REASONS[:-1]):
            code = F.when(F.coalesce(given, F.lit(REASONS[0])) == reason, i + 1).otherwise(code)
        at = F.unix_micros(F.col(f"{f}__at").cast("timestamp")) if f"{f}__at" in facts.columns else F.lit(None).cast("long")
        out += [value.alias(f), F.when(value.isNotNull(), 0).otherwise(code).cast("tinyint").alias(f"{f}__code"), F.when(value.isNotNull(), at).alias(f"{f}__at_us")]
    return facts.select(*PANEL.keys, *out)


def require_grid(facts: DataFrame) -> None:
    """An error unless every security has every session exactly once. Two small aggregations."""
    n, securities, sessions = facts.agg(F.count("*"), F.count_distinct("security_id"), F.count_distinct("session")).first()
    if n != securities * sessions or not facts.groupBy(*PANEL.keys).count().filter("count > 1").isEmpty():
        raise PanelError(f"{n} rows are no grid of {securities} securities and {sessions} sessions")


def build_column_source(spark: SparkSession, root: str, snapshot: str, facts: DataFrame, fields: list[str]) -> tuple[str, bool]:
    """Publishes columns_of() a complete grid, under snapshot, fields and content; returns its path and whether it was there already."""

    def build() -> DataFrame:
        require_grid(facts)
        return columns_of(facts, fields).repartitionByRange("session").sortWithinPartitions(*reversed(PANEL.keys))

    return publish(spark, root, {"kind": "columns", "snapshot": pinned(snapshot), "fields": fields, "content": content_identity(facts)}, build)


def load_column_source(spark: SparkSession, path: str, fields: list[str] | None = None, scan: bool = False) -> DataFrame:
    """Keys and per field the value as a double, <field>__missing_reason and <field>__at. Only the asked fields are read; one that the source hasn't is an error."""
    known = (read_json(spark, f"{path}/identity.json") or {}).get("fields", [])
    wanted = known if fields is None else fields
    if not set(wanted) <= set(known):
        raise PanelError(f"the source has {known}")
    table = published(spark, path, scan)
    reasons = F.array(*(F.lit(r) for r in REASONS))
    cells = [x for f in wanted for x in (F.col(f).cast("double").alias(f), F.get(reasons, F.col(f"{f}__code") - 1).alias(f"{f}__missing_reason"), F.timestamp_micros(f"{f}__at_us").alias(f"{f}__at"))]
    return table.select(*PANEL.keys, *cells)


def index_of(spark: SparkSession, root: str) -> DataFrame:
    """path, kind, snapshot of every table published below root: what there is to load."""
    from .documents import published_below

    rows = [(p, i.get("kind"), i.get("snapshot")) for p, i in published_below(spark, root)]
    return spark.createDataFrame(rows, "path string, kind string, snapshot string")
