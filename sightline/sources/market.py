"""Panels over the star-schema tables: suppliers as securities, months as sessions, unit prices as prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import calendar, grid

#: What orders two lines of a session; more columns than the key, which repeats.
LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly_bars(lineitem: DataFrame) -> DataFrame:
    """security_id, session, open, close, high, low, amount. One partial aggregation; only seven columns are read."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = lineitem.select(F.col("l_suppkey").alias("security_id"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("session"), price.alias("p"), *LINE_ORDER)
    order = F.struct(*LINE_ORDER)
    return rows.groupBy("security_id", "session").agg(F.min_by("p", order).alias("open"), F.max_by("p", order).alias("close"), F.max("p").alias("high"), F.min("p").alias("low"), F.sum("l_extendedprice").alias("amount"))


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete monthly grid: bars, pos, member (all but every seventh cell) and industry (the supplier's region)."""
    bars = monthly_bars(table(spark, sf_dir, "lineitem"))
    sup = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    industry = sup.select(F.col("s_suppkey").alias("security_id"), F.col("n_regionkey").alias("industry"))
    lines = table(spark, sf_dir, "lineitem")
    # from the lines and not from the bars, which would be made a second time for it
    universe = lines.select(F.col("l_suppkey").alias("security_id")).distinct()
    months = lines.select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("session"))
    full = grid(bars, calendar(months), universe).join(industry, "security_id", "left")
    return full.withColumn("member", (F.col("security_id") + F.col("pos")) % 7 != 0)


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete daily grid of the suppliers' regions: bars, pos and member. Region 4 has no bars in the last 100 sessions."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("security_id"))
    regions = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "security_id")
    price, order = F.col("l_extendedprice") / F.col("l_quantity"), F.struct(*LINE_ORDER, "l_quantity", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.join(regions, F.col("l_suppkey") == F.col("s_suppkey")).select("security_id", F.col("l_shipdate").cast("date").alias("session"), price.alias("p"), *LINE_ORDER, "l_quantity", "l_suppkey")
    bars = rows.groupBy("security_id", "session").agg(F.min_by("p", order).alias("open"), F.max_by("p", order).alias("close"), F.max("p").alias("high"), F.min("p").alias("low"), F.sum("l_extendedprice").alias("amount"))
    days = calendar(lines.select(F.col("l_shipdate").cast("date").alias("session")))
    last = days.agg(F.max("pos").alias("last"))
    full = grid(bars, days, regions.select("security_id")).crossJoin(F.broadcast(last))
    live = (F.col("security_id") != 4) | (F.col("pos") <= F.col("last") - 100)
    return full.select("security_id", "session", "pos", *(F.when(live, F.col(c)).alias(c) for c in ("open", "close", "high", "low", "amount")), F.lit(True).alias("member"))


def factors(panel: DataFrame) -> DataFrame:
    """A factor that steps up each year, missing for some cells."""
    step = 1 + 0.25 * F.floor((F.col("pos") - 1) / 12)
    return panel.select("security_id", "session", F.when((F.col("security_id") * 3 + F.col("pos")) % 41 != 0, step.cast("double")).alias("factor"))


def report_events(events: DataFrame) -> DataFrame:
    """The events table as revised reports: every eleventh is a retraction, periods lie up to ten days back."""
    return events.select(
        F.col("user_id").alias("security_id"), F.date_sub(F.col("ts").cast("date"), (F.col("event_id") % 10).cast("int")).alias("report_period"), F.col("ts").cast("timestamp").alias("usable_from"),
        F.col("event_id").alias("revision_id"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"),
    )


def report_sessions(events: DataFrame) -> DataFrame:
    """security_id, session, cutoff (20:00) for every user and day of the events table."""
    days = events.select(F.col("ts").cast("date").alias("session")).distinct()
    users = events.select(F.col("user_id").alias("security_id")).distinct()
    return users.crossJoin(F.broadcast(days)).withColumn("cutoff", F.col("session").cast("timestamp") + F.expr("interval 20 hours"))
