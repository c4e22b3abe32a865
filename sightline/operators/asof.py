"""Point-in-time joins: what was knowable at a session's cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import PANEL, PanelSpec


def latest_revision(facts: DataFrame, keys: list[str], cutoff: str | None = None) -> DataFrame:
    """One row a key: the latest revision by usable_from, then revision_id; with a cutoff column, of those visible at it.

    An aggregate with max_by instead of a window: it combines before the shuffle.
    """
    seen = facts if cutoff is None else facts.filter(F.col("usable_from") <= F.col(cutoff))
    rest = [c for c in facts.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct("usable_from", "revision_id"))
    return seen.groupBy(*keys).agg(latest.alias("__row")).select(*keys, "__row.*")


def latest_report(sessions: DataFrame, events: DataFrame, value: str, out: str, *, strict: bool = False, spec: PanelSpec = PANEL) -> DataFrame:
    """Adds the value of the latest report period visible at each session's cutoff.

    sessions: security_id, session (DATE), cutoff (TIMESTAMP on the session's day). events: security_id, report_period (DATE),
    usable_from (TIMESTAMP), revision_id and the value. Of the events with usable_from <= cutoff (strict: <) and
    report_period <= session the largest report_period wins, within it the latest revision; a null value, as of a retracted
    report, wins over older ones. Also adds <out>_period and <out>_at.

    One shuffle and one running max_by over sessions and events in order of time, instead of a join by range: an event takes
    part from the time on when both its conditions hold.
    """
    period = F.col("report_period").cast("timestamp")
    from_ = F.greatest(F.col("usable_from"), period)
    # an event is before the sessions of the same instant, or behind them when the bound is strict
    turn = F.when(F.lit(strict) & (F.col("usable_from") >= period), 2).otherwise(0)
    fact = F.struct(F.col("report_period").alias("period"), F.col("usable_from").alias("at"), F.col(value).alias("value"))
    order = F.struct(F.col("report_period"), F.col("usable_from"), F.col("revision_id"))
    e = events.select(F.col(spec.security), from_.alias("__time"), turn.alias("__turn"), fact.alias("__fact"), order.alias("__order"), F.lit(None).cast("struct<%s>" % ",".join(f"`{n}`:{t}" for n, t in sessions.dtypes)).alias("__row"))
    s = sessions.select(F.col(spec.security), F.col("cutoff").alias("__time"), F.lit(1).alias("__turn"), F.lit(None).cast(e.schema["__fact"].dataType).alias("__fact"), F.lit(None).cast(e.schema["__order"].dataType).alias("__order"), F.struct(*sessions.columns).alias("__row"))
    w = Window.partitionBy(spec.security).orderBy("__time", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(s).withColumn("__best", F.max_by("__fact", "__order").over(w)).filter("__turn = 1 and __row is not null")
    return both.select("__row.*", F.col("__best.value").alias(out), F.col("__best.period").alias(f"{out}_period"), F.col("__best.at").alias(f"{out}_at"))


def repeated_reports(events: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Events of one security that tie in period, clock and revision: their order would be arbitrary."""
    return events.groupBy(spec.security, "report_period", "usable_from", "revision_id").count().filter("count > 1")


def visible_window(facts: DataFrame, outputs: DataFrame, lookback: int, spec: PanelSpec = PANEL) -> DataFrame:
    """Facts of each output session's whole lookback at that session's own cutoff: the exact form of the window rule.

    facts: security_id, pos, value fields, usable_from. outputs: out_session, out_pos, cutoff, one row an output session (the
    small side). A historical cell that came late is there for later outputs and missing for earlier ones. If every cell is
    visible at its own session's cutoff, windows over the facts give the same and cost less; all_on_time() tells.
    """
    reach = (F.col(spec.position) <= F.col("out_pos")) & (F.col(spec.position) > F.col("out_pos") - lookback)
    return facts.join(F.broadcast(outputs), reach & (F.col("usable_from") <= F.col("cutoff")))


def all_on_time(facts: DataFrame) -> bool:
    """Whether each cell was available at its own session's cutoff (columns usable_from, cutoff)."""
    return facts.filter(F.col("usable_from") > F.col("cutoff")).isEmpty()


def adjust_to_anchor(prices: DataFrame, factors: DataFrame, fields: list[str], anchors: DataFrame | None = None, spec: PanelSpec = PANEL) -> DataFrame:
    """price * factor / factor at the anchor session, per field as <field>__adjusted, with <field>__reason where it is null.

    anchors: security_id and anchor_session, or only anchor_session; None: each row is its own anchor. The clock of an
    adjusted price is the latest of price, factor and anchor factor (column adjusted_at, where inputs have usable_from).
    """
    timed = "usable_from" in prices.columns and "usable_from" in factors.columns
    f = factors.select(*spec.keys, F.col("factor").alias("__f"), *([F.col("usable_from").alias("__f_at")] if timed else []))
    both = prices.join(f, spec.keys, "left")
    if anchors is None:
        both = both.withColumn("anchor_session", F.col(spec.session))
    elif spec.security in anchors.columns:
        both = both.join(anchors, spec.security, "left")
    else:
        both = both.crossJoin(F.broadcast(anchors))
    a = f.select(F.col(spec.security), F.col(spec.session).alias("anchor_session"), F.col("__f").alias("__a"), *([F.col("__f_at").alias("__a_at")] if timed else []))
    both = both.join(a, [spec.security, "anchor_session"], "left")
    out = [c for c in both.columns if not c.startswith("__")]
    cells = []
    for field in fields:
        p = F.col(field)
        reason = F.when(p.isNull(), "price_missing").when(F.col("__f").isNull(), "factor_missing").when(F.col("__a").isNull(), "anchor_factor_missing").when(F.col("__a") == 0, "anchor_factor_zero")
        cells += [F.try_divide(p * F.col("__f"), F.col("__a")).alias(f"{field}__adjusted"), reason.alias(f"{field}__reason")]
    clock = [F.greatest("usable_from", "__f_at", "__a_at").alias("adjusted_at")] if timed else []
    return both.select(*out, *cells, *clock)
