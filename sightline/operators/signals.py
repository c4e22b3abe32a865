"""Signals: normalising, blending, joining and selecting scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cross_section import EPSILON
from .panel import PANEL, PanelError, PanelSpec


def daily_zscore(signal: DataFrame, score: str = "score", out: str = "z", reject: bool = True, spec: PanelSpec = PANEL) -> DataFrame:
    """Adds each session's z-score of the scored rows. A constant section is an error (reject) or has null scores."""
    stats = signal.groupBy(spec.session).agg(F.avg(score).alias("__mean"), F.stddev_pop(score).alias("__std"), F.count(score).alias("__n"))
    if reject:
        bad = stats.filter((F.col("__n") > 0) & ~(F.col("__std") > EPSILON)).head(1)
        if bad:
            raise PanelError(f"constant section {bad[0][0]}")
    both = signal.join(stats, spec.session)
    return both.withColumn(out, F.when(F.col("__std") > EPSILON, (F.col(score) - F.col("__mean")) / F.col("__std"))).drop("__mean", "__std", "__n")


def weighted(weights: dict[str, float]) -> Column:
    """Sum of weight * column; null where any is. Weights aren't negative and sum to 1."""
    if any(w < 0 for w in weights.values()) or not math.isclose(sum(weights.values()), 1.0, abs_tol=1e-12):
        raise PanelError("weights must not be negative and must sum to 1")
    total = None
    for c, w in weights.items():
        part = F.lit(float(w)) * F.col(c)
        total = part if total is None else total + part
    return total


def join_signals(signals: dict[str, DataFrame], score: str = "score", outer: bool = False, spec: PanelSpec = PANEL) -> DataFrame:
    """One column of scores a signal, by key: keys that all have, or that any has."""
    out = None
    for name, df in signals.items():
        one = df.select(*spec.keys, F.col(score).alias(name))
        out = one if out is None else out.join(one, spec.keys, "full_outer" if outer else "inner")
    return out


def top_k(signal: DataFrame, k: int, score: str = "score", above: float | None = 0.0, spec: PanelSpec = PANEL) -> DataFrame:
    """The k best rows of each session, ties by security; scores not above the floor are out."""
    able = signal.filter(F.col(score).isNotNull() if above is None else F.col(score) > above)
    order = Window.partitionBy(spec.session).orderBy(F.desc(score), spec.security)
    return able.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def etf_signal(features: DataFrame, score: str, cutoff: str, spec: PanelSpec = PANEL) -> DataFrame:
    """A signal frame from a feature: score, valid, invalid_reason, knowledge_cutoff, available_at (by default the cutoff)."""
    at = F.coalesce(F.col("available_at"), F.col(cutoff)) if "available_at" in features.columns else F.col(cutoff)
    reason = F.when(F.col(score).isNull(), F.lit("FEATURE_MISSING"))
    return features.select(*spec.keys, F.col(score).alias("score"), reason.isNull().alias("valid"), reason.alias("invalid_reason"), F.col(cutoff).alias("knowledge_cutoff"), at.alias("available_at"))


def rotation_decisions(signal: DataFrame, days: DataFrame, k: int = 1, spec: PanelSpec = PANEL) -> DataFrame:
    """Holdings for the first session of each ISO week, from the signal of the session before it; none means cash."""
    from .panel import first_of_iso_week, previous_session

    trades = first_of_iso_week(days, spec).select(F.col(spec.session).alias("trade_session"))
    pairs = previous_session(days, spec).select(F.col(spec.session).alias("trade_session"), F.col("prediction_session").alias(spec.session))
    wanted = trades.join(pairs, "trade_session").filter(F.col(spec.session).isNotNull())
    return top_k(signal.join(F.broadcast(wanted), spec.session), k, spec=spec)


def rank_buffer(df: DataFrame, k: int, keep: int, score: str = "score", spec: PanelSpec = PANEL) -> DataFrame:
    """session, held (names in the order they were bought): at most k names, each kept while it ranks within keep; free places go to the best that aren't held.

    What is bought depends on what was held before, so sessions are gone through one after the other, over the at most `keep`
    best names of each: a table of sessions * keep rows, however many securities there are. Ties rank by name; scores that
    aren't positive and nulls don't rank. A session without such scores sells everything.
    """
    best = top_k(df, keep, score, spec=spec).groupBy(spec.session).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(spec.security).alias("name")))).alias("ranked"))
    days = df.select(spec.session).distinct().join(best, spec.session, "left")
    empty = F.array().cast(f"array<{dict(df.dtypes)[spec.security]}>")
    names = F.coalesce(F.transform("ranked", lambda x: x["name"]), empty)
    every = days.agg(F.array_sort(F.collect_list(F.struct(F.col(spec.session).alias("day"), names.alias("names")))).alias("days"))

    def step(acc, x):
        stay = F.filter(acc["held"], lambda h: F.array_contains(x["names"], h))
        held = F.slice(F.concat(stay, F.filter(x["names"], lambda n: ~F.array_contains(acc["held"], n))), 1, k)
        return F.struct(held.alias("held"), F.concat(acc["out"], F.array(F.struct(x["day"].alias("day"), held.alias("held")))).alias("out"))

    none = F.filter(F.array(F.struct(F.lit(None).cast(dict(df.dtypes)[spec.session]).alias("day"), empty.alias("held"))), lambda x: x["day"].isNotNull())
    told = every.select(F.explode(F.aggregate("days", F.struct(empty.alias("held"), none.alias("out")), step)["out"]).alias("x"))
    return told.select(F.col("x.day").alias(spec.session), F.col("x.held").alias("held"))
