"""Signal statistics: information coefficients, their summaries, coverage and quantile groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cross_section import average_rank
from .panel import PANEL, PanelSpec

MINIMUM_PAIRS = 20

#: Why a row isn't a pair, in order of precedence.
EXCLUSIONS = ("MEMBERSHIP_UNKNOWN", "NOT_MEMBER", "RAW_LABEL_INVALID", "LABEL_NOT_MATURE", "SIGNAL_MISSING", "SIGNAL_INVALID")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient, null for a constant side: corr() would raise under ANSI arithmetic."""
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(constant, F.lit(None)).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def exclusion_reason(cutoff: Column) -> Column:
    """Columns: member, label_valid, label_available_at, scored (a signal row exists), signal_valid."""
    conditions = (
        F.col("member").isNull(), ~F.col("member"), ~F.coalesce("label_valid", F.lit(False)), F.coalesce(F.col("label_available_at") > cutoff, F.lit(True)),
        ~F.coalesce("scored", F.lit(False)), ~F.coalesce("signal_valid", F.lit(False)),
    )
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in zip(EXCLUSIONS, conditions, strict=True)))


def daily_ic(pairs: DataFrame, sessions: DataFrame | None = None, rank: bool = False, minimum: int = MINIMUM_PAIRS, by: tuple[str, ...] = ("signal",), spec: PanelSpec = PANEL) -> DataFrame:
    """by, session, n_pairs, ic, reason. pairs: by, session, score, outcome, both present.

    rank: correlation of average ranks. With sessions (by, session) each of them has a row, also without any pair. Null
    coefficients say why: INSUFFICIENT_PAIRS, CONSTANT_CROSS_SECTION, NON_FINITE_CORRELATION.
    """
    keys = [*by, spec.session]
    if rank:
        pairs = pairs.select(*keys, average_rank(F.col("score"), keys).alias("score"), average_rank(F.col("outcome"), keys).alias("outcome"))
    x, y = F.col("score"), F.col("outcome")
    each = pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), correlation(x, y).alias("__ic"), ((F.min(x) == F.max(x)) | (F.min(y) == F.max(y))).alias("__constant"))
    if sessions is not None:
        each = sessions.select(*keys).distinct().join(each, keys, "left")
    n = F.coalesce("n_pairs", F.lit(0))
    reason = F.when(n < minimum, "INSUFFICIENT_PAIRS").when(F.col("__constant"), "CONSTANT_CROSS_SECTION").when(F.col("__ic").isNull() | F.isnan("__ic"), "NON_FINITE_CORRELATION")
    marked = each.withColumn("reason", reason)
    return marked.select(*keys, n.alias("n_pairs"), F.when(F.col("reason").isNull(), F.col("__ic")).alias("ic"), "reason")


def ic_summary(daily: DataFrame, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """by, n_sessions, mean_ic, std_ic, icir, reason: equal weights, ddof 1, not annualised."""
    each = daily.groupBy(*by).agg(F.count("ic").alias("n_sessions"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"))
    reason = F.when(F.col("n_sessions") == 0, "NO_VALID_SESSIONS").when(F.col("n_sessions") == 1, "INSUFFICIENT_VALID_SESSIONS").when(F.col("std_ic") == 0, "ZERO_VARIANCE")
    return each.withColumn("icir", F.try_divide(F.col("mean_ic"), F.col("std_ic"))).withColumn("reason", reason)


def by_period(daily: DataFrame, by: tuple[str, ...] = ("signal",), spec: PanelSpec = PANEL) -> DataFrame:
    """Daily rows once under period `all` and once under their calendar year."""
    year = F.year(spec.session).cast("string")
    return daily.withColumn("period", F.explode(F.array(F.lit("all"), year)))


def common_sample(pairs: DataFrame, n_signals: int, spec: PanelSpec = PANEL) -> DataFrame:
    """Pairs of the keys for which every signal has one (signal is unique by key): an aggregate and a semi-join."""
    keys = pairs.groupBy(*spec.keys).agg(F.count_distinct("signal").alias("n")).filter(F.col("n") == n_signals)
    return pairs.join(keys, spec.keys, "left_semi")


def samples(pairs: DataFrame, n_signals: int, spec: PanelSpec = PANEL) -> DataFrame:
    """Pairs with the column sample: all as native, and those of the common sample again as common."""
    native = pairs.withColumn("sample", F.lit("native"))
    return native.unionByName(common_sample(pairs, n_signals, spec).withColumn("sample", F.lit("common")))


def coverage(rows: DataFrame, by: tuple[str, ...] = ("signal",), spec: PanelSpec = PANEL) -> DataFrame:
    """Counts by session: scope, reference, label, prediction, pair, and one column an exclusion reason (columns reason, member, label_ok, signal_ok)."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy(*by, spec.session).agg(
        F.count("*").alias("n_scope"), n(F.col("member")).alias("n_reference"), n(F.col("label_ok")).alias("n_label"), n(F.col("signal_ok")).alias("n_prediction"), F.count_if(F.col("reason").isNull()).alias("n_pair"),
        *(n(F.col("reason") == r).alias(r.lower()) for r in EXCLUSIONS),
    )


def quantile_groups(pairs: DataFrame, groups: int = 10, minimum: int = MINIMUM_PAIRS, by: tuple[str, ...] = ("signal",), spec: PanelSpec = PANEL) -> DataFrame:
    """Mean outcome by group of the score's average-rank fraction, first by session, then over sessions with equal weight."""
    keys = [*by, spec.session]
    counts = pairs.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") >= minimum)
    ranked = pairs.withColumn("__rank", average_rank(F.col("score"), keys)).join(counts, keys)
    group = F.least(F.lit(groups), F.ceil(F.col("__rank") / F.col("__n") * groups)).cast("long")
    each = ranked.groupBy(*keys, group.alias("group")).agg(F.avg("outcome").alias("__mean"), F.count("*").alias("__size"))
    return each.groupBy(*by, "group").agg(F.count("*").alias("n_sessions"), F.avg("__mean").alias("mean_outcome"), F.sum("__size").alias("n_pairs"))


def stage_report(rows: DataFrame, by: tuple[str, ...] = ("signal",), spec: PanelSpec = PANEL) -> DataFrame:
    """First and last session, number of sessions, rows, and the mean of ic where there is one."""
    ic = [F.avg("ic").alias("mean_ic")] if "ic" in rows.columns else []
    return rows.groupBy(*by).agg(F.min(spec.session).alias("first_session"), F.max(spec.session).alias("last_session"), F.count_distinct(spec.session).alias("n_sessions"), F.count("*").alias("n_rows"), *ic)
