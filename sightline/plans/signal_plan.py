"""Running signal plans: raw predictions, their daily z-scores, and weighted blends, as one derived signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, signals
from ..operators.panel import PANEL, PanelError, PanelSpec
from .contracts import SignalPlanSpec, validate


def run_plan(plan: SignalPlanSpec, raw: dict[str, DataFrame], reject: bool = True, spec: PanelSpec = PANEL) -> DataFrame:
    """Keys, score, valid, invalid_reason of the plan's output. raw: predictions (keys, score) by the names of raw nodes.

    Raw signals are joined once, on all keys or on those of any of them as the plan says; a score that isn't there is null, a
    blend of it is too, and says MISSING_INPUT.
    """
    validate(plan)
    names = [n.name for n in plan.nodes if n.op == "raw"]
    if set(names) != set(raw):
        raise PanelError(f"the plan needs {sorted(names)}, given are {sorted(raw)}")
    df = signals.join_signals({n: raw[n] for n in names}, outer=plan.join.startswith("outer"), spec=spec)
    for n in plan.nodes:
        if n.op == "daily_zscore":
            df = signals.daily_zscore(df, n.inputs[0], n.name, reject, spec)
        elif n.op == "weighted_combine":
            df = df.withColumn(n.name, signals.weighted(dict(zip(n.inputs, n.weights, strict=True))))
    score = F.col(plan.output)
    reason = F.when(score.isNull(), F.lit("MISSING_INPUT"))
    return df.select(*spec.keys, score.alias("score"), reason.isNull().alias("valid"), reason.alias("invalid_reason"))


def compare(signals_: dict[str, DataFrame], outcome: DataFrame, sessions: DataFrame | None = None, minimum: int = evaluation.MINIMUM_PAIRS, spec: PanelSpec = PANEL) -> DataFrame:
    """Daily coefficients of several owners' signals against one independent outcome, on their own and on their common sample.

    signals_: (keys, score, valid) by name. outcome: keys, outcome.
    """
    every = None
    for name, df in signals_.items():
        one = df.filter("valid").select(F.lit(name).alias("signal"), *spec.keys, "score")
        every = one if every is None else every.unionByName(one)
    pairs = every.join(outcome.filter("outcome is not null"), spec.keys).filter("score is not null")
    return evaluation.daily_ic(evaluation.samples(pairs, len(signals_), spec), sessions, minimum=minimum, by=("sample", "signal"), spec=spec)


def check_parents(derived: DataFrame, parents: dict[str, DataFrame], spec: PanelSpec = PANEL) -> None:
    """An error if a derived signal has a key that one of its parents hasn't."""
    for name, df in parents.items():
        found = derived.filter("valid").select(*spec.keys).join(df, spec.keys, "left_anti").head(1)
        if found:
            raise PanelError(f"{name} has no row for {found[0].asDict()}")
