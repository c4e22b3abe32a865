"""Whole queries in one call: the rotation experiment, joint features, and the sequential train-and-evaluate experiment.

Each result is a table under the digest of what defines it: asking again with the same definition and source reads the table
and computes nothing.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, evaluation, labels, models, panel, schedules, signals
from ..sources.documents import content_identity, digest, publish, published
from ..sources.facts import pinned
from . import catalog, dag
from .contracts import SignalPlanSpec, to_dict
from .signal_plan import run_plan

KEYS = ["security_id", "session"]


@dataclass(frozen=True)
class Built:
    """A published table: where it is, and whether it was there already."""

    path: str
    reused: bool

    def read(self, spark: SparkSession) -> DataFrame:
        return published(spark, self.path)


def source_identity(snapshot: str, frames: dict[str, DataFrame], trusted: bool = False) -> dict:
    """What an identity says of its sources: the snapshot's name and, unless the caller vouches that the name stands for nothing else, the frames' content (one scan each)."""
    return {"snapshot": pinned(snapshot)} | ({} if trusted else {"content": {k: content_identity(df) for k, df in frames.items()}})


def build_features(spark: SparkSession, root: str, snapshot: str, facts: DataFrame, nodes: list[dag.Node], outputs: list[str], trusted: bool = False) -> Built:
    """Features of a plan over a panel. facts: a complete grid with pos and member. trusted: see source_identity()."""
    identity = {"kind": "features", **source_identity(snapshot, {"facts": facts}, trusted), "nodes": [n.to_dict() for n in dag.closure(nodes, outputs)], "outputs": outputs}
    return Built(*publish(spark, root, identity, lambda: dag.compile_plan(facts, nodes, outputs)))


def rotation_features(prices: DataFrame, factors: DataFrame, momentum: int = 20) -> DataFrame:
    """Keys, adjusted_close, momentum and momentum_rank, each row on prices adjusted to its own session.

    prices: a complete grid with close, pos and member. A ratio of two adjusted prices doesn't depend on the anchor, so
    close * factor serves every output session alike, and nothing after a session has a say in it: a security that stops early
    keeps its momentum up to there. Without a factor, or with 0, a session has no adjusted price.
    """
    f = factors.select(*KEYS, F.col("factor").alias("__factor"))
    known = prices.join(f, KEYS, "left").withColumn("__factor", F.when(F.col("__factor") != 0, F.col("__factor")))
    scaled = known.select(*KEYS, "pos", "member", F.col("close").alias("own"), (F.col("close") * F.col("__factor")).alias("close"))
    return dag.compile_plan(scaled, *catalog.rotation_recipe(momentum, "own"))


def build_rotation(spark: SparkSession, root: str, snapshot: str, prices: DataFrame, factors: DataFrame, momentum: int = 20, k: int = 1, trusted: bool = False) -> tuple[Built, Built]:
    """Momentum features on adjusted closes (see rotation_features()), and from them the weekly holdings. trusted: see source_identity()."""
    nodes, _ = catalog.rotation_recipe(momentum, "own")
    identity = {"kind": "rotation_features", **source_identity(snapshot, {"prices": prices, "factors": factors}, trusted), "nodes": [n.to_dict() for n in nodes]}

    def build() -> DataFrame:
        if prices.select("session").distinct().count() < momentum + 1:
            raise panel.PanelError(f"momentum over {momentum} sessions needs {momentum + 1}")
        return rotation_features(prices, factors, momentum)

    features = Built(*publish(spark, root, identity, build))

    def pick() -> DataFrame:
        table = features.read(spark)
        return signals.rotation_decisions(table.select(*KEYS, F.col("momentum").alias("score")), table.select("session").distinct(), k)

    return features, Built(*publish(spark, root, {"kind": "rotation", "features": features.path.rpartition("/")[2], "top_k": k}, pick))


def build_joint(spark: SparkSession, root: str, snapshot: str, markets: dict[str, DataFrame], sessions: DataFrame, events: DataFrame, report_field: str, trusted: bool = False) -> Built:
    """Market fields and their one-session returns beside the latest visible report. sessions: keys, pos and cutoff. trusted: see source_identity()."""

    def build() -> DataFrame:
        reports = asof.latest_report(sessions, events, report_field, f"report__{report_field}").drop("cutoff")
        joint = panel.merge_domains(markets).join(reports, KEYS)
        fields = [c for c in joint.columns if "__" in c and not c.startswith("report__")]
        from ..operators.rolling import pct_change

        return joint.select("*", *(pct_change(F.col(c), 1).alias(f"{c}__return") for c in fields))

    source = source_identity(snapshot, {**{f"market {k}": df for k, df in markets.items()}, "sessions": sessions, "events": events}, trusted)
    return Built(*publish(spark, root, {"kind": "joint", **source, "field": report_field}, build))


def build_sequential(
    spark: SparkSession, root: str, snapshot: str, rows: DataFrame, features: list[str], horizon: int, refit: int, mature: int, profile: models.TrainingProfile = models.TrainingProfile(), plan: SignalPlanSpec | None = None, minimum_pairs: int = evaluation.MINIMUM_PAIRS, trusted: bool = False
) -> tuple[Built, ...]:
    """Refits every `refit` sessions on mature, normalised labels, predicts out of sample, and evaluates: (predictions, daily coefficients), and the derived signal third.

    rows: a complete grid with pos, member, open, close and the features; features_at and cutoff, where there are such, bound
    what a model may see. Models are saved with receipts beside the predictions, so a run that broke off goes on with the next
    fold. plan: a signal plan over the raw predictions (its raw node is named "raw"), whose output is published and evaluated too.
    trusted: see source_identity().
    """
    labelled = labels.normalize(labels.forward_labels(rows, horizon).withColumn("reason", F.when(~F.coalesce("member", F.lit(False)), "NOT_MEMBER").otherwise(F.col("invalid_reason"))))
    days = rows.select("session").distinct()
    identity = {"kind": "sequential", **source_identity(snapshot, {"rows": rows}, trusted), "features": features, "horizon": horizon, "refit": refit, "mature": mature, "profile": asdict(profile)}

    def predictions() -> DataFrame:
        folds = schedules.periodic_folds(days, refit, mature, horizon)
        train = schedules.nominally_mature(schedules.training_sessions(folds, days, last=mature + horizon - 1), horizon)
        spans = train.groupBy("fold").agg(F.min("session").alias("a"), F.max("session").alias("b"))
        each = [{"name": f"fold{r.fold}", "train_from": r.a, "train_to": r.b, "predict_from": r.first_trade, "predict_to": r.last_trade} for r in folds.join(spans, "fold").orderBy("fold").collect()]
        return models.run_folds(labelled, each, features, "normalized", profile, folder=fold_folder(root, identity))

    scored = Built(*publish(spark, root, identity, predictions))
    raw = {"kind": "derived", "of": scored.path.rpartition("/")[2]}

    def derive() -> DataFrame:
        return run_plan(plan, {"raw": scored.read(spark).filter("valid").select(*KEYS, "score")})

    derived = [] if plan is None else [Built(*publish(spark, root, raw | {"plan": to_dict(plan)}, derive))]
    owners = {"raw": scored} | ({"derived": derived[0]} if derived else {})

    def evaluated() -> DataFrame:
        pairs = reduce(DataFrame.unionByName, (b.read(spark).select(F.lit(k).alias("signal"), *KEYS, "score", "valid") for k, b in owners.items()))
        pairs = pairs.join(labelled.select(*KEYS, F.col("return").alias("outcome")), KEYS)
        return evaluation.daily_ic(pairs.filter("valid and outcome is not null").select("signal", *KEYS, "score", "outcome"), pairs.select("signal", "session").distinct(), minimum=minimum_pairs)

    of = {k: b.path.rpartition("/")[2] for k, b in owners.items()}
    return scored, Built(*publish(spark, root, {"kind": "evaluation", "of": of, "minimum": minimum_pairs}, evaluated)), *derived


def fold_folder(root: str, identity: dict) -> str:
    """Where the models of a sequential experiment are."""
    return f"{root.rstrip('/')}/folds-{digest(identity)[7:]}"


def build_evaluation_labels(spark: SparkSession, root: str, snapshot: str, prices: DataFrame, horizon: int, trusted: bool = False) -> Built:
    """Outcomes of the full grid, published on their own: no training window, signal or membership has a say in them."""
    identity = {"kind": "evaluation_labels", **source_identity(snapshot, {"prices": prices}, trusted), "horizon": horizon}
    return Built(*publish(spark, root, identity, lambda: labels.forward_labels(prices, horizon)))


def freeze_evaluation(spark: SparkSession, root: str, signals_: dict[str, Built], outcomes: Built) -> Built:
    """The pairs that an evaluation is of (signal, keys, score, outcome), published: what was evaluated can be read and audited later."""

    def build() -> DataFrame:
        every = reduce(DataFrame.unionByName, (b.read(spark).filter("valid").select(F.lit(k).alias("signal"), *KEYS, "score") for k, b in signals_.items()))
        return every.join(outcomes.read(spark).filter("valid").select(*KEYS, F.col("return").alias("outcome")), KEYS).select("signal", *KEYS, "score", "outcome")

    of = {k: b.path.rpartition("/")[2] for k, b in signals_.items()}
    return Built(*publish(spark, root, {"kind": "evaluation_pairs", "of": of, "outcomes": outcomes.path.rpartition("/")[2]}, build))
