"""Experiment configurations in YAML, compiled to checked specifications."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.labels import resolve_target
from ..operators.models import TrainingProfile
from ..sources.documents import DocumentError, digest, load_yaml
from ..sources.facts import pinned
from . import catalog, contracts


@dataclass(frozen=True)
class ExperimentConfig:
    """What a sequential experiment needs besides its rows."""

    snapshot: str
    features: tuple[str, ...]
    label: contracts.LabelSpec
    refit: int
    mature: int
    profile: TrainingProfile
    evaluation: contracts.SignalEvaluationSpec

    @property
    def identity(self) -> str:
        return digest({"snapshot": self.snapshot, "features": list(self.features), "label": contracts.to_dict(self.label), "refit": self.refit, "mature": self.mature, "profile": vars(self.profile), "evaluation": contracts.to_dict(self.evaluation)})


_SECTIONS = {"snapshot", "features", "label", "schedule", "training", "evaluation"}


def _section(document: dict, name: str, allowed: set[str], required: set[str] = frozenset()) -> dict:
    out = document.get(name) or {}
    if not isinstance(out, dict) or set(out) - allowed or required - set(out):
        raise DocumentError(f"{name}: may have {sorted(allowed)}, must have {sorted(required)}")
    return out


def compile_config(text: str) -> ExperimentConfig:
    """Unknown sections, fields and features are errors; defaults are those of the specifications."""
    document = load_yaml(text)
    if not isinstance(document, dict) or set(document) - _SECTIONS or not {"snapshot", "features", "schedule"} <= set(document):
        raise DocumentError(f"sections are {sorted(_SECTIONS)}")
    known = {*catalog.stock_catalog()[1], *catalog.price_catalog()[1]}
    features = tuple(document["features"])
    if len(set(features)) != len(features) or set(features) - known:
        raise DocumentError(f"features repeated or unknown: {sorted(set(features) - known)}")
    label = _section(document, "label", {"entry", "exit", "horizon", "strict_maturity"})
    spec = contracts.validate(contracts.LabelSpec(**label))
    resolve_target(spec.entry, spec.exit, spec.horizon)
    schedule = _section(document, "schedule", {"refit", "mature"}, {"refit", "mature"})
    training = _section(document, "training", {"learning_rate", "rounds", "depth", "seed"})
    evaluation = _section(document, "evaluation", {"minimum_pairs", "group_count"})
    return ExperimentConfig(pinned(str(document["snapshot"])), features, spec, int(schedule["refit"]), int(schedule["mature"]), TrainingProfile(**training), contracts.SignalEvaluationSpec(**evaluation))
