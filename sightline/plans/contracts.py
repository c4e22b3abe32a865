"""Typed, immutable definitions of features, labels, folds, training, signals and evaluations, with checks and identities.

A definition is plain data: it serialises to canonical JSON, and its semantic identity is the digest of that without the
fields that don't change what it computes. Values that aren't known are said to be so instead of defaulted.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_args, get_origin, get_type_hints

from ..sources.documents import canonical, digest, parse

STAGES = ("fact", "base", "cross_sectional", "model_input")
SIGNAL_OPS = ("raw", "daily_zscore", "weighted_combine")
JOINS = ("inner_on_security_session", "outer_on_security_session")
#: Fields that name or describe a definition and don't change its meaning.
DESCRIPTIVE = ("metadata", "uri", "title", "description")


class ContractError(ValueError):
    """A definition that contradicts itself or its parts."""


@dataclass(frozen=True)
class Unknown:
    """A value that is required and not known, with the reason."""

    reason: str


@dataclass(frozen=True)
class Column:
    name: str
    dtype: str = "float64"
    unit: str | None = "dimensionless"
    stage: str = "base"


@dataclass(frozen=True)
class Requirement:
    domain: str
    fields: tuple[str, ...]
    history: int = 1


@dataclass(frozen=True)
class FeatureDefinition:
    id: str
    version: int
    column: Column
    formula: str = ""
    requirements: tuple[Requirement, ...] = ()
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class FeaturePlanSpec:
    columns: tuple[Column, ...]
    nodes: tuple[dict, ...] = ()
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class FeatureRelease:
    features: tuple[FeatureDefinition, ...]
    plan: FeaturePlanSpec
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class LabelSpec:
    entry: str = "next_open"
    exit: str = "close"
    horizon: int = 5
    strict_maturity: bool = True
    price_basis: str | Unknown = "adjusted"
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class FoldSpec:
    name: str
    fit_session: str
    first_trade: str
    last_trade: str
    train_sessions: int | None = None
    train_years: int | None = None


@dataclass(frozen=True)
class DatasetSpec:
    release: FeatureRelease
    label: LabelSpec
    folds: tuple[FoldSpec, ...]
    universe: str | Unknown = Unknown("universe not given")


@dataclass(frozen=True)
class TrainingSpec:
    learning_rate: float = 0.05
    rounds: int = 100
    depth: int = 5
    seed: int = 42
    schema: tuple[str, ...] = ()


@dataclass(frozen=True)
class SignalNode:
    name: str
    op: str
    inputs: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()


@dataclass(frozen=True)
class SignalPlanSpec:
    nodes: tuple[SignalNode, ...]
    output: str
    join: str = "inner_on_security_session"


@dataclass(frozen=True)
class SignalEvaluationSpec:
    minimum_pairs: int = 20
    group_count: int = 10
    periods: str = "all_and_calendar_years"


@dataclass(frozen=True)
class ModelRelease:
    dataset: str
    training: TrainingSpec
    features: tuple[str, ...]
    uri: str = ""


@dataclass(frozen=True)
class StrategyRecipe:
    """What a selection needs; orders and accounts are made elsewhere."""

    top_k: int = 1
    above: float = 0.0
    rebalance: str = "first_session_of_iso_week"
    metadata: dict = field(default_factory=dict)


TYPES = {c.__name__: c for c in (Unknown, Column, Requirement, FeatureDefinition, FeaturePlanSpec, FeatureRelease, LabelSpec, FoldSpec, DatasetSpec, TrainingSpec, SignalNode, SignalPlanSpec, SignalEvaluationSpec, ModelRelease, StrategyRecipe)}


def to_dict(x: Any) -> Any:
    if is_dataclass(x):
        return {"type": type(x).__name__} | {f.name: to_dict(getattr(x, f.name)) for f in fields(x)}
    if isinstance(x, (tuple, list)):
        return [to_dict(v) for v in x]
    return {k: to_dict(v) for k, v in x.items()} if isinstance(x, dict) else x


def from_dict(d: Any) -> Any:
    """The definition that to_dict() made the value from; unknown types and unknown or missing fields are errors."""
    if isinstance(d, list):
        return tuple(from_dict(v) for v in d)
    if not isinstance(d, dict):
        return d
    if "type" not in d:
        return {k: from_dict(v) for k, v in d.items()}
    kind = TYPES.get(d["type"])
    if kind is None:
        raise ContractError(f"unknown type {d['type']!r}")
    names, given = {f.name for f in fields(kind)}, set(d) - {"type"}
    if names != given:
        raise ContractError(f"{d['type']}: missing {sorted(names - given)}, unknown {sorted(given - names)}")
    return kind(**{k: from_dict(d[k]) for k in given})


def dumps(x: Any) -> str:
    return canonical(to_dict(x))


def loads(text: str) -> Any:
    return from_dict(parse(text))


def save(x: Any, path: str) -> None:
    """Writes a new file on the driver; an existing one is an error."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(dumps(x))


def load(path: str) -> Any:
    with open(path, encoding="utf-8") as f:
        return loads(f.read())


def content_digest(x: Any) -> str:
    return digest(to_dict(x))


def _meaning(d: Any) -> Any:
    if isinstance(d, dict):
        return {k: _meaning(v) for k, v in d.items() if k not in DESCRIPTIVE}
    return [_meaning(v) for v in d] if isinstance(d, list) else d


def semantic_identity(x: Any) -> str:
    """Digest of what a definition computes: two that differ in descriptions only have the same."""
    return digest(_meaning(to_dict(x)))


def unresolved(x: Any, at: str = "") -> list[str]:
    """Where a definition holds unknown values."""
    if isinstance(x, Unknown):
        return [at or "/"]
    if is_dataclass(x):
        return [p for f in fields(x) for p in unresolved(getattr(x, f.name), f"{at}/{f.name}")]
    if isinstance(x, (tuple, list)):
        return [p for i, v in enumerate(x) for p in unresolved(v, f"{at}/{i}")]
    return [p for k, v in x.items() for p in unresolved(v, f"{at}/{k}")] if isinstance(x, dict) else []


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise ContractError(message)


def validate(x: Any) -> Any:
    """x, if it and its parts are consistent."""
    for f in fields(x) if is_dataclass(x) else ():
        value = getattr(x, f.name)
        for v in value if isinstance(value, tuple) else (value,):
            if is_dataclass(v):
                validate(v)
    if isinstance(x, Column):
        _check(x.dtype in ("float64", "float32", "bool"), f"{x.name}: dtype {x.dtype}")
        _check(x.stage in STAGES, f"{x.name}: stage {x.stage}")
        _check(x.unit is not None or x.dtype == "bool", f"{x.name}: only booleans have no unit")
    elif isinstance(x, FeaturePlanSpec):
        names = [c.name for c in x.columns]
        _check(len(set(names)) == len(names), "a column name is used twice")
    elif isinstance(x, FeatureRelease):
        _check([f.column.name for f in x.features] == [c.name for c in x.plan.columns], "features and plan columns differ in names or order")
    elif isinstance(x, LabelSpec):
        _check(x.horizon >= 1, "a horizon of at least one session")
    elif isinstance(x, FoldSpec):
        _check(x.fit_session <= x.first_trade <= x.last_trade, f"{x.name}: its sessions don't rise")
        _check((x.train_sessions is None) != (x.train_years is None), f"{x.name}: give either sessions or years")
    elif isinstance(x, DatasetSpec):
        for a, b in zip(x.folds, x.folds[1:], strict=False):
            _check(a.last_trade < b.first_trade, f"folds {a.name} and {b.name} overlap")
    elif isinstance(x, TrainingSpec):
        _check(0 < x.learning_rate <= 1 and x.rounds >= 1, "a rate in (0, 1] and at least one round")
    elif isinstance(x, SignalPlanSpec):
        done: set[str] = set()
        _check(x.join in JOINS, f"join {x.join}")
        for n in x.nodes:
            _check(n.op in SIGNAL_OPS and n.name not in done and set(n.inputs) <= done, f"node {n.name}")
            _check(n.op != "daily_zscore" or len(n.inputs) == 1 and not n.weights, f"{n.name}: one input and no weights")
            if n.op == "weighted_combine":
                _check(len(n.weights) == len(n.inputs) > 0 and min(n.weights) >= 0 and abs(sum(n.weights) - 1) <= 1e-12, f"{n.name}: weights that aren't negative and sum to 1")
            done.add(n.name)
        _check(x.output in done, "the output is no node")
    elif isinstance(x, ModelRelease):
        _check(not x.training.schema or x.training.schema == x.features, "the model's schema isn't the features'")
    return x


def admit(x: Any) -> Any:
    """x, if it's valid and nothing in it is unknown."""
    validate(x)
    open_ = unresolved(x)
    _check(not open_, f"unknown: {', '.join(open_)}")
    return x


def contract_schema(kind: type) -> dict:
    """JSON Schema of a definition type."""
    scalars = {str: "string", int: "integer", float: "number", bool: "boolean", dict: "object", type(None): "null"}

    def of(t) -> dict:
        if t in scalars:
            return {"type": scalars[t]}
        if is_dataclass(t):
            return contract_schema(t)
        if get_origin(t) is tuple:
            return {"type": "array", "items": of(get_args(t)[0])}
        return {"anyOf": [of(a) for a in get_args(t)]}

    hints = get_type_hints(kind)
    properties = {"type": {"const": kind.__name__}} | {f.name: of(hints[f.name]) for f in fields(kind)}
    return {"type": "object", "additionalProperties": False, "required": list(properties), "properties": properties}
