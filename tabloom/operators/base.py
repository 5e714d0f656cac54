"""Operators: ``fit`` learns a small state by aggregates, ``transform`` is lazy."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column

from tabloom.frame import Table

_REGISTRY: dict[str, type["Operator"]] = {}


class SchemaDrift(ValueError):
    """The features at transform time are not those seen at fit time."""


def register(cls: type["Operator"]) -> type["Operator"]:
    _REGISTRY[cls.name] = cls
    return cls


def get_operator(name: str, **params: Any) -> "Operator":
    return _REGISTRY[name](**params)


def operator_names(family: str | None = None) -> list[str]:
    return sorted(n for n, cls in _REGISTRY.items() if family in (None, cls.family))


class Operator:
    """Base class; subclass, set the class fields and ``register`` to extend.

    ``contract`` names the acceptance rule and ``need`` the usefulness rule in
    :mod:`tabloom.plans.contracts`.
    """

    name = "operator"
    family = "data preprocess"
    contract = "b"
    need = "always"

    def __init__(self, **params: Any):
        self.params = params

    def fit(self, t: Table) -> "Fitted":
        return Fitted(self, t.features, self.learn(t))

    def learn(self, t: Table) -> dict:
        """State from ``t``: literals of size O(features), never rows."""
        return {}

    def columns(self, t: Table, state: dict) -> dict[str, Column]:
        """Output features by name."""
        raise NotImplementedError

    def apply(self, t: Table, state: dict) -> Table:
        return t.derive(self.columns(t, state))

    def fit_transform(self, t: Table) -> Table:
        return self.fit(t).transform(t)


@dataclass
class Fitted:
    operator: Operator
    inputs: tuple[str, ...]
    state: dict = field(default_factory=dict)

    def transform(self, t: Table) -> Table:
        if tuple(t.features) != tuple(self.inputs):
            raise SchemaDrift(f"{self.operator.name}: fitted on {self.inputs}, got {t.features}")
        return self.operator.apply(t, self.state)

    def to_json(self) -> str:
        """State as JSON; operators that hold a Spark ML model save that instead."""
        return json.dumps(
            {
                "operator": self.operator.name,
                "params": self.operator.params,
                "inputs": list(self.inputs),
                "state": self.state,
            }
        )

    @staticmethod
    def from_json(text: str) -> "Fitted":
        spec = json.loads(text)
        return Fitted(get_operator(spec["operator"], **spec["params"]), tuple(spec["inputs"]), spec["state"])
