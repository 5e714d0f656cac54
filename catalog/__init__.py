"""Registered queries over the given tables, each with its check in plain SQL."""

from __future__ import annotations

from catalog.registry import ORACLES, QUERIES
from catalog import ( # noqa: F401
    sources,
    contracts,
    preparation,
    scaling,
    selection,
    hard_columns,
    streams,
    decomposition,
    learning,
    models,
    forests,
    pipelines,
    profiling,
    sampling,
)

__all__ = ["QUERIES", "ORACLES"]
