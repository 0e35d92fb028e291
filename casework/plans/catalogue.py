"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

import importlib

from casework.plans.registry import ORACLES, QUERIES

_MODULES = [
    "casework.plans.q_text",
    "casework.plans.q_cases",
    "casework.plans.q_eval",
    "casework.plans.q_retrieval",
    "casework.plans.q_models",
    "casework.plans.q_streaming",
]


def load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries():
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return {k: f() for k, f in ORACLES.items()}
