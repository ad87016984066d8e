"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from trellis.plans.registry import ORACLE, QUERIES

_MODULES = (
    "trellis.plans.evaluation_queries",
    "trellis.plans.reward_queries",
    "trellis.plans.statistics_queries",
    "trellis.plans.batch_queries",
    "trellis.plans.sampling_queries",
    "trellis.plans.streaming_queries",
)


def load() -> tuple[dict, dict]:
    for m in _MODULES:
        importlib.import_module(m)
    return QUERIES, ORACLE
