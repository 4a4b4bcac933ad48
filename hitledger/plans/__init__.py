"""Registered queries, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = ("scalars", "gaps", "reconciling", "behavior", "stream", "baselines", "decisions", "records", "checks", "streams", "models")


def all_queries():
    from .registry import REGISTRY

    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return dict(REGISTRY)
