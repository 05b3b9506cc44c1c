"""All catalogue queries, imported so that they register."""

from __future__ import annotations

import importlib

from plumbline.plans.registry import CATALOG, Query

MODULES = ("integrity", "sampling", "metrics", "studies", "decisions", "statistics")


def load() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"plumbline.plans.{m}")
    return CATALOG
