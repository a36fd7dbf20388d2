"""All registered queries."""

from __future__ import annotations

import importlib

from chronolith.plans.registry import CHECKS, QUERIES

for _name in ("scalar", "history", "ancestry", "graph", "risk", "text", "source", "report"):
    importlib.import_module(f"chronolith.plans.{_name}_queries")

__all__ = ["CHECKS", "QUERIES"]
