"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from flowloom.plans.registry import ORACLES, QUERIES

for _module in ("flow_plans", "table_plans", "score_plans", "net_plans", "model_plans", "file_plans"):
    import_module(f"flowloom.plans.{_module}")

__all__ = ["QUERIES", "ORACLES"]
