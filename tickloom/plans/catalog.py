"""All registered queries (importing the plan modules registers them)."""

from tickloom.plans import dataset_plans, indicator_plans, ledger_plans, model_plans, signal_plans, source_plans, stream_plans  # noqa: F401
from tickloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
