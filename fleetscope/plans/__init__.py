"""Registered queries (one per inventory operator) and the batch analytics chain."""

import importlib

_MODULES = ("q_readside", "q_analytics", "q_ingest", "q_market", "q_design", "q_extra", "q_tables", "q_more", "q_outcomes", "q_pricing")


def load_all():
    """Import every query module so the registry is complete."""
    from fleetscope.plans import catalog
    for m in _MODULES:
        importlib.import_module(f"fleetscope.plans.{m}")
    return catalog.REGISTRY
