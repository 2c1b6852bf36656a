"""Registered queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ["mask_queries", "geometry_queries", "track_queries", "relation_queries", "evaluation_queries",
           "quality_queries", "align_queries", "stream_queries", "source_queries"]


def load():
    """All queries and oracles, by name."""
    from sceneloom.plans import registry
    for m in MODULES:
        import_module(f"sceneloom.plans.{m}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
