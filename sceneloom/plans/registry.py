"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from sceneloom.plans.scene_sql import sql
from sceneloom.plans.scene_view import SceneView

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **ctes: str):
    """Register ``fn(view) -> DataFrame`` under a name, with the SQL it must equal."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(SceneView(spark, sf_dir))
        if oracle:
            ORACLES[name] = sql(oracle, **ctes)
        return fn

    return add
