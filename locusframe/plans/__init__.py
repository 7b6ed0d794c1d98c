"""Query registry over the star-schema tables."""

from __future__ import annotations

from types import ModuleType


def all_queries() -> ModuleType:
    """The registry, filled."""
    from locusframe.plans import core_queries, genetics_queries, model_queries, registry  # noqa: F401

    return registry
