"""Named queries over the given tables."""

from __future__ import annotations

from importlib import import_module

THEMES = (
    "runs", "texts", "matching", "statistics", "judging", "messages", "signals", "reports",
    "summaries", "documents",
)


def load():
    """All registered queries and SQL twins, by name."""
    from . import registry

    for theme in THEMES:
        import_module(f"{__name__}.{theme}")
    return registry.QUERIES, registry.ORACLES
