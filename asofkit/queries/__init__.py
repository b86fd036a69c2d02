"""Registered queries over the shared test tables."""

from importlib import import_module
from pathlib import Path

from asofkit.queries.registry import REGISTRY, Query


def load_all() -> dict[str, Query]:
    """Import every query module once and return the registry."""
    for path in sorted(Path(__file__).parent.glob("*_queries.py")):
        import_module(f"asofkit.queries.{path.stem}")
    return REGISTRY
