"""Every registered query, grouped as the operators are."""

from importlib import import_module

from engramlake.registry.core import QUERIES, TWINS

_MODULES = ("tables", "screening", "routing", "rounds", "graphs", "entities", "governance", "promotion", "recall", "streams")


def load() -> None:
    for name in _MODULES:
        import_module(f"engramlake.registry.{name}")


load()

__all__ = ["QUERIES", "TWINS", "load"]
