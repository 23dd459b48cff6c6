"""Bindings of the operators to the test tables, each with its SQL counterpart."""

from importlib import import_module

MODULES = ["steps", "tables", "measures", "monitoring", "models", "intake", "samples", "learning", "streams"]


def load_all() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")
