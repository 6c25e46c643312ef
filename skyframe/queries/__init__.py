"""Registered queries over the test tables, each with the SQL that checks it."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Imports every module of this package, which registers its queries."""
    for m in iter_modules(__path__):
        import_module(f"{__name__}.{m.name}")
