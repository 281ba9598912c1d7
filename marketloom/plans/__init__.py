"""Registered queries, one module per domain."""
from __future__ import annotations

import importlib
import pkgutil

from . import registry


def load():
    """Import every plan module and return (queries, oracle SQL)."""
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.ORACLE
