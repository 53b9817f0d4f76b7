"""Registered queries over the test tables, one module per operator family."""
from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every plan module; returns (queries, oracle SQL)."""
    from crateloom.plans import registry
    for mod in pkgutil.iter_modules(__path__):
        if mod.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{mod.name}")
    return registry.QUERIES, registry.ORACLES
