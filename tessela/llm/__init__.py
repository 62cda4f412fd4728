"""Operators for preparing training data; nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib
import pkgutil

from tessela.catalog import Catalog


def training_catalog() -> Catalog:
    """The queries of every module here whose name begins with ``plan_``."""
    merged = Catalog()
    for name in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("plan_")):
        merged.merge(importlib.import_module(f"{__name__}.{name}").catalog)
    return merged
