"""Named queries; every module here has a ``catalog``."""

from __future__ import annotations

import importlib
import pkgutil

from tessela.catalog import Catalog


def all_plans() -> Catalog:
    catalog = Catalog()
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        catalog.merge(importlib.import_module(f"{__name__}.{m}").catalog)
    return catalog
