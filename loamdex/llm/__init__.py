"""Operators for preparing training data. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib
import pkgutil

#: The modules of this subpackage that register queries.
MODULES = [m for m in (importlib.import_module(f"{__name__}.{x.name}") for x in sorted(pkgutil.iter_modules(__path__), key=lambda x: x.name)) if hasattr(m, "QUERIES")]
