"""The registered queries of this subpackage and, where SQL can express them, their SQL."""
from __future__ import annotations

import importlib
import pkgutil

import postern.llm as package


def _modules() -> list:
    names = sorted(m.name for m in pkgutil.iter_modules(package.__path__) if m.name.startswith("op"))
    return [importlib.import_module(f"postern.llm.{n}") for n in names]


QUERIES = {k: v for m in _modules() for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _modules() for k, v in m.ORACLE.items()}
