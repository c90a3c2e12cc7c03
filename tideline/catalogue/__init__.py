"""All registered queries. Importing the modules fills the registry."""

from __future__ import annotations

from importlib import import_module

from tideline.catalogue.base import ORACLES, QUERIES, Query

MODULES = ["store", "shop", "relational", "log", "health", "rules", "cdc", "series", "shape", "sources"]


def _load() -> None:
    for name in MODULES:
        import_module(f"tideline.catalogue.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
