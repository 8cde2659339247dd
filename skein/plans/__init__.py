"""Query plans over the test tables, one module for each family of operators."""

import importlib

MODULES: tuple[str, ...] = ("dataset", "tables", "kv", "objects", "metrics", "relational", "commits", "versions", "encodings")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
