"""Registered queries, one module per group of operators."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__, __name__ + "."):
        if module.name.rsplit(".", 1)[1].startswith("q_"):
            importlib.import_module(module.name)
