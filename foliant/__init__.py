"""foliant: catalogue, search and reading-activity analytics on PySpark."""

from foliant.sources.catalog import Catalog, load_catalog

__all__ = ["Catalog", "load_catalog"]
