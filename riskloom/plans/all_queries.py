"""Every registered query: importing this module loads all catalogues into the registry."""

from riskloom.plans import catalog, catalog_model  # noqa: F401  (register on import)
from riskloom.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
