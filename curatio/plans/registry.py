"""All registered queries and their oracle SQL (importing the catalog modules registers them)."""

from curatio.plans import catalog, catalog_io, catalog_jobs, catalog_pages, catalog_tokens  # noqa: F401
from curatio.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
