"""All registered queries: importing the catalog modules fills the registry."""

from freightdocs.plans import catalog_documents, catalog_flow, catalog_reconcile, catalog_records, catalog_text  # noqa: F401
from freightdocs.plans.catalog import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
