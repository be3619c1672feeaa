"""Importing this module fills the registry."""

from panelgrid.plans import (clean_queries, grid_queries, io_queries, ml_queries,  # noqa: F401
                             panel_queries, pvalue_queries, stored_queries, study_queries,
                             summary_queries)
from panelgrid.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
