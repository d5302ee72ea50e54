"""Collects every registered query and oracle statement."""

from . import catalog, catalog_interference, catalog_sources, catalog_text, catalog_jobs  # noqa: F401  (registration side effects)
from . import oracle, oracle_interference, oracle_jobs, oracle_sources, oracle_text  # noqa: F401
from .catalog import QUERIES
from .oracle import SQL

__all__ = ["QUERIES", "SQL"]
