"""All named queries."""

from . import catalog_aggs, catalog_joins, catalog_rules, catalog_scalars, catalog_sources, catalog_streams, catalog_windows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
