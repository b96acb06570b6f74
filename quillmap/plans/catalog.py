"""All queries of the engine, by name."""

from . import q_aggregates, q_basic, q_joins, q_products, q_sources  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
