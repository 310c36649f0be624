"""All queries over the driver's tables, by name, and their SQL."""

from . import execution_queries, feature_queries, market, model_queries, research_queries, run_queries  # noqa: F401  (registers)
from .base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "benchmark_net_performance"
