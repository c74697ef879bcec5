"""Every query of the engine by name, with its DuckDB oracle where SQL can express it."""

from quillon.plans import api_queries, further_queries, relational_queries, retrieval_queries, serving_queries, structure_queries  # noqa: F401  they register their queries
from quillon.plans.registry import ORACLES, QUERIES  # noqa: F401
