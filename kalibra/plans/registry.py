"""All queries of the engine by name, with their SQL."""

from kalibra.plans import inference_queries, projection_queries, relational_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (projection_queries, inference_queries, relational_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
