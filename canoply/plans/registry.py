"""Names of the queries, each with its DuckDB counterpart."""

from . import config_queries, raster_queries

QUERIES = raster_queries.QUERIES | config_queries.QUERIES
ORACLES = raster_queries.ORACLES | config_queries.ORACLES
