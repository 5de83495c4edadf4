"""All queries of the library."""

from roomflow.plans import page_queries, pipeline_queries, profile_queries, row_queries, scalar_queries, source_queries  # noqa: F401  they register themselves
from roomflow.plans.registry import COVERS, ORACLE_SQL, QUERIES  # noqa: F401
