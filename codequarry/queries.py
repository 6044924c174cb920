"""All queries of the core; importing a query set registers its queries."""

from codequarry.query_sets import knowledge, pipeline, scalar, search, tracking, upkeep  # noqa: F401
from codequarry.registry import QUERIES, SQL  # noqa: F401
