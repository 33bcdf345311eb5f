"""Every named query; importing a module registers its queries."""

from snaplake.plans import (  # noqa: F401
    depth_queries, filter_queries, quality_queries, score_queries, serving_queries, storage_queries, typing_queries,
)
from snaplake.plans.registry import BUILDS, SQL  # noqa: F401
