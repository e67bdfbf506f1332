"""Importing this module registers every query."""

from polarframe.plans import feature_queries, fusion_queries, learning_queries, profile_queries, source_queries  # noqa: F401
from polarframe.plans.registry import REGISTRY  # noqa: F401
