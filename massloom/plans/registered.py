"""Importing this module registers every query."""
from massloom.plans import (  # noqa: F401
    q_aggregates,
    q_joins,
    q_metrics,
    q_models,
    q_ranking,
    q_rows,
    q_scores,
    q_sets,
    q_sources,
    q_streams,
)
