"""All registered queries; importing the modules fills the registry."""

from groupaudit.plans import (  # noqa: F401
    q_audits,
    q_governance,
    q_inference,
    q_joins,
    q_metrics,
    q_models,
    q_profile,
    q_projections,
    q_signals,
    q_sources,
    q_splits,
)
from groupaudit.plans.registry import QUERIES

__all__ = ["QUERIES"]
