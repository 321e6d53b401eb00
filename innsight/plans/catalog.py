"""All registered queries, as the driver contract wants them."""

from __future__ import annotations

from innsight.plans import (audit_queries, evaluate_queries, feature_queries,  # noqa: F401
                            model_queries, profile_queries, scoring_queries)
from innsight.plans.registry import REGISTRY, oracle_text


def queries():
    return {name: q.build for name, q in REGISTRY.items()}


def oracle_sql():
    out = {}
    for name, q in REGISTRY.items():
        text = oracle_text(q)
        if text is not None:
            out[name] = text
    return out
