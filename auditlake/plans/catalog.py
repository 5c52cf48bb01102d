"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from auditlake.plans import q_audit, q_identity, q_ops, q_pages  # noqa: F401
from auditlake.plans.registry import OPERATORS, ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "OPERATORS"]
