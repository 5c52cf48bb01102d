"""auditlake: usage, change-audit and permission-error analytics on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from built-in
Spark SQL functions, so Catalyst plans the whole chain (pushdown, pruning,
partial aggregation, broadcast decisions) and nothing is collected.
"""

from auditlake.session import build_session, ensure_utc, scratch_path

__all__ = ["build_session", "ensure_utc", "scratch_path"]
