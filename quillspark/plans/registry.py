"""All registered queries of the reference's operators and their DuckDB SQL."""

from __future__ import annotations

from quillspark.plans import profile_queries  # noqa: F401  registers its own
from quillspark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
