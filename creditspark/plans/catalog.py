"""All registered queries and their SQL twins."""

from __future__ import annotations

from creditspark.plans import q_columns, q_files, q_jobs, q_model, q_profile, q_report  # noqa: F401  (they register)
from creditspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
