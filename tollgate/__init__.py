"""tollgate: a release gate for tables, built on Spark DataFrames.

Reads a table, runs data-quality detectors as distributed queries (PII
patterns, exact and near duplicates, split leakage, conflicting labels,
class imbalance, missing provenance or license), and rolls the findings up
to BLOCK / WARN / PASS with masked, capped evidence and reproducible hashes.
"""

from .config import Limits, Release, Roles, REQUEST_LIMITS
from .plans.audit import AuditResult, audit
from .operators.prepare import prepare

__all__ = ["Limits", "Release", "Roles", "REQUEST_LIMITS", "AuditResult", "audit", "prepare"]
