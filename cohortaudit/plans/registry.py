"""All registered queries and their SQL."""

from __future__ import annotations

# Each module registers its queries when it is imported.
from cohortaudit.plans import audit_queries, cohort_queries, family_queries, join_queries, risk_queries, section_queries, store_queries  # noqa: F401
from cohortaudit.plans.book import ORACLE, QUERIES  # noqa: F401
