"""Every query of the engine by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from claimspark.plans import build, discovery, enrichment, extraction, groups, matching, registries, registry_pages, scans, served, spans  # noqa: F401 - adds its queries
from claimspark.plans.queries import ORACLE, QUERIES, flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]
