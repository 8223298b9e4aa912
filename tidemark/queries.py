"""Every registered query of the engine and its SQL."""

from tidemark.plans import accounts, company, construction, content, controls, evidence, market, narratives, normalisation, point_in_time, reference_data, research, risk, scorecards, simulation  # noqa: F401  they register themselves
from tidemark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
