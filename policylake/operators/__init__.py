"""Relational operators: discovery, versions, comparison, audit, eligibility and metrics."""
