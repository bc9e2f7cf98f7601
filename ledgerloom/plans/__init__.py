"""Whole jobs: loads, reports, quality views, reconciliation."""
