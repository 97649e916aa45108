"""Evaluation plans: dimension scores, rollups, compliance and report."""
