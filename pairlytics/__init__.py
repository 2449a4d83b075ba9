"""Pairwise-results analytics on Spark."""
