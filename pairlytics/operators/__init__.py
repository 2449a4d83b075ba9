"""Operators over pairwise results: records, ratings, evaluation, logs."""
