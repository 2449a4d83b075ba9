"""Streams into tables."""
