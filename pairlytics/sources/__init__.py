"""Readers of input tables and adapters to the library's relations."""
