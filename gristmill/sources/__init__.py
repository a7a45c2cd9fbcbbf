"""Readers for record files and adapters for tables."""
