"""Relational operators over records: screening, components, splits, models."""
