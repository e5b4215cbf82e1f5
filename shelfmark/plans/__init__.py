"""Composite plans: the entry points a user calls."""
