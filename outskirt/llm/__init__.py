"""Operators for preparing training text; see the table in the README."""
