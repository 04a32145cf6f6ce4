"""Operators on property graphs."""
