"""Operators for preparing training text: screening, deduplication, mixing, encoding."""
