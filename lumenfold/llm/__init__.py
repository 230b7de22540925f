"""Operators that prepare training text and reference data; nothing else in the library imports them."""
