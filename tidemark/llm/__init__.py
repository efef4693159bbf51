"""Operators for preparing training text: dedup, filters, scoring, mixing, token files.

Nothing outside this subpackage imports it.
"""
