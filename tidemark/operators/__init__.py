"""Relational operators over an operation log (key, seq, kind, value)."""
