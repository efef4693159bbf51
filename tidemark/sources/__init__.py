"""Data files of a store."""
