"""Structured Streaming into a store."""

from .ingest import ingest

__all__ = ["ingest"]
