"""Driver-side planning: the commit manifest and the compaction picker. No Spark here."""
