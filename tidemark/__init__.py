"""A Spark-native engine for multi-version key-value data."""
