"""Column functions: key codecs and byte accounting."""
