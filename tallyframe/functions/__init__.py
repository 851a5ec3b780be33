"""Column builders and shared tables."""
