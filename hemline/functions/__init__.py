"""Column functions: vectors, text lists, metrics."""
