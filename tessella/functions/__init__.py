"""Column expressions: text, distributions, statistics."""
