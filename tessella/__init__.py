"""Spark-first analytics for large language-model response experiments."""
