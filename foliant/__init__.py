"""Spark-first analytics for long-form documents."""
