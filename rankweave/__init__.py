"""Spark-first scoring, evaluation and data-checking engine."""
