"""Spark-first engine for preparing and scoring conversational training data."""
