"""Spark-first analytics for regulatory news: scoring, dedup, entity graph, verification, publishing."""
