"""Spark-first analytics for bid/ask bars, market graphs and run-level statistics."""
