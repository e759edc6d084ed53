"""Graded-confidence analytics on Spark."""
