"""Trajectory folding on Spark: from message tables to bounded-context training data."""
