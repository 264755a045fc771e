"""Spark-first spatial-graph analytics over 2-D and 3-D point sets."""
