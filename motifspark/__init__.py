"""Labelled sub-graph counting, statistics and cardinality estimation on Spark."""
