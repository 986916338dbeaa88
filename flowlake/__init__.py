"""Spark-first network-flow analytics."""
