"""Spark-first evidence and configuration analytics."""
