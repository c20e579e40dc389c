"""Structured-log analytics on Spark."""
