"""Adapters from the given tables to log events, traces and control tables."""
